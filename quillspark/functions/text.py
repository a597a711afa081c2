"""Scalar derivations on identifiers, titles and text, as Spark columns.

The source data treats '' like NULL; every function here gives NULL for a
missing or unusable value unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, written out so that Java and RE2 read it alike.
SPACE = r"\t\n\x{000b}\f\r \x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Fixed value: what a DOI looks like inside a text.
DOI = rf"""10\.[0-9]{{4,9}}/[^{SPACE}"'<>]+"""
#: Fixed value: punctuation that a DOI picks up at its end.
DOI_TAIL = ".,;:)]}"
#: Fixed value: identifiers that stand in for a missing DOI and title, in order.
KEY_IDS = ("arxiv", "pmcid", "pmid", "openalex")


def some(value: Column) -> Column:
    """NULL for ''."""
    return F.nullif(value, F.lit(""))


def strip(text: Column) -> Column:
    """Text without white space at its ends; '' stays ''."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def slug(title: Column) -> Column:
    """Lower-case ASCII letters and digits of a title, or NULL."""
    return some(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""))


def dedup_key(doi: Column, title: Column, ids: Column) -> Column:
    """The key that links records: the DOI in lower case, else the title's slug, else 'name:value' of an identifier."""
    others = [F.concat(F.lit(f"{name}:"), some(F.element_at(ids, F.lit(name)))) for name in KEY_IDS]
    return F.coalesce(some(F.lower(doi)), slug(title), *others)


def plain_title(title: Column) -> Column:
    """A title for comparison: lower case, ASCII letters, digits and inner spaces; '' if nothing is left."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""))


def doi_in(text: Column) -> Column:
    """The first DOI in a text without trailing punctuation."""
    return some(F.rtrim(F.regexp_extract(text, DOI, 0), F.lit(DOI_TAIL)))


def doi_of_url(url: Column) -> Column:
    """A DOI without the resolver in front of it; that exact prefix only."""
    return F.regexp_replace(url, r"^https://doi\.org/", "")


def last_segment(url: Column) -> Column:
    """The last path segment of a URL."""
    return some(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1))


def pmcid_in(text: Column) -> Column:
    return some(F.regexp_extract(text, "PMC[0-9]+", 0))


def arxiv_of_doi(doi: Column) -> Column:
    """The arXiv id that an arXiv DOI holds, its case kept."""
    prefix = "10.48550/arxiv."
    return F.when(F.startswith(F.lower(doi), F.lit(prefix)), F.substr(doi, F.lit(len(prefix) + 1)))


def arxiv_of_url(url: Column) -> Column:
    return F.element_at(F.split(url, "/abs/"), -1)


def path_safe(name: Column) -> Column:
    """An identifier as a file name: never empty, never with a leading dot."""
    return F.coalesce(some(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), r"^\.+", "_")), F.lit("_"))


def without_tags(markup: Column) -> Column:
    """Text of markup: tags become spaces, also one that isn't closed; white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>?", " "), "[ \\t\\n\\f\\r]+", " "))


def restored_abstract(index: Column) -> Column:
    """Text of an inverted index MAP<word, positions>: words by position, then by themselves."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x.w), " ")


#: Versions that stand for a provider named alone.
MODEL_VERSIONS = {"claude": "claude-3.5-sonnet", "codex": "gpt-5.2-xhigh", "gemini": "gemini-3-flash-preview"}


def model_version(model: Column) -> Column:
    """What follows the first ':' of a model's name; else the version that the name stands for, else the name."""
    known = F.create_map(*(F.lit(x) for kv in MODEL_VERSIONS.items() for x in kv))
    return F.when(F.contains(model, F.lit(":")), strip(F.regexp_replace(model, r"^[^:]*:", ""))).otherwise(F.coalesce(F.element_at(known, model), model))


def model_parts(model: Column) -> Column:
    """STRUCT<provider, version, level> of 'provider:version[:level]'; a trailing word is a level too."""
    parts = F.split(model, ":", 3)
    version = F.get(parts, F.lit(1))
    words = F.split(version, " ")
    level = F.coalesce(F.get(parts, F.lit(2)), F.when(F.size(words) > 1, F.element_at(words, -1)))
    name = F.when(F.get(parts, F.lit(2)).isNull() & (F.size(words) > 1), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(version)
    return F.struct(parts[0].alias("provider"), name.alias("version"), level.alias("level"))


def first_id(doi: Column, arxiv: Column, pmcid: Column) -> Column:
    """The identifier a paper is filed under: its DOI, else arXiv id, else PMCID; '' counts as missing."""
    return F.coalesce(some(doi), some(arxiv), some(pmcid))


def case_slug(name: Column) -> Column:
    """A test's name in lower case with hyphens for spaces."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def test_id(model: Column, agent: Column, name: Column, run_id: Column) -> Column:
    """'provider_agent_slug_stamp' with the last but one part of the run id."""
    return F.concat_ws("_", F.split(model, ":")[0], agent, case_slug(name), F.try_element_at(F.split(run_id, "_"), F.lit(-2)))


def run_id(stamp: Column) -> Column:
    """'run_YYYYMMDD_HHMMSS' of a timestamp in the session's time zone, which is UTC."""
    return F.date_format(stamp, "'run_'yyyyMMdd_HHmmss")


def without_front_matter(text: Column) -> Column:
    """Text without what stands between two lines of '---' at its start."""
    return F.regexp_replace(text, r"(?s)\A---.*?---\n", "")


def filled(template: str, **values: Column) -> Column:
    """A template with '{name}' replaced by values, NULL counting as ''; other braces stay."""
    done = F.lit(template)
    for name, value in values.items():
        done = F.replace(done, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return done


def headings(markdown: Column) -> Column:
    """ARRAY of section headings of a paper, whether marked by '#' or set in bold on a line of their own."""
    marks = F.regexp_extract_all(markdown, F.lit(r"(?m)^(?:#+ +(?=\S)|(?=\*\*))(.*\S)[ \t]*$"), F.lit(1))
    return F.filter(F.transform(marks, lambda h: F.regexp_replace(h, r"^\*\*(.*)\*\*$", "$1")), lambda h: h != "")


def clipped(text: Column, most: int) -> Column:
    """The first ``most`` characters, as error bodies (500) and reports (5000) show them."""
    return F.left(text, F.lit(most))


def safe_url(url: Column, host: Column | None = None) -> Column:
    """Whether a URL is http or https with a host, and that host if one is named."""
    scheme, found = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    good = F.lower(scheme).isin("http", "https") & (found != "")
    return F.coalesce(good if host is None else good & (F.lower(found) == F.lower(host)), F.lit(False))


def lenient_int(value: Column) -> Column:
    """An integer, or NULL for anything that isn't one."""
    return value.try_cast("int")


def list_items(text: Column) -> Column:
    """Items of a comma list, blank ones and an unpadded 'none' dropped, the rest trimmed."""
    return F.transform(F.filter(F.split(text, ","), lambda v: (F.trim(v) != "") & (F.lower(v) != "none")), lambda v: F.trim(v))


def number_after(text: Column, label: str) -> Column:
    """The integer after 'label:' or 'label =', asterisks and backticks between allowed; 0 if there is none."""
    return F.coalesce(some(F.regexp_extract(text, rf"{label}[*`]*\s*[:=]\s*([0-9]+)", 1)).try_cast("int"), F.lit(0))
