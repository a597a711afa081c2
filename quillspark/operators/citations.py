"""Verification of bibliographies: resolution, title comparison, retraction with three values, verdicts, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import similarity
from ..functions.text import doi_in, plain_title, some

#: Fixed value: least similarity of two titles that match without containing one another.
SIMILAR = 0.85


def contained(a: Column, b: Column) -> Column:
    """Whether one comparable title lies within the other; empty titles match nothing."""
    x, y = plain_title(a), plain_title(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def titles_match(a: Column, b: Column) -> Column:
    """Contained, or similar; the comparison letter by letter gets text only where containment fails and both titles
    have some."""
    x, y = plain_title(a), plain_title(b)
    asked = (x != "") & (y != "") & ~contained(a, b)
    return contained(a, b) | F.coalesce(F.when(asked, similarity(F.when(asked, x), F.when(asked, y))) >= SIMILAR, F.lit(False))


def _one_each(works: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """The first row, by ``ord``, of each value of a key."""
    return works.where(key.isNotNull()).groupBy(key.alias("_k")).agg(F.min_by(F.struct(*fields), "ord").alias("_w"))


def _missing(df: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def resolve(claims: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Claims (..., doi) with matched_title, source, hit_doi, hit_pmid, hit_retracted: by DOI in ``first``, else in ``second``.

    Sides: (doi, matched_title, ord) and, if they have them, pmid and retracted; the
    second never says that a work is retracted.  Each side is reduced to one row a
    DOI, so a claim keeps one row; a claim without DOI finds nothing.
    """
    fields = ["doi", "matched_title", "pmid", "retracted"]
    sides = [_one_each(_missing(s, pmid="string", retracted="boolean"), F.lower(some(F.col("doi"))), fields) for s in (first, second)]
    c = claims.withColumn("_k", F.lower(some(F.col("doi"))))
    c = c.join(sides[0].withColumnRenamed("_w", "_a"), "_k", "left").join(sides[1].withColumnRenamed("_w", "_b"), "_k", "left")
    hit = F.coalesce("_a", "_b")
    source = F.when(F.col("_a").isNotNull(), "openalex").when(F.col("_b").isNotNull(), "epmc")
    retracted = F.coalesce(F.col("_a.retracted"), F.lit(False))
    return c.withColumns({"source": source, "matched_title": hit["matched_title"], "hit_doi": hit["doi"], "hit_pmid": some(hit["pmid"]), "hit_retracted": retracted}).drop("_k", "_a", "_b")


def _words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain_title(title), " "), lambda w: w != ""))


def resolve_titles(claims: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """Claims (key, title, ...) with the work that a search for their title puts first, if the titles match.

    A work is found if it has all words of the claimed title; of several the one
    with the fewest words, then the least ``ord``, comes first.  Candidates meet at
    the rarest word of the claim, so common words don't multiply them.  Claims
    without words, and those none is found for, get NULLs.  Columns as :func:`resolve`.
    """
    kept = _missing(works, pmid="string", retracted="boolean").where("matched_title <> ''").withColumn("_have", _words(F.col("matched_title")))
    tokens = kept.select("ord", F.explode("_have").alias("_t"))
    counts = tokens.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    asked = claims.select(key, _words(F.col("title")).alias("_want")).where("size(_want) > 0")
    rare = asked.select(key, F.size("_want").alias("_size"), F.explode("_want").alias("_t")).join(counts, "_t").groupBy(key).agg(
        F.count(F.lit(1)).alias("_seen"), F.any_value("_size").alias("_size"), F.min(F.struct("_n", "_t")).alias("_r")
    )
    rare = rare.where("_seen = _size").select(key, F.col("_r._t").alias("_t"))
    met = rare.join(tokens, "_t").join(asked, key).join(kept, "ord").where(F.size(F.array_except("_want", "_have")) == 0)
    top = met.groupBy(key).agg(F.min_by(F.struct("doi", "matched_title", "pmid", "retracted"), F.struct(F.size("_have"), "ord")).alias("_w"))
    found = claims.join(top, key, "left")
    good = F.col("_w").isNotNull() & titles_match(F.col("title"), F.col("_w.matched_title"))
    found = found.withColumn("_w", F.when(good, F.col("_w")))
    return found.withColumns(
        {
            "source": F.when(F.col("_w").isNotNull(), "openalex"), "matched_title": F.col("_w.matched_title"), "hit_doi": some(F.col("_w.doi")), "hit_pmid": some(F.col("_w.pmid")),
            "hit_retracted": F.coalesce("_w.retracted", F.lit(False)),
        }
    ).drop("_w")


def crossref_verdicts(hits: DataFrame, notices: DataFrame) -> DataFrame:
    """``hits`` (..., hit_doi) with crossref: whether a retraction notice (updates) points at the DOI.

    NULL where nothing can be asked: without a DOI, and with one that holds a
    comma, which would split the service's filter.
    """
    known = notices.select(F.lower(some(F.col("updates"))).alias("_d")).where("_d is not null").distinct().withColumn("_n", F.lit(True))
    doi = some(F.col("hit_doi"))
    joined = hits.withColumn("_d", F.lower(doi)).join(known, "_d", "left")
    return joined.withColumn("crossref", F.when(doi.isNotNull() & ~F.contains(doi, F.lit(",")), F.coalesce("_n", F.lit(False)))).drop("_d", "_n")


def marked_retracted(pub_types: Column, corrections: Column) -> Column:
    """Whether a publication type says retracted or a correction is a 'retraction in'; NULL lists say nothing."""
    types = F.exists(F.coalesce(pub_types, F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit("retracted")))
    fixes = F.exists(F.coalesce(corrections, F.array().cast("array<struct<type:string>>")), lambda c: F.lower(F.coalesce(c["type"], F.lit(""))) == "retraction in")
    return F.coalesce(types, F.lit(False)) | F.coalesce(fixes, F.lit(False))


def europepmc_verdicts(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """``hits`` (..., hit_pmid) with europepmc: what the first article (pmid, pub_types, corrections, ord) of the id says; NULL if there is none."""
    says = articles.where("pmid <> ''").groupBy(F.col("pmid").alias("_p")).agg(F.min_by(marked_retracted(F.col("pub_types"), F.col("corrections")), "ord").alias("europepmc"))
    return hits.withColumn("_p", some(F.col("hit_pmid"))).join(says, "_p", "left").drop("_p")


def verify(claims: DataFrame, first: DataFrame, second: DataFrame, notices: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """(key, status, doi, matched_title, source, retraction_checked, retraction_source) of claims (key, doi, title).

    A claim with a DOI is looked up by the DOI alone, one without by its title in
    the first source; one with neither is not found.  Then come the retraction
    ladder and the verdict.
    """
    c = claims.select(key, some(F.col("doi")).alias("doi"), some(F.col("title")).alias("title"))
    hits = resolve(c.where("doi is not null"), first, second).unionByName(resolve_titles(c.where("doi is null"), first, key))
    judged = europepmc_verdicts(crossref_verdicts(hits, notices), articles)
    state = retraction(F.col("hit_retracted"), F.when(~F.col("hit_retracted"), F.col("crossref")), F.when(~F.col("hit_retracted") & ~F.coalesce("crossref", F.lit(False)), F.col("europepmc")))
    full = judged.withColumn("_s", F.when(F.col("source").isNotNull(), state))
    status = verdict(F.col("doi"), F.col("title"), F.col("source").isNotNull(), F.col("matched_title"), F.coalesce("_s.retracted", F.lit(False)), titles_match(F.col("title"), F.col("matched_title")))
    return full.select(
        key, status.alias("status"), F.coalesce("hit_doi", "doi").alias("doi"), "matched_title", "source",
        F.coalesce("_s.checked", F.lit(False)).alias("retraction_checked"), F.col("_s.source").alias("retraction_source"),
    )


def retraction(openalex: Column, crossref: Column, europepmc: Column) -> Column:
    """STRUCT<retracted, checked, source> of three verdicts, NULL where a source couldn't be asked.

    The first source alone can convict but not clear.  Any conviction wins and
    names its source; otherwise the sources that cleared are joined by '+'; if
    none could be asked the state is unchecked, never clean.
    """
    cleared = F.concat_ws("+", F.when(crossref.isNotNull(), "crossref"), F.when(europepmc.isNotNull(), "europepmc"))
    convicted = F.when(openalex, "openalex").when(crossref, "crossref").when(europepmc, "europepmc")
    asked = crossref.isNotNull() | europepmc.isNotNull()
    return F.struct(
        convicted.isNotNull().alias("retracted"),
        (convicted.isNotNull() | asked).alias("checked"),
        F.coalesce(convicted, some(cleared)).alias("source"),
    )


def verdict(doi: Column, title: Column, found: Column, matched_title: Column, retracted: Column, matches: Column) -> Column:
    """verified, mismatched, not_found or retracted.

    A claim that has a DOI is judged by the DOI alone; its title can only be
    contradicted where both titles exist and the claimed one holds no DOI.
    """
    contradicted = some(doi).isNotNull() & some(title).isNotNull() & doi_in(title).isNull() & some(matched_title).isNotNull() & ~matches
    return F.when(~found, "not_found").when(retracted, "retracted").when(contradicted, "mismatched").otherwise("verified")


def report(results: DataFrame) -> DataFrame:
    """One row: the four counts, zero-filled; verified but unchecked ones; and whether all are verified."""
    is_ = lambda s: F.col("status") == s
    counts = [F.count_if(is_(s)).alias(s) for s in ("verified", "mismatched", "not_found", "retracted")]
    return results.agg(
        F.count(F.lit(1)).alias("total"), *counts, F.count_if(is_("verified") & ~F.col("checked")).alias("unchecked"), (F.count_if(is_("verified")) == F.count(F.lit(1))).alias("passes")
    )
