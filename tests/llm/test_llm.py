import datetime as dt
import random
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import encoding, lookalikes, packing, quality, scans, titles
from quillspark.llm.components import connected
from quillspark.llm.history import History, Neighbourhood, close_by, one_each, plain_doi, repeats
from quillspark.llm.linkage import PLAIN, agreement_by_chance, calibration, match
from quillspark.llm.survivors import key_year, survivor_fields, survivors

CORPUS = (
    "rec_id bigint, workspace string, batch_no int, key string, ids map<string,string>, title string, year int, cited_by bigint, found_via string, "
    "screening struct<status:string,stage:string,reason:string>, seen_at timestamp, loaded_at timestamp, extra string"
)


def at(day):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=day)


def corpus(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def rec(i, ws="w", batch=1, key="k", ids=None, title=None, year=None, cited=None, via=None, status=None, stage=None, seen=0):
    return (i, ws, batch, key, ids or {}, title, year, cited, via, (status, stage, None), at(seen) if seen is not None else None, at(400), "x")


# Problem 1


def test_survivor_fields(spark):
    rows = [
        rec(1, year=2012, cited=5, via="OpenAlex + EPMC", status="included", stage="title_abstract", seen=1),
        rec(2, year=2021, cited=9_999_999, via="openalex", status="Exclude ", stage="full_text", seen=5),
        rec(3, year=2021, cited=7, via="snowball :refs", status="maybe", seen=9),
        rec(4, year=9999, cited=0, via=None, seen=20),
        rec(5, key="single", year=2000),
        rec(6, key=None, year=2000),
        rec(7, key="none", year=0, cited=-1, via="", status="pending", seen=None),
        rec(8, key="none", year=None, cited=None, via=" + ", seen=None),
    ]
    got = {(r.key, r.field): r.value for r in survivor_fields(corpus(spark, rows)).collect()}
    assert got == {("k", "year"): "2021", ("k", "cited_by"): "7", ("k", "found_via"): "epmc+openalex+snowball:refs", ("k", "screening"): "excluded"}


def test_copies_vote_once_and_late_rows_dont_win(spark):
    rows = [rec(1, year=2001, via="openalex", seen=10)] + [rec(i, year=2000, via="openalex", seen=5) for i in range(2, 6)] + [rec(9, year=2001, via="epmc", seen=6)]
    r = survivors(corpus(spark, rows)).first()
    assert r.year == 2001 and r.n_rows == 6
    rows = [rec(1, cited=9, status="included", seen=50), rec(2, cited=3, status="excluded", seen=2)]
    r = survivors(corpus(spark, rows)).first()
    assert (r.cited_by, r.screening) == (9, "included")


def test_survivors_of_nothing_and_zero_counts(spark):
    assert survivors(corpus(spark, [])).count() == 0
    assert survivors(corpus(spark, [rec(1, cited=0), rec(2, cited=None)])).first().cited_by == 0


def test_key_year(spark):
    df = spark.createDataFrame([("10.1/jse.2014.123",), ("10.1/s99(07)abn",), ("title2014",)], "k string")
    assert [r.y for r in df.select(key_year(F.col("k")).alias("y")).collect()] == [2014, 2007, None]


# Problem 2


def page_rows(spark):
    prose = [
        "the committee asked for a clearer account of consent and storage",
        "the committee asked for a longer account of training and storage",
        "several interviewees described the training and the account of consent",
        "records were excluded when the population did not match the protocol of care",
        "long-term records of the protocol were excluded when the long-term population grew",
    ]
    pages = []
    for p in range(40):
        body = [prose[(p + k) % 5] for k in range(12)]
        pages.append((p, f"path{p // 2}", p % 2 + 1, "\n".join(["Journal of Things, vol. 3", *body, f"Page {p} of 80"])))
    text = "Journal of Things, vol. 3\nthe cornmittee asked for a clearer account of con-\nsent and storage of population 1O4 data in\nthe proto\ncol was clear and long-\nterm account\n\nPage 9 of 80"
    pages += [(100, "bad", 1, text), (101, "bad", 2, None), (102, "other", 1, ""), (103, "other", 2, " \n ")]
    return spark.createDataFrame(pages, "page_id bigint, path string, page_no int, text string")


def test_scans(spark):
    kinds, repaired = scans.repairs(page_rows(spark))
    got = {(r.line_no, r.kind) for r in kinds.where("page_id = 100").collect()}
    assert got == {(1, "furniture"), (8, "furniture"), (2, "misread"), (2, "split"), (3, "misread"), (4, "split")}
    assert {r.line_no for r in kinds.where("page_id = 3").collect()} == {1, 14}
    texts = {r.path: r.text for r in scans.documents(repaired).collect()}
    assert texts["bad"] == "the committee asked for a clearer account of consent and storage of population 104 data in the protocol was clear and long-term account"
    assert texts["other"] == ""


def test_scan_parts():
    lex = scans.Lexicon({w: 100 for w in ("account", "protocol", "term", "long", "long-term", "the", "committee", "modern", "could")}, {"(ould": [("could", None)]})
    assert scans.cut_word("proto-", "col", lex) and scans.cut_word("proto", "col", lex)
    assert not scans.cut_word("long-", "term", lex) and not scans.cut_word("the", "account", lex)
    assert scans.cut_word("Zubra\xad", "nofu", lex) and not scans.cut_word("", "x", lex)
    assert scans.slips("committee", "cornmittee") == 1 and scans.slips("modern", "modem") == 1 and scans.slips("of", "on") is None
    assert scans.plausible("the", "tbc") and not scans.plausible("it", "lf") and not scans.plausible("the", "the")
    assert all(scans.strokes(a) == scans.strokes(b) for a, b in scans.GLYPHS)
    assert scans.mended("(ould", [], lex) == ("could", True) and scans.mended("(S2)", [], lex)[0] == "(52)"
    assert scans.mended("(2O12),", [], lex) == ("(2012),", True) and scans.mended("Zub0ta", [], lex) == ("Zubota", True)
    assert scans.headed("Slow Evidence    12") and scans.headed("l2   Slow Evidence") and not scans.headed("    Slow evidence") and not scans.headed("a    b    c")
    assert scans.misread_number("1O4") and scans.misread_number("2Z)") and not scans.misread_number("CO2") and not scans.misread_number("14th")
    assert scans.page_number("- ii -") and scans.page_number("[12]") and not scans.page_number("185).") and not scans.page_number("[15].")
    assert scans.mask("Journal of Data, vol. 12 (2O3)") == scans.mask("Journa1 of Data, vol. 7 (4)")


def test_misreadings_that_recur_are_found(spark):
    lines = [f"{k} the committee asked for a clearer account of storage" for k in range(120)]
    lines += [f"{k} the cornmittee asked for a clearer account of storage" for k in range(120, 127)]
    pages = spark.createDataFrame([(p, "a", p + 1, "\n".join(lines[p::10])) for p in range(10)], "page_id bigint, path string, page_no int, text string")
    kinds, repaired = scans.repairs(pages)
    got = {(r.page_id, r.line_no) for r in kinds.where("kind = 'misread'").collect()}
    assert got == {(k % 10, k // 10 + 1) for k in range(120, 127)}
    assert "cornmittee" not in scans.documents(repaired).first().text


def test_vectors_decide(spark):
    """A word that looks like another but stands among other words keeps its spelling; removing the vectors loses links."""
    lines = [f"{k} we had a long talk about data" for k in range(25)] + [f"{k} some very bad weather hit farms" for k in range(6)]
    lines += ["9 some bad news about data", "8 wc had a long talk about data"]
    pages = spark.createDataFrame([(1, "a", 1, "\n".join(lines))], "page_id bigint, path string, page_no int, text string")
    found = lambda how: {r.line_no for r in scans.repairs(pages, how)[0].where("kind = 'misread'").collect()}
    assert found(scans.Scan()) == {33}
    assert found(scans.Scan(close=2.0)) == set()


def test_words_cut_between_pages(spark):
    body = "the committee asked for a clearer account of consent"
    rows = [(1, "a", 1, "\n".join([body] * 8) + "\nstorage and com-"), (2, "a", 2, "\n" * 20 + "mittee\nheard it"), (3, "b", 1, ""), (4, "b", 2, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, path string, page_no int, text string")
    kinds, repaired = scans.repairs(pages)
    assert [(r.page_id, r.line_no, r.kind) for r in kinds.where("kind = 'split'").collect()] == [(1, 9, "split")]
    texts = {r.path: r.text for r in scans.documents(repaired).collect()}
    assert texts["a"].endswith("consent storage and committee heard it") and texts["b"] == ""


def test_misreadings_at_line_ends_are_found(spark):
    lines = [f"{k} all of the committee asked for a clearer account of storage" for k in range(60)]
    lines += ["cornmittee asked for a clearer account of the committee", "storage and a clearer account of the accounf", "cornmiftee", "Zubranofu asked for storage"]
    pages = spark.createDataFrame([(1, "a", 1, "\n".join(lines))], "page_id bigint, path string, page_no int, text string")
    kinds, repaired = scans.repairs(pages)
    assert {r.line_no for r in kinds.where("kind = 'misread'").collect()} == {61, 62, 63}
    text = scans.documents(repaired).first().text
    assert text.endswith("committee asked for a clearer account of the committee storage and a clearer account of the account committee Zubranofu asked for storage")


# Problem 3


def works(seed=3, n=60):
    random.seed(seed)
    names = ["".join(random.choice("bdfgklmnprstvz") + random.choice("aeiou") for _ in range(4)) for _ in range(n)]
    rows, i = [], 0
    for w, name in enumerate(names):
        title = f"Effects of water treatment on seedling growth in {random.choice(['small farms', 'urban parks'])}: the {name} study"
        ids = {"doi": f"10.1234/abc.2014.{10000 + w}", "openalex": f"W{w}", "pmid": str(w), "arxiv": f"1402.{w:05d}v1"}
        for k in range(random.randint(1, 4)):
            i += 1
            own = dict(random.sample(sorted(ids.items()), 2))
            noisy = {0: title, 1: title.upper(), 2: title.replace("seedling", "seedlng"), 3: f"The {title}."}[k]
            rows.append((w, rec(i, ws=f"w{w % 2}", batch=random.randint(1, 6), key=f"key {w} {k}", ids=own, title=noisy)))
        if w % 9 == 0:
            i += 1
            rows.append((f"c{w}", rec(i, ws=f"w{w % 2}", batch=2, key=f"c {w}", ids={"doi": f"10.1234/corr.{w}"}, title=f"Correction to: {title}")))
    return rows


def truth(rows):
    groups = defaultdict(list)
    for w, r in rows:
        groups[w, r[1]].append((r[2], r[0]))
    return {(x[1], min(g)[1]) for g in groups.values() for x in g if x != min(g)}


@pytest.mark.parametrize("epochs", [[(None, None)], [(None, 3), (3, None)], [(None, 2), (2, 3), (3, 4), (4, 5), (5, None)]])
def test_repeats_dont_depend_on_epochs(spark, epochs):
    rows = works()
    got = repeats(corpus(spark, [r for _, r in rows]), epochs, Neighbourhood(runs=3))
    assert {(r.rec_id, r.accepted) for r in got.collect()} == truth(rows)


def test_history_is_reopened_and_read_in_part(spark, tmp_path):
    """Another session goes on; a batch of one workspace reads a part of the files; the result is that of one load."""
    rows = [(w, (r[0], f"ws {r[0] % 40}", *r[2:])) for w, r in works(n=150)]
    by_batch = lambda lo, hi: corpus(spark, [r for _, r in rows if lo <= r[2] < hi])
    for lo, hi in ((1, 3), (3, 5)):
        History(spark, Neighbourhood(runs=9, files=8), str(tmp_path / "h")).ingest(by_batch(lo, hi))
    last = History(spark, Neighbourhood(runs=9, files=8), str(tmp_path / "h"))
    assert len(last.state["runs"]) == 2 and last.version == 2
    last.ingest(by_batch(5, 9).where("workspace = 'ws 7'"))
    read, there = last.touched
    assert 0 < read <= there / 2
    last.ingest(by_batch(5, 9).where("workspace <> 'ws 7'"))
    last.compact()
    assert len(last.state["runs"]) == 1
    again = History(spark, Neighbourhood(), str(tmp_path / "h")).accepted()
    whole = History(spark)
    whole.ingest(corpus(spark, [r for _, r in rows]))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in whole.accepted().collect()}


def test_window_finds_slips_wherever_they_are(spark):
    """The share of slips found by the sorted windows alone, by the place of the slip, in one workspace of similar titles.

    Slips are in content words: one in a function word makes a content word of it."""
    random.seed(4)
    stem = ["effects of water on crop yield", "a study of sleep and memory", "trends in public transport use"]
    titles_ = [f"{random.choice(stem)} in the {''.join(random.choice('bdfgklmnprstvz') + random.choice('aeiou') for _ in range(4))} region after {random.choice(['ten', 'two', 'six'])} {random.choice(['dry', 'wet', 'cold'])} years" for _ in range(400)]
    rows, slips = [], {}
    for k, t in enumerate(titles_):
        rows.append(rec(2 * k, key=f"a {k}", ids={}, title=t))
        spot = random.choice([k for k in range(len(t)) if t[k] != " " and t[: k + 1].rsplit(" ", 1)[-1][:-1] + t[k:].split(" ", 1)[0] not in titles.FUNCTION_WORDS])
        rows.append(rec(2 * k + 1, key=f"b {k}", ids={}, title=t[:spot] + t[spot + 1 :]))
        slips[2 * k + 1] = spot / len(t)
    got = {r.rec_id for r in repeats(corpus(spark, rows), [(None, None)]).collect()}
    for part in range(4):
        here = [i for i, spot in slips.items() if part / 4 <= spot < (part + 1) / 4]
        assert sum(i in got for i in here) >= 0.9 * len(here)


def test_windows_against_brute_force():
    """Columns at once find the pairs that comparing row by row finds."""
    random.seed(1)
    title = lambda: " ".join(random.choice(["aé", "ab", "abc", "x"]) for _ in range(random.randint(1, 5)))
    for size in (1, 2, 9, 100):
        rows = sorted((random.randint(0, 3), title(), n, random.random() < 0.3, 0) for n in range(size))
        merged = {}
        for block, text, n, new, _ in rows:
            least, any_new = merged.get((block, text), (n, new))
            merged[block, text] = (min(least, n), any_new or new)
        flat = [(*key, *value) for key, value in merged.items()]
        close = lambda s, t: t.startswith(s) or abs(len(s) - len(t)) <= 3 and s.count(" ") == t.count(" ")
        want = {(a[2], b[2]) for k, a in enumerate(flat) for b in flat[k + 1 : k + 5] if a[0] == b[0] and (a[3] or b[3]) and close(a[1], b[1])}
        table = one_each(pa.table(list(map(list, zip(*rows, strict=True))), ["block", "title", "ord", "new", "place"]))
        i, j = close_by(table, 0, table.num_rows, 4, 3)
        order = table["ord"].to_pylist()
        assert {(order[a], order[b]) for a, b in zip(i, j, strict=True)} == want


def test_repeats_edge_cases(spark):
    assert repeats(corpus(spark, []), [(None, None)]).count() == 0
    same = rec(1, key="10.1/x", title="Preface", ids={"doi": "10.1234/a1"})
    rows = [same, rec(2, key="preface", title="Preface", ids={"doi": "10.1234/b2"}), rec(3, key=None, ids={"doi": "10.1234/a1"}), rec(4, ws=None, ids={"doi": "10.1234/a1"}), rec(5, key="pmid:7", ids={"pmid": "7"}), rec(6, key="x", batch=None, title="", ids={"pmid": "7"})]
    rows += [rec(i, key="hot", ids={"pmid": "hot"}, title=None) for i in range(10, 200)]
    got = {(r.rec_id, r.accepted) for r in repeats(corpus(spark, rows), [(None, None)]).collect()}
    assert got == {(6, 5)} | {(i, 10) for i in range(11, 200)}


@pytest.mark.parametrize("text", ["10.1234/ABC", "https://doi.org/10.1234/abc", "doi:10.1234/abc.", "10.1234/abc/full", "1o.1234/abc", "10.1234//abc", "10.1234%2fabc", "10.1234/abc?src=list", "10.1234/abc)", "10.1234/abc.v1", "10.1234/abc#sec1;"])
def test_plain_doi(text):
    assert plain_doi(text) == "10.1234/abc"


def test_plain_doi_keeps_brackets_and_parts():
    assert plain_doi("10.1/x") is None and plain_doi(None) is None
    assert plain_doi("10.9901/s2345(19)abn") == "10.9901/s2345(19)abn" and plain_doi("10.9901/x/part2") == "10.9901/x/part2"


def test_components_against_brute_force(spark):
    random.seed(5)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, None), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Problem 4


def test_match(spark):
    rows = works(seed=8, n=80)
    year = lambda w: 1960 + int(str(w).strip("c")) * 37 % 60
    left = [(r[0], r[5], year(w)) for w, r in rows if r[0] % 2]
    left += [(9001, "Preface", 2014), (9002, None, None), (9003, "", 2000)]
    right = [(r[0], r[5], year(w) if r[0] % 7 else None) for w, r in rows] + [(9101, "Preface", 2014), (9102, None, None)]
    kind = "id bigint, title string, year int"
    got = {(r.left_id, r.right_id): r.confidence for r in match(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect()}
    work = {r[0]: w for w, r in rows}
    want = {(a, b) for a, *_ in left if a < 9000 for b in work if work[a] == work[b]}
    assert set(got) == want and all(0.5 <= c <= 1 for c in got.values())


def test_titles_without_distinctive_words_meet_all_others(spark):
    """Every word is common, and the shortened titles lack the rarest words of the whole ones, so that no key brings them together."""
    random.seed(6)
    names = ["".join(random.choice("bdfgklmnprstvz") + random.choice("aeiou") for _ in range(4)) for _ in range(40)]
    whole = [random.sample(names, 9) for _ in range(40)]
    n = {w: sum(w in t for t in whole) for w in names}
    short = [[w for w in t if w in sorted(t, key=lambda w: (n[w], w))[4:]] for t in whole]
    assert min(n.values()) > 4
    kind = "id bigint, title string, year int"
    left, right = (spark.createDataFrame([(i, " ".join(t), 1960 + i * 37 % 60) for i, t in enumerate(ts)], kind) for ts in (whole, short))
    assert {(r.left_id, r.right_id, r.found_by) for r in match(left, right).collect()} >= {(i, i, "all") for i in range(40)}
    assert {(r.left_id, r.right_id) for r in match(right, left).collect()} >= {(i, i) for i in range(40)}


def test_match_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, title string, year int")
    assert match(none, none).count() == 0


def test_titles():
    a = titles.read("Reconsidering β-carotene intake as a driver of crop yield: lessons from Zubrani and two other sites")
    b = titles.read("[Lessons from Zubrani &amp; two other sites: reconsidering beta-carotene intake as a driver of crop yield (preprint)].")
    assert sorted(a.words) == sorted(b.words) and a.marker == b.marker == ""
    for text, marker in (("X y z - second wave", "wave 2"), ("X y z (Part II)", "part 2"), ("Correction to: X y z", "correction"), ("X y z in women", "in women"), ("X y z, 2015", "year 2015"), ("X y z: Volume 3", "volume 3")):
        assert titles.read(text).marker == marker
    assert titles.read(None).words == () and titles.read("...").words == ()
    assert titles.vector(("abc", "def")) == titles.vector(("def", "abc")) != titles.vector(("abd", "def"))


def test_calibration_is_monotone():
    curve = calibration([(0.7, 100, 15), (0.8, 100, 40), (0.75, 50, 30), (1.0, 500, 480)], 0.15)
    values = [v for _, v in curve]
    assert values == sorted(values) and values[0] == 0 and values[-1] == 1
    assert calibration([], 0.15) == PLAIN and calibration([(0.7, 100, 90), (1.0, 100, 95)], 0.9) == PLAIN
    assert agreement_by_chance({2000: 1, 2010: 1}, {2001: 1, 2005: 1}) == 0.25 and agreement_by_chance({}, {2000: 1}) == 1


# Problem 5


def test_forms(spark):
    same = ["Café-style help", "Café-style help", "Café‑style help", "Cаfé-style he​lp", "Ｃａｆé-style  help", " Café-style help­"]
    other = ["Cafe-style help", "café-style help", "Café-style help.", "Café–style help"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*same, *other, None, "", " "])], "i int, t string")
    forms = {r.i: r.form for r in lookalikes.with_form(df, "t").collect()}
    assert len({forms[i] for i in range(6)}) == 1 and len({forms[i] for i in range(10)}) == 5
    assert (forms[10], forms[11], forms[12]) == (None, "", "")
    words = spark.createDataFrame([("Влияние воды",), ("I² ﬁne Ⅱ",), ("x" * 100_000 + "​",)], "t string")
    assert [r.form[:20] for r in lookalikes.with_form(words, "t").collect()] == ["Влияние воды", "I² fine II", "x" * 20]


def test_same_look(spark):
    left = spark.createDataFrame([(1, "w", "A b"), (2, "w", "A b"), (3, "v", "A b"), (4, None, "A b"), (5, "w", None), (6, "w", "A b")], "cite_id bigint, workspace string, title string")
    right = spark.createDataFrame([(10, "w", "A b"), (11, "w", "А b"), (12, "w", "a b"), (13, "w", "A b")], "rec_id bigint, workspace string, title string")
    got = {(r.cite_id, r.rec_id) for r in lookalikes.same_look(left, right, "cite_id", "rec_id", "workspace", "title").collect()}
    assert got == {(1, 11), (2, 10), (2, 11), (2, 13), (6, 10), (6, 11), (6, 13)}
    assert lookalikes.same_look(left.limit(0), right, "cite_id", "rec_id", "workspace", "title").count() == 0


# Problem 6

TEXTS = ["It's the 'tis  of\n\n 12 ab1c!!", "", None, " ", "<|endoftext|> naïve Ünï 漢字 \U0001f600‍", "a" * 3000, "\r\n\t x y　z", "the the the " * 500]


def test_encode_against_the_tokenizer_and_back(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string")
    ids = encoding.encode(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: whole.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in encoding.decode(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoding.encode(df.limit(0)).count() == 0


# Problem 7


def test_packing(spark):
    random.seed(2)
    sizes = [(i, random.choice([0, 30, 100, 250, 300, 511, 512, 513, 5000, random.randint(1, 512)])) for i in range(400)] + [(1000, None)]
    packs = spark.createDataFrame([(1, 512), (2, 2048), (3, 0)], "pack int, capacity int")
    df = spark.createDataFrame(sizes, "doc bigint, n_tokens bigint")
    how = packing.Evolution(shard_items=100, shard_bins=40)
    rows = packing.pack(df, packs, how).collect()
    for number, capacity in ((1, 512), (2, 2048)):
        mine = [r for r in rows if r.pack == number]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            fill[r.bin] += r.size
            pieces[r.doc].append((r.start, r.size))
        total = sum(n or 0 for _, n in sizes)
        assert max(fill.values()) <= capacity and sum(fill.values()) == total
        for doc, n in sizes:
            n = n or 0
            cover = sorted(pieces[doc])
            assert sum(s for _, s in cover) == n and len(cover) == max(1, -(-n // capacity))
            assert all(a + s == b for (a, s), (b, _) in zip(cover, cover[1:], strict=False))
        assert len([b for b in fill.values() if b]) <= 1.06 * -(-total // capacity)
    assert rows == packing.pack(df, packs, how).collect() or set(rows) == set(packing.pack(df, packs, how).collect())
    assert packing.pack(df.limit(0), packs, how).count() == 0


def test_packing_takes_every_capacity(spark):
    packs = spark.createDataFrame([(i, 7) for i in range(1200)], "pack int, capacity int")
    df = spark.createDataFrame([(1, 12)], "doc bigint, n_tokens bigint")
    rows = packing.pack(df, packs, packing.Evolution(islands=1, epochs=1, rounds=1)).collect()
    assert sorted((r.pack, r.start, r.size) for r in rows) == [(i, start, size) for i in range(1200) for start, size in ((0, 7), (7, 5))]


# Problem 8


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\r\n- one\n- one\n\n| a | b |"), (2, None), (3, ""), (4, " \n ")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in quality.statistics(df).collect()}
    assert (r[1].words, r[1].lines, r[1].ended_lines, r[1].marked_lines, r[1].repeated_lines) == (7, 4, 0.25, 0.75, 0.25)
    for k in (2, 3, 4):
        assert all(r[k][f] == 0 or f in ("words_per_stop", "longest_run_ratio") for f in quality.FEATURES)


def test_induce_finds_a_rule():
    random.seed(1)
    x = pd.DataFrame({"a": [random.random() for _ in range(600)], "b": [random.random() for _ in range(600)]})
    y = ((x.a > 0.7) & (x.b <= 0.5)).to_numpy()
    rules = quality.induce(x, y)
    got = sum((r.holds(x) for r in rules[1:]), rules[0].holds(x)) > 0
    assert (got == y).mean() > 0.97
    assert quality.induce(x, y & False) == [] and quality.case_sql([]) == "0" and quality.induce(x[:0], y[:0]) == []


def test_junk_on_held_out_documents(spark):
    random.seed(4)
    words = "the study of water and seedlings in farms was repeated with all the records that we had from two sites".split()
    prose = lambda: " ".join(" ".join(random.sample(words, 14)).capitalize() + "." for _ in range(random.randint(2, 9)))
    rows = lambda: "\n".join(f"- {random.choice(['crop yield', 'bone density', 'soil'])}" for _ in range(random.randint(6, 20)))
    cells = lambda: "\n".join(f"farm\t{random.random():.3f}\t{random.randint(1, 99)}" for _ in range(random.randint(5, 20)))
    docs = [(i, (prose, prose, rows, cells)[i % 4]()) for i in range(600)] + [(900, None), (901, ""), (902, "  "), (903, prose() + "\n" + "- soil\n- water")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rules = quality.learn(df.where("doc_id < 400"))
    got = {r.doc_id for r in quality.junk(df, rules=rules).collect()}
    assert not got & {900, 901, 902, 903}
    assert sum((i in got) == (i % 4 > 1) for i in range(600)) >= 585


def test_queries_run(spark):
    from quillspark.llm.queries import ORACLE, QUERIES

    for name, query in QUERIES.items():
        if name.startswith(("p1", "p5", "p6", "p8_s")):
            assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert set(ORACLE) <= set(QUERIES)
