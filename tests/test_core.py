import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markup, text
from quillspark.operators import citations, corpus, graph, prose, scores, search
from quillspark.sources import records

RECORD = records.RECORD


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("doi", "title", "ids", "key"),
    [
        (None, None, {"openalex": "W77", "pmid": "31"}, "pmid:31"),
        ("", "Ünder Öther: skies (2nd ed.)", {"arxiv": "2101.5"}, "nderthersiesnded".replace("siesn", "skies2n")),
        ("10.55/QRS(7)", "Snow", {}, "10.55/qrs(7)"),
        (None, "???", {"pmcid": ""}, None),
        (None, " ", {"openalex": "W8", "arxiv": "hep-th/99"}, "arxiv:hep-th/99"),
    ],
)
def test_dedup_key(spark, doi, title, ids, key):
    df = spark.createDataFrame([(doi, title, ids)], "doi string, title string, ids map<string,string>")
    assert df.select(text.dedup_key(F.col("doi"), F.col("title"), F.col("ids")).alias("k")).first().k == key


@pytest.mark.parametrize(("name", "safe"), [("a b/c", "a_b_c"), ("...x", "_x"), (None, "_"), ("10.77/é", "10.77__"), ("./x/../y", "__x_.._y".replace("__x", "__x"))])
def test_path_safe(spark, name, safe):
    assert one(spark, name, text.path_safe) == safe


def test_identifiers(spark):
    assert one(spark, "10.48550/ARXIV.2203.00011v2", text.arxiv_of_doi) == "2203.00011v2" and one(spark, "10.7/arxiv.1", text.arxiv_of_doi) is None
    assert one(spark, "see PMC12 and PMC34", text.pmcid_in) == "PMC12" and one(spark, "pmc12", text.pmcid_in) is None
    assert one(spark, "https://example.org/a/b//", text.last_segment) == "b"
    assert one(spark, "(https://doi.org/10.5555/ab.c-d_e).", text.doi_in) == "10.5555/ab.c-d_e" and one(spark, "10.123/x", text.doi_in) is None
    assert one(spark, {"b": [1, 3], "a": [0], "c": [1]}, text.restored_abstract, "map<string,array<int>>") == "a b c b"
    assert one(spark, " x ,NONE,,y,none ", text.list_items) == ["x", "y", "none"]
    assert one(spark, "p:v w high", text.model_parts).asDict() == {"provider": "p", "version": "v w", "level": "high"}
    assert one(spark, "codex", text.model_version) == "gpt-5.2-xhigh" and one(spark, "p: v:w ", text.model_version) == "v:w" and one(spark, "own", text.model_version) == "own"
    assert one(spark, "# One\ntext\n**Two**\n### Three ", text.headings) == ["One", "Two", "Three"]
    assert one(spark, "---\na: 1\n---\nbody", text.without_front_matter) == "body"
    assert one(spark, "v", lambda c: text.filled("<{a}|{b}|{c}>", a=c, b=F.lit(None))) == "<v||{c}>"
    assert one(spark, "x-2nd o'neil", markup.display_name) == "X 2Nd O'Neil"


def rows(spark, values):
    return spark.createDataFrame([(k, *v) for k, v in enumerate(values)], f"ord int, {RECORD}")


NONE = (None, None, None)


def test_merge_keeps_first_decision_and_unions_labels(spark):
    df = rows(
        spark,
        [
            ("k", {"doi": "10.60/q"}, "T", 0, 5, "openalex", NONE, None, None),
            ("k", {"pmcid": "PMC9"}, "U", 2021, None, "epmc+openalex", ("included", "full_text", None), "fulltext", "evidence"),
            ("k", {"pmcid": "PMC8"}, None, 2020, 9, "arxiv", ("excluded", "x", "y"), None, None),
            (None, {}, "lost", 1, 1, "openalex", NONE, None, None),
        ],
    )
    r = corpus.merge(df, ["key"], ["ord"]).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.title, r.year, r.cited_by, r.found_via, r.fulltext, r.role) == ("T", 2021, 9, "openalex+epmc+arxiv", "fulltext", "evidence")
    assert r.ids == {"doi": "10.60/q", "pmcid": "PMC8"}
    assert r.screening.status == "included"


def test_merge_of_nothing(spark):
    assert corpus.merge(rows(spark, []), ["key"], ["ord"]).count() == 0


def test_upsert_existing_decisions_win(spark):
    old = rows(spark, [("k", {}, "T", 2000, 5, "openalex", ("excluded", "s", "wrong population"), None, None)])
    new = rows(spark, [("k", {}, "N", 2001, 9, "snowball:citations", ("included", "s", None), None, None), ("n", {}, "X", 1, 1, "epmc", NONE, None, None)])
    r = {x.key: x for x in corpus.upsert(old, new, ["key"], ["ord"]).collect()}
    assert set(r) == {"k", "n"} and r["k"].screening.reason == "wrong population" and r["k"].found_via == "openalex+snowball:citations" and r["k"].cited_by == 9


def test_flow(spark):
    df = rows(
        spark,
        [
            ("1", {}, "", 1, 1, "openalex", ("included", None, None), "fulltext", None),
            ("2", {}, "", 1, 1, "openalex", ("included", None, None), None, None),
            ("3", {}, "", 1, 1, "arxiv", ("excluded", None, "wrong population"), None, None),
            ("4", {}, "", 1, 1, "snowball:refs", ("excluded", None, "wrong population"), None, None),
        ],
    )
    r = corpus.flow(df).first()
    assert (r.after_dedup, r.screened, r.excluded, r.included, r.not_retrieved, r.in_synthesis, r.passes) == (4, 4, 2, 2, 1, 1, True)
    bare = rows(spark, [("1", {}, "", 1, 1, None, NONE, None, None), ("2", {}, "", 1, 1, "", ("excluded", None, ""), None, None)])
    assert corpus.by_source(bare).first().asDict() == {"source": "unknown", "n": 2}
    assert corpus.excluded_by_reason(bare).first().reason == "unspecified"
    assert corpus.flow(bare).first().passes is False


@pytest.mark.parametrize("o", [True, False, None])
@pytest.mark.parametrize("c", [True, False, None])
@pytest.mark.parametrize("e", [True, False, None])
def test_retraction_ladder(spark, o, c, e):
    df = spark.createDataFrame([(o, c, e)], "o boolean, c boolean, e boolean")
    r = df.select(F.inline(F.array(citations.retraction(F.col("o"), F.col("c"), F.col("e"))))).first()
    convicted = [n for n, v in (("openalex", o), ("crossref", c), ("europepmc", e)) if v]
    cleared = [n for n, v in (("crossref", c), ("europepmc", e)) if v is not None]
    want = (bool(convicted), bool(convicted or cleared), convicted[0] if convicted else "+".join(cleared) or None)
    assert tuple(r) == want


def test_titles_match(spark):
    pairs = [("Soil: a REVIEW", "soil a review", True), ("Rivers", "Lakes of the north", False), ("", " ", False), (None, "x", False), ("growth of alpine larches over time", "growth of alpine larchs over tme", True), ("Ice", "Ice ages", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    for r in df.select("w", citations.titles_match(F.col("a"), F.col("b")).alias("m")).collect():
        assert r.m == r.w


def test_verify(spark):
    work = "doi string, matched_title string, pmid string, retracted boolean, ord int"
    first = spark.createDataFrame([("10.60/a", "Rivers of ice and stone", "7", False, 1), ("10.60/b", "Moss in towns", None, True, 2), ("10.60/c,d", "Deep sea vents", None, False, 3), (None, "Wind over dunes at night", "9", False, 4)], work)
    second = spark.createDataFrame([("10.60/e", "Fungi of the heath", "8", None, 1)], work)
    notices = spark.createDataFrame([("10.60/E",), (None,)], "updates string")
    articles = spark.createDataFrame([("7", ["Journal Article"], None, 1), ("9", None, [("Retraction in",)], 2)], "pmid string, pub_types array<string>, corrections array<struct<type:string>>, ord int")
    claims = [(1, "10.60/A", "Rivers of ice and stone"), (2, "10.60/A", "Something else entirely, with no such words"), (3, "10.60/b", None), (4, "10.60/c,d", None), (5, "10.60/zz", "Moss in towns"), (6, None, "Rivers of ice and stone"), (7, None, "Wind over dunes"), (8, "10.60/e", None), (9, "", ""), (10, None, "Moss in deserts")]
    r = {x.id: tuple(x)[1:] for x in citations.verify(spark.createDataFrame(claims, "id int, doi string, title string"), first, second, notices, articles, "id").collect()}
    assert {k: v[0] for k, v in r.items()} == {1: "verified", 2: "mismatched", 3: "retracted", 4: "verified", 5: "not_found", 6: "verified", 7: "retracted", 8: "retracted", 9: "not_found", 10: "not_found"}
    assert r[1][4:] == (True, "crossref+europepmc") and r[3][4:] == (True, "openalex") and r[4][4:] == (False, None) and r[7][4:] == (True, "europepmc") and r[8][3:] == ("epmc", True, "crossref")
    assert r[5][1:3] == ("10.60/zz", None)


def test_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"results": [{"id": "https://openalex.org/W5", "doi": "https://doi.org/10.60/M", "title": "Moss", "publication_year": 1987, "cited_by_count": None}]}))
    (tmp_path / "a.json").write_text(json.dumps({"papers": [{"id": "2203.00011v2", "title": "On Dunes!", "published": "2022-03-01T00:00:00Z"}]}))
    (tmp_path / "e.json").write_text(json.dumps({"hitCount": 1, "results": [], "references": [{"title": "Fen birds", "pubYear": "n.d.", "pmid": "55", "citedByCount": 2}]}))
    parts = [records.read_openalex(spark, f"{tmp_path}/o.json"), records.read_arxiv(spark, f"{tmp_path}/a.json"), records.read_epmc(spark, f"{tmp_path}/e.json")]
    r = records.union_in_order(parts).orderBy("ord").collect()
    assert [(x.key, x.year, x.cited_by, x.found_via) for x in r] == [("10.60/m", 1987, 0, "openalex"), ("ondunes", 2022, 0, "arxiv"), ("fenbirds", None, 2, "epmc")]
    assert r[1].ids == {"arxiv": "2203.00011v2"} and r[2].ids == {"pmid": "55"}
    (tmp_path / "c.json").write_text(json.dumps({"papers": [{"key": "k", "title": "t"}]}))
    corpus_rows = records.read_corpus(spark, f"{tmp_path}/c.json")
    assert corpus_rows.first().key == "k"
    path = str(tmp_path / "store")
    assert records.last_version(spark, path) is None
    records.write_corpus(corpus_rows.drop("ord"), path)
    again = spark.read.schema(RECORD).json(records.last_version(spark, path))
    records.write_corpus(again.union(again), path)
    assert spark.read.schema(RECORD).json(records.last_version(spark, path)).count() == 2
    assert records.write_result(again, f"{tmp_path}/out").first().rows == 1
    many = spark.range(12)
    assert len(records.printed(many, 10)) == 11 and len(records.printed(many, 10, terminal=False)) == 12


def test_citation_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("* A. Author, https://doi.org/10.5555/mno;\n\n--- Plain words only\n")
    r = records.read_citations(spark, f"{tmp_path}/c.txt").collect()
    assert [x.doi for x in r] == ["10.5555/mno", None] and r[1].title == "Plain words only"
    (tmp_path / "c.json").write_text(json.dumps([{"doi": "10.60/a", "title": ""}, "see 10.5555/xyz.", "Only a title"]))
    r = records.read_citations(spark, f"{tmp_path}/c.json").collect()
    assert [(x.doi, x.title) for x in r] == [("10.60/a", None), ("10.5555/xyz", None), (None, "Only a title")]
    bib = '@string{x = "y"}\n  @book{k1,title = "Peat and {B}og",\n year = 1990, Title={Peat {and {B}og}} , doi={10.60/p}}\ntext @misc{no, title={x}}\n@Misc{ k2 ,\n title={Open\n@misc{k3, title={Fen}}\n@misc{title={No key}}'
    (tmp_path / "c.bib").write_text(bib)
    assert [(x.raw, x.doi, x.title) for x in records.read_citations(spark, f"{tmp_path}/c.bib").collect()] == [("k1", "10.60/p", "Peat and Bog"), ("k2", None, None), ("k3", None, "Fen")]


def test_atom_cases_and_front_matter(spark, tmp_path):
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2203.00011v2</id><title>On\n  dunes</title><summary>s</summary><published>2022</published><author><name>A  B</name></author><link title='pdf' href='u'/></entry></feed>"
    (tmp_path / "f.xml").write_text(feed)
    for r in (records.read_atom(spark, f"{tmp_path}/f.xml"), records.atom_records(spark.createDataFrame([(feed,), ("none",)], "value string"))):
        assert [(x.id, x.title, x.published, x.authors, x.pdf_url, x.doi) for x in r.collect()] == [("2203.00011v2", "On dunes", "2022", ["A B"], "u", None)]
    (tmp_path / "cases/folder").mkdir(parents=True)
    case = "**Agent**: agent-x\n**Timeout**: 900\n- [ ] not this\n## Rubric Profile\n- **First Tier**: research-quality (60%)\n- **Second**: logic (40%)\n- **Bad**: x (y%)\n## Task Prompt\n```\nDo it\n```\n### Must Identify\n- [ ] must a\n- [x] must b\n### Other\n- [ ] nor this\n"
    (tmp_path / "cases/folder/test-one-two.md").write_text(case)
    (tmp_path / "cases/folder/test-broken.md").write_text("nothing")
    r = records.read_cases(spark, f"{tmp_path}/cases", "fold").collect()
    assert len(r) == 1 and (r[0].agent, r[0].name, r[0].task, r[0].timeout, r[0].difficulty) == ("agent-x", "One Two", "Do it", 900, "Medium")
    assert {k: tuple(v) for k, v in r[0].profile.items()} == {"first tier": ("research-quality", 60), "second": ("logic", 40)} and r[0].must_include == ["must a", "must b"]
    assert records.read_cases(spark, f"{tmp_path}/cases", "zzz").count() == 0
    assert [tuple(x) for x in records.list_cases(spark, f"{tmp_path}/cases").collect()] == [("folder", ["broken", "one-two"])]
    (tmp_path / "skills/a/b").mkdir(parents=True)
    (tmp_path / "skills/a/SKILL.md").write_text("---\nname: x\ndescription: y z\n---\nbody")
    (tmp_path / "skills/a/b/SKILL.md").write_text("plain")
    r = {x.name: x for x in records.read_front_matter(spark, f"{tmp_path}/skills").collect()}
    assert r["x"].description == "y z" and r["x"].body == "body" and r["b"].body == "plain"


def test_markup():
    jats = "<article xmlns='u'><front><article-title>T</article-title><abstract><p>A</p></abstract><abstract> </abstract></front><body><sec><title>M <b>n</b></title><p>one <i>two</i>\n  three<p>in</p></p></sec></body><body><p>no</p></body></article>"
    assert markup.article_markdown(jats) == "# T\n\n## Abstract\n\nA\n\n\n## M n\n\n\none two\n  threein\n\nin"
    assert markup.article_markdown("<oops> a < b") == "a" and markup.article_markdown(None) is None


def test_search(spark):
    df = spark.createDataFrame([(1, "a b", 2020, ["x"], None), (2, "b c", 2010, ["x", "y"], "d"), (3, None, None, None, None)], "id int, title string, year int, tags array<string>, doi string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(search.filtered(df, "year:>2015")) == [1]
    assert ids(search.filtered(df, "tags:x,has_doi:true")) == [2]
    assert ids(search.filtered(df, "from_year:2010,to_year:2015")) == [2]
    assert ids(search.filtered(df, "title.search:B C")) == [2]
    with pytest.raises(search.SearchError):
        search.filtered(df, "nope:1")
    cond = lambda q: search.boolean({"ti": ["title"], "all": ["title", "doi"]}, q)
    assert ids(df.where(cond("ti:b ANDNOT (all:d OR ti:zz)"))) == [1]
    assert ids(df.where(cond('"b c" OR ti:a'))) == [1, 2]
    with pytest.raises(search.SearchError):
        cond("(ti:b")
    assert [r.id for r in search.page(df, "year:desc", "id", 1, 500).collect()] == [1, 2, 3]
    assert {r.value: r.n for r in search.grouped(df, "tags").collect()} == {"x": 2, "y": 1}
    assert ids(search.sampled(df, "id", 2, 5)) == ids(search.sampled(df, "id", 2, 5))


def test_requests(spark):
    df = spark.createDataFrame([(1, "wet soil", [("de", ["x"])], True), (2, "dry soil", [("fr", ["y", "z"])], None), (3, None, None, False)], "id int, title string, at array<struct<country:string,tags:array<string>>>, free boolean")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(search.filtered(df, "at.country:de|it")) == [1] and ids(search.filtered(df, "at.tags:z")) == [2]
    assert ids(search.filtered(df, "at.country:!de")) == [2] and ids(search.filtered(df, "title+free.search:soil")) == [1, 2]
    edges = spark.createDataFrame([(1, 2), (3, 2)], "citing int, cited int")
    assert ids(search.filtered(df, "cites:2", edges=edges)) == [1, 3] and ids(search.filtered(df, "cited_by:3", edges=edges)) == [2] and ids(search.filtered(df, "related_to:2", edges=edges)) == [1, 3]
    for bad in ("at.nope:1", "title:x"):
        with pytest.raises(search.SearchError):
            search.filtered(df, bad, capabilities={"at.nope": {"filter"}})
    flags = {"OPEN_ACCESS": "free", "EXT_ID": "id"}
    assert ids(search.europepmc(df, "soil", flags, ["title"])) == [1] and ids(search.europepmc(df, "OPEN_ACCESS:n NOT EXT_ID:3", flags, ["title"])) == [2]
    with pytest.warns(UserWarning):
        assert search.asked(df, "id", sample=2, sort="id:asc").count() == 2
    assert [r.id for r in search.asked(df, "id", sort="id:desc", size=2, number=2, select="id").collect()] == [1]
    assert search.asked(df, "id", group_by="free").count() == 3 and ids(search.by_ids(df, "id", "1, 3,9")) == [1, 3]
    assert [r.id for r in search.listed(df, "id", 1, 5).collect()] == [2, 3] and search.any_hit(df.where("id > 9")).first().hit is False
    assert search.pilot(df, "id", 1, above=2).count() == 1 and search.pilot(df, "id", 1, above=3).count() == 3


def test_co_citation_of_a_work_that_cites_much(spark):
    e = spark.createDataFrame([(0, k) for k in range(30)] + [(1, 3), (1, 4), (None, 1), (2, None)], "citing int, cited int")
    r = {(x.a, x.b): x.n for x in graph.co_cited(e, piece=7).collect()}
    assert len(r) == 30 * 29 // 2 and r[3, 4] == 2 and sum(r.values()) == 436


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (1, 3)], "citing int, cited int")
    s = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.round) for r in graph.snowball(e, s, 5).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert [tuple(r) for r in graph.co_cited(e).collect()] == [(2, 3, 1)]


def test_scores(spark):
    df = spark.createDataFrame([(80.0, 60.0), (None, 40.0)], "s double, w double")
    assert df.agg(scores.weighted_mean(F.col("s"), F.col("w")).alias("m")).first().m == 48.0
    assert df.where("w < 0").agg(scores.weighted_mean(F.col("s"), F.col("w")).alias("m")).first().m == 0
    judge = lambda t: one(spark, t, lambda c: scores.judged(c, {"RIGOUR": 60, "FORM": 40}))
    j = judge("**RIGOUR**: 80\nRIGOUR_REASONING: sound\nand short\n\nFORM` = 90\nMUST_INCLUDE_MET: a, b ,none\nMUST_INCLUDE_MISSED: none\n")
    assert (j.overall, j.passed, j.rigour.score, j.rigour.reasoning, j.form.score, j.form.reasoning, j.met, j.missed) == (84.0, True, 80, "sound\nand short", 90, "Score: 90/100", ["a", "b"], [])
    j = judge("RIGOUR: 80\nOVERALL_SCORE: 65.5\nOVERALL_JUSTIFICATION: fine\nRESULT: PASS")
    assert (j.overall, j.result, j.passed, j.reasoning) == (65.5, "PASS", True, "fine")
    assert judge("nothing").passed is False and judge("").overall == 0
    assert df.select(markup.rounded(F.lit(85.85), F.lit(1)).alias("r")).first().r == 85.8


def test_simpson_reversal(spark):
    data = [("A", "easy", 800, 760), ("A", "hard", 200, 140), ("B", "easy", 200, 196), ("B", "hard", 800, 654)]
    df = spark.createDataFrame(data, "h string, s string, n int, k int")
    rate = {(r.h, r.s): r.r for r in df.groupingSets([["h", "s"], ["h"]], "h", "s").agg((F.sum("k") / F.sum("n")).alias("r")).collect()}
    assert rate["A", None] > rate["B", None] and rate["A", "easy"] < rate["B", "easy"] and rate["A", "hard"] < rate["B", "hard"]


def test_prose(spark):
    df = spark.createDataFrame([(1, "It may be so, perhaps; it might.\n\nfine words here\nfine words there"), (2, None)], "doc_id int, text string")
    r = {x.doc: x for x in prose.audit(df, "doc_id", "text", prose.HEDGES, 2).collect()}
    assert (r[1].paragraphs, r[1].hits, r[1].flagged) == (3, 3, 1) and 2 not in r
    assert prose.monotonous(df, "doc_id", "text").first().runs == 1


def test_streaming_upsert_goes_on_after_a_restart(spark, tmp_path):
    from quillspark.streaming.upsert import CorpusTable, start

    df = rows(spark, [("k", {}, "T", 2000, 5, "openalex", ("included", None, None), None, None), ("j", {}, "S", 1999, 1, "epmc", NONE, None, None)])
    df.write.parquet(f"{tmp_path}/in")
    table = lambda: CorpusTable(spark, f"{tmp_path}/table", ["key"], ["ord"], buckets=4)
    assert table().read() is None and table().version is None
    start(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), table(), f"{tmp_path}/check").awaitTermination()
    for n in range(4):  # each time a new table object, as after a restart
        rows(spark, [("k", {}, "N", 2001, 9 + n, "arxiv", ("excluded", None, "x"), None, None)]).write.mode("append").parquet(f"{tmp_path}/in")
        start(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), table(), f"{tmp_path}/check").awaitTermination()
    r = {x.key: x for x in table().read().collect()}
    assert len(r) == 2 and r["k"].screening.status == "included" and r["k"].cited_by == 12 and r["k"].found_via == "openalex+arxiv" and r["j"].title == "S"
    last = table().version
    assert table().versions() == [last - 1, last]
    # The bucket of the other key was written once only, and what no manifest names is gone.
    assert sorted(set(table().manifest(last).values())) == [0, last] and len(list((tmp_path / "table/data").iterdir())) == 3
    table().take_in(df, last)  # a batch that was committed changes nothing
    assert table().version == last


def test_services(tmp_path):
    import datetime as dt
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quillspark.sources import services as s

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            n = seen.count(self.path)
            status = 404 if self.path == "/gone" else 503 if self.path == "/busy" or (self.path == "/later" and n < 3) else 200
            body = gzip.compress(b'{"a": 1}') if self.path == "/later" else "é".encode("latin-1")
            self.send_response(status)
            self.send_header("Retry-After", "2")
            self.send_header("Content-Type", "text/plain; charset=latin-1")
            if self.path == "/later" and status == 200:
                self.send_header("Content-Encoding", "gzip")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    client = s.Client(f"http://127.0.0.1:{server.server_port}/", sleep=waits.append, retries=3)
    assert client.json("later") == {"a": 1} and len(waits) == 2 and 3 <= waits[0] <= 3.5 and 6 <= waits[1] <= 6.5
    assert client.get("page").text() == "é"
    for path, tries in (("gone", 1), ("busy", 4)):
        with pytest.raises(s.ServiceError) as error:
            client.get(path)
        assert error.value.status in (404, 503) and seen.count(f"/{path}") == tries
    with pytest.raises(s.ServiceError):
        client.get("http://elsewhere.example/x")
    server.shutdown()
    down = s.Client(f"http://127.0.0.1:{server.server_port + 1}/", sleep=waits.append, retries=1, timeout=1)
    with pytest.raises(s.ServiceError):
        down.get("x")
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert s.retry_after("7") == 7 and s.retry_after("Mon, 01 Jan 2024 00:01:00 GMT", now) == 60 and s.retry_after("soon") is None and s.retry_after(None) is None
    assert [s.wait_before(k, None) for k in (0, 1, 9)] == [3, 6, 180] and s.wait_before(0, 100) == 100
    assert "page" not in s.openalex_url("works", sample=5, sort="x", page=2) and "sort" not in s.openalex_url("works", sample=5, sort="x") and "per_page=100" in s.openalex_url("works", per_page=900)
    assert "OPEN_ACCESS%3Ay" in s.epmc_url("x", 5) and s.epmc_url("open_access:n", 5).count("OPEN_ACCESS") == 0 and "pageSize=1000" in s.epmc_url("x", 5000)
    gap = s.Limiter("test", 0.2, str(tmp_path))
    import time

    began = time.monotonic()
    for _ in range(3):
        gap.wait()
    assert time.monotonic() - began >= 0.38


def test_recorded_services(tmp_path):
    from quillspark.sources import services as s

    lines = [{"url": f"{s.EPMC}{s.epmc_url('q', 3, c)}", "body": json.dumps({"resultList": {"result": [{"id": i} for i in ids]}, "nextCursorMark": n})} for c, ids, n in (("*", [1, 2], "B"), ("B", [3, 4], "C"))]
    lines += [{"url": f"{s.EPMC}PMC1/fullTextXML", "body": "<a><article-title>T</article-title></a>"}, {"url": f"{s.EPMC}p.pdf", "body": "%PDF-1"}, {"url": f"{s.EPMC}x.pdf", "body": "<html>"}]
    lines += [{"url": f"{s.EPMC}search?query=DOI%3A%2210.60%2Fa%22&format=json&pageSize=5", "body": json.dumps({"resultList": {"result": [{"pmid": "1"}, {"pmcid": "PMC9"}]}})}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    client = s.client_of("epmc", {"recording": str(tmp_path / "r.jsonl")})
    assert [x["id"] for x in s.epmc_items(client, "q", 3)] == [1, 2, 3]
    assert s.full_text(client, "PMC1") == "# T" and s.pdf(client, "p.pdf") == b"%PDF-1" and s.pdf(client, "x.pdf") is None
    assert s.pmcid_of_doi(client, "10.60/a") == "PMC9"
    assert s.work_by_doi(s.client_of("openalex", {"recording": str(tmp_path / "r.jsonl")}), "10.60/none") is None
    assert s.has_notice(client, "10.60/a,b") is None
    assert list(s.atom_items(b"<feed xmlns='http://www.w3.org/2005/Atom'/>")) == []


def test_benchmark_golden(spark):
    from quillspark.operators import benchmark

    runs = spark.createDataFrame([("r1", "opus", 25, 25), ("r2", "x", 22, 20), ("r3", "g", 25, 25), ("r4", "g", 26, 24), ("r5", "g", 26, 26)], "run_id string, model string, tests_run int, tests_passed int")
    one = benchmark.summary(runs.withColumn("scores_by_agent", F.create_map(F.lit("a"), F.array(F.lit(1.0))))).first()
    assert (one.total_runs, one.models, one.agents, one.overall_pass_rate) == (5, ["g", "opus", "x"], ["a"], 96.8)
    assert benchmark.summary(runs.limit(0).withColumn("scores_by_agent", F.create_map(F.lit("a"), F.array(F.lit(1.0))))).first().overall_pass_rate == 0


def test_statistics_of_nothing(spark):
    from quillspark.operators import stats

    none = spark.createDataFrame([(None, None)], "g string, v double")
    assert stats.t_test(none, F.col("g") == "a", "v").first().welch_t is None
    assert stats.anova(none, "g", "v").first().f is None
    assert stats.odds_ratio(none, F.col("v") > 1, F.col("v") > 2).first().odds_ratio is None
    assert stats.mann_whitney(none, "g", "a", "v").first().u is None and stats.kruskal_wallis(none, "g", "v").first().h is None
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", 4.0)], "g string, v double")
    r = stats.mann_whitney(df, "g", "a", "v").first()
    assert (r.n1, r.n2, r.u) == (2, 3, 0.5)


def test_registry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[:2] == ["workspace", "key"]
