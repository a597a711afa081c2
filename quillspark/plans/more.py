"""Queries of the core that make files, recordings or runs of the test tables first, and of statistics; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import benchmark, citations, corpus, graph, search, stats
from ..session import table as T
from ..sources import records, services
from ..storage import table_path
from ..streaming.upsert import CorpusTable, start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Readers: each table is written as the files that the reader takes, and read back.

_SLUG = lambda t: f"nullif(regexp_replace(lower({t}), '[^a-z0-9]', '', 'g'), '')"


def _text_files(rows: DataFrame, name: str) -> str:
    """Write a text column as files of one line each group; returns the folder."""
    path = table_path(rows.sparkSession, name)
    rows.write.text(path)
    return path


@query(f"""select coalesce(nullif(lower(ids['doi']), ''), {_SLUG("title")}, 'openalex:W' || rec_id) as key, nullif(ids['doi'], '') as doi, 'W' || rec_id as openalex, title, year, coalesce(cited_by, 0) as cited_by,
'snowball:citations' as found_via from corpus""")
def reader_openalex(spark, folder):
    c = T(spark, folder, "corpus")
    work = F.struct(F.concat(F.lit("https://openalex.org/W"), "rec_id").alias("id"), F.concat(F.lit("https://doi.org/"), text.some(F.element_at("ids", "doi"))).alias("doi"), "title", F.col("year").alias("publication_year"), F.col("cited_by").alias("cited_by_count"))
    # One work in each response: a file is read by one task.
    path = _text_files(c.select(F.to_json(F.struct(F.array(work).alias("results"))).alias("value")), "works")
    lines = spark.read.schema(records.OPENALEX).json(path)
    r = records.openalex_records(lines, "snowball:citations")
    return r.select("key", F.col("ids")["doi"].alias("doi"), F.col("ids")["openalex"].alias("openalex"), "title", "year", "cited_by", "found_via")


@query(f"""select coalesce(nullif(lower(doi), ''), {_SLUG("title")}, 'pmcid:' || nullif(pmcid, ''), 'pmid:' || nullif(pmid, '')) as key, nullif(doi, '') as doi, title,
case when regexp_full_match(trim(pubyear), '[0-9]+') then try_cast(trim(pubyear) as int) end as year, coalesce(citedbycount, 0) as cited_by from epmc_results""")
def reader_epmc(spark, folder):
    e = T(spark, folder, "epmc_results")
    hit = F.struct("doi", "title", F.col("pubyear").alias("pubYear"), "pmid", "pmcid", F.col("citedbycount").alias("citedByCount"))
    path = _text_files(e.select(F.to_json(F.struct(F.array().cast("array<string>").alias("results"), F.array(hit).alias("citations"))).alias("value")), "hits")
    r = records.epmc_records(spark.read.schema(records.EPMC).json(path), "epmc")
    return r.select("key", F.col("ids")["doi"].alias("doi"), "title", "year", "cited_by")


@query("select key, title, year, cited_by, found_via, screening.status as status, nullif(ids['doi'], '') as doi from corpus")
def corpus_write_read(spark, folder):
    c = T(spark, folder, "corpus").select("key", "ids", "title", "year", "cited_by", "found_via", "screening", "fulltext", "role")
    path = table_path(spark, "corpus")
    records.write_corpus(c, path)
    back = spark.read.schema(records.RECORD).json(records.last_version(spark, path))
    return back.select("key", "title", "year", "cited_by", "found_via", F.col("screening.status").alias("status"), text.some(F.col("ids")["doi"]).alias("doi"))


_SP = r"\t\n\x{000b}\f\r \x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(rf"""with l as (select regexp_replace(regexp_replace(regexp_replace(regexp_replace('- ' || replace(replace(raw, chr(13), ' '), chr(10), ' '), '^[{_SP}]+|[{_SP}]+$', '', 'g'), '^[-*]+', ''), '^[{_SP}]+', ''), '[{_SP}]+$', '') as raw from verify_citations)
select nullif(rtrim(regexp_extract(raw, '10\.[0-9]{{4,9}}/[^{_SP}"''<>]+', 0), '.,;:)]}}'), '') as doi, raw as title, raw from l where raw <> ''""")
def citations_of_lines(spark, folder):
    v = T(spark, folder, "verify_citations").where("raw is not null")
    path = _text_files(v.select(F.concat(F.lit("- "), F.regexp_replace("raw", r"[\r\n]", " ")).alias("value")), "lines")
    return records.citation_lines(spark.read.text(path))


@query(rf"""select cast(rec_id as varchar) as id, trim(regexp_replace(title, '[{_SP}]+', ' ', 'g')) as title, 'by ' || workspace as author from corpus where title is not null and workspace is not null""")
def atom_feed(spark, folder):
    """An Atom entry of each corpus row, read back."""
    c = T(spark, folder, "corpus").where("title is not null and workspace is not null")
    esc = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/"), F.col("rec_id"), F.lit("</id><title> "), esc(F.regexp_replace("title", r"[\r\n]", " ")), F.lit(" </title><author><name>by "), esc(F.col("workspace")), F.lit("</name></author>"))
    r = records.atom_records(c.select(F.concat(entry, F.lit("</entry></feed>")).alias("value")))
    return r.select("id", "title", F.col("authors")[0].alias("author"))


# Services, played back from recordings made of the tables.


def _recorded(rows: DataFrame, name: str) -> str:
    return _text_files(rows.select(F.to_json(F.struct("url", "body")).alias("value")), name)


@query("select result_id, title, pmid from epmc_results")
def service_epmc_search(spark, folder):
    """All results of a search, page by page along the cursor."""
    size = 500
    e = T(spark, folder, "epmc_results").select("result_id", "title", "pmid", F.floor(F.col("result_id") / size).alias("page"))
    pages = e.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("result_id", "title", "pmid"))).alias("result"))
    # A few rows: one for each page.
    chain = pages.withColumn("next", F.lead("page").over(Window.orderBy("page"))).withColumn("first", F.row_number().over(Window.orderBy("page")) == 1)
    most = 10**9
    one = services.epmc_url("x", most, "@")
    url = F.concat(F.lit(services.EPMC), F.replace(F.lit(one), F.lit("%40"), F.when(F.col("first"), F.lit("%2A")).otherwise(F.col("page").cast("string"))))
    body = F.to_json(F.struct(F.struct("result").alias("resultList"), F.coalesce(F.col("next"), F.col("page")).cast("string").alias("nextCursorMark")))
    found = services.read(spark, "epmc", query="x", most=most, recording=_recorded(chain.select(url.alias("url"), body.alias("body")), "epmc"))
    r = found.select(F.from_json("item", "result_id bigint, title string, pmid string").alias("r"))
    return r.select("r.*")


@query("select p_partkey as id, p_name as title from part")
def service_openalex_pages(spark, folder):
    """All works of a listing, 100 on a page."""
    p = T(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.floor(F.col("p_partkey") / 100).alias("page"))
    total = p.agg(F.count(F.lit(1)).alias("count"))
    pages = p.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("results")).crossJoin(F.broadcast(total))  # one row
    one = services.openalex_url("works", page=0, per_page=100)
    url = F.concat(F.lit(services.OPENALEX), F.replace(F.lit(one), F.lit("page=0"), F.concat(F.lit("page="), (F.col("page") + 1).cast("string"))))
    made = pages.select(url.alias("url"), F.to_json(F.struct(F.struct("count").alias("meta"), "results")).alias("body"))
    found = services.read(spark, "openalex", entity="works", per_page=500, recording=_recorded(made, "openalex"))
    return found.select(F.from_json("item", "id bigint, title string").alias("r")).select("r.*")


@query("select distinct 'A1' as citing, cast(l_partkey as varchar) as cited from lineitem where l_orderkey = 1")
def service_references(spark, folder):
    """The references of one article as edges, page by page."""
    rows = T(spark, folder, "lineitem").where("l_orderkey = 1").select(F.col("l_partkey").cast("string").alias("id")).distinct()
    one = rows.agg(F.array_sort(F.collect_list(F.struct("id"))).alias("r"))  # the lines of an order are few
    per = 2
    pages = one.select("r", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("r") / per).cast("int")))).alias("page"))
    url = F.concat(F.lit(services.EPMC + "MED/A1/references?page="), F.col("page"), F.lit(f"&pageSize={per}&format=json"))
    body = F.to_json(F.struct(F.size("r").alias("hitCount"), F.struct(F.slice("r", (F.col("page") - 1) * per + 1, per).alias("reference")).alias("referenceList")))
    items = services.read(spark, "references", source="MED", article="A1", per_page=per, recording=_recorded(pages.select(url.alias("url"), body.alias("body")), "refs"))
    return services.graph_edges(items, "A1", "references")


@query("""with d as (select distinct doi from verify_citations where doi <> ''), n as (select distinct lower(ids['doi']) k from corpus where regexp_matches(lower(title), '^(correction|erratum|retraction)'))
select doi as id, case when contains(doi, ',') then null else n.k is not null end as noticed from d left join n on lower(doi) = n.k""")
def service_notice_probe(spark, folder):
    """For each cited DOI whether a notice updates it, asked as a count; unknown for DOIs that hold a comma."""
    import urllib.parse

    v = T(spark, folder, "verify_citations").where("doi <> ''").select("doi").distinct()
    notices = T(spark, folder, "corpus").where(F.regexp_like(F.lower("title"), F.lit("^(correction|erratum|retraction)"))).select(F.lower(F.element_at("ids", "doi")).alias("k")).distinct()
    quoted = F.pandas_udf(lambda s: s.map(urllib.parse.quote_plus), "string")
    n = v.join(notices, F.lower("doi") == F.col("k"), "left")
    url = F.concat(F.lit(services.CROSSREF + "works?filter=updates%3A"), quoted("doi"), F.lit("%2Cupdate-type%3Aretraction&rows=0"))
    body = F.to_json(F.struct(F.struct(F.when(F.col("k").isNull(), 0).otherwise(1).alias("total-results")).alias("message")))
    found = services.look_up(v, "doi", "notice", recording=_recorded(n.select(url.alias("url"), body.alias("body")), "notices"))
    return found.select("id", (F.col("found") == "true").alias("noticed"))


# Evaluation runs made of the events.

_RUBRICS = {"design-quality": 70, "output-structure": 30}
_MODELS = ("claude:opus", "codex:gpt-5.2 xhigh", "gemini")


def _details(spark, folder) -> DataFrame:
    e = T(spark, folder, "events")
    a, b = (F.col("event_id") * 7 % 101).cast("string"), (F.col("event_id") * 13 % 101).cast("string")
    answer = F.concat(
        F.lit("DESIGN_QUALITY: "), a, F.lit("\nDESIGN_QUALITY_REASONING: so\n`OUTPUT_STRUCTURE` = "), b, F.lit("\nMUST_INCLUDE_MET: a, b\nMUST_INCLUDE_MISSED: "), F.when(F.col("event_id") % 3 == 0, "c").otherwise("none"),
        F.lit("\nOVERALL_JUSTIFICATION: Because of "), F.col("event_type"), F.lit("\n"), F.when(F.col("event_id") % 5 == 0, "RESULT: PASS").otherwise(""),
    )
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.dayofmonth("ts") % 3 + 1).cast("int"))
    rows = e.select(
        F.date_format("ts", "'run_'yyyyMMdd_'000000'").alias("run_id"), F.date_trunc("day", "ts").alias("stamp"), model.alias("model"), F.col("event_type").alias("agent"), F.concat(F.lit("Case "), F.col("event_id")).alias("test_name"),
        F.when(F.col("user_id") % 2 == 0, F.lit("difficulty: hard")).alias("case_text"), answer.alias("answer"), F.col("props").alias("output"), F.col("value").alias("seconds"),
    )
    return benchmark.details(rows, _RUBRICS)


_DETAILS = """d as (select event_id, 'run_' || strftime(ts, '%Y%m%d') || '_000000' as run_id, strftime(ts, '%Y%m%d') as day, list_extract(['claude:opus', 'codex:gpt-5.2 xhigh', 'gemini'], day(ts) % 3 + 1) as model, event_type as agent,
(70.0 * (event_id * 7 % 101) + 30.0 * (event_id * 13 % 101)) / 100.0 as overall, event_id % 5 = 0 as told, case when event_id % 3 = 0 then 1 else 0 end as missed, user_id, value, props from events),
t as (select *, cast(format('{:.1f}', overall) as double) as score, told or overall >= 70 as passed, split_part(model, ':', 1) || '_' || agent || '_case-' || event_id || '_' || day as id from d),
runs as (select run_id, any_value(model) as model, count(*) as tests_run, count(*) filter (passed) as tests_passed, cast(format('{:.1f}', cast(sum(cast(score as decimal(20,6))) as double) / count(*)) as double) as average_score,
 cast(format('{:.1f}', 100.0 * count(*) filter (passed) / count(*)) as double) as pass_rate from t group by 1)"""


@query(f"""with {_DETAILS} select id, run_id, model, case when contains(model, ':') then trim(split_part(model, ':', 2)) when model = 'gemini' then 'gemini-3-flash-preview' else model end as model_version, score, passed,
case when user_id % 2 = 0 then 'Hard' else 'Medium' end as difficulty, 2.0 / (2 + missed) as coverage, 'Covered 2/' || (2 + missed) || ' required elements' as details, 'Because of ' || agent as justification from t""")
def run_details(spark, folder):
    return _details(spark, folder).select("id", "run_id", "model", "model_version", "score", "passed", "difficulty", "coverage", "details", "justification")


@query(f"with {_DETAILS} select run_id, model, cast(tests_run as bigint) as tests_run, cast(tests_passed as bigint) as tests_passed, average_score, pass_rate from runs")
def run_overview(spark, folder):
    """Runs stored in two steps, the second of which replaces part of the first, and the overview of the store."""
    store = benchmark.Store(spark, table_path(spark, "runs"))
    rows = _details(spark, folder)
    store.append(rows.where("run_id < 'run_20240120'"))
    store.append(rows.where("run_id >= 'run_20240110'"))
    return store.overview().drop("stamp", "scores_by_agent")


@query(f"with {_DETAILS} select run_id, agent, array_to_string(list_transform(list(score order by id), lambda x: format('{{:.1f}}', x)), ' ') as scores from t group by 1, 2")
def run_scores_by_agent(spark, folder):
    r = benchmark.scores_per_agent(_details(spark, folder))
    return r.select("run_id", "agent", F.array_join(F.transform("scores", lambda x: F.format_string("%.1f", x)), " ").alias("scores"))


@query(f"""with {_DETAILS} select count(*) as total_runs, (select array_to_string(list_sort(list(distinct model)), '|') from runs) as models, (select array_to_string(list_sort(list(distinct agent)), '|') from t) as agents,
cast(format('{{:.1f}}', 100.0 * sum(tests_passed) / sum(tests_run)) as double) as overall_pass_rate from runs""")
def run_totals(spark, folder):
    s = benchmark.summary(benchmark.overview(_details(spark, folder)))
    return s.select("total_runs", F.array_join("models", "|").alias("models"), F.array_join("agents", "|").alias("agents"), "overall_pass_rate")


@query(f"with {_DETAILS} select model, run_id, average_score from runs qualify row_number() over (partition by model order by run_id desc) = 1")
def run_latest(spark, folder):
    return benchmark.latest(benchmark.overview(_details(spark, folder)).drop("scores_by_agent")).select("model", "run_id", "average_score")


@query(f"with {_DETAILS} select run_id, average_score, previous, round(average_score - previous, 1) as delta, case when average_score > previous then 'up' when average_score < previous then 'down' when average_score = previous then 'same' end as arrow from (select *, lag(average_score) over (order by run_id) previous from runs)")
def run_score_trend(spark, folder):
    return benchmark.trend(benchmark.overview(_details(spark, folder))).select("run_id", "average_score", "previous", "delta", "arrow")


_READ = """f as (select *, split_part(model, ':', 1) || '_' || agent || '_case-' || event_id || '.md' as file, format('{:.1f}', score) as shown from t)"""


@query(f"with {_DETAILS}, {_READ} select file, model, agent, 'Case ' || event_id as name, case when passed then 'PASS' else 'FAIL' end as status, cast(shown as double) as score from f")
def report_scan(spark, folder):
    """Reports of all tests, the newest of each file, read back."""
    made = benchmark.latest_reports(benchmark.reports(_details(spark, folder)))
    return benchmark.read_reports(made.select("file", "report"))


@query(f"with {_DETAILS}, {_READ} select count(*) as n, count(*) filter (passed) as passes, round(cast(sum(cast(shown as decimal(20,6))) as double) / count(*), 6) as average from f")
def report_totals(spark, folder):
    one = benchmark.report_index(report_scan(spark, folder))
    return one.select("n", "passes", F.round("average", 6).alias("average"))


@query(f"with {_DETAILS}, {_READ} select '| ' || model || ' | ' || agent || ' | Case ' || event_id || ' | ' || case when passed then 'PASS' else 'FAIL' end || ' | ' || format('{{:.0f}}', round(cast(shown as decimal(9,1)), 0)) || ' | [' || file || '](' || file || ') |' as line from f")
def report_summary(spark, folder):
    return benchmark.summary_rows(report_scan(spark, folder)).select("line")


@query("""select workspace as agent, coalesce(nullif(case when phase = 'synthesis' then question end, ''), nullif(methodology, ''), '') as methodology from workspaces""")
def methodology_fallback(spark, folder):
    w = T(spark, folder, "workspaces")
    own = w.where("phase = 'synthesis'").select(F.col("workspace").alias("name"), F.col("question").alias("body"))
    return benchmark.methodology(w.select(F.col("workspace").alias("agent")), own, w.select(F.col("workspace").alias("name"), F.col("methodology").alias("body")))


@query("""with r as (select workspace, 'primary' tier, 60 weight, question body, 'first-rubric' rubric from workspaces union all select workspace, 'secondary', 40, null, 'second-rubric' from workspaces)
select workspace as "case", coalesce(string_agg('--- ' || rubric || ' (' || weight || '%) ---' || chr(10) || body, chr(10) order by tier), '') as texts, string_agg(upper(tier[1]) || tier[2:] || ') **' || case tier when 'primary' then 'First' else 'Second' end || ' Rubric** (' || weight || '%)', chr(10) order by tier) as dimensions,
cast(sum(weight) as bigint) as weight from r group by 1""")
def rubric_lookup(spark, folder):
    """Each workspace is a case whose first rubric is its question; the second has no text."""
    w = T(spark, folder, "workspaces")
    pair = lambda name, weight: F.struct(name.alias("rubric"), F.lit(weight).alias("weight"))
    profile = F.create_map(F.lit("primary"), pair(F.concat(F.lit("first-rubric#"), "workspace"), 60), F.lit("secondary"), pair(F.lit("second-rubric"), 40))
    made = benchmark.rubric_texts(w.select(F.col("workspace").alias("case"), profile.alias("profile")), w.where("question is not null").select(F.concat(F.lit("first-rubric#"), "workspace").alias("name"), F.col("question").alias("body")))
    # Names are told apart by workspace; that part isn't shown.
    return made.select("case", F.regexp_replace("texts", r"first-rubric#\S+", "first-rubric").alias("texts"), F.regexp_replace("dimensions", r"First Rubric#[^*]+", "First Rubric").alias("dimensions"), "weight")


# Test cases as Markdown.


@query("""select workspace as agent, 'Case ' || upper(workspace[1]) || replace(workspace, '-', ' ')[2:] as name, 2 as tiers, 70 as first_weight, coalesce(nullif(trim(question), ''), '-') as must, coalesce(nullif(trim(methodology), ''), '-') as task,
case when phase = 'synthesis' then 900 else 600 end as timeout from workspaces where question is distinct from '' or true""")
def test_cases(spark, folder):
    w = T(spark, folder, "workspaces")
    one_line = lambda c: F.coalesce(text.some(F.trim(F.col(c))), F.lit("-"))
    body = F.concat(
        F.lit("# A case\n**Agent**: "), "workspace", F.lit("\n"), F.when(F.col("phase") == "synthesis", "**Timeout**: 900\n").otherwise(""), F.lit("## Rubric Profile\n- **Main Tier**: design-quality (70%)\n- **Other**: output-structure (30%)\n\n## Task Prompt\n"),
        one_line("methodology"), F.lit("\n\n## Criteria\n### Must Include\n- [ ] "), one_line("question"), F.lit("\n### Should Include\n- [ ] no\n"),
    )
    files = w.select(body.alias("value"), F.concat(F.lit("x/test-case-"), "workspace", F.lit(".md")).alias("path"))
    c = records.cases(files)
    return c.select("agent", "name", F.size("profile").alias("tiers"), F.col("profile")["main tier"]["weight"].alias("first_weight"), F.col("must_include")[0].alias("must"), "task", "timeout")


@query("select workspace as path, coalesce(nullif(phase, ''), '-') as name, case when question is null or question = '' then null else trim(question) end as description, 'body ' || workspace as body from workspaces")
def front_matter_fields(spark, folder):
    w = T(spark, folder, "workspaces")
    value = F.concat(F.lit("---\nname: "), F.coalesce(text.some(F.col("phase")), F.lit("-")), F.lit("\ndescription: "), F.coalesce("question", F.lit("")), F.lit("\n---\nbody "), "workspace")
    return records.front_matter(w.select(F.col("workspace").alias("path"), value.alias("value"))).select("path", "name", "description", "body")


# Scalars.


@query(r"""select rec_id, coalesce(nullif(ids['doi'], ''), nullif(ids['arxiv'], ''), nullif(ids['pmcid'], '')) as filed,
array_to_string(list_transform(range(1, length(role) + 1), lambda i: case when i = 1 or not regexp_matches(replace(role, '-', ' ')[i - 1], '[\p{L}]') then upper(replace(role, '-', ' ')[i]) else lower(replace(role, '-', ' ')[i]) end), '') as shown,
'gemini_' || coalesce(workspace, 'x') || '_a-case_20240102' as test, left(title, 20) as clipped from corpus""")
def scalar_names(spark, folder):
    i = lambda n: F.element_at("ids", n)
    return T(spark, folder, "corpus").select(
        "rec_id", text.first_id(i("doi"), i("arxiv"), i("pmcid")).alias("filed"), markup.display_name("role").alias("shown"),
        text.test_id(F.lit("gemini:x"), F.coalesce("workspace", F.lit("x")), F.lit("A Case"), text.run_id(F.lit("2024-01-02 03:04:05").cast("timestamp"))).alias("test"), text.clipped(F.col("title"), 20).alias("clipped"),
    )


@query("""with u as (select rec_id, case rec_id % 4 when 0 then 'https://export.example.org/a?b=1' when 1 then 'http://other.example.com/' when 2 then 'ftp://export.example.org/x' else coalesce(ids['doi'], '') end u from corpus)
select rec_id, starts_with(u, 'http') and contains(u, '://') as safe, starts_with(u, 'https://export.example.org/') as own from u""")
def url_guard(spark, folder):
    k = F.col("rec_id") % 4
    url = F.when(k == 0, "https://export.example.org/a?b=1").when(k == 1, "http://other.example.com/").when(k == 2, "ftp://export.example.org/x").otherwise(F.coalesce(F.element_at("ids", "doi"), F.lit("")))
    return T(spark, folder, "corpus").select("rec_id", text.safe_url(url).alias("safe"), text.safe_url(url, F.lit("export.example.org")).alias("own"))


@query(r"""with l as (select page_id, unnest(string_split(page_text, chr(10))) line, generate_subscripts(string_split(page_text, chr(10)), 1) n from fulltext_pages)
select page_id, string_agg(trim(regexp_replace(line, '^#+ +', '')), '|' order by n) as headings from l where regexp_matches(line, '^#+ +[^ \t\r\n]') group by 1""")
def section_headings(spark, folder):
    h = T(spark, folder, "fulltext_pages").select("page_id", text.headings(F.regexp_replace("page_text", r"\r", "")).alias("h"))
    return h.where("size(h) > 0").select("page_id", F.array_join(F.transform("h", lambda x: F.trim(x)), "|").alias("headings"))


# Search.


@query("select workspace, phase from workspaces where len(list_filter(decisions, lambda d: d.date > '2021-06-01')) > 0")
def search_nested(spark, folder):
    return search.filtered(T(spark, folder, "workspaces"), "decisions.date:>2021-06-01").select("workspace", "phase")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_partkey in (1, 5)) and o_orderstatus = 'O'")
def search_cites(spark, folder):
    edges = T(spark, folder, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    legal = {"o_orderstatus": {"filter"}, "o_totalprice": {"sort"}}
    return search.filtered(T(spark, folder, "orders"), "cites:1|5,o_orderstatus:O", edges=edges, key="o_orderkey", capabilities=legal).select("o_orderkey", "o_orderstatus")


@query("""select rec_id from corpus where coalesce(fulltext = 'fulltext', false) and (coalesce(ids['pmid'] = '1', false) or coalesce(contains(lower(title), 'water'), false)) and not coalesce(role = 'background', false)""")
def search_epmc(spark, folder):
    c = T(spark, folder, "corpus").withColumn("free", F.col("fulltext") == "fulltext").withColumn("pmid", F.element_at("ids", "pmid"))
    return search.europepmc(c, "(EXT_ID:1 OR water) NOT SRC:background", {"OPEN_ACCESS": "free", "EXT_ID": "pmid", "SRC": "role"}, ["title"]).select("rec_id")


@query("select p_partkey, p_name from part where p_partkey in (3, 7, 11)")
def search_ids(spark, folder):
    return search.by_ids(T(spark, folder, "part"), "p_partkey", "3, 7,11").select("p_partkey", "p_name")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc nulls last, o_orderkey limit 10 offset 20")
def search_listing(spark, folder):
    return search.listed(T(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 20, 10, "o_orderdate", "descending")


@query("select c_custkey, c_name from (select * from customer where c_acctbal > 0 order by md5(c_custkey || '|3'), c_custkey limit 15)")
def search_request(spark, folder):
    """A sample with a sort order, which is ignored."""
    return search.asked(T(spark, folder, "customer"), "c_custkey", filter="c_acctbal:>0", sample=15, seed=3, sort="c_acctbal:desc", select="c_custkey,c_name")


@query("select count(*) > 0 as hit from part where p_size > 49")
def search_probe(spark, folder):
    return search.any_hit(search.filtered(T(spark, folder, "part"), "p_size:>49"))


@query("select p_partkey from part order by md5(p_partkey || '|5'), p_partkey limit 20")
def search_pilot(spark, folder):
    return search.pilot(T(spark, folder, "part").select("p_partkey"), "p_partkey", seed=5)


@query("with e as (select distinct l_orderkey a, l_partkey b from lineitem) select distinct b as node from e where a in (select a from e where b in (1, 2)) and b not in (1, 2)")
def related_works(spark, folder):
    """Parts that share an order with part 1 or 2: one hop back, one forth, new ones only."""
    e = T(spark, folder, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    seeds = spark.createDataFrame([(1,), (2,)], "node bigint")
    return graph.hop(e, graph.hop(e, seeds, True), False).join(seeds, "node", "left_anti")


# Merging by the stricter key, and as a stream.


@query("""with k as (select rec_id, workspace, nullif(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), '') || '|' || coalesce(nullif(lower(found_via), ''), '-') || '|' || coalesce(cast(year as varchar), '-') as k from corpus)
select workspace, k as key, count(*) as n, min(rec_id) as first from k where k is not null group by 1, 2""")
def stricter_key(spark, folder):
    rows = T(spark, folder, "corpus").withColumn("k", corpus.strict_key(F.col("title"), F.lower("found_via"), F.col("year"))).where("k is not null")
    return rows.groupBy("workspace", F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first"))


@query("""with s as (select * from corpus where key is not null and workspace is not null)
select workspace, key, arg_min(title, rec_id) filter (title <> '') as title, arg_min(year, rec_id) filter (year <> 0) as year, max(coalesce(cited_by, 0)) as cited_by, arg_min(role, rec_id) filter (role <> '') as role from s group by 1, 2""")
def streaming_upsert(spark, folder):
    """The corpus as a stream of files, each of which is a micro-batch, merged bucket by bucket."""
    c = T(spark, folder, "corpus").where("key is not null and workspace is not null").select("rec_id", "workspace", "key", "ids", "title", "year", "cited_by", "found_via", "screening", "fulltext", "role")
    source = table_path(spark, "stream")
    bounds = [r for r in c.agg(F.expr("percentile_disc(array(0.0, 0.34, 0.67, 1.0)) within group (order by rec_id)").alias("q")).first().q or []]
    for since, until in zip(bounds, bounds[1:], strict=False):
        part = c.where((F.col("rec_id") >= since) & (F.col("rec_id") < until if until < bounds[-1] else F.col("rec_id") <= until))
        part.coalesce(1).write.mode("append").parquet(source)
    done = CorpusTable(spark, table_path(spark, "table"), ["workspace", "key"], ["rec_id"], buckets=8)
    if bounds:
        stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start(stream, done, table_path(spark, "check")).awaitTermination()
    return (done.read() if bounds else c.limit(0)).select("workspace", "key", "title", "year", "cited_by", "role")


# Statistics.


@query("""with g as (select l_returnflag = 'R' a, l_extendedprice v from lineitem), s as (select count(v) filter (a) n1, count(v) filter (not a) n2, avg(v) filter (a) m1, avg(v) filter (not a) m2, var_samp(v) filter (a) s1, var_samp(v) filter (not a) s2 from g)
select n1, n2, round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 4) as welch_t, round(pow(s1 / n1 + s2 / n2, 2) / (pow(s1 / n1, 2) / (n1 - 1) + pow(s2 / n2, 2) / (n2 - 1)), 2) as welch_df,
round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4) as student_t, n1 + n2 - 2 as student_df from s""")
def t_test(spark, folder):
    r = stats.t_test(T(spark, folder, "lineitem"), F.col("l_returnflag") == "R", "l_extendedprice")
    return r.select("n1", "n2", F.round("welch_t", 4).alias("welch_t"), F.round("welch_df", 2).alias("welch_df"), F.round("student_t", 4).alias("student_t"), "student_df")


@query("""with g as (select o_orderpriority g, count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) * count(*) w from orders group by 1), t as (select count(*) k, sum(n) nn, sum(w) ww, sum(n * m) / sum(n) mm from g), b as (select sum(n * pow(m - mm, 2)) b from g, t)
select round(b / (k - 1) / (ww / (nn - k)), 3) as f, k - 1 as df1, cast(nn - k as bigint) as df2, round(b / (b + ww), 6) as eta2 from t, b""")
def anova(spark, folder):
    r = stats.anova(T(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
    return r.select(F.round("f", 3).alias("f"), "df1", "df2", F.round("eta2", 6).alias("eta2"))


@query("""with c as (select count(*) filter (e and o) a, count(*) filter (e and not o) b, count(*) filter (not e and o) c, count(*) filter (not e and not o) d from (select l_discount > 0.05 e, l_returnflag = 'R' o from lineitem)), r as (select *, a * d * 1.0 / (b * c) r, 1.959963984540054 * sqrt(1.0/a + 1.0/b + 1.0/c + 1.0/d) h from c)
select a, b, c, d, round(r, 6) as odds_ratio, round(exp(ln(r) - h), 6) as low, round(exp(ln(r) + h), 6) as high from r""")
def odds_ratio(spark, folder):
    r = stats.odds_ratio(T(spark, folder, "lineitem"), F.col("l_discount") > 0.05, F.col("l_returnflag") == "R")
    return r.select("a", "b", "c", "d", *(F.round(c, 6).alias(c) for c in ("odds_ratio", "low", "high")))


@query("select l_returnflag as flag, count(l_quantity) as n, round(avg(l_quantity), 4) as mean, round(avg(l_quantity) - 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) as low, round(avg(l_quantity) + 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) as high from lineitem group by 1")
def mean_interval(spark, folder):
    r = stats.mean_interval(T(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity")
    return r.select("flag", "n", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query("select p_size, cast(ceil(2 * pow(1.959963984540054 + 0.8416212335729143, 2) / pow(p_size / 100.0, 2)) as bigint) as n from (select distinct p_size from part) where p_size > 0")
def power_sample_size(spark, folder):
    sizes = T(spark, folder, "part").select("p_size").distinct().where("p_size > 0")
    return sizes.select("p_size", stats.sample_size(F.col("p_size") / 100).alias("n"))


_RANKS = "r as (select g, v, (rank() over (order by v) + rank() over (order by v) + count(*) over (partition by v) - 1) / 2.0 as r, count(*) over (partition by v) t from {0})"


@query("with x as (select l_returnflag = 'R' g, l_quantity v from lineitem), " + _RANKS.format("x") + """, t as (select sum(pow(t, 3) - t) ties from (select v, any_value(t) t from r group by v)), n as (select count(*) filter (g) n1, count(*) filter (not g) n2, sum(r) filter (g) r1 from r)
select n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 1) as u, round((r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 4) as z from n, t""")
def mann_whitney(spark, folder):
    r = stats.mann_whitney(T(spark, folder, "lineitem"), "l_returnflag", "R", "l_quantity")
    return r.select("n1", "n2", F.round("u", 1).alias("u"), F.round("z", 4).alias("z"))


@query("with x as (select o_orderpriority g, round(o_totalprice / 1000) v from orders), " + _RANKS.format("x") + """, t as (select sum(pow(t, 3) - t) ties from (select v, any_value(t) t from r group by v)), k as (select g, count(*) n, sum(r) s from r group by g), q as (select sum(n) n, count(*) k, sum(s * s / n) q from k)
select round((12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)), 4) as h, k - 1 as df from q, t""")
def kruskal_wallis(spark, folder):
    r = stats.kruskal_wallis(T(spark, folder, "orders").withColumn("v", F.round(F.col("o_totalprice") / 1000)), "o_orderpriority", "v")
    return r.select(F.round("h", 4).alias("h"), "df")


@query("with x as (select l_quantity a, l_discount b from lineitem), r as (select (2 * rank() over (order by a) + count(*) over (partition by a) - 1) / 2.0 ra, (2 * rank() over (order by b) + count(*) over (partition by b) - 1) / 2.0 rb from x) select round(corr(ra, rb), 6) as rho from r")
def spearman(spark, folder):
    return stats.spearman(T(spark, folder, "lineitem"), "l_quantity", "l_discount").select(F.round("rho", 6).alias("rho"))


@query("""with e as (select event_type, user_id, avg(value) e, var_samp(value) / count(value) v from events group by 1, 2), w as (select event_type, count(*) k, sum(1 / v) w, sum(e / v) we, sum(e * e / v) wee from e where v > 0 group by 1)
select event_type, k, round(we / w, 5) as pooled, round(wee - we * we / w, 3) as q, round(greatest(0, (wee - we * we / w - (k - 1)) / (wee - we * we / w)) * 100, 3) as i2 from w""")
def heterogeneity(spark, folder):
    e = T(spark, folder, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("e"), F.try_divide(F.var_samp("value"), F.count("value")).alias("v"))
    r = stats.heterogeneity(e, "e", "v", ["event_type"])
    return r.select("event_type", "k", F.round("pooled", 5).alias("pooled"), F.round("q", 3).alias("q"), F.round("i2", 3).alias("i2"))


@query("select screening.reason as theme, count(*) as mentions, count(distinct workspace) as participants, round(count(distinct workspace) * 1.0 / (select count(distinct workspace) from corpus), 6) as share from corpus where screening.reason is not null group by 1")
def theme_prevalence(spark, folder):
    r = stats.prevalence(T(spark, folder, "corpus").select(F.col("screening.reason").alias("theme"), "workspace"), "theme", "workspace")
    return r.select("theme", "mentions", "participants", F.round("share", 6).alias("share"))


@query("""select result_id, contains(lower(title), 'study') or contains(lower(title), 'review') as retracted from epmc_results where title is not null""")
def retraction_marks(spark, folder):
    kind = F.when(F.contains(F.lower("title"), F.lit("study")), "RETRACTED publication").otherwise("Retraction of publication")
    fix = F.when(F.contains(F.lower("title"), F.lit("review")), "Retraction in").otherwise("Retraction of")
    return T(spark, folder, "epmc_results").where("title is not null").select("result_id", citations.marked_retracted(F.array(kind), F.array(F.struct(fix.alias("type")))).alias("retracted"))
