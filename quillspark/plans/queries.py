"""Queries of the core over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import citations, corpus, graph, prose, scores, search
from ..session import table as T

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


SLUG = "nullif(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), '')"
KEY = f"""coalesce(nullif(lower(ids['doi']), ''), {SLUG}, 'arxiv:' || nullif(ids['arxiv'], ''), 'pmcid:' || nullif(ids['pmcid'], ''),
 'pmid:' || nullif(ids['pmid'], ''), 'openalex:' || nullif(ids['openalex'], ''))"""
SP = r"\t\n\x{000b}\f\r \x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    return T(spark, folder, "corpus").withColumn("key", text.dedup_key(F.element_at("ids", "doi"), F.col("title"), F.col("ids")))


@query(f"select rec_id, {KEY} as key, {KEY} is null as dropped from corpus")
def dedup_key(spark, folder):
    return _keyed(spark, folder).select("rec_id", "key", F.col("key").isNull().alias("dropped"))


def _merge_sql(order: str) -> str:
    return f"""
with r as (select *, {KEY} as k, {order} as o from corpus), s as (select * from r where k is not null and workspace is not null),
l as (select workspace, k, lab, min(o) o, arg_min(p, o) p from (select workspace, k, o, unnest(string_split(found_via, '+')) lab, generate_subscripts(string_split(found_via, '+'), 1) p from s) where lab <> '' group by all),
v as (select workspace, k, string_agg(lab, '+' order by o, p) found_via from l group by all),
i as (select workspace, k, e.key n, arg_max(e.value, o) val from (select workspace, k, o, unnest(map_entries(ids)) e from s) where e.value <> '' group by all),
j as (select workspace, k, string_agg(n || '=' || val, ',' order by n) ids from i group by all)
select s.workspace, s.k as key, arg_min(title, o) filter (title <> '') as title, arg_min(year, o) filter (year <> 0) as year, max(coalesce(cited_by, 0)) as cited_by,
 arg_min(fulltext, o) filter (fulltext <> '') as fulltext, arg_min(role, o) filter (role <> '') as role,
 coalesce(arg_min(screening.status, o) filter (screening.status <> ''), nullif(arg_min_null(screening.status, o), '')) as status,
 case when bool_or(coalesce(screening.status <> '', false)) then arg_min_null(screening.stage, o) filter (screening.status <> '') else arg_min_null(screening.stage, o) end as stage,
 case when bool_or(coalesce(screening.status <> '', false)) then arg_min_null(screening.reason, o) filter (screening.status <> '') else arg_min_null(screening.reason, o) end as reason, any_value(v.found_via) as found_via, any_value(j.ids) as ids
from s left join v using (workspace, k) left join j using (workspace, k) group by s.workspace, s.k"""


def _flat(merged: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.transform(F.map_entries("ids"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return merged.select("workspace", "key", "title", "year", "cited_by", "fulltext", "role", text.some(F.col("screening.status")).alias("status"), "screening.stage", "screening.reason", "found_via", F.array_join(pairs, ",").alias("ids"))


@query(_merge_sql("rec_id"))
def corpus_merge(spark, folder):
    return _flat(corpus.merge(_keyed(spark, folder), ["workspace", "key"], ["rec_id"]))


_MEDIAN = "(select quantile_disc(batch_no, 0.5) from corpus)"


@query(_merge_sql(f"{{'b': case when batch_no <= {_MEDIAN} then 0 else 1 end, 'r': rec_id}}"))
def corpus_upsert_resume(spark, folder):
    """The older half of the batches is the corpus, the rest, rows without batch among them, comes in."""
    rows = _keyed(spark, folder)
    middle = rows.agg(F.expr("percentile_disc(0.5) within group (order by batch_no)")).first()[0]
    old = F.coalesce(F.col("batch_no") <= F.lit(middle).cast("int"), F.lit(False))
    return _flat(corpus.upsert(rows.where(old), rows.where(~old), ["workspace", "key"], ["rec_id"]))


@query("select coalesce(nullif(found_via, ''), 'unknown') as source, count(*) as n from corpus group by 1")
def records_by_source(spark, folder):
    return corpus.by_source(T(spark, folder, "corpus"))


@query("select coalesce(nullif(screening.reason, ''), 'unspecified') as reason, count(*) as n from corpus where screening.status = 'excluded' group by 1")
def prisma_excluded_by_reason(spark, folder):
    return corpus.excluded_by_reason(T(spark, folder, "corpus"))


_FLOW = """count(*) as after_dedup, count(*) filter (screening.status <> '') as screened, count(*) filter (screening.status = 'excluded') as excluded,
count(*) filter (screening.status = 'included') as included, count(*) filter (screening.status = 'included' and fulltext is distinct from 'fulltext') as not_retrieved,
count(*) filter (screening.status = 'included' and fulltext = 'fulltext') as in_synthesis,
count(*) filter (screening.status = 'excluded' and coalesce(screening.reason, '') = '') = 0 as passes from corpus"""


@query(f"select {_FLOW}")
def prisma_flow(spark, folder):
    return corpus.flow(T(spark, folder, "corpus"))


@query(f"select workspace, {_FLOW} group by workspace")
def prisma_gate(spark, folder):
    return corpus.flow(T(spark, folder, "corpus"), "workspace")


@query("""select workspace, key, count(distinct s) as sources from (select workspace, key, regexp_replace(unnest(string_split(lower(found_via), '+')), '\\s', '', 'g') s from corpus)
where s <> '' group by workspace, key having count(distinct s) >= 3""")
def triangulation(spark, folder):
    return corpus.triangulated(T(spark, folder, "corpus"), ["workspace", "key"])


ROUTES = ("cached", "user_pdf", "epmc", "arxiv_pdf", "oa_pdf", "openalex_abstract", "none")


@query(f"""select workspace, rec_id, read_id, status, source, fulltext_path from read_paper
qualify row_number() over (partition by workspace, rec_id order by coalesce(nullif(list_position({list(ROUTES)}, source), 0), 8), read_id) = 1""")
def fulltext_route(spark, folder):
    return corpus.best_route(T(spark, folder, "read_paper"), ["workspace", "rec_id"], ROUTES)


_DOI = rf"""nullif(rtrim(regexp_extract(raw, '10\.[0-9]{{4,9}}/[^{SP}"''<>]+', 0), '.,;:)]}}'), '')"""


@query(f"select cite_id, {_DOI} as doi from verify_citations")
def doi_extract(spark, folder):
    return T(spark, folder, "verify_citations").select("cite_id", text.doi_in(F.col("raw")).alias("doi"))


@query("select cite_id, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')) as plain from verify_citations")
def title_normalize(spark, folder):
    return T(spark, folder, "verify_citations").select("cite_id", text.plain_title(F.col("title")).alias("plain"))


@query(r"""select rec_id, coalesce(nullif(regexp_replace(regexp_replace(ids['doi'], '[^A-Za-z0-9._-]', '_', 'g'), '^\.+', '_'), ''), '_') as safe,
nullif(regexp_extract('https://example.org/' || ids['pmcid'], 'PMC[0-9]+', 0), '') as pmcid,
nullif(list_extract(string_split(rtrim('https://example.org/' || ids['pmid'] || '/', '/'), '/'), -1), '') as pmid,
case when lower('10.48550/arXiv.' || ids['arxiv']) like '10.48550/arxiv.%' then substr('10.48550/arXiv.' || ids['arxiv'], 16) end as arxiv from corpus""")
def identifier_normalize(spark, folder):
    id_ = lambda name: F.element_at("ids", name)
    site = F.lit("https://example.org/")
    return T(spark, folder, "corpus").select(
        "rec_id",
        text.path_safe(id_("doi")).alias("safe"),
        text.pmcid_in(F.concat(site, id_("pmcid"))).alias("pmcid"),
        text.last_segment(F.concat(site, id_("pmid"), F.lit("/"))).alias("pmid"),
        text.arxiv_of_doi(F.concat(F.lit("10.48550/arXiv."), id_("arxiv"))).alias("arxiv"),
    )


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>?', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) as plain from documents")
def html_tag_strip(spark, folder):
    return T(spark, folder, "documents").select("doc_id", text.without_tags(F.col("text")).alias("plain"))


@query("""with w as (select doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as w, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) as p from documents)
select doc_id, string_agg(w, ' ' order by p, w) as abstract from w group by doc_id""")
def inverted_index_build_restore(spark, folder):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    places = T(spark, folder, "documents").select("doc_id", F.posexplode(words).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", text.restored_abstract(F.col("index")).alias("abstract"))


def _sides(spark, folder):
    """Works, with what marks a retracted one; results of the second source; notices; articles."""
    c, e = T(spark, folder, "corpus"), T(spark, folder, "epmc_results")
    gone = F.coalesce(F.col("screening.reason") == "retracted", F.lit(False))
    works = c.select(F.element_at("ids", "doi").alias("doi"), F.col("title").alias("matched_title"), F.element_at("ids", "pmid").alias("pmid"), gone.alias("retracted"), F.col("rec_id").alias("ord"))
    results = e.select("doi", F.col("title").alias("matched_title"), "pmid", F.col("result_id").alias("ord"))
    notices = c.where(F.regexp_like(F.lower("title"), F.lit("^(correction|erratum|retraction)"))).select(F.element_at("ids", "doi").alias("updates"))
    kind = F.when(F.contains(F.lower("title"), F.lit("protocol")), "Retracted Publication").otherwise("Journal Article")
    fix = F.when(F.contains(F.lower("title"), F.lit("reply")), "Retraction in").otherwise("Comment in")
    from_works = c.select(F.element_at("ids", "pmid").alias("pmid"), F.array(kind).alias("pub_types"), F.array(F.struct(fix.alias("type"))).alias("corrections"), F.col("rec_id").alias("ord"))
    return works, results, notices, from_works


def _claims(spark, folder):
    return T(spark, folder, "verify_citations").select("cite_id", "doi", "title")


def _resolved(spark, folder):
    works, results, _, _ = _sides(spark, folder)
    return citations.resolve(_claims(spark, folder), works, results)


_RESOLVED = """w as (select rec_id ord, ids['doi'] doi, title, ids['pmid'] pmid, coalesce(screening.reason = 'retracted', false) gone from corpus),
a as (select lower(doi) d, arg_min({'doi': doi, 't': title, 'p': pmid, 'g': gone}, ord) h from w where doi <> '' group by 1),
b as (select lower(doi) d, arg_min({'doi': doi, 't': title, 'p': pmid, 'g': false}, result_id) h from epmc_results where doi <> '' group by 1),
r as (select cite_id, nullif(v.doi, '') doi, nullif(title, '') title, coalesce(a.h, b.h) h, case when a.d is not null then 'openalex' when b.d is not null then 'epmc' end as source
from verify_citations v left join a on lower(nullif(v.doi, '')) = a.d left join b on lower(nullif(v.doi, '')) = b.d)"""
_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
#: The ratio of matching blocks of the pairs of a table ``asked`` (id, x, y): the longest common block, earliest first,
#: then the same to its left and right.  Texts of 200 letters and more aren't covered.
_RATIO = """m as (select id, i, j from (select id, x, y, unnest(range(1, length(x) + 1)) i from asked), unnest(range(1, length(y) + 1)) t(j) where x[i] = y[j]),
runs as (select id, min(i) i, min(j) j, count(*) k from (select id, i, j, i - row_number() over (partition by id, i - j order by i) g from m) group by id, i - j, g),
seg as (select id, 1 as alo, length(x) + 1 as ahi, 1 as blo, length(y) + 1 as bhi, 0 as n from asked
 union all select id, p.alo, p.ahi, p.blo, p.bhi, p.n from (select id, unnest([
  {'alo': alo, 'ahi': b.i, 'blo': blo, 'bhi': b.j, 'n': b.n}, {'alo': b.i + b.n, 'ahi': ahi, 'blo': b.j + b.n, 'bhi': bhi, 'n': 0}]) p
 from (select id, alo, ahi, blo, bhi, max({'n': n, 'a': -i, 'b': -j, 'i': i, 'j': j}) b from (
  select id, alo, ahi, blo, bhi, i + s as i, j + s as j, least(k - s, ahi - i - s, bhi - j - s) n from (
   select seg.id, alo, ahi, blo, bhi, i, j, k, greatest(0, alo - i, blo - j) s from seg join runs on seg.id = runs.id and i < ahi and j < bhi and i + k > alo and j + k > blo)) where n > 0
  group by id, alo, ahi, blo, bhi))),
ratios as (select id, 2.0 * sum(n) / nullif(any_value(length(x) + length(y)), 0) ratio from seg join asked using (id) group by id)"""


@query(f"with {_RESOLVED} select cite_id, doi, title, h.t as matched_title, h.doi as hit_doi, nullif(h.p, '') as hit_pmid, coalesce(h.g, false) as hit_retracted, source from r")
def citation_resolve(spark, folder):
    r = _resolved(spark, folder)
    return r.select("cite_id", text.some(F.col("doi")).alias("doi"), text.some(F.col("title")).alias("title"), "matched_title", "hit_doi", "hit_pmid", "hit_retracted", "source")


@query(f"""with {_RESOLVED}, n as (select cite_id, {_PLAIN("title")} x, {_PLAIN("h.t")} y from r)
select cite_id, coalesce(x <> '' and y <> '' and (contains(x, y) or contains(y, x)), false) as contained from n""")
def citation_contained(spark, folder):
    return _resolved(spark, folder).select("cite_id", citations.contained(F.col("title"), F.col("matched_title")).alias("contained"))


@query(f"""with recursive {_RESOLVED}, asked as (select cite_id id, {_PLAIN("title")} x, {_PLAIN("h.t")} y from r where title <> '' and h.t <> ''), {_RATIO}
select id as cite_id, round(coalesce(ratio, case when x = '' and y = '' then 1.0 else 0.0 end), 9) as ratio, coalesce(x <> '' and y <> '' and (contains(x, y) or contains(y, x) or ratio >= 0.85), false) as matches from asked left join ratios using (id)""")
def citation_similarity(spark, folder):
    both = _resolved(spark, folder).where("title <> '' and matched_title <> ''")
    ratio = markup.similarity(text.plain_title(F.col("title")), text.plain_title(F.col("matched_title")))
    return both.select("cite_id", F.round(ratio, 9).alias("ratio"), citations.titles_match(F.col("title"), F.col("matched_title")).alias("matches"))


#: The first work that has all words of a claim without DOI, by fewest words.
_TITLED = f"""ww as (select ord, doi, title, pmid, gone, list_distinct(list_filter(string_split({_PLAIN("title")}, ' '), lambda q: q <> '')) ws from w where title <> ''),
cw as (select cite_id, title, list_distinct(list_filter(string_split({_PLAIN("title")}, ' '), lambda q: q <> '')) ws from r where doi is null and title is not null),
wt as (select ord, unnest(ws) q from ww), df as (select q, count(*) n from wt group by 1), ct as (select cite_id, unnest(ws) q from cw),
rare as (select cite_id, arg_min(q, {{'n': n, 'q': q}}) q, count(*) k from ct join df using (q) group by 1),
met as (select cw.cite_id, cw.title claim, ww.* from rare join cw using (cite_id) join wt on wt.q = rare.q join ww on ww.ord = wt.ord where rare.k = len(cw.ws) and list_has_all(ww.ws, cw.ws)),
best as (select cite_id, any_value(claim) title, arg_min({{'doi': doi, 't': title, 'p': pmid, 'g': gone}}, {{'n': len(ws), 'o': ord}}) h from met group by 1)"""


_VERDICTS = """select rec_id, case when ids['openalex'] <> '' then lower(title) like 'retraction notice%' end as o,
case when ids['doi'] <> '' then lower(title) like '%retraction%' end as c, case when ids['pmid'] <> '' then screening.reason = 'retracted' is true end as e from corpus"""


def _verdicts(spark, folder):
    has = lambda name: F.element_at("ids", name) != ""
    t = F.lower("title")
    return T(spark, folder, "corpus").select(
        "rec_id",
        F.when(has("openalex"), F.startswith(t, F.lit("retraction notice"))).alias("o"),
        F.when(has("doi"), F.contains(t, F.lit("retraction"))).alias("c"),
        F.when(has("pmid"), (F.col("screening.reason") == "retracted").eqNullSafe(True)).alias("e"),
    )


@query(f"""with v as ({_VERDICTS}) select rec_id, coalesce(o, false) or coalesce(c, false) or coalesce(e, false) as retracted,
coalesce(o, false) or c is not null or e is not null as checked,
case when o then 'openalex' when c then 'crossref' when e then 'europepmc' else nullif(concat_ws('+', case when c is not null then 'crossref' end, case when e is not null then 'europepmc' end), '') end as source from v""")
def retraction_ladder(spark, folder):
    return _verdicts(spark, folder).select("rec_id", F.inline(F.array(citations.retraction(F.col("o"), F.col("c"), F.col("e")))))


_JUDGED = rf"""{_RESOLVED}, {_TITLED},
pairs as (select cite_id id, {_PLAIN("title")} x, {_PLAIN("h.t")} y from r where doi is not null union all select cite_id, {_PLAIN("title")}, {_PLAIN("h.t")} from best),
asked as (select * from pairs where x <> '' and y <> '' and not contains(x, y) and not contains(y, x)), {_RATIO},
same as (select id cite_id, coalesce(x <> '' and y <> '' and (contains(x, y) or contains(y, x) or ratio >= 0.85), false) same from pairs left join ratios using (id)),
hits as (select r.cite_id, r.doi, r.title, case when r.doi is not null then r.h when same.same then best.h end h, case when r.doi is not null then r.source when same.same then 'openalex' end source, coalesce(same.same, false) same
 from r left join best using (cite_id) left join same using (cite_id)),
notices as (select distinct lower(ids['doi']) d from corpus where regexp_matches(lower(title), '^(correction|erratum|retraction)') and ids['doi'] <> ''),
arts as (select ids['pmid'] p, arg_min(contains(lower(title), 'reply') or contains(lower(title), 'protocol'), rec_id) e0, arg_min_null(coalesce(contains(lower(title), 'reply'), false) or coalesce(contains(lower(title), 'protocol'), false), rec_id) e
 from corpus where ids['pmid'] <> '' group by 1),
v as (select hits.*, coalesce(h.g, false) o, case when nullif(h.doi, '') is not null and not contains(h.doi, ',') then notices.d is not null end c, arts.e e from hits left join notices on lower(nullif(h.doi, '')) = notices.d left join arts on nullif(h.p, '') = arts.p),
j as (select cite_id, case when source is null then 'not_found' when o or coalesce(c, false) or coalesce(e, false) then 'retracted'
 when doi is not null and title is not null and nullif(h.t, '') is not null and regexp_extract(title, '10\.[0-9]{{4,9}}/[^{SP}"''<>]+', 0) = '' and not same then 'mismatched' else 'verified' end as status,
 coalesce(nullif(h.doi, ''), doi) as doi, h.t as matched_title, source, source is not null and (o or c is not null or e is not null) as retraction_checked,
 case when source is null then null when o then 'openalex' when c then 'crossref' when e then 'europepmc' else nullif(concat_ws('+', case when c is not null then 'crossref' end, case when e is not null then 'europepmc' end), '') end as retraction_source from v)"""


def _judged(spark, folder):
    return citations.verify(_claims(spark, folder), *_sides(spark, folder), key="cite_id")


@query(f"with recursive {_JUDGED} select cite_id, h.t as matched_title, nullif(h.doi, '') as hit_doi from hits where doi is null")
def citation_title_search(spark, folder):
    works, _, _, _ = _sides(spark, folder)
    claims = _claims(spark, folder).where("doi is null or doi = ''")
    return citations.resolve_titles(claims, works, "cite_id").select("cite_id", "matched_title", "hit_doi")


@query(f"with recursive {_JUDGED} select * from j")
def citation_verdict(spark, folder):
    return _judged(spark, folder)


@query(f"""with recursive {_JUDGED} select count(*) as total, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'mismatched') as mismatched,
count(*) filter (status = 'not_found') as not_found, count(*) filter (status = 'retracted') as retracted, count(*) filter (status = 'verified' and not retraction_checked) as unchecked,
count(*) filter (status = 'verified') = count(*) as passes from j""")
def verification_report(spark, folder):
    return citations.report(_judged(spark, folder).withColumnRenamed("retraction_checked", "checked"))


@query("select rec_id, workspace, year, cited_by from corpus where year > 2015 and cited_by >= 10 and found_via in ('openalex', 'epmc') and title is not null and not coalesce(workspace = 'ws-0042', false)")
def search_filter(spark, folder):
    return search.filtered(T(spark, folder, "corpus"), "year:>2015,cited_by:>=10,found_via:openalex|epmc,has_title:true,workspace:!ws-0042").select("rec_id", "workspace", "year", "cited_by")


@query(r"select rec_id, title from corpus where regexp_matches(lower(title), '\bblood\b') and regexp_matches(lower(title), '\bpressure\b')")
def search_text(spark, folder):
    return search.filtered(T(spark, folder, "corpus"), "title.search:blood pressure").select("rec_id", "title")


@query("""select rec_id, title from corpus where coalesce(contains(lower(title), 'water fluoridation'), false) and (coalesce(contains(lower(title), 'birds'), false) or coalesce(contains(lower(title), 'salmon'), false))
and not coalesce(contains(lower(title), 'comment'), false) and seen_at >= timestamp '2022-01-01' and seen_at < timestamp '2023-12-01'""")
def search_boolean(spark, folder):
    stamp = lambda t: F.to_timestamp(F.lit(t), "yyyyMMddHHmm")
    condition = search.boolean({"ti": ["title"], "all": ["title", "key"]}, 'ti:"water fluoridation" AND (ti:birds OR ti:salmon) ANDNOT ti:comment AND seen:[202201010000 TO 202312010000]', {"seen": lambda a, b: (F.col("seen_at") >= stamp(a)) & (F.col("seen_at") < stamp(b))})
    return T(spark, folder, "corpus").where(condition).select("rec_id", "title")


@query("select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey limit 25 offset 50")
def search_sort_page(spark, folder):
    return search.page(T(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_acctbal:desc", "c_custkey", number=3)


@query("select source as value, count(*) as n from documents group by 1")
def search_group_by(spark, folder):
    return search.grouped(T(spark, folder, "documents"), "source")


@query("select doc_id, source from documents order by md5(doc_id || '|7'), doc_id limit 20")
def search_sample(spark, folder):
    return search.sampled(T(spark, folder, "documents").select("doc_id", "source"), "doc_id", 20, 7)


@query("select p_partkey, p_name, count(*) over () as hits from part where p_size > 10")
def search_select_count(spark, folder):
    found = search.filtered(T(spark, folder, "part"), "p_size:>10")
    # The number of hits is one row, so it is joined rather than computed over one window.
    return search.selected(found, "p_partkey,p_name").crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("hits"))))


def _edges(spark, folder):
    return T(spark, folder, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


@query("select distinct l_orderkey as node from lineitem where l_partkey in (select p_partkey from part where p_size = 1)")
def citation_graph_forward(spark, folder):
    return graph.hop(_edges(spark, folder), T(spark, folder, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), True)


@query("select distinct l_partkey as node from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def citation_graph_backward(spark, folder):
    return graph.hop(_edges(spark, folder), T(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node")), False)


@query("with e as (select distinct l_orderkey o, l_partkey p from lineitem) select x.p as a, y.p as b, count(*) as n from e x join e y on x.o = y.o and x.p < y.p group by 1, 2")
def co_citation(spark, folder):
    return graph.co_cited(_edges(spark, folder))


@query("""with e as (select distinct 'o' || l_orderkey a, 'p' || l_partkey b from lineitem), s as (select 'p' || p_partkey node from part where p_size = 1),
r1 as (select distinct a node from e where b in (select node from s) and a not in (select node from s)),
u as (select b a, a b from e), r2 as (select distinct u.a node from u where u.b in (select node from r1) and u.a not in (select node from s) and u.a not in (select node from r1))
select node, 0 as round from s union all select node, 1 from r1 union all select node, 2 from r2""")
def snowball_new_only(spark, folder):
    e = _edges(spark, folder).select(F.concat(F.lit("o"), "citing").alias("citing"), F.concat(F.lit("p"), "cited").alias("cited"))
    both = e.union(e.select("cited", "citing"))
    seeds = T(spark, folder, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.snowball(both, seeds, rounds=2, forward=True)


_WEIGHTS = {"click": 1, "view": 2, "purchase": 4, "error": 1}
_W = "case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 4 when 'error' then 1 else 0 end"


@query(f"""with e as (select user_id, {_W} w, value v from events)
select user_id, round(coalesce(sum(cast(coalesce(v, 0) * w as decimal(20,6))) / nullif(sum(w), 0), 0), 4) as overall from e group by 1""")
def rubric_weighted_mean(spark, folder):
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _WEIGHTS.items() for x in kv)), F.col("event_type")), F.lit(0))
    return T(spark, folder, "events").groupBy("user_id").agg(F.round(scores.weighted_mean(F.col("value"), weight), 4).alias("overall"))


def _runs(spark, folder):
    passed = F.count_if(F.col("value") >= 20)
    return T(spark, folder, "events").groupBy(F.to_date("ts").cast("string").alias("run")).agg(
        F.count(F.lit(1)).alias("total"), passed.alias("passed"), F.round(F.avg(F.col("value").cast("decimal(20,4)")).cast("double"), 2).alias("average"), F.round(100.0 * passed / F.count(F.lit(1)), 1).alias("pass_rate")
    )


_RUNS = "select cast(cast(ts as date) as varchar) as run, count(*) as total, count(*) filter (value >= 20) as passed, round(sum(cast(value as decimal(20,4)))::double / count(value), 2) as average, round(100.0 * count(*) filter (value >= 20) / count(*), 1) as pass_rate from events group by 1"


@query(_RUNS)
def run_summary(spark, folder):
    return _runs(spark, folder)


@query(f"with r as ({_RUNS}), p as (select run, passed, lag(passed) over (order by run) as previous from r) select run, passed, previous, passed - previous as delta, case when passed > previous then 'up' when passed < previous then 'down' when passed = previous then 'same' end as arrow from p")
def run_trend(spark, folder):
    return scores.trend(_runs(spark, folder).select("run", "passed"), "run", "passed")


@query("""with m as (select event_type as model, round(sum(cast(value as decimal(20,4)))::double / count(value), 2) as average from events group by 1)
select model, average, rank() over (order by average desc) as place, case when average >= 90 then 'Excellent' when average >= 75 then 'Good' when average >= 60 then 'Fair' when average >= 40 then 'Poor' else 'Failing' end as band from m""")
def leaderboard(spark, folder):
    from pyspark.sql import Window

    models = T(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg(F.col("value").cast("decimal(20,4)")).cast("double"), 2).alias("average"))
    return models.select("model", "average", F.rank().over(Window.orderBy(F.desc("average"))).alias("place"), scores.band(F.col("average")).alias("band"))


def _answer():
    """A judge's answer made of a corpus row: bold keys, an equals sign, and an overall score in some rows only."""
    nl, status = F.lit("\n"), F.col("screening.status")
    return F.concat(
        F.lit("**DESIGN_QUALITY**: "), (F.abs(F.coalesce("cited_by", F.lit(0))) % 101).cast("string"), nl, F.lit("DESIGN_QUALITY_REASONING: "), F.coalesce("screening.reason", F.lit("-")), nl,
        F.lit("OUTPUT_STRUCTURE = "), (F.abs(F.coalesce("year", F.lit(0))) % 100).cast("string"), nl, F.lit("MUST_INCLUDE_MET: "), F.coalesce("found_via", F.lit("none")), F.lit(", scope"), nl, F.lit("MUST_INCLUDE_MISSED: none"), nl,
        F.when(F.col("role").isNotNull(), F.concat(F.lit("OVERALL_SCORE: "), (F.abs(F.coalesce("year", F.lit(0))) % 100).cast("string"), F.lit(".5\n"))).otherwise(""),
        F.when(status == "included", "RESULT: PASS").when(status == "excluded", "RESULT: FAIL").otherwise(""),
    )


@query(r"""with j as (select rec_id, abs(coalesce(cited_by, 0)) % 101 as design, abs(coalesce(year, 0)) % 100 as output, role, screening.status s, nullif(trim(coalesce(screening.reason, '-')), '') reason, coalesce(found_via, 'none') via from corpus),
k as (select *, case when role is not null then output + 0.5 else (75.0 * design + 25.0 * output) / 100.0 end as overall from j)
select rec_id, overall, case s when 'included' then 'PASS' when 'excluded' then 'FAIL' end as result, case s when 'included' then true when 'excluded' then false else overall >= 70 end as passed,
cast(design as int) as design, cast(output as int) as output, array_to_string(list_filter(list_transform(list_filter(string_split(via || ', scope', ','), lambda x: trim(x) <> '' and lower(x) <> 'none'), lambda x: trim(x)), lambda x: true), '|') as met, 0 as missed from k""")
def judge_parse(spark, folder):
    rows = T(spark, folder, "corpus").select("rec_id", scores.judged(_answer(), {"DESIGN_QUALITY": 75, "OUTPUT_STRUCTURE": 25}).alias("j"))
    return rows.select("rec_id", "j.overall", "j.result", "j.passed", F.col("j.design_quality.score").alias("design"), F.col("j.output_structure.score").alias("output"), F.array_join("j.met", "|").alias("met"), F.size("j.missed").alias("missed"))


def _audit_sql(pattern: str, most: int) -> str:
    return f"""with p as (select doc_id, unnest(string_split(text, chr(10))) x from documents), h as (select doc_id, len(regexp_extract_all(lower(x), '\\b(?:{pattern})\\b')) h from p where trim(x) <> '')
select doc_id as doc, count(*) as paragraphs, cast(sum(h) as bigint) as hits, count(*) filter (h > {most}) as flagged from h group by 1"""


@query(_audit_sql("potentially|possibly|may|might|seems|could|arguably|perhaps", 2))
def prose_hedging(spark, folder):
    return prose.audit(T(spark, folder, "documents"), "doc_id", "text", prose.HEDGES, 2)


@query(_audit_sql("furthermore|moreover|additionally|it is important to note|it is worth mentioning|interestingly", 0))
def prose_transitions(spark, folder):
    return prose.audit(T(spark, folder, "documents"), "doc_id", "text", prose.TRANSITIONS, 0)


@query(_audit_sql("various|different|multiple|numerous|important|significant|the field|the literature", 0))
def prose_abstractions(spark, folder):
    return prose.audit(T(spark, folder, "documents"), "doc_id", "text", prose.ABSTRACTIONS, 0)


@query(_audit_sql("it can be|it is suggested|it was found|it should be noted", 2))
def prose_voice(spark, folder):
    return prose.audit(T(spark, folder, "documents"), "doc_id", "text", prose.VOICE, 2)


@query("""with p as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') l from documents), q as (select doc_id, unnest(l) x, generate_subscripts(l, 1) place from p),
n as (select doc_id, place, len(list_filter(string_split(x, ' '), lambda w: w <> '')) n from q),
f as (select doc_id, count(n) over w k, max(n) over w - min(n) over w s from n window w as (partition by doc_id order by place rows between 2 preceding and current row))
select doc_id as doc, count(*) filter (k = 3 and s <= 10) as runs from f group by 1""")
def prose_monotony(spark, folder):
    return prose.monotonous(T(spark, folder, "documents"), "doc_id", "text")


@query("""select l_returnflag as flag, o_orderpriority as priority, count(*) as n, count(*) filter (l_discount > 0.05) as hits, round(100.0 * count(*) filter (l_discount > 0.05) / count(*), 3) as rate
from lineitem join orders on l_orderkey = o_orderkey group by grouping sets ((l_returnflag, o_orderpriority), (l_returnflag))""")
def simpson_stratified(spark, folder):
    rows = T(spark, folder, "lineitem").join(T(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag, priority = F.col("l_returnflag"), F.col("o_orderpriority")
    hits = F.count_if(F.col("l_discount") > 0.05)
    sets = rows.groupingSets([[flag, priority], [flag]], flag, priority).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.round(100.0 * hits / F.count(F.lit(1)), 3).alias("rate"))
    return sets.withColumnsRenamed({"l_returnflag": "flag", "o_orderpriority": "priority"})


@query("""with g as (select l_returnflag = 'R' a, l_quantity v from lineitem), s as (select count(v) filter (a) n1, count(v) filter (not a) n2, avg(v) filter (a) m1, avg(v) filter (not a) m2, var_samp(v) filter (a) s1, var_samp(v) filter (not a) s2 from g)
select n1, n2, round(m1, 4) as mean1, round(m2, 4) as mean2, round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)), 4) as d from s""")
def effect_size(spark, folder):
    one = scores.effect_size(T(spark, folder, "lineitem"), F.col("l_returnflag") == "R", "l_quantity")
    return one.select("n1", "n2", *(F.round(c, 4).alias(c) for c in ("mean1", "mean2", "d")))


@query("select l_returnflag as flag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1")
def correlation(spark, folder):
    return T(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("select l_returnflag as flag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def regression(spark, folder):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return T(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("""with c as (select o_orderpriority a, o_orderstatus b, count(*) o from orders group by 1, 2), r as (select a, sum(o) r from c group by 1), k as (select b, sum(o) c from c group by 1), n as (select sum(o) n from c)
select round(sum(pow(coalesce(c.o, 0) - r.r * k.c / n.n, 2) / (r.r * k.c / n.n)), 4) as chi2, (count(distinct r.a) - 1) * (count(distinct k.b) - 1) as df from r cross join k cross join n left join c on c.a = r.a and c.b = k.b""")
def chi_square_stat(spark, folder):
    one = scores.chi_square(T(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")
    return one.select(F.round("chi2", 4).alias("chi2"), "df")


@query("""select r_name as domain, n_name as field, c_mktsegment as topic, count(*) as works from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by rollup (r_name, n_name, c_mktsegment)""")
def topic_rollup(spark, folder):
    nation, region = T(spark, folder, "nation"), T(spark, folder, "region")
    rows = T(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("domain"), F.col("n_name").alias("field"), F.col("c_mktsegment").alias("topic"))
    return rows.rollup("domain", "field", "topic").agg(F.count(F.lit(1)).alias("works"))


@query("""with l as (select 0 as layer, workspace as name, question as body from workspaces where phase = 'synthesis' union all select 1, workspace, methodology from workspaces)
select name, layer, body from l qualify row_number() over (partition by name order by layer) = 1""")
def skill_shadow_resolve(spark, folder):
    w = T(spark, folder, "workspaces")
    own = w.where("phase = 'synthesis'").select(F.col("workspace").alias("name"), F.lit(0).alias("layer"), F.col("question").alias("body"))
    common = w.select(F.col("workspace").alias("name"), F.lit(1).alias("layer"), F.col("methodology").alias("body"))
    return scores.first_of_layers(own.unionByName(common), "name", "layer")


@query("select workspace, phase, d.date as date, d.decision as decision, d.why as why, p as place from (select workspace, phase, unnest(decisions) d, generate_subscripts(decisions, 1) - 1 p from workspaces)")
def project_decisions(spark, folder):
    rows = T(spark, folder, "workspaces").select("workspace", "phase", F.posexplode("decisions").alias("place", "d"))
    return rows.select("workspace", "phase", "d.date", "d.decision", "d.why", F.col("place").cast("bigint").alias("place"))


@query("""with f as (select workspace, screening.reason r, min(batch_no) b from corpus where screening.reason <> '' group by 1, 2), s as (select workspace, b as step, count(*) as new_codes from f group by 1, 2)
select workspace, step, new_codes, cast(sum(new_codes) over (partition by workspace order by step) as bigint) as codes from s""")
def saturation_curve(spark, folder):
    rows = T(spark, folder, "corpus").select("workspace", "batch_no", F.col("screening.reason").alias("reason")).where("reason <> ''")
    return scores.saturation(rows, "workspace", ["batch_no"], "reason").select("workspace", F.col("step.batch_no").alias("step"), "new_codes", "codes")


@query("""with n as (select max(year(loaded_at)) now from corpus), b as (select c.* from corpus c, n where c.year between 1500 and n.now), m as (select max(year) newest from b)
select workspace, count(distinct key) as sources, count(distinct key) filter (year >= newest - 5) as recent, count(distinct key) >= 10 as enough from b, m group by 1""")
def recency_and_volume(spark, folder):
    return corpus.recency(T(spark, folder, "corpus"), ["workspace"])


_BODY = rf"regexp_replace(regexp_replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[{SP}]+', ''), '[{SP}]+$', '')"


@query(rf"""select doc_id, '# ' || source || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || coalesce(lang, '-') || ' text' || chr(10) || chr(10) || chr(10) || '## Part ' || source || chr(10)
|| case when coalesce({_BODY}, '') = '' then '' else chr(10) || chr(10) || {_BODY} end as markdown from documents where source <> ''""")
def jats_to_markdown(spark, folder):
    escape = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    xml = F.concat(
        F.lit("<article xmlns='urn:a'><front><article-title>"), escape(F.col("source")), F.lit("</article-title><abstract><p>"), escape(F.coalesce("lang", F.lit("-"))), F.lit(" <i>text</i></p></abstract></front><body><sec><title>Part <b>"),
        escape(F.col("source")), F.lit("</b></title><p>"), escape(clean), F.lit("</p></sec></body></article>"),
    )
    return T(spark, folder, "documents").where("source <> ''").select("doc_id", markup.jats_markdown(xml).alias("markdown"))


@query(r"""select cite_id, nullif(regexp_replace(coalesce(doi, ''), '["{}\\]', '', 'g'), '') as doi, nullif(regexp_replace(coalesce(title, ''), '["{}\\]', ' ', 'g'), '') as title, 'c' || cite_id as raw from verify_citations""")
def bibtex_parse(spark, folder):
    plain = F.regexp_replace(F.coalesce("title", F.lit("")), r'["{}\\]', " ")
    doi = F.regexp_replace(F.coalesce("doi", F.lit("")), r'["{}\\]', "")
    entry = F.concat(F.lit("@comment{none}\n@article{c"), F.col("cite_id"), F.lit(",\n  title = {First},\n  Title = {{"), plain, F.lit('}},\n  year = 1999,\n  doi = "'), doi, F.lit('"\n}\n'))
    return T(spark, folder, "verify_citations").select("cite_id", F.inline(markup.bib_entries(entry)))
