"""Queries pN_... of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .encoding import encode
from .history import Neighbourhood, repeats
from .linkage import corpus_year, match, result_year
from .lookalikes import form_sql, same_look
from .packing import pack, token_counts
from .quality import junk, statistics
from .scans import documents, repairs
from .survivors import TRUST, survivor_fields

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor_fields(table(spark, folder, "corpus"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "fulltext_pages").selectExpr("page_id", "fulltext_path as path", "page_no", "page_text as text")
    read = table(spark, folder, "read_paper").where("fulltext_path is not null").select(F.col("fulltext_path").alias("path")).distinct()
    return pages.join(read, "path", "left_semi")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return repairs(_pages(spark, folder))[0]


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(repairs(_pages(spark, folder))[1]).select(F.col("path").alias("fulltext_path"), "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "corpus")
    # The older batches are a first load; the newer ones come in two steps, between which the runs are compacted.
    cuts = corpus.agg(F.expr("percentile_disc(array(0.8, 0.9)) within group (order by batch_no)")).first()[0]
    cuts = sorted(set(cuts or []))
    found = repeats(corpus, list(zip([None, *cuts], [*cuts, None], strict=True)), Neighbourhood(runs=2))
    return found.select(F.least("rec_id", "accepted").alias("rec_id_a"), F.greatest("rec_id", "accepted").alias("rec_id_b"))


def _p4(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "epmc_results").select(F.col("result_id").alias("id"), "title", result_year().alias("year"))
    corpus = table(spark, folder, "corpus").select(F.col("rec_id").alias("id"), "title", corpus_year().alias("year"))
    return match(results, corpus)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p4(spark, folder).select(F.col("right_id").alias("rec_id"), F.col("left_id").alias("result_id"))


def p4_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _p4(spark, folder).select(F.col("right_id").alias("rec_id"), F.col("left_id").alias("result_id"), "score", "confidence", "found_by")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cites, corpus = table(spark, folder, "verify_citations"), table(spark, folder, "corpus")
    return same_look(cites, corpus, "cite_id", "rec_id", "workspace", "title")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_counts(table(spark, folder, "documents"))
    packs = table(spark, folder, "pack_sizes").selectExpr("pack_id as pack", "capacity_tokens as capacity")
    return pack(sizes, packs).selectExpr("pack as pack_id", "capacity", "bin as bin_id", "doc as doc_id", "piece", "start as start_token", "size as n_tokens")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return junk(table(spark, folder, "documents")).select("doc_id")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return statistics(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_texts": p2_texts,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}

_TRUST = " ".join(f"when '{label}' then {weight}" for label, weight in TRUST.items())
_BEST_YEAR = "row_number() over (partition by workspace, key order by round(log2(sum(weight)), 6) desc, max(tier * 4503599627370496 + seen) desc, value desc)"

ORACLE: dict[str, str] = {
    "p1_found": rf"""
with rows as (select workspace, key, year, cited_by,
  list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(found_via, '')), '[\s\p{{Z}}]+', '', 'g'), '+'), lambda x: x <> ''))) vias,
  case when trim(lower(screening.status)) in ('include', 'included') then 'included' when trim(lower(screening.status)) in ('exclude', 'excluded') then 'excluded' end decision,
  coalesce(lower(screening.stage) = 'full_text', false) late, coalesce(epoch_us(seen_at), 0) seen
  from corpus where workspace <> '' and key <> ''),
base as (select workspace, key, year, cited_by, vias, decision, late, seen, count(*) n, pow(2.0, (seen / 86400e6 - 18262) / 1460.0) decay,
  case coalesce(vias[1], '') {_TRUST} else 0.8 end trust,
  coalesce(try_cast(nullif(regexp_extract(key, '^10\..*\.((?:19|20)\d\d)\.', 1), '') as int),
   case when try_cast(nullif(regexp_extract(key, '^10\..*\((\d\d)\)', 1), '') as int) > 40 then 1900 else 2000 end + try_cast(nullif(regexp_extract(key, '^10\..*\((\d\d)\)', 1), '') as int)) stated,
  case when seen > 0 then year(make_timestamp(seen)) + 1 else 9998 end latest from rows group by all),
big as (select workspace, key from base group by 1, 2 having sum(n) >= 2),
years as (select workspace, key, value, max(tier) tier, {_BEST_YEAR} place from (
  select workspace, key, year as value, 1 as tier, seen, trust * decay as weight from base where year between 1500 and latest
  union all select workspace, key, stated, 0, seen, decay * 0.22 from base where stated between 1500 and latest) group by workspace, key, value having max(tier) = 1),
counts as (select workspace, key, arg_max(cited_by, {{'t': cited_by > 0, 's': seen, 'c': cited_by}}) value from base where cited_by between 0 and 1000000 group by 1, 2),
via as (select workspace, key, string_agg(distinct label, '+' order by label) value from (select workspace, key, unnest(vias) label from base) group by 1, 2),
decided as (select workspace, key, arg_max(decision, {{'s': seen, 'f': late, 'd': decision}}) value from base where decision is not null group by 1, 2)
select workspace, key, field, value from big join (
 select workspace, key, 'year' as field, cast(value as varchar) as value from years where place = 1
 union all select workspace, key, 'cited_by', cast(value as varchar) from counts
 union all select workspace, key, 'found_via', value from via
 union all select workspace, key, 'screening', value from decided) using (workspace, key)""",
    "p5_found": f"""
with a as (select cite_id, workspace, title, {form_sql("title")} form from verify_citations), b as (select rec_id, workspace, title, {form_sql("title")} form from corpus)
select cite_id, rec_id from a join b on a.workspace = b.workspace and a.form = b.form and a.title <> b.title where a.form <> ''""",
}
