"""Record linkage, the merge aggregate, the incremental upsert and the counts of the screening flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug, some


def merge(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One record for each distinct ``keys``, merging in the order of the columns ``order``.

    title, year, fulltext and role: the first that is neither NULL, '' nor 0;
    cited_by: the greatest, NULL counting as 0; screening: that of the first
    decided record, else of the first; ids: the last value of each name;
    found_via: labels joined by '+' in the order they first appear.  Rows with a
    NULL key are dropped.  ``order`` must tell rows apart.

    Rows, labels and identifiers are reduced in one aggregation by key and name
    before anything is gathered by key, so the size of a key's group doesn't matter.
    """
    rows = records.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_o", F.struct(*order))
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("_o"))).alias(c)
    decided = some(F.col("screening.status")).isNotNull()
    # One table of facts, one shuffle: each row is followed by a row for each label and each identifier.
    label = F.transform(F.split(F.coalesce("found_via", F.lit("")), r"\+"), lambda v, p: F.struct(F.lit(1).alias("kind"), v.alias("name"), p.alias("place"), F.lit(None).cast("string").alias("value")))
    names = F.transform(F.map_entries(F.coalesce("ids", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lit(2).alias("kind"), e["key"].alias("name"), F.lit(0).alias("place"), e["value"].alias("value")))
    facts = F.filter(F.concat(label, names), lambda f: F.when(f["kind"] == 1, f["name"] != "").otherwise(f["value"] != ""))
    own = F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("name"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("value")))
    kept = ["title", "year", "cited_by", "fulltext", "role", "screening"]
    long = rows.select(*keys, "_o", *kept, F.explode(F.concat(own, facts)).alias("_f"))
    is_own = F.col("_f.kind") == 0
    part = long.select(*keys, "_o", *(F.when(is_own, F.col(c)).alias(c) for c in kept), F.col("_f.kind").alias("_kind"), F.col("_f.name").alias("_name"), F.col("_f.place").alias("_p"), F.col("_f.value").alias("_value"))
    named = part.groupBy(*keys, "_kind", "_name").agg(
        first("title", F.col("title") != ""),
        first("year", F.col("year") != 0),
        F.max(F.when(F.col("_kind") == 0, F.coalesce("cited_by", F.lit(0).cast("bigint")))).alias("cited_by"),
        first("fulltext", F.col("fulltext") != ""),
        first("role", F.col("role") != ""),
        F.coalesce(F.min_by("screening", F.when(decided, F.col("_o"))), F.min_by("screening", "_o")).alias("screening"),
        F.min(F.struct("_o", "_p")).alias("_at"),
        F.max_by("_value", "_o").alias("_value"),
    )
    owned = lambda c: F.max_by(c, F.when(F.col("_kind") == 0, F.lit(1))).alias(c)
    via = F.array_sort(F.collect_list(F.when(F.col("_kind") == 1, F.struct("_at", "_name"))))
    ids = F.array_sort(F.collect_list(F.when(F.col("_kind") == 2, F.struct("_name", "_value"))))
    whole = named.groupBy(*keys).agg(*(owned(c) for c in kept), via.alias("_via"), ids.alias("_ids"))
    joined = F.when(F.size("_via") > 0, F.array_join(F.transform("_via", lambda x: x["_name"]), "+"))
    return whole.select(*keys, *kept, joined.alias("found_via"), F.when(F.size("_ids") > 0, F.map_from_entries("_ids")).alias("ids"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Merge ``incoming`` into ``existing``, whose records come first, so that their decisions stay."""
    both = existing.withColumn("_part", F.lit(0)).unionByName(incoming.withColumn("_part", F.lit(1)))
    return merge(both, keys, ["_part", *order])


def strict_key(title: Column, author: Column, year: Column) -> Column:
    """A stricter key than the usual one: title, first author and year; NULL without a title."""
    return F.concat(slug(title), F.lit("|"), F.coalesce(some(author), F.lit("-")), F.lit("|"), F.coalesce(year.cast("string"), F.lit("-")))


def by_source(records: DataFrame) -> DataFrame:
    """(source, n): records of each joined label; missing ones are 'unknown'."""
    return records.groupBy(F.coalesce(some(F.col("found_via")), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def excluded_by_reason(records: DataFrame) -> DataFrame:
    """(reason, n) of excluded records; missing reasons are 'unspecified'."""
    out = records.where("screening.status = 'excluded'")
    return out.groupBy(F.coalesce(some(F.col("screening.reason")), F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flow(records: DataFrame, *by: str) -> DataFrame:
    """The screening flow in one pass: after_dedup, screened, excluded, included, not_retrieved, in_synthesis, passes.

    not_retrieved: included ones whose full text wasn't had, NULL counting as
    not had; passes: every excluded record has a reason.
    """
    included, excluded = F.col("screening.status") == "included", F.col("screening.status") == "excluded"
    had = F.col("fulltext").eqNullSafe("fulltext")
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("after_dedup"),
        F.count_if(F.col("screening.status") != "").alias("screened"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(included).alias("included"),
        F.count_if(included & ~had).alias("not_retrieved"),
        F.count_if(included & had).alias("in_synthesis"),
        (F.count_if(excluded & some(F.col("screening.reason")).isNull()) == 0).alias("passes"),
    )


def triangulated(records: DataFrame, claim: list[str], least: int = 3) -> DataFrame:
    """(claim, sources) with at least ``least`` independent source labels."""
    label = F.explode(F.split(F.regexp_replace(F.lower("found_via"), r"\s", ""), r"\+"))
    rows = records.select(*claim, label.alias("_s")).where("_s <> ''").distinct()
    return rows.groupBy(*claim).agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= least)


def best_route(reads: DataFrame, paper: list[str], priority: tuple[str, ...]) -> DataFrame:
    """The best way a paper's full text was had: the first of ``priority``, then the least read_id."""
    place = F.array_position(F.lit(list(priority)), F.col("source"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(priority) + 1).alias("place"), F.col("read_id"))
    best = F.min_by(F.struct("read_id", "status", "source", "fulltext_path"), rank)
    return reads.groupBy(*paper).agg(best.alias("b")).select(*paper, "b.*")




def recency(records: DataFrame, by: list[str], within: int = 5, enough: int = 10) -> DataFrame:
    """(by, sources, recent, enough): distinct keys, those of the last ``within`` years, and whether there are enough.

    The years count back from the newest believable one: not before 1500 and not
    after the year in which the newest row was loaded.  Rows without such a year
    aren't counted.
    """
    loaded = records.agg(F.max(F.year("loaded_at")).alias("_now"))
    rows = records.join(F.broadcast(loaded), F.col("year").between(F.lit(1500), F.col("_now")))  # one row
    newest = rows.agg(F.max("year").alias("_new"))
    kept = rows.join(F.broadcast(newest))  # one row
    late = F.count_distinct(F.when(F.col("year") >= F.col("_new") - within, F.col("key")))
    return kept.groupBy(*by).agg(F.count_distinct("key").alias("sources"), late.alias("recent"), (F.count_distinct("key") >= enough).alias("enough"))
