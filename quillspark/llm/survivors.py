"""Best representative of each duplicate group.

The records of a group are unpivoted to (field, value) rows, each row carries a
vote of source trust times recency decay, the votes are summed per normalised
value, the winner of each field is taken with ``max_by`` and the winners are
pivoted back into one record.

Every step is a hash aggregation with map-side combining on (group, field,
value), so a group that holds a third of all rows is reduced to its distinct
values before anything is shuffled by group alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of votes a source's year gets; preprint servers state the year of the preprint.
TRUST = {
    "epmc": 1.0,
    "openalex": 0.95,
    "snowball:citations": 0.9,
    "snowball:refs": 0.9,
    "arxiv": 0.4,
    "": 0.9,
}


@dataclass(frozen=True)
class Policy:
    """Parameters of the vote.

    trust: weight by normalised source label; other labels get other_trust.
    identifier_trust: weight, for each row, of a year that is part of the key; it
    only supports a year that some row states.
    half_life_days: age at which a year's vote counts half.
    max_citations: a higher citation count is not believable.
    min_year: an earlier publication year is not believable, nor one later
    than the year after the record was seen.
    """

    trust: dict[str, float] = field(default_factory=lambda: dict(TRUST))
    other_trust: float = 0.8
    identifier_trust: float = 0.22
    half_life_days: float = 1460.0
    max_citations: int = 1_000_000
    min_year: int = 1500


def labels(found_via: Column) -> Column:
    """Distinct labels of a '+'-joined list: lower case, without white space, empty ones dropped."""
    clean = F.regexp_replace(F.lower(found_via), r"[\s\p{Z}]+", "")
    return F.array_distinct(F.filter(F.split(clean, r"\+"), lambda x: x != ""))


def decision(status: Column) -> Column:
    """'included' or 'excluded' for any spelling of either, else NULL (undecided)."""
    s = F.trim(F.lower(status))
    return F.when(s.isin("include", "included"), "included").when(s.isin("exclude", "excluded"), "excluded")


def key_year(key: Column) -> Column:
    """Publication year that a DOI-shaped key states, as '.2014.' or '(14)'; NULL if none."""
    four = F.regexp_extract(key, r"^10\..*\.((?:19|20)\d\d)\.", 1)
    two = F.regexp_extract(key, r"^10\..*\((\d\d)\)", 1)
    short = two.try_cast("int")
    return F.coalesce(four.try_cast("int"), F.when(short > 40, short + 1900).otherwise(short + 2000))


def _trust(policy: Policy, source: Column) -> Column:
    pairs = [F.lit(x) for kv in policy.trust.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), source), F.lit(policy.other_trust))


#: Fields by the number that stands for them in the shuffled votes; 0 stands for the group itself.
GROUP, YEAR, CITED_BY, FOUND_VIA, SCREENING = range(5)
_SEPARATOR = "\x00"


def field_votes(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Summed votes of each value of each field of each group: g1, g2, field, value, votes, newest.

    (g1, g2) is a 128-bit hash of workspace and key, which only the row of
    field 0 spells out; that row's votes count the group's rows, copies
    included.  newest orders by tier and then by time, for decisions by time and
    then by tier.  Rows without workspace or key are dropped; '' counts as NULL.
    Copies, rows equal in all voted fields and in ``seen_at``, vote once.
    """
    base = (
        rows.where((F.col("workspace") != "") & (F.col("key") != ""))
        .select(
            "workspace",
            "key",
            "year",
            "cited_by",
            F.coalesce(F.array_join(F.array_sort(labels(F.col("found_via"))), "+"), F.lit("")).alias("vias"),
            decision(F.col("screening.status")).alias("decision"),
            F.coalesce(F.lower(F.col("screening.stage")) == "full_text", F.lit(False)).alias("full"),
            F.greatest(F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(0)), F.lit(0)).alias("seen"),
        )
        .groupBy("workspace", "key", "year", "cited_by", "vias", "decision", "full", "seen")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Weights relative to a fixed moment: their ratios inside a group don't depend on it.
    days = F.col("seen") / 86_400e6 - 18_262  # days since 2020-01-01
    decay = F.pow(F.lit(2.0), days / policy.half_life_days)
    vias = F.filter(F.split("vias", r"\+"), lambda x: x != "")
    source = F.coalesce(F.get(vias, F.lit(0)), F.lit(""))
    latest_year = F.when(F.col("seen") > 0, F.year(F.timestamp_micros("seen")) + 1).otherwise(F.lit(9998))
    believable = lambda y: (y >= policy.min_year) & (y <= latest_year)
    vote = lambda field, value, tier, weight: F.struct(
        F.lit(field).cast("tinyint").alias("field"), value.cast("string").alias("value"), tier.cast("bigint").alias("tier"), weight.alias("weight")
    )
    from_key = key_year(F.col("key"))
    count = F.col("cited_by")
    votes = F.concat(
        F.array(
            vote(GROUP, F.concat_ws(_SEPARATOR, "workspace", "key"), F.lit(0), F.col("n").cast("double")),
            vote(YEAR, F.when(believable(F.col("year")), F.col("year")), F.lit(1), _trust(policy, source) * decay),
            vote(YEAR, F.when(believable(from_key), from_key), F.lit(0), decay * policy.identifier_trust),
            # Counts don't fall: a zero beside positive counts means a source that has none.
            vote(CITED_BY, F.when(count.between(0, policy.max_citations), count), (count > 0), _trust(policy, source) * decay),
            vote(SCREENING, F.col("decision"), F.col("full"), decay),
        ),
        F.transform(vias, lambda v: vote(FOUND_VIA, v, F.lit(0), _trust(policy, v) * decay)),
    )
    return (
        base.select(F.xxhash64("workspace", "key").alias("g1"), F.xxhash64("key", F.lit(1), "workspace").alias("g2"), "seen", F.inline(votes))
        .where(F.col("value").isNotNull())
        .groupBy("g1", "g2", "field", "value")
        .agg(
            F.sum("weight").alias("votes"),
            F.max(F.when(F.col("field") == SCREENING, F.col("seen") * 2 + F.col("tier")).otherwise(F.col("tier") * F.lit(1 << 52) + F.col("seen"))).alias("newest"),
        )
    )


def survivors(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One record per (workspace, key): workspace, key, n_rows, year, cited_by, found_via, screening.

    year: most votes, ties to the newest and then the later year.  cited_by: the
    newest believable count, a positive one before zero.  found_via: all labels,
    sorted and joined by '+'.  screening: the newest decision; of equally new
    ones the one of the later stage, then 'included'.  A field that no row can
    fill is NULL.  Empty input gives an empty result.
    """
    votes = field_votes(rows, policy)
    value, is_ = F.col("value"), lambda field: F.col("field") == field
    # Sums of doubles depend on the order of rows; rounded logarithms don't.
    score = F.round(F.log2("votes"), 6)
    stated = F.col("newest") >= 1 << 52
    pick = lambda which, *order: F.max_by(value, F.when(which, F.struct(*order, value.alias("value"))))
    best = votes.groupBy("g1", "g2").agg(
        F.max(F.when(is_(GROUP), value)).alias("group"),
        F.max(F.when(is_(GROUP), F.col("votes"))).cast("bigint").alias("n_rows"),
        pick(is_(YEAR) & stated, score, F.col("newest")).cast("int").alias("year"),
        pick(is_(CITED_BY), F.col("newest"), score, value.try_cast("bigint").alias("number")).cast("bigint").alias("cited_by"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_(FOUND_VIA), value))), "+").alias("vias"),
        pick(is_(SCREENING), F.col("newest"), score).alias("screening"),
    )
    parts = F.split("group", _SEPARATOR, 2)
    return best.select(parts[0].alias("workspace"), parts[1].alias("key"), "n_rows", "year", "cited_by", F.expr("nullif(vias, '')").alias("found_via"), "screening")


def survivor_fields(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(workspace, key, field, value) of the survivors of groups of two or more rows, as text."""
    best = survivors(rows, policy).where("n_rows >= 2")
    long = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("year", "cited_by", "found_via", "screening")))
    return best.select("workspace", "key", F.inline(long)).where("value is not null")
