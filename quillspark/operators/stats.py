"""Statistics of groups as aggregates: tests of means, variances, ranks and tables, intervals, power, heterogeneity.

Statistics and degrees of freedom are given, not p-values.  NULL values are left
out; where a statistic isn't defined (too few values, no variance) it is NULL.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: quantile of the normal distribution for intervals of 95 %.
Z95 = 1.959963984540054


def t_test(df: DataFrame, group: Column, value: str) -> DataFrame:
    """One row: n1, n2, mean1, mean2, Welch's t and its df, Student's t and its df, of the groups where ``group`` is true and false."""
    v, a, b = F.col(value).cast("double"), group, ~group
    side = lambda g: [F.count(F.when(g, v)), F.avg(F.when(g, v)), F.var_samp(F.when(g, v))]
    names = ["n1", "mean1", "v1", "n2", "mean2", "v2"]
    one = df.agg(*(c.alias(n) for c, n in zip(side(a) + side(b), names, strict=True)))
    e1, e2 = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v2"), F.col("n2"))
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2)
    diff = F.col("mean1") - F.col("mean2")
    welch = F.try_divide(F.pow(e1 + e2, F.lit(2)), F.try_divide(F.pow(e1, F.lit(2)), F.col("n1") - 1) + F.try_divide(F.pow(e2, F.lit(2)), F.col("n2") - 1))
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    return one.select("n1", "n2", "mean1", "mean2", F.try_divide(diff, F.sqrt(e1 + e2)).alias("welch_t"), welch.alias("welch_df"), F.try_divide(diff, spread).alias("student_t"), (F.col("n1") + F.col("n2") - 2).alias("student_df"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: F of the one-way analysis of variance, its two df, and eta squared; NULL is no group."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    g = rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("s")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("total"))
    between = F.col("q") - F.try_divide(F.col("total") * F.col("total"), F.col("n"))
    mean = lambda s, d: F.try_divide(s, d)
    return t.select(
        F.try_divide(mean(between, F.col("k") - 1), mean(F.col("within"), F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"),
        F.try_divide(between, between + F.col("within")).alias("eta2"),
    )


def odds_ratio(df: DataFrame, exposed: Column, outcome: Column) -> DataFrame:
    """One row: the four cells, the odds ratio and its interval of 95 %; NULL if a cell is empty."""
    cell = lambda e, o: F.count_if(e & o)
    one = df.agg(cell(exposed, outcome).alias("a"), cell(exposed, ~outcome).alias("b"), cell(~exposed, outcome).alias("c"), cell(~exposed, ~outcome).alias("d"))
    ratio = F.try_divide(F.col("a") * F.col("d") * F.lit(1.0), F.col("b") * F.col("c"))
    half = Z95 * F.sqrt(sum((F.try_divide(F.lit(1.0), F.col(x)) for x in "bcd"), F.try_divide(F.lit(1.0), F.col("a"))))
    return one.select("a", "b", "c", "d", ratio.alias("odds_ratio"), F.exp(F.ln(F.nullif(ratio, F.lit(0.0))) - half).alias("low"), F.exp(F.ln(F.nullif(ratio, F.lit(0.0))) + half).alias("high"))


def mean_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, low, high): means with intervals of 95 % by the normal distribution."""
    v = F.col(value).cast("double")
    g = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("s"))
    half = Z95 * F.try_divide(F.col("s"), F.sqrt("n"))
    return g.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def sample_size(d: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Cases needed in each of two groups to find a difference of ``d`` standard deviations; NULL for 0."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.ceil(F.try_divide(F.lit(2 * z * z), d * d))


def ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(value, by..., n, rank): mean ranks of values, ties sharing theirs, without ever sorting all rows in one task.

    Rows are counted by value first; the counts before each value are summed
    within ranges of values and then over the ranges.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value"), *by).agg(F.count(F.lit(1)).alias("n"))
    values = rows.groupBy("value").agg(F.sum("n").alias("all")).repartitionByRange("value").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range of values, however many values there are.
    parts = values.groupBy("part").agg(F.sum("all").alias("size")).select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    placed = values.withColumn("before", F.coalesce(F.sum("all").over(inside), F.lit(0))).join(parts, "part")
    rank = F.col("base") + F.col("before") + (F.col("all") + 1) / 2
    return rows.join(placed.select("value", "all", rank.alias("rank")), "value").select("value", *by, "n", "all", "rank")


def mann_whitney(df: DataFrame, group: str, one: str, value: str) -> DataFrame:
    """One row: n1, n2, U of the group ``one`` against all others, and z corrected for ties."""
    rows = df.where(F.col(group).isNotNull()).withColumn("_g", F.col(group) == one)
    r = ranks(rows, value, ["_g"])
    ties = r.groupBy("value").agg(F.any_value("all").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = r.agg(F.sum(F.when(F.col("_g"), F.col("n"))).alias("n1"), F.sum(F.when(~F.col("_g"), F.col("n"))).alias("n2"), F.sum(F.when(F.col("_g"), F.col("n") * F.col("rank"))).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    total = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / F.lit(12.0) * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    return n.crossJoin(ties).select("n1", "n2", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n2") / 2, sd).alias("z"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: H of the rank sums of all groups, corrected for ties, and its df; NULL is no group."""
    r = ranks(df.where(F.col(group).isNotNull()).withColumnRenamed(group, "_g"), value, ["_g"])
    ties = r.groupBy("value").agg(F.any_value("all").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    g = r.groupBy("_g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("s"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    h = F.lit(12.0) / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    return t.crossJoin(ties).select(F.try_divide(h, 1 - F.try_divide(F.col("ties"), F.pow("n", F.lit(3)) - F.col("n"))).alias("h"), (F.col("k") - 1).alias("df"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of the mean ranks of two columns, over rows that have both."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    rx, ry = (ranks(rows, c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    return rows.join(rx, "x").join(ry, "y").agg(F.corr("rx", "ry").alias("rho"))


def heterogeneity(effects: DataFrame, effect: str, variance: str, by: list[str] | None = None) -> DataFrame:
    """(by, k, pooled, q, i2): inverse-variance pooled effect, Cochran's Q and I squared in percent; variances of 0 are left out."""
    rows = effects.where(F.col(variance) > 0).withColumn("_w", F.lit(1.0) / F.col(variance))
    w, e = F.col("_w"), F.col(effect)
    g = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * e).alias("we"), F.sum(w * e * e).alias("wee"))
    q = F.col("wee") - F.try_divide(F.col("we") * F.col("we"), F.col("w"))
    i2 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("k") - 1), q), F.lit(0.0))) * 100
    return g.select(*(by or []), "k", F.try_divide(F.col("we"), F.col("w")).alias("pooled"), q.alias("q"), i2.alias("i2"))


def prevalence(rows: DataFrame, theme: str, participant: str) -> DataFrame:
    """(theme, mentions, participants, share): how often a theme comes up, and with how many of all participants."""
    all_of = rows.agg(F.count_distinct(participant).alias("_n"))
    g = rows.where(F.col(theme).isNotNull()).groupBy(theme).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(participant).alias("participants"))
    return g.crossJoin(F.broadcast(all_of)).select(theme, "mentions", "participants", F.try_divide(F.col("participants") * 1.0, F.col("_n")).alias("share"))
