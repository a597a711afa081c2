"""Analytics of evaluation runs, and statistical summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_items, number_after, some, strip

#: Fixed value: the score from which a run passes.
PASS = 70


def weighted_mean(score: Column, weight: Column) -> Column:
    """Sum of score times weight by the sum of weights; a missing score is 0, and so is a mean without weight."""
    exact = lambda c: c.cast("decimal(20,6)")
    return F.coalesce(F.try_divide(F.sum(exact(F.coalesce(score, F.lit(0)) * weight)), F.sum(exact(weight))), F.lit(0)).cast("double")


def judged(text: Column, rubrics: dict[str, int] | None = None) -> Column:
    """STRUCT<overall, result, passed, reasoning, met, missed, rubric...> of a judge's answer.

    rubrics: weights by key.  Keys may be followed by asterisks or backticks and by
    ':' or '='.  An explicit overall score wins over the weighted mean of the
    rubrics' scores (a missing score is 0, no weight gives 0), an explicit result
    over the passing score.
    """
    rubrics = rubrics or {}
    stated = some(F.regexp_extract(text, r"OVERALL_SCORE[*`]*\s*[:=]\s*([0-9.]+)", 1)).try_cast("double")
    each = {key: number_after(text, key) for key in rubrics}
    weight = sum(rubrics.values())
    mean = sum((each[key] * F.lit(w) for key, w in rubrics.items()), F.lit(0)) / F.lit(float(weight)) if weight else F.lit(0.0)
    overall = F.coalesce(stated, mean)
    result = some(F.regexp_extract(text, r"RESULT:\s*(PASS|FAIL)", 1))
    items = lambda name: list_items(some(F.regexp_extract(text, rf"{name}:\s*([^\n]+)", 1)))
    block = lambda name: some(strip(F.regexp_extract(text, rf"(?s){name}:\s*(.+?)(?:\n\n|\n[A-Z_]+:|\z)", 1)))
    none = F.array().cast("array<string>")
    return F.struct(
        overall.alias("overall"),
        result.alias("result"),
        F.coalesce(result == "PASS", overall >= PASS).alias("passed"),
        justification(text).alias("reasoning"),
        F.coalesce(items("MUST_INCLUDE_MET"), none).alias("met"),
        F.coalesce(items("MUST_INCLUDE_MISSED"), none).alias("missed"),
        *(F.struct(each[key].alias("score"), F.coalesce(block(f"{key}_REASONING"), F.concat(F.lit("Score: "), each[key].cast("string"), F.lit("/100"))).alias("reasoning")).alias(key.lower()) for key in rubrics),
    )


def justification(text: Column) -> Column:
    """Why a judge decided: the overall justification unless it begins with a rubric's name, else the first reasoning,
    else the first justification, else ''."""
    block = lambda name, stop: some(strip(F.regexp_extract(text, rf"(?s){name}:\s*(.+?)(?:\n\n|\n{stop}:|\z)", 1)))
    whole = block("OVERALL_JUSTIFICATION", "RESULT")
    named = F.regexp_like(whole, F.lit(r"^(?:ANALYTICAL|OUTPUT|RESEARCH|DESIGN)"))
    return F.coalesce(F.when(~named, whole), block("REASONING", "[A-Z_]+"), block("JUSTIFICATION", "[A-Z_]+"), F.lit(""))


def difficulty(text: Column) -> Column:
    """The word after 'difficulty:' with a capital; 'Medium' if there is none, as where the label is set in bold."""
    return F.coalesce(F.initcap(some(F.regexp_extract(text, r"(?i)difficulty:\s*(\w+)", 1))), F.lit("Medium"))


def covered(met: Column, missed: Column) -> Column:
    """Share of required items that were met; NULL if none were asked for."""
    return F.try_divide(F.size(met), F.size(met) + F.size(missed))


def trend(runs: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """``runs`` with previous, delta and arrow against the run before (of the same ``by``)."""
    before = Window.partitionBy(*(by or [])).orderBy(order)
    delta = F.col(value) - F.col("previous")
    arrow = F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same")
    return runs.withColumn("previous", F.lag(value).over(before)).withColumn("delta", delta).withColumn("arrow", arrow)


def band(score: Column) -> Column:
    """Excellent, Good, Fair, Poor or Failing by the anchors 90, 75, 60 and 40."""
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Failing")


def effect_size(df: DataFrame, group: Column, value: str) -> DataFrame:
    """One row: the sizes and means of two groups (group true, group false) and Cohen's d."""
    v, a, b = F.col(value), group, ~group
    n1, n2 = F.count_if(a & v.isNotNull()), F.count_if(b & v.isNotNull())
    m1, m2 = F.avg(F.when(a, v)), F.avg(F.when(b, v))
    s1, s2 = F.var_samp(F.when(a, v)), F.var_samp(F.when(b, v))
    pooled = F.sqrt(F.try_divide((n1 - 1) * s1 + (n2 - 1) * s2, n1 + n2 - 2))
    return df.agg(n1.alias("n1"), n2.alias("n2"), m1.alias("mean1"), m2.alias("mean2"), F.try_divide(m1 - m2, pooled).alias("d"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """One row: the chi-square statistic of two categories and its degrees of freedom; NULL is a category."""
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("o"))
    rows, columns = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # A contingency table has as many cells as pairs of categories, however many rows there are.
    full = rows.crossJoin(columns).crossJoin(total).join(cells.withColumnsRenamed({row: "_r", column: "_c"}), F.col(row).eqNullSafe(F.col("_r")) & F.col(column).eqNullSafe(F.col("_c")), "left")
    expected = F.col("r") * F.col("c") / F.col("n")
    return full.agg(
        F.sum(F.pow(F.coalesce("o", F.lit(0)) - expected, 2) / expected).alias("chi2"),
        ((F.count_distinct(F.coalesce(F.col(row), F.lit("\x00"))) - 1) * (F.count_distinct(F.coalesce(F.col(column), F.lit("\x00"))) - 1)).alias("df"),
    )


def first_of_layers(layers: DataFrame, name: str, priority: str) -> DataFrame:
    """One row for each name, from the layer of least priority number: a personal layer shadows a common one."""
    others = [c for c in layers.columns if c != name]
    return layers.groupBy(name).agg(F.min_by(F.struct(*others), priority).alias("_l")).select(name, "_l.*")


def saturation(events: DataFrame, scope: str, order: list[str], code: str) -> DataFrame:
    """(scope, step, new_codes, codes): codes first seen at each step, and so far."""
    firsts = events.groupBy(scope, code).agg(F.min(F.struct(*order)).alias("at"))
    steps = firsts.groupBy(scope, F.col("at").alias("step")).agg(F.count(F.lit(1)).alias("new_codes"))
    sofar = Window.partitionBy(scope).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("codes", F.sum("new_codes").over(sofar))
