"""The store of evaluation runs: detail rows and the overview made of them, reports and their index.

A detail row is one test of one run: (run_id, stamp, model, agent, test_name,
case_text, answer, output, seconds).  Runs are appended and the overview is
computed anew, so that runs written side by side lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.markup import display_name, rounded
from . import scores

#: The score from which a test passes, and the letters of output that a report shows.
THRESHOLD, SHOWN = 70, 5000
#: Agents whose methodology is filed under another name.
METHODOLOGY = {"grant-proposal": "grant-writing", "lateral-thinking": "research-methodology"}


def one_place(value: Column) -> Column:
    """A number rounded to one place as its binary value has it."""
    return rounded(value, F.lit(1))


def details(rows: DataFrame, rubrics: dict[str, int]) -> DataFrame:
    """Detail rows with id, model_version, difficulty, score, passed, threshold, rubrics, met, missed, coverage, details, justification.

    rubrics: weights by name ('research-quality').  NULL answers score 0 and fail.
    """
    keys = {name.replace("-", "_").upper(): w for name, w in rubrics.items()}
    judged = rows.withColumn("_j", scores.judged(F.coalesce("answer", F.lit("")), keys))
    each = F.map_from_entries(F.array(*(F.struct(F.lit(name), F.struct(F.lit(w).alias("weight"), F.col(f"_j.{name.replace('-', '_')}.score").alias("score"), F.col(f"_j.{name.replace('-', '_')}.reasoning").alias("reasoning"))) for name, w in rubrics.items())))
    met, missed = F.col("_j.met"), F.col("_j.missed")
    return judged.select(
        "run_id", "stamp", "model", text.model_version(F.col("model")).alias("model_version"), "agent",
        text.test_id(F.col("model"), F.col("agent"), F.col("test_name"), F.col("run_id")).alias("id"), text.case_slug(F.col("test_name")).alias("test_case"), "test_name",
        scores.difficulty(F.coalesce("case_text", F.lit(""))).alias("difficulty"), one_place(F.col("_j.overall")).alias("score"), F.col("_j.passed").alias("passed"), F.lit(THRESHOLD).alias("threshold"),
        each.alias("rubrics"), met.alias("met"), missed.alias("missed"), scores.covered(met, missed).alias("coverage"),
        F.format_string("Covered %d/%d required elements", F.size(met), F.size(met) + F.size(missed)).alias("details"), F.col("_j.reasoning").alias("justification"), "output", "seconds",
    )


def overview(rows: DataFrame) -> DataFrame:
    """A row for each run of detail rows (run_id, stamp, model, agent, score, passed, id): tests_run, tests_passed, average_score, pass_rate, scores_by_agent.

    scores_by_agent: MAP<agent, ARRAY<score>>, scores in the order of test ids.
    """
    by_agent = rows.groupBy("run_id", "agent").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("s")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", F.transform("s", lambda x: x["score"]))))).alias("scores_by_agent")
    )
    n, passed = F.count(F.lit(1)), F.count_if("passed")
    runs = rows.groupBy("run_id").agg(
        F.min("stamp").alias("stamp"), F.min("model").alias("model"), n.alias("tests_run"), passed.alias("tests_passed"), F.avg(F.col("score").cast("decimal(20,6)")).cast("double").alias("_a"), (F.lit(100.0) * passed / n).alias("_p")
    )
    return runs.join(by_agent, "run_id", "left").select("run_id", "stamp", "model", "tests_run", "tests_passed", one_place(F.col("_a")).alias("average_score"), one_place(F.col("_p")).alias("pass_rate"), "scores_by_agent")


def summary(runs: DataFrame) -> DataFrame:
    """One row over all runs: total_runs, models, agents (distinct, sorted), overall_pass_rate."""
    agents = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("scores_by_agent")))))
    rate = F.coalesce(F.try_divide(F.sum("tests_passed") * 100.0, F.sum("tests_run")), F.lit(0.0))
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), F.array_sort(F.collect_set("model")).alias("models"), agents.alias("agents"), rate.alias("_r")).select("total_runs", "models", "agents", one_place(F.col("_r")).alias("overall_pass_rate"))


def scores_per_agent(rows: DataFrame) -> DataFrame:
    """(run_id, agent, scores): an agent's scores of a run in the order of test ids."""
    return rows.groupBy("run_id", "agent").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "score"))), lambda x: x["score"]).alias("scores"))


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each model; of equal stamps the greatest run id."""
    fields = runs.columns
    return runs.groupBy("model").agg(F.max_by(F.struct(*fields), F.struct("stamp", "run_id")).alias("r")).select("r.*")


def trend(runs: DataFrame) -> DataFrame:
    """Runs in order of stamp and run id with the average before, and what changed.  Runs are few, however many tests they have."""
    before = Window.orderBy("stamp", "run_id")
    delta = F.col("average_score") - F.col("previous")
    return runs.withColumn("previous", F.lag("average_score").over(before)).withColumn("delta", F.round(delta, 1)).withColumn("arrow", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same"))


class Store:
    """Detail rows in a folder partitioned by run, and the overview computed from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        """Add detail rows; a run that is written again replaces itself only."""
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").parquet(f"{self.folder}/details")

    def details(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/details").parquet(f"{self.folder}/details").withColumn("run_id", F.col("run_id").cast("string"))

    def overview(self) -> DataFrame:
        return overview(self.details())


def read_overview(spark: SparkSession, path: str) -> DataFrame:
    """The runs of an overview file; a missing model_version is NULL."""
    run = (
        "run_id string, timestamp string, model string, model_version string, tests_run int, tests_passed int, average_score double, "
        "scores_by_agent map<string,array<double>>, pass_rate double, detail_file string"
    )
    kind = f"schema_version string, runs array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in run.split(', '))}>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.inline("runs"))


#: Fixed value: the layout of a report, which :func:`read_reports` reads.
_REPORT = """# Evaluation Report: {name}

**Agent**: {agent}  
**Model**: {model}  
**Status**: {status}  
**Duration**: {seconds}s

## Scores
| Rubric | Score |
|--------|-------|
{rows}
| **Overall** | **{overall}/100** |

## Must-Include
**Met**: {met}  
**Missed**: {missed}

## Output
```
{output}
```

## Judge Evaluation
{judge}
"""


def reports(rows: DataFrame) -> DataFrame:
    """(model, agent, name, file, report): a Markdown report of each detail row; the output is shown up to a bound."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("rubrics")), lambda e: F.format_string("| %s | %d/100 |", F.initcap(F.replace(e["key"], F.lit("-"), F.lit(" "))), e["value"]["score"])), "\n")
    joined = lambda c: F.coalesce(text.some(F.array_join(c, ", ")), F.lit("None"))
    body = text.filled(
        _REPORT, name=F.col("test_name"), agent=F.col("agent"), model=F.col("model"), status=F.when(F.col("passed"), "PASS").otherwise("FAIL"), seconds=F.format_string("%.1f", "seconds"),
        rows=lines, overall=F.format_string("%.1f", "score"), met=joined("met"), missed=joined("missed"), output=text.clipped(F.col("output"), SHOWN), judge=F.col("justification"),
    )
    file = F.concat_ws("_", F.lower(F.split("model", ":")[0]), "agent", F.concat("test_case", F.lit(".md")))
    return rows.select("model", "agent", F.col("test_name").alias("name"), "stamp", file.alias("file"), body.alias("report"))


def latest_reports(made: DataFrame) -> DataFrame:
    """The newest report of each file; all of them are the history, filed under stamp and file."""
    return made.groupBy("file").agg(F.max_by(F.struct("model", "agent", "name", "stamp", "report"), "stamp").alias("r")).select("file", "r.*")


def history_name(stamp: Column, file: Column) -> Column:
    return F.concat_ws("_", F.date_format(stamp, "yyyyMMdd_HHmmss"), file)


def read_reports(files: DataFrame) -> DataFrame:
    """(file, model, agent, name, status, score) read back from reports (file, report); a missing score is 0."""
    one = lambda pattern: text.strip(F.regexp_extract("report", pattern, 1))
    score = F.coalesce(text.some(one(r"(?s)Overall.*?([0-9]+(?:\.[0-9]+)?)/100")).try_cast("double"), F.lit(0.0))
    return files.select(
        "file", one(r"\*\*Model\*\*:\s*([^\n]+)").alias("model"), one(r"\*\*Agent\*\*:\s*([^\n]+)").alias("agent"), one(r"# Evaluation Report:\s*([^\n]+)").alias("name"),
        one(r"\*\*Status\*\*:\s*(PASS|FAIL)").alias("status"), score.alias("score"),
    )


def report_index(read: DataFrame) -> DataFrame:
    """One row: the number of reports, of passes, and the mean score; zeros for none."""
    return read.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "PASS").alias("passes"), F.coalesce(F.avg(F.col("score").cast("decimal(20,6)")).cast("double"), F.lit(0.0)).alias("average"))


def summary_rows(read: DataFrame) -> DataFrame:
    """The rows of the summary by model, agent and name, each as a line of a Markdown table."""
    line = F.format_string("| %s | %s | %s | %s | %.0f | [%s](%s) |", "model", "agent", "name", F.when(F.col("status") == "PASS", "PASS").otherwise("FAIL"), "score", "file", "file")
    return read.select("model", "agent", "name", line.alias("line")).orderBy("model", "agent", "name")


def methodology(agents: DataFrame, own: DataFrame, skills: DataFrame) -> DataFrame:
    """Agents (agent) with the methodology (name, body) of their own file, else of the skill of that name, else of the
    skill they are filed under; '' if there is none."""
    named = F.create_map(*(F.lit(x) for kv in METHODOLOGY.items() for x in kv))
    a = agents.withColumn("_m", F.coalesce(F.element_at(named, F.col("agent")), F.col("agent")))
    side = lambda df, on, to: df.groupBy(F.col("name").alias(on)).agg(F.min("body").alias(to))
    a = a.join(side(own, "agent", "_o"), "agent", "left").join(side(skills, "agent", "_s"), "agent", "left").join(side(skills, "_m", "_t"), "_m", "left")
    return a.withColumn("methodology", F.coalesce(text.some(F.col("_o")), text.some(F.col("_s")), text.some(F.col("_t")), F.lit(""))).drop("_m", "_o", "_s", "_t")


def rubric_texts(profiles: DataFrame, rubrics: DataFrame) -> DataFrame:
    """(case, texts, dimensions, weight): the rubrics (name, body) of each case's profile (MAP<tier, STRUCT<rubric, weight>>) by tier.

    A rubric without text is left out of the texts, but its weight counts.
    """
    tiers = profiles.select("case", F.explode("profile").alias("tier", "_r")).select("case", "tier", "_r.rubric", "_r.weight")
    bodies = rubrics.groupBy(F.col("name").alias("rubric")).agg(F.min("body").alias("body"))
    full = tiers.join(bodies, "rubric", "left")
    shown = F.when(F.col("body").isNotNull(), F.format_string("--- %s (%d%%) ---\n%s", "rubric", "weight", "body"))
    dimension = F.format_string("%s) **%s** (%d%%)", F.initcap("tier"), display_name(F.col("rubric")), "weight")
    rows = full.select("case", "tier", "weight", shown.alias("shown"), dimension.alias("dimension"))
    packed = rows.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("tier", "shown", "dimension"))).alias("r"), F.sum("weight").alias("weight"))
    texts = F.array_join(F.filter(F.transform("r", lambda x: x["shown"]), lambda t: t.isNotNull()), "\n")
    return packed.select("case", texts.alias("texts"), F.array_join(F.transform("r", lambda x: x["dimension"]), "\n").alias("dimensions"), "weight")
