"""Text quality statistics and a learned rule list that tells prose from lists, tables and junk.

The statistics are built-in SQL expressions.  An ordered rule list is induced
by incremental reduced-error pruning on a bounded sample of labelled documents;
its learned thresholds are exported to a SQL CASE expression, which Spark
applies natively to every document.  Documents carry no label of their own, so
the sample is labelled by :func:`label`, which looks at the make-up of the
lines, something the statistics only see in sum.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Common words of English, German, French and Spanish.
COMMON = {
    "en": "the of and to in a is that for was with were by as on from not be at this are which or an had have has it its their they but we our no than when only how who been more most",
    "de": "der die das und in zu den mit von ist im auf für ein eine einen einem nicht wurde wurden als an auch es sich des dem dass ob wir war sind bei nach über aus um einer werden keine nur zwei wird",
    "fr": "le la les des du de et un une dans est pour sur que qui par au aux en se ne pas ont a été ce cette il plus sont avec nous si aucune deux entre leur ou d l sans",
    "es": "el la los las de del y en un una que se por con para es no su al lo como más fue han si sin sus entre o a esta este ha son está muy dos ninguna tras",
}
#: Most documents in the labelled sample.
SAMPLE = 8000


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


#: Statistics by name, in the order of the table.
FEATURES = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "ended_lines", "common_words", "words_per_line",
    "words_per_stop", "marked_lines", "repeated_lines", "delimiters_per_word", "gaps_per_word", "tags_per_word", "longest_run_ratio",
    "years_per_line", "keyed_lines", "distinct_words",
)


def statistics(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chars, lines, and FEATURES): statistics of each document's whole text.

    words; mean word length; shares of symbols, digits and capitals in the
    characters that are no white space; shares of lines that end in
    punctuation, begin with a list mark, repeat another line or have a key and
    a colon; share of common words of four languages and of distinct words in
    the words; words per line and per sentence end; delimiters (| tab ;), wide
    gaps and tags per word; the longest run without white space as a share of
    the text; years in brackets per line.

    Lines are separated by any line end and blank ones don't count.  NULL,
    empty and blank texts have 0 in every column.  Columns of ``df`` other than
    ``doc`` and ``text`` don't matter.
    """
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?| | |\u0085", "\n")
    base = df.select(F.col(doc).alias("doc"), t.alias("t"))
    base = base.select(
        "doc",
        "t",
        F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\p{Z}\t]+$|^[\p{Z}\t]+", ""))), lambda x: x != "").alias("ls"),
        F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"), F.lit(0)).alias("ws"),
    )
    common = sorted({w for words in COMMON.values() for w in words.split()})
    lines, words = F.size("ls").cast("double"), F.size("ws").cast("double")
    solid = _count(F.col("t"), r"[^\s\p{Z}]")
    among = lambda pattern: _share(F.size(F.filter("ls", lambda x: x.rlike(pattern))), F.col("lines"))
    runs = F.transform(F.split("t", r"[\s\p{Z}]+"), F.length)
    one = base.select(
        "doc",
        "t",
        "ls",
        "ws",
        lines.alias("lines"),
        words.alias("words"),
        solid.alias("solid"),
        F.length("t").cast("double").alias("chars"),
    )
    return one.select(
        F.col("doc").alias(doc),
        "chars",
        "lines",
        "words",
        _share(F.length(F.array_join("ws", "")), F.col("words")).alias("mean_word_length"),
        _share(_count(F.col("t"), r"[^\s\p{Z}\p{L}\p{N}\p{M}]"), F.col("solid")).alias("symbol_ratio"),
        _share(_count(F.col("t"), r"\p{N}"), F.col("solid")).alias("digit_ratio"),
        _share(_count(F.col("t"), r"\p{Lu}"), F.col("solid")).alias("upper_ratio"),
        among(r"""[.!?:…]["'”’»)\]]*$""").alias("ended_lines"),
        _share(F.size(F.filter("ws", lambda w: w.isin(*common))), F.col("words")).alias("common_words"),
        _share(F.col("words"), F.col("lines")).alias("words_per_line"),
        (F.col("words") / (_count(F.col("t"), r"""\p{Ll}["'”’»)\]]*[.!?](?=[\s\p{Z}]|$)""") + 1)).alias("words_per_stop"),
        among(r"^(?:[-–—*+•▪◦·‣]|\[[ xX]\]|\(?\d{1,3}[.)\]]|\(?[a-zA-Z][.)]|\[\d+\]|\|)\s?").alias("marked_lines"),
        _share(F.col("lines") - F.size(F.array_distinct("ls")), F.col("lines")).alias("repeated_lines"),
        _share(_count(F.col("t"), r"(?<=\S)[|\t;]|\s\|"), F.col("words")).alias("delimiters_per_word"),
        _share(_count(F.col("t"), r"\S {2,}\S"), F.col("words")).alias("gaps_per_word"),
        _share(_count(F.col("t"), r"</?[a-zA-Z][^<>]*>|\]\s*(?:AND|OR)\b"), F.col("words")).alias("tags_per_word"),
        _share(F.array_max(runs).cast("double"), F.col("chars")).alias("longest_run_ratio"),
        _share(_count(F.col("t"), r"\((?:19|20)\d\d[a-z]?\)[.,]"), F.col("lines")).alias("years_per_line"),
        among(r"^[^\s:][^:]{0,40}:(?:\s|$)").alias("keyed_lines"),
        _share(F.size(F.array_distinct("ws")).cast("double"), F.col("words")).alias("distinct_words"),
    )


_LIST = re.compile(r"^\s*(?:[-–—*+•▪◦·‣]|\(?\d{1,3}[.)\]]|\(?[a-zA-Z][.)]|\[\d+\])\s")
_CELLS = re.compile(r"(?:^|\s)\|\s.*\s\|(?:\s|$)|^\|-|\S\t.*\t|\S {2,}\S.*\S {2,}\S|^\S+(?:,\S*){3,}$|;.*;.*;")
_CODE = re.compile(r"\.{5,}|</?[a-z][^>]*>|\[(?:ti|ab)\]|^\d{4}-\d\d-\d\d|\S{45,}|^\[\d+\]|^[\W\d\s]+$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_COMMON = {w for words in COMMON.values() for w in words.split()}


def by_lines(text: str) -> int | None:
    """1 for a text made of list items, table rows or junk, 0 for prose, None where that is in doubt.

    Lines are weighed by their length.  Consecutive plain lines are read as one
    paragraph, so hard line breaks don't matter.
    """
    lines = re.split(r"\r\n?|\n", text)
    often = Counter(x.strip() for x in lines)
    odd = prose = doubt = 0
    block: list[str] = []

    def close() -> None:
        nonlocal odd, prose, doubt
        if not block:
            return
        whole = " ".join(block)
        size = len(whole)
        words = _WORD.findall(whole)
        titled = sum(w[0].isupper() for w in words) / max(1, len(words))
        words = [w.lower() for w in words]
        common = sum(w in _COMMON for w in words) / max(1, len(words))
        stops = len(re.findall(r"[^\W\d_][\])\"'’%]*[.!?](?:\s|$)|\][.!?]|\d[)%]?\.(?:\s|$)", whole))
        short = len(block) >= 4 and len(words) <= 4 * len(block)
        if not stops and (short or not words or (len(words) >= 8 and titled > 0.35)):
            odd += size
        elif len(words) >= 8 and common >= 0.12 and (stops >= 1 or len(words) >= 20) and len(words) / max(1, stops) >= 5:
            prose += size
        elif len(block) >= 4 or (len(words) >= 8 and common < 0.06):
            odd += size
        else:
            doubt += size
        block.clear()

    for line in lines:
        plain = line.strip()
        if not plain:
            close()
        elif _LIST.match(line) and len(_WORD.findall(plain)) <= 14 or _CELLS.search(line) or _CODE.search(plain) or often[plain] >= 4:
            close()
            odd += len(plain)
        else:
            block.append(plain)
    close()
    total = odd + prose + doubt
    return 1 if odd > 0.7 * total else 0 if prose > 0.6 * total else None


def by_sentences(text: str) -> int | None:
    """The same by how much of the text lies in sentences: at least six words, one in ten of them common, and a stop."""
    inside = total = 0
    for piece in re.split(r"(?<=[.!?])[\])\"'’”»]*\s+|\n\s*\n", text):
        words = _WORD.findall(piece.lower())
        total += len(piece)
        if len(words) >= 6 and piece.rstrip("\"'’”»)] ")[-1:] in ".!?" and sum(w in _COMMON for w in words) >= 0.1 * len(words):
            inside += len(piece)
    return 0 if inside > 0.7 * total else 1 if inside < 0.15 * total else None


def by_rhythm(text: str) -> int | None:
    """The same by the places of common words: prose has some among any twenty words, lists and tables have stretches without."""
    words = [w in _COMMON for w in _WORD.findall(text.lower())]
    if len(words) < 20:
        return None
    windows = [sum(words[k : k + 20]) for k in range(0, len(words) - 19, 10)]
    share = sum(n >= 2 for n in windows) / len(windows)
    return 0 if share >= 0.8 else 1 if share <= 0.3 else None


def label(text: str | None) -> int | None:
    """What the lines of a text say, 1 for list, table or junk and 0 for prose, unless sentences and rhythm both speak
    against it; None where that is in doubt, and for texts that are NULL, empty or blank."""
    if not text or not text.strip():
        return None
    first = by_lines(text)
    if first is None or by_sentences(text) in (None, first) or by_rhythm(text) in (None, first):
        return first
    return None


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds: (feature, '<=' or '>', value)."""

    tests: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " and ".join(f"{name} {op} {value!r}D" for name, op, value in self.tests)

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for name, op, value in self.tests:
            ok &= (x[name] <= value) if op == "<=" else (x[name] > value)
        return ok


def _candidates(x: pd.DataFrame, cuts: int) -> list[tuple[str, str, float, np.ndarray]]:
    found = []
    for name in x.columns:
        column = x[name].to_numpy()
        for value in np.unique(np.round(np.quantile(column, np.linspace(0, 1, cuts + 1)[:-1]), 4)):
            below = column <= value
            if 0 < below.sum() < len(column):
                found += [(name, "<=", float(value), below), (name, ">", float(value), ~below)]
    return found


def induce(x: pd.DataFrame, y: np.ndarray, cuts: int = 64, seed: int = 7, most: int = 24, least: float = 0.9) -> list[Rule]:
    """Ordered rules for class 1 by incremental reduced-error pruning.

    Until the pruning set speaks against it, a rule is grown on two thirds of
    the rows by FOIL gain, its last tests are dropped while (p - n) / (p + n)
    on the other third doesn't fall, and the rows it covers are removed.  A
    rule worth no more than ``least`` ends the induction.  An empty sample or
    one of a single class gives no rule.
    """
    rules: list[Rule] = []
    random = np.random.default_rng(seed)
    x, y = x.reset_index(drop=True), np.asarray(y, bool)
    while y.any() and not y.all() and len(y) >= 6 and len(rules) < most:
        grow = random.random(len(y)) < 2 / 3
        gx, gy = x[grow].reset_index(drop=True), y[grow]
        if not gy.any():
            break
        covered, tests = np.ones(len(gy), bool), []
        options = _candidates(gx, cuts)
        while (~gy & covered).any() and len(tests) < 6:
            p, n = (gy & covered).sum(), (~gy & covered).sum()
            base = np.log2(p / (p + n))
            best, gain = None, 1e-9
            for option in options:
                now = covered & option[3]
                q = (gy & now).sum()
                if q:
                    g = q * (np.log2(q / now.sum()) - base)
                    if g > gain:
                        best, gain = option, g
            if best is None:
                break
            covered &= best[3]
            tests.append(best[:3])
        px, py = x[~grow], y[~grow]

        def worth(some: list, px: pd.DataFrame = px, py: np.ndarray = py) -> float:
            hit = Rule(tuple(some)).holds(px)
            p, n = (py & hit).sum(), (~py & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        if not tests or worth(tests) <= least:
            break
        rule = Rule(tuple(tests))
        hit = rule.holds(x)
        if not (y & hit).any():
            break
        rules.append(rule)
        x, y = x[~hit].reset_index(drop=True), y[~hit]
    return rules


def case_sql(rules: list[Rule]) -> str:
    """SQL CASE of the ordered rules: the number of the first rule that holds, 0 if none."""
    if not rules:
        return "0"
    return "case " + " ".join(f"when {rule.sql()} then {k}" for k, rule in enumerate(rules, 1)) + " else 0 end"


def drawn(df: DataFrame, doc: str, text: str, sample: int) -> DataFrame:
    """(doc, text) of at most ``sample`` documents that have text, those with the least hash of their id.

    Only ids are counted, filtered and sorted; a hash bound taken from their number
    keeps all but about twice the sample from the sort.  Texts are fetched for the
    ids chosen, whose number the parameter bounds.
    """
    ids = df.where(F.length(F.trim(F.col(text))) > 0).select(doc, F.xxhash64(doc).alias("_h"))
    n = ids.count()
    bound = min(2**63 - 1, 2**64 * 2 * (sample + 100) // max(n, 1) - 2**63)
    some = materialise(ids.where(F.col("_h") <= F.lit(bound)).orderBy("_h", doc).limit(sample).select(doc), "sample")
    # The texts are few enough to be spread, and dear enough to be read side by side.
    return df.select(doc, text).join(F.broadcast(some), doc, "left_semi").repartition(df.sparkSession.sparkContext.defaultParallelism, doc)


def learn(df: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules learned from at most ``sample`` documents, taken in the order of a hash of their id."""
    some = materialise(drawn(df, doc, text, sample), "drawn")

    @F.pandas_udf("int")
    def labelled(texts: pd.Series) -> pd.Series:
        return texts.map(label).astype("Int32")

    rows = statistics(some, doc, text).join(some.select(doc, labelled(text).alias("label")), doc)
    known = rows.where("label is not null").select(*FEATURES, "label").orderBy(*FEATURES).toPandas()
    return induce(known[list(FEATURES)], known["label"].to_numpy() == 1)


def junk(df: DataFrame, doc: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(doc, rule, and the statistics) of the documents that are mainly list, table or junk.

    ``rule`` is the number of the rule that found the document.  Documents
    without a word character or any text are found only if they have some mark:
    NULL, empty and blank texts never are.
    """
    rules = learn(df, doc, text) if rules is None else rules
    stats = statistics(df, doc, text).withColumn("rule", F.expr(case_sql(rules)))
    wordless = (F.col("words") == 0) & (F.col("symbol_ratio") > 0)
    return stats.where((F.col("rule") > 0) | wordless).where("chars > 0 and (words > 0 or symbol_ratio > 0)")
