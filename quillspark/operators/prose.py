"""Audit of prose: hedging, formulaic transitions, abstraction and voice, paragraph lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lexicons of the audit.
HEDGES = ("potentially", "possibly", "may", "might", "seems", "could", "arguably", "perhaps")
TRANSITIONS = ("furthermore", "moreover", "additionally", "it is important to note", "it is worth mentioning", "interestingly")
ABSTRACTIONS = ("various", "different", "multiple", "numerous", "important", "significant", "the field", "the literature")
VOICE = ("it can be", "it is suggested", "it was found", "it should be noted")


def occurrences(text: Column, lexicon: tuple[str, ...]) -> Column:
    """How often phrases of the lexicon stand in the text, as words, in any case."""
    return F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(lexicon) + r")\b"))


def paragraphs(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, place, paragraph): the lines that aren't blank, from 0."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return df.select(F.col(doc).alias("doc"), F.posexplode(kept).alias("place", "paragraph"))


def audit(df: DataFrame, doc: str, text: str, lexicon: tuple[str, ...], most: int) -> DataFrame:
    """(doc, paragraphs, hits, flagged): hits of the lexicon, and paragraphs with more than ``most``."""
    hits = occurrences(F.col("paragraph"), lexicon).cast("bigint")
    return paragraphs(df, doc, text).select("doc", hits.alias("h")).groupBy("doc").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("h").alias("hits"), F.count_if(F.col("h") > most).alias("flagged"))


def monotonous(df: DataFrame, doc: str, text: str, run: int = 3, within: int = 10) -> DataFrame:
    """(doc, runs): places where ``run`` paragraphs in a row differ by at most ``within`` words."""
    words = F.size(F.filter(F.split("paragraph", " "), lambda w: w != ""))
    frame = Window.partitionBy("doc").orderBy("place").rowsBetween(1 - run, 0)
    rows = paragraphs(df, doc, text).select("doc", "place", words.alias("n"))
    seen = rows.select("doc", F.count("n").over(frame).alias("k"), (F.max("n").over(frame) - F.min("n").over(frame)).alias("spread"))
    return seen.groupBy("doc").agg(F.count_if((F.col("k") == run) & (F.col("spread") <= within)).alias("runs"))
