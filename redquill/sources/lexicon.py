"""Lexicons are input tables; a missing or empty one is an error, never silently no words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LexiconError(ValueError):
    """A lexicon that can't be used."""


def checked(lexicon: DataFrame, name: str) -> DataFrame:
    if lexicon.isEmpty():
        raise LexiconError(f"the lexicon {name} is empty")
    return lexicon


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """w: the distinct, trimmed, lower-cased lines of a text file."""
    return checked(spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w != ''").distinct(), path)


def confusion_table(spark: SparkSession, entries: dict[str, tuple[str, str]], overlay: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """wrong, right, reason; the overlay wins."""
    merged = {k.strip().lower(): v for k, v in {**entries, **(overlay or {})}.items()}
    if not merged:
        raise LexiconError("no confusions")
    return spark.createDataFrame([(k, *v) for k, v in merged.items()], "wrong string, right string, reason string")


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """word, note of a CSV file with exactly this header; of equal words the last counts."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if [c.lstrip("﻿") for c in rows.columns] != ["word", "note"]:
        raise LexiconError("the header must be word,note")
    rows = rows.toDF("word", "note").withColumn("n", F.monotonically_increasing_id())
    if not rows.where("word is null or trim(word) = '' or length(word) > 120 or length(note) > 500").isEmpty():
        raise LexiconError("a row is invalid")
    return rows.groupBy(F.lower(F.trim("word")).alias("key")).agg(F.max_by("word", "n").alias("word"), F.max_by("note", "n").alias("note")).select("word", "note")


def build(words: DataFrame, pattern: str) -> DataFrame:
    """The sorted, distinct, lower-cased words that match ``pattern`` as a whole."""
    return words.select(F.lower(F.trim("w")).alias("w")).where(F.col("w").rlike(f"^(?:{pattern})$")).distinct().orderBy("w")
