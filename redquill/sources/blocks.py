"""Blocks: the units of text that findings are anchored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_from_text(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """One block a line: doc_id, block_id, block_ord, text, kind. Empty lines count in the order but are dropped."""
    body = F.col("text") if text is None else text
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(body, "\n", -1)).alias("block_ord", "text")).where("text != ''")
    return rows.select("doc_id", F.concat(F.lit("document:p"), F.col("block_ord")).alias("block_id"), "block_ord", "text", F.lit("paragraph").alias("kind"))


def inspect(blocks: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_table_cells, n_chars, n_words."""
    return blocks.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"), F.count_if(F.col("kind") == "table_cell").alias("n_table_cells"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))).alias("n_words")
    )
