"""From raw documents to packed sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redquill.llm import linededup, mixing, nearcopies, packing, toxicity
from redquill.llm.runtime import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, at the threshold of their language, go."""
    return toxicity.classified(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("not toxic").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; the documents stay."""
    return documents(linededup.remove_lines(docs, carry=("lang", "source")).withColumnRenamed("kept_text", "text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more the one with the smallest id stays; texts without words are a group; rows that share an id are told apart by their texts."""
    return documents(nearcopies.one_of_each(docs, shingle=5, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last time may be cut."""
    return documents(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carry_ids=False, memo_words=250_000)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None  # a trained classifier and hash-ordered streams have no SQL; see tests/llm/test_operators.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
