"""Rule findings over a stream of documents: stateless, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from redquill.plans.rules import rule_findings
from redquill.sources.blocks import blocks_from_text


def stream_findings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return rule_findings(blocks_from_text(spark.readStream.schema(schema).parquet(path)))
