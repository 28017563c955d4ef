"""Query op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.llm.mixing import mix
from lumen.llm.registry import register, table


@register("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and the sample of documents for tempered sources, languages and
    topics."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")
