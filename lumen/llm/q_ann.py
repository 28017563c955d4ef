"""Query op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.ann import nearest
from lumen.llm.registry import register, table


@register("op7_ann")
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
