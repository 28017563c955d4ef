"""Query op1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import held_out
from lumen.llm.registry import register, table
from lumen.llm.toxicity import fit, score


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned from four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out(F.col("doc_id"))
    weights = fit(docs, table(spark, sf_dir, "labels"), learn=~fold)
    return score(docs, weights).select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
