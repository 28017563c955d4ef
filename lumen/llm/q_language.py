"""Query op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import held_out
from lumen.llm.language import identify, learn
from lumen.llm.registry import register, table


@register("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from four folds."""
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"))
    prototypes = learn(docs, allowed=~fold)
    return identify(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", fold.alias("held_out"), F.col("language")["lang"].alias("lang_pred"),
        F.col("language")["score"].alias("score"))
