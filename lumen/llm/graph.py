"""Connected components of large edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest
    node that can be reached.

    Each round hooks every node to its smallest neighbour, shortens the
    resulting trees by pointer jumping, and replaces the edges by those that
    remain between roots, so that a round at least halves the nodes. A hub
    is one key of joins between written tables, which AQE splits; minima are
    aggregated before the shuffle.
    """
    edges = written(spark, edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parents = written(spark, both.groupBy("node").agg(F.least("node", F.min("to")).alias("root")), "parents")
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = written(spark, parents.join(above, "root").select(
                "node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "parents")
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        labels = parents if labels is None else written(spark, labels.join(
            parents.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select(
            "node", F.coalesce("higher", "root").alias("root")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(spark, edges.join(a, "a").join(b, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
