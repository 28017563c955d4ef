"""Sums over everything that comes before a row, in an order over all rows.

A window without a key, or with one hot key, sorts its rows in one task.
Here rows are range-partitioned by (key, order) and written, so that each
partition holds one stretch of the order; the sums of whole partitions are
then a small table (partitions plus keys), and windows run inside a stretch
only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.session import written


def sums_before(df: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """df with ``<s>_before`` for each s of sums: its sum over the rows of the
    same ``by`` that come before in ``order`` (0 for the first).

    Rows should differ in (by, order); nulls in ``by`` are a key like others.
    """
    keys = [*by, *order]
    stretch = written(df.sparkSession, df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "__part", F.spark_partition_id()), "stretches")
    parts = stretch.groupBy(*by, "__part").agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), F.col("__part").alias("__at"),
                         *(F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}") for s in sums))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stretch.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    same = reduce(and_, (F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)), F.col("__part") == F.col("__at"))
    return local.join(parts, same).select(
        *df.columns, *((F.col(f"{s}_before") + F.col(f"__{s}")).alias(f"{s}_before") for s in sums))


def roc_auc(pred: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by.., auc, positives, negatives): the exact area under the ROC curve,
    equal scores counting half.

    A label above 0.5 is positive; rows without a label or a score (null or
    NaN) are left out; auc is null where a class is missing. Rows are counted
    per score first, so that a score of a third of all rows is one row a task.
    """
    by = by or []
    s, hit = F.col(score).cast("double"), F.col(label).cast("double") > 0.5
    rows = pred.select(*by, s.alias("__score"), hit.alias("__hit")).where(
        F.col("__hit").isNotNull() & F.col("__score").isNotNull() & ~F.isnan("__score"))
    counts = rows.groupBy(*by, "__score").agg(F.count_if("__hit").alias("pos"), F.count_if(~F.col("__hit")).alias("neg"))
    below = sums_before(counts, by, ["__score"], ["neg"])
    won = F.col("pos").cast("decimal(18,0)") * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(19,0)")
    total = below.groupBy(*by).agg(F.sum(won).alias("__won"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return total.select(*by, F.try_divide(F.col("__won").cast("double"), 2 * pairs).alias("auc"),
                        F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"))
