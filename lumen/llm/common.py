"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.session import scratch_path


def held_out(key: Column) -> Column:
    """True for the fold whose labels and languages are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row, also when the body
    uses it inside another lambda (Catalyst would inline it there)."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Rows handed to a Python worker at once: texts can be long.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold of long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the cluster's shared folder.

    Cuts the lineage: later stages reread these files, so a lost executor
    never makes them recompute what came before.
    """
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so when
    the driver's garbage is collected, which may be long after."""
    spark.sparkContext._jvm.System.gc()
