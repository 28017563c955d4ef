"""Table-level sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def standardize_name(name: str) -> str:
    """strip, lower, then space and dash to underscore."""
    return re.sub(r"[ -]", "_", name.strip().lower())


def standardize_names(df: DataFrame) -> DataFrame:
    """S3: rename every column; fail when two names collide afterwards."""
    new = [standardize_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both standardize to {n!r}")
        seen[n] = old
    return df.toDF(*new)


def scan_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A whole table by catalog name, or a parquet path."""
    if "/" in name_or_path or name_or_path.endswith(".parquet"):
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)
