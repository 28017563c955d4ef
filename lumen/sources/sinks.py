"""Sinks: replace a table, export CSV, summary view, snippet append (K1, K2,
K5, K6). K3 is a stream (lumen.streaming), K4 lives with the models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.exprs import col

# Snippet defaults for absent fields.
SNIPPET_DEFAULTS = {"title": "Untitled", "code": "", "tags": "", "is_favorite": False}
SNIPPET_REQUIRED = ("title", "code")


def save_table(df: DataFrame, name: str, folder: str | None = None) -> str:
    """K1: replace a table of the catalog; returns the version's own name.

    Each version is a table of its own (under ``folder`` if given, else in the
    warehouse), and ``name`` is a view that moves to it once it is complete.
    So a failed write changes nothing, rows may come from the table itself, and
    whoever reads the old version reads it to the end; ``drop_old_versions``
    removes those that are no longer needed. A plain table of that name becomes
    the first version."""
    spark = df.sparkSession
    version = f"{name}__v{uuid.uuid4().hex[:12]}"
    writer = df.write.format("parquet")
    if folder:
        writer = writer.option("path", f"{folder}/{version}")
    writer.saveAsTable(version)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__v0")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    return version


def drop_old_versions(spark: SparkSession, name: str, keep: str) -> list[str]:
    """Drops all versions of a table but one, and returns their names."""
    old = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}__v") and t.name != keep]
    for t in old:
        spark.sql(f"DROP TABLE {t}")
    return old


def export_csv(df: DataFrame, path: str) -> None:
    """K2: rows as CSV with a header and no index; a directory of parts, one
    per task (no single-writer bottleneck). Quotes are doubled, as in pandas."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def create_summary_view(spark: SparkSession, df: DataFrame, name: str = "v_customer_summary") -> DataFrame:
    """K5: (re)create the churn summary view over a table."""
    from lumen.operators.risk import churn_summary
    view = churn_summary(df)
    view.createOrReplaceTempView(name)
    return spark.table(name)


def with_snippet_defaults(df: DataFrame) -> DataFrame:
    """K6 shaping: absent fields take their defaults; an explicit null title
    or code fails as the NOT NULL column would."""
    out = [col("id")] if "id" in df.columns else [F.lit(None).cast("int").alias("id")]
    for name, default in SNIPPET_DEFAULTS.items():
        if name not in df.columns:
            out.append(F.lit(default).alias(name))
        elif name in SNIPPET_REQUIRED:
            out.append(F.when(col(name).isNull(),
                              F.raise_error(F.lit(f"NOT NULL constraint failed: snippet.{name}")))
                       .otherwise(col(name)).alias(name))
        else:
            out.append(col(name).alias(name))
    return df.select(*out)


def insert_snippets(df: DataFrame, path: str) -> None:
    """K6: append snippets to a parquet table."""
    with_snippet_defaults(df).write.mode("append").parquet(path)
