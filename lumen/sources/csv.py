"""CSV to table with pandas-compatible missing tokens and types.

Spark's own ``inferSchema`` disagrees with pandas on the cases that matter
(``NA`` stays text and turns a numeric column into a string; dates become
timestamps), so the file is read as text and typed in two steps:

1. tokens that pandas reads as missing become null;
2. one aggregate over all columns counts, per column, how many values look
   boolean / integral / numeric; the narrowest type that fits every value
   wins (an integral column with gaps is double, as in pandas; an all-null
   column is double and therefore numeric).

Header names follow pandas: a blank header is ``Unnamed: i`` and a repeated
one ``a.1``, ``a.2``. Of each file the header line is read to the driver.
"""

from __future__ import annotations

import csv
import io
import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.exprs import (BOOLEAN_PATTERN, INTEGER_PATTERN, MISSING_TOKENS, NUMBER_PATTERN,
                                   SPECIAL_FLOAT_PATTERN, col)

SUPPORTED = (".csv",)


def pandas_header(raw: list[str]) -> list[str]:
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(raw):
        name = name if name.strip() else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            cand = f"{name}.{seen[name]}"
            while cand in seen:
                seen[name] += 1
                cand = f"{name}.{seen[name]}"
            seen[cand] = 0
            name = cand
        else:
            seen[name] = 0
        out.append(name)
    return out


def _headers(spark: SparkSession, path: str, nested: bool) -> dict[str, list[str]]:
    """Header line -> the files that begin with it, by file name; one line for
    each file comes to the driver, which has listed the files anyway.

    The first line of a file is the first one of its first block, which one
    task reads in order; ``first`` of a grouped aggregate keeps it."""
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", nested).text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"))
    found = lines.where("start = 0").groupBy("file").agg(F.first("value").alias("line")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: r["file"]):
        out.setdefault(r["line"], []).append(unquote(r["file"]))
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """Type text columns the way pandas' reader would (see module doc)."""
    if not df.columns:
        return df
    aggs = []
    for i, c in enumerate(df.columns):
        x = col(c)
        t = F.trim(x)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(BOOLEAN_PATTERN)).alias(f"b{i}"),
                 F.count_if(t.rlike(INTEGER_PATTERN) & t.try_cast("long").isNotNull()).alias(f"i{i}"),
                 F.count_if(t.rlike(NUMBER_PATTERN) | t.rlike(SPECIAL_FLOAT_PATTERN)).alias(f"d{i}"),
                 F.count_if(x.isNull()).alias(f"z{i}")]
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(df.columns):
        n, b, k, d, z = (row[f"{p}{i}"] for p in "nbidz")
        x = col(c)
        if n == 0:
            out.append(F.lit(None).cast("double").alias(c))
        elif b == n and z == 0:
            out.append((F.lower(x) == "true").alias(c))
        elif k == n and z == 0:
            out.append(F.trim(x).cast("long").alias(c))
        elif d == n:
            t = F.lower(F.trim(x))
            out.append(F.when(t.rlike(SPECIAL_FLOAT_PATTERN), F.lit(None).cast("double"))
                       .otherwise(t.try_cast("double")).alias(c))
        else:
            out.append(x.alias(c))
    return df.select(*out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_csv_table(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = False,
                   **options) -> DataFrame:
    """Header row, pandas missing tokens, inferred types. Unsupported
    extensions are an error, as in the reference.

    Files are split among tasks; with ``multi_line``, for quoted values that
    hold line breaks, each file is one task's. A row with more values than the
    header is an error, one with fewer ends in missing values.

    Files of a folder may differ in their headers: columns are matched by name,
    in the order of the first file (by name), then of those that add some; a
    column that a file lacks is missing in its rows."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext and ext not in SUPPORTED and not _is_folder(spark, path):
        raise ValueError("Unsupported file format. Please upload a CSV or Excel file.")
    headers = _headers(spark, path, bool(options.get("recursiveFileLookup")))
    if not headers:
        return spark.createDataFrame([], "_empty string").limit(0)
    parts = [_read_files(spark, [path] if len(headers) == 1 else files, next(csv.reader(io.StringIO(line))), multi_line, options)
             for line, files in headers.items()]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    text = raw.select(*[F.when(col(c).isin(*MISSING_TOKENS), F.lit(None)).otherwise(col(c)).alias(c)
                        for c in raw.columns])
    return infer_types(text) if infer else text


def _read_files(spark: SparkSession, files: list[str], header: list[str], multi_line: bool, options: dict) -> DataFrame:
    """Files that share a header, as text columns named by it."""
    names = pandas_header(header)
    surplus = "surplus"
    while surplus in names:
        surplus += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, surplus]])
    reader = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
              .option("multiLine", multi_line).option("escape", '"'))
    for k, v in options.items():
        reader = reader.option(k, v)
    too_long = F.raise_error(F.lit(f"a row has more than {len(names)} values"))
    return reader.csv(files).where(F.when(col(surplus).isNull(), True).otherwise(too_long)).drop(surplus)
