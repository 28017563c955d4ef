"""Breached-secret and breached-address lookups.

The reference sends the first five hex digits of a secret's SHA-1 to a
remote range service and scans the answer for the other 35. Here the range
table is built from a corpus with Spark and the lookup is an equi-join on
(prefix, suffix), so a batch of secrets is checked in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# SHA-1 hex split as the range protocol splits it.
PREFIX_LEN = 5
SUFFIX_LEN = 35
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def sha1_upper(c: Column) -> Column:
    return F.upper(F.sha1(c.cast("binary")))


def hash_corpus(df: DataFrame, c: str) -> DataFrame:
    """(prefix, suffix, count) over the SHA-1 of every non-null value.
    The grouped count combines map-side, so a repeated secret is cheap."""
    h = sha1_upper(F.col(c))
    return (df.where(F.col(c).isNotNull())
            .select(F.substring(h, 1, PREFIX_LEN).alias("prefix"),
                    F.substring(h, PREFIX_LEN + 1, SUFFIX_LEN).alias("suffix"))
            .groupBy("prefix", "suffix").agg(F.count(F.lit(1)).alias("count")))


def write_hash_corpus(corpus: DataFrame, path: str) -> None:
    """Persist the range table partitioned by the first two hex digits and
    sorted by prefix, so that a lookup for a few secrets reads a few
    directories and, in their files, a few row groups."""
    (corpus.withColumn("p2", F.substring("prefix", 1, 2)).hint("rebalance", "p2")
     .sortWithinPartitions("p2", "prefix").write.mode("overwrite").partitionBy("p2").parquet(path))


def read_hash_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The range table. Its schema is given: Spark would read prefixes that
    happen to be digits as numbers."""
    return spark.read.schema("prefix string, suffix string, count long, p2 string").parquet(path)


# Prefixes that go into the scan of the range table as literals.
PUSHED_PREFIXES = 1000


def _asked_ranges(keyed: DataFrame, corpus: DataFrame) -> DataFrame:
    """The part of a partitioned range table that the secrets can hit: the
    directories of their first two digits (256 at most), and within them the
    ranges of their prefixes where these are few.

    A join does not do this: Spark prunes partitions at run time for a side it
    broadcasts, and of a left join it can only broadcast the range table."""
    few = [r["prefix"] for r in keyed.select("prefix").distinct().limit(PUSHED_PREFIXES + 1).collect() if r["prefix"]]
    if len(few) <= PUSHED_PREFIXES:
        return corpus.where(F.col("p2").isin(sorted({p[:2] for p in few})) & F.col("prefix").isin(sorted(few)))
    digits = [r["p2"] for r in keyed.select(F.substring("prefix", 1, 2).alias("p2")).distinct().collect() if r["p2"]]
    return corpus.where(F.col("p2").isin(sorted(digits)))


def secret_exposure(secrets: DataFrame, corpus: DataFrame, c: str = "secret") -> DataFrame:
    """Breached flag and count per secret; an empty or null secret is an
    error. Of a range table written by ``write_hash_corpus`` only the ranges
    of the secrets are read."""
    s = F.col(c)
    h = sha1_upper(s)
    keyed = secrets.select(
        F.when(s.isNull() | (s == ""), F.raise_error(F.lit("Password cannot be empty"))).otherwise(s).alias(c),
        F.substring(h, 1, PREFIX_LEN).alias("prefix"),
        F.substring(h, PREFIX_LEN + 1, SUFFIX_LEN).alias("suffix"))
    if "p2" in corpus.columns:
        corpus = _asked_ranges(keyed, corpus).drop("p2")
    hit = keyed.join(corpus, ["prefix", "suffix"], "left")
    n = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return hit.select(c, (n > 0).alias("breached"), n.alias("count"))


def extract_emails(df: DataFrame, c: str = "text") -> DataFrame:
    """Distinct e-mail addresses found in a text column (whole texts)."""
    return (df.select(F.explode(F.regexp_extract_all(F.col(c), F.lit(EMAIL_PATTERN), 0)).alias("email"))
            .distinct())


def email_exposure(emails: DataFrame, breaches: DataFrame) -> DataFrame:
    """Breached flag and the sorted list of breach names per address.
    Breach names are grouped first (bounded per address, merged map-side)."""
    names = breaches.groupBy("email").agg(F.sort_array(F.collect_set("breach")).alias("b"))
    j = emails.join(names, "email", "left")
    b = F.coalesce(F.col("b"), F.array().cast("array<string>"))
    return j.select("email", (F.size(b) > 0).alias("breached"),
                    F.array_join(b, ", ").alias("breaches"), F.size(b).cast("long").alias("n_breaches"))
