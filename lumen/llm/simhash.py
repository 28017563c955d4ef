"""SimHash near-duplicates with a pigeonring filter.

A fingerprint of 64 bits is cut into a ring of m = max_bits + 1 segments. If
two fingerprints differ in at most max_bits bits, then some segment starts a
chain around the ring whose first l segments differ in at most
l * max_bits / m bits, for every l. With m segments that means: the first
segment is equal, the first two differ in at most one bit, and so on.

Candidates therefore share the first segment and, but for one bit, the
second: one side of an equi-join lists every fingerprint under its m pairs of
segments, the other also under the pairs with one bit of the second turned.
The rest of the chain and then the full distance are checked inside the join.

Equal fingerprints are one node. Before that join a cheap contraction links
fingerprints that are neighbours in the order of the rotated fingerprints;
the join then looks only for links between different components, so a large
group of near copies yields few rows instead of all its pairs, and no link
between components is lost.

Defined cases: null, empty and blank texts have fingerprint zero; a text of
fewer words than a shingle is one shingle; repeated rows each get their
result; rows with a null id link nothing themselves and get the component of
equal fingerprints, or null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm.common import fresh, small_batches, written
from lumen.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# How far apart in a sorted order the contraction looks for links.
REACH = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all shingles, unsigned."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = list(zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), 65_536):
        hashes = np.array([digest(data[s:e], SEED) for s, e in spans[at:at + 65_536]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(spans), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): fingerprints as signed longs."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(key).alias("id"), run(F.col(text)).alias("fp"))


def _ring(max_bits: int) -> list[list[int]]:
    """Lengths of the ring's segments, from each start on."""
    m = max_bits + 1
    lengths = [64 // m + (i < 64 % m) for i in range(m)]
    return [lengths[i:] + lengths[:i] for i in range(m)]


def _rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _turned(key: Column, flips: Column, start: int) -> Column:
    return F.transform(flips, lambda f: F.struct(F.lit(start).alias("start"), key.bitwiseXOR(f).alias("key")))


def _neighbours(nodes: DataFrame, max_bits: int, reach: int) -> DataFrame:
    """Some of the links: (a, b) of nodes within reach in a sorted order of
    the fingerprints rotated to each segment. Parts are split by range, so a
    large group is spread; links across their borders are left to the join."""
    ring = _ring(max_bits)
    offsets = [sum(ring[0][:i]) for i in range(len(ring))]
    turned = F.explode(F.array(*(F.struct(F.lit(i).alias("start"), _rotated(F.col("fp"), off).alias("turned"))
                                 for i, off in enumerate(offsets)))).alias("t")
    rows = nodes.select("id", turned).select("id", "t.start", "t.turned")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def root(x):
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        tail = None
        for b in batches:
            fresh = 0 if tail is None else len(tail)
            b = b if tail is None else pd.concat([tail, b])
            ids, start, fp = b["id"].to_numpy(), b["start"].to_numpy(), b["turned"].to_numpy().view(np.uint64)
            out = []
            for lag in range(1, min(reach, len(b) - 1) + 1):
                near = (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= max_bits) & (start[lag:] == start[:-lag])
                near[:max(0, fresh - lag)] = False
                for i in np.flatnonzero(near).tolist():
                    x, y = root(int(ids[i])), root(int(ids[i + lag]))
                    if x != y:
                        above[max(x, y)] = min(x, y)
                        out.append((ids[i], ids[i + lag]))
            tail = b.iloc[-reach:]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return (rows.repartitionByRange("start", "turned").sortWithinPartitions("start", "turned")
            .mapInPandas(link, "a long, b long"))


def _links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): every pair of components with fingerprints within max_bits."""
    ring, m = _ring(max_bits), max_bits + 1
    fp = F.col("fp")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    exact, turned = [], []
    for i, lengths in enumerate(ring):
        second = lengths[1] if m > 1 else 0
        key = F.shiftrightunsigned(_rotated(fp, sum(ring[0][:i])), 64 - lengths[0] - second)
        flips = F.array(none, *(F.shiftleft(one, j) for j in range(second)))
        exact.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
        turned.append(_turned(key, flips, i))
    left = nodes.select("fp", "comp", F.inline(F.array(*exact))).alias("l")
    right = nodes.select("fp", "comp", F.inline(F.flatten(F.array(*turned)))).alias("r")
    differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    keep = (F.col("l.comp") < F.col("r.comp")) & (F.bit_count(differ) <= max_bits)
    chain = F.lit(False)
    for i, lengths in enumerate(ring):
        around = _rotated(differ, sum(ring[0][:i]))
        within = F.col("l.start") == i
        for n in range(2, m):
            within &= F.bit_count(F.shiftrightunsigned(around, 64 - sum(lengths[:n]))) <= n * max_bits // m
        chain |= within
    # Turning one bit leads from either of a pair to the other: l < r loses none.
    # Spark sizes both sides as nodes, though they list each node up to 75
    # times: without a hint it may broadcast them.
    return (left.join(right.hint("merge"), (F.col("l.start") == F.col("r.start")) & (F.col("l.key") == F.col("r.key")) & chain & keep)
            .select(F.col("l.comp").alias("a"), F.col("r.comp").alias("b")))


def linked(spark: SparkSession, prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) of each row of prints (id, fp)."""
    nodes = written(spark, prints.dropna().groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    first = components(spark, _neighbours(nodes, max_bits, REACH))
    nodes = written(spark, nodes.join(first.withColumnRenamed("node", "id"), "id", "left").select(
        "fp", F.coalesce("root", "id").alias("comp")), "nodes")
    second = components(spark, _links(nodes, max_bits))
    labels = written(spark, nodes.join(second.withColumnRenamed("node", "comp"), "comp", "left").select(
        "fp", F.coalesce("root", "comp").alias("component_id")), "labels")
    return prints.join(labels, "fp", "left").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id) of each row: fp the fingerprint as a signed
    long, component_id the smallest id that links reach."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, key, text, shingle), "prints")
    return linked(spark, prints, max_bits).withColumnRenamed("id", key)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of docs: that of the smallest id, and of its
    repeated rows that with the smallest text hash. Rows with a null id stay."""
    spark = docs.sparkSession
    found = near_duplicates(docs, key, text, shingle, max_bits)
    keep = written(spark, found.where(F.col(key) == F.col("component_id")).select(key).distinct(), "keep")
    order = Window.partitionBy(key).orderBy(F.xxhash64(text), *(F.col(c) for c in docs.columns if c not in (key, text)))
    row = fresh(docs, "row")
    once = (docs.join(keep, key, "left_semi").withColumn(row, F.row_number().over(order))
            .where(F.col(row) == 1).select(*docs.columns))
    return once.unionByName(docs.where(F.col(key).isNull()))
