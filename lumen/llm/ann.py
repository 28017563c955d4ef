"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors are centred, scaled to length one and turned by one random rotation;
a code keeps the signs, packed to bits, with the length and the cosine
between the vector and its code. From these the inner product with any query
is estimated without bias, with an error that concentrates around

    |v| |q| sqrt((1 - f^2) / f^2) / sqrt(d - 1)        (f: that cosine)

A vector is reranked with the exact product unless its estimate plus EPSILON
times that error stays below the k-th best lower bound of its block.

Every row is coded. Queries are asked in blocks of fixed size: a block is
broadcast, every task streams its part of the codes past it and keeps the
best k of each query so far, whose last one raises the bar for the rest of
the part. A task returns k rows a query; the best k of all are taken at the
end. Memory holds a block of queries and a few thousand vectors.

Defined cases: vectors that are null or zero, hold a null, NaN or infinite
component, or have another length than most vectors, take no part, nor do
null ids; rows of a query's own id are no candidates; repeated rows are
candidates each, but of a query's repeated rows one vector is asked; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.llm.common import written

EPSILON = 3.0
SEED = 20_241
# Queries broadcast at once; queries and vectors multiplied at once.
QUERY_BLOCK = 4_096
ROWS, COLUMNS = 256, 1_024
CODES = "id long, vector binary, bits binary, size double, cosine double"
FOUND = "query_id long, vec_id long, score double"


def rotation(d: int) -> np.ndarray:
    """A random rotation (or reflection), the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, cosine to the code) of each centred vector."""
    turned = (vectors - centre) @ turn
    size = np.sqrt((turned ** 2).sum(axis=1))
    cosine = np.abs(turned).sum(axis=1) / np.maximum(size, 1e-300) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), size, np.where(size > 0, cosine, 1.0)


class Search:
    """The best k of each query among the vectors seen so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = query_ids, queries, k
        self.turned = (queries @ turn).astype(np.float32) / np.float32(np.sqrt(len(turn)))
        self.base = queries @ centre
        self.length = np.sqrt((queries ** 2).sum(axis=1))
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1)

    def add(self, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, size: np.ndarray, cosine: np.ndarray) -> None:
        d = vectors.shape[1]
        signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        spread = size * np.sqrt(np.maximum(1 - cosine ** 2, 0)) / cosine / np.sqrt(max(d - 1, 1))
        for at in range(0, len(self.ids), ROWS):
            part = slice(at, at + ROWS)
            guess = (self.turned[part] @ signs.T) * (size / cosine) + self.base[part, None]
            # The products of float32 round a little beyond the bound.
            error = self.length[part, None] * (EPSILON * spread + 1e-5 * size)
            own = self.ids[part, None] == ids
            bar = self.scores[part, -1]
            if len(ids) > self.k:
                lower = np.where(own, -np.inf, guess - error)
                bar = np.maximum(bar, np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            row, col = np.nonzero((guess + error >= bar[:, None]) & ~own)
            exact = np.einsum("ij,ij->i", vectors[col], self.queries[at + row])
            self._merge(at, row, ids[col], exact)

    def _merge(self, at: int, row: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        n = len(self.scores[at:at + ROWS])
        row = np.append(row, np.repeat(np.arange(n), self.k))
        ids = np.append(ids, self.found[at:at + n].ravel())
        exact = np.append(exact, self.scores[at:at + n].ravel())
        order = np.lexsort((ids, -exact, row))
        row, ids, exact = row[order], ids[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.scores[at + row[best], place[best]] = exact[best]
        self.found[at + row[best], place[best]] = ids[best]

    def rows(self) -> pd.DataFrame:
        some = self.scores > -np.inf
        return pd.DataFrame({"query_id": np.repeat(self.ids, some.sum(axis=1)), "vec_id": self.found[some],
                             "score": self.scores[some]})


def _valid(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row.

    is_query: over the long column ``id``.
    """
    spark = vectors.sparkSession
    rows, d = _valid(vectors, key, vector)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    means = rows.agg(*(F.avg(F.get("v", F.lit(i))) for i in range(d))).first()
    centre, turn = np.array(means, dtype=float), rotation(d)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy()).astype(np.float64)
                bits, size, cosine = encode(v, centre, turn)
                yield pd.DataFrame({"id": b["id"], "vector": [x.tobytes() for x in v], "bits": [x.tobytes() for x in bits],
                                    "size": size, "cosine": cosine})

    codes = written(spark, rows.mapInPandas(code, CODES), "codes")
    queries = codes.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = written(spark, queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "queries")

    def asked(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block], np.int64),
                                               b"".join(bytes(r["vector"]) for r in block)))

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, data = shared.value
            search = Search(ids, np.frombuffer(data, np.float64).reshape(-1, d), centre, turn, k)
            for b in batches:
                for at in range(0, len(b), COLUMNS):
                    c = b.iloc[at:at + COLUMNS]
                    search.add(c["id"].to_numpy(), np.frombuffer(b"".join(c["vector"]), np.float64).reshape(-1, d),
                               np.frombuffer(b"".join(c["bits"]), np.uint8).reshape(len(c), -1),
                               c["size"].to_numpy(), c["cosine"].to_numpy())
            yield search.rows()

        return codes.mapInPandas(meet, FOUND)

    # About QUERY_BLOCK queries reach the driver at once.
    found = [written(spark, asked(blocks.where(F.col("block") == g).select("id", "vector").collect()), "found")
             for g in range(n_blocks)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
