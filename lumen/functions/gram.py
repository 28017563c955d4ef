"""Pairwise-complete correlations of many columns in one scan.

Each task turns its Arrow batches into matrices and keeps, for every pair of
columns, the rows complete in both: their number, means, sums of squares and
products about the means, and extremes. Products of matrices give the sums of
all pairs at once; batches are merged by the formula for the moments of a
union, so large means cost no precision. A task hands over one row for each
pair, whatever it read; these are merged the same way in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIELDS = ("n", "mean_a", "mean_b", "var_a", "var_b", "cov", "min_a", "max_a", "min_b", "max_b")
_SCHEMA = "i int, j int, n long, " + ", ".join(f"{f} double" for f in _FIELDS[1:])


class _Moments:
    """Square matrices; [i, j] is about column i, over the rows that have j too."""

    def __init__(self, x: np.ndarray) -> None:
        here = ~np.isnan(x)
        mask = here.astype(np.float64)
        some = here.any(axis=0)
        # Sums are taken about a value of the batch itself.
        middle = np.where(some, x[here.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        z = np.where(here, x - middle, 0.0)
        self.n = mask.T @ mask
        with np.errstate(invalid="ignore", divide="ignore"):
            first = np.where(self.n > 0, z.T @ mask / self.n, 0.0)
        self.mean = middle[:, None] + first
        self.var = (z * z).T @ mask - self.n * first * first
        self.cov = z.T @ z - self.n * first * first.T
        self.least, self.most = np.full_like(self.n, np.inf), np.full_like(self.n, -np.inf)
        # Columns that lack the same rows share their partners' extremes.
        same, at = np.unique(here, axis=1, return_inverse=True)
        at = at.reshape(-1)
        for k in range(same.shape[1]):
            rows = x[same[:, k]]
            if len(rows):
                held = ~np.isnan(rows)
                self.least[:, at == k] = np.where(held, rows, np.inf).min(axis=0)[:, None]
                self.most[:, at == k] = np.where(held, rows, -np.inf).max(axis=0)[:, None]

    def add(self, o: _Moments) -> None:
        n = self.n + o.n
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(n > 0, o.n / n, 0.0)
        apart = o.mean - self.mean
        self.mean = np.where(self.n == 0, o.mean, np.where(o.n == 0, self.mean, self.mean + apart * share))
        both = np.where((self.n > 0) & (o.n > 0), self.n * share, 0.0)
        self.var += o.var + apart * apart * both
        self.cov += o.cov + apart * apart.T * both
        self.n, self.least, self.most = n, np.minimum(self.least, o.least), np.maximum(self.most, o.most)


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        if b.num_rows:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            found = _Moments(x)
            if held is None:
                held = found
            else:
                held.add(found)
    if held is None:
        return
    i, j = np.triu_indices(len(held.n))
    keep = held.n[i, j] > 0
    i, j = i[keep], j[keep]
    cols = [held.n[i, j].astype(np.int64), held.mean[i, j], held.mean[j, i], held.var[i, j], held.var[j, i], held.cov[i, j],
            held.least[i, j], held.most[i, j], held.least[j, i], held.most[j, i]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])],
        ["i", "j", *_FIELDS])


def pair_correlations(df: DataFrame, exprs: list[Column]) -> DataFrame:
    """(i, j, n, r) for all i <= j whose n complete rows are not none: Pearson's
    r of the expressions (doubles, null where missing), null where one of them
    is constant over these rows."""
    parts = df.select(*(e.cast("double").alias(f"x{k}") for k, e in enumerate(exprs))).mapInArrow(_task, _SCHEMA)
    pair = Window.partitionBy("i", "j")  # a row a task
    whole = {f"all_{s}": F.sum(F.col("n") * F.col(f"mean_{s}")).over(pair) / F.sum("n").over(pair) for s in "ab"}
    a, b = (F.col(f"mean_{s}") - F.col(f"all_{s}") for s in "ab")
    n = F.col("n")
    found = parts.withColumns(whole).groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("var_a") + n * a * a).alias("var_a"), F.sum(F.col("var_b") + n * b * b).alias("var_b"),
        F.sum(F.col("cov") + n * a * b).alias("cov"), F.min("min_a").alias("min_a"), F.max("max_a").alias("max_a"),
        F.min("min_b").alias("min_b"), F.max("max_b").alias("max_b"))
    varies = (F.col("min_a") < F.col("max_a")) & (F.col("min_b") < F.col("max_b"))
    r = F.try_divide(F.col("cov"), F.sqrt("var_a") * F.sqrt("var_b"))
    return found.select("i", "j", "n", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
