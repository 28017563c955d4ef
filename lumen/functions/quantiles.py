"""Exact order statistics and capped distinct counts that scale.

Spark's exact ``percentile`` keeps a value->count map of the whole column in
the one task that finishes a global aggregate; on a large column that task
holds every distinct value. Instead the k-th smallest value is found in three
scans (two for a short column):

1. one aggregate gives count, min and max; for series that one task may not
   sort, another gives a mergeable sketch, combined in two steps, so that no
   task merges the sketches of all others. The sketch brackets every wanted
   rank by two values of the series;
2. one pass groups the rows: those inside a bracket by value, those between
   brackets by the gap they lie in. The gaps' counts say which rank a
   bracket's first row has, and running counts of its values lead to the
   wanted one. Values of a bracket are sorted by one task where they are few,
   else by ranges over all tasks.

A sketch errs with a small probability. The exact counts show that, and the gap
that does hold the rank is the bracket of another round, so results are always
exact. A hot value is one row a task. Interpolation follows pandas/numpy
``linear``: h=(n-1)p, q = v[floor h] + (v[floor h + 1] - v[floor h]) * frac.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.ranks import sums_before
from lumen.session import written

# Groups of tasks whose sketches are merged before all are.
MERGERS = 64


def _margin(size: int) -> float:
    """What a sketch of this size may be off, in shares of the rows, with room."""
    return min(0.5, 4 * size ** -0.9)


def column_stats(df: DataFrame, exprs: list[Column]) -> list[tuple[int, float | None, float | None]]:
    """(count, min, max) of several double expressions in one job."""
    if not exprs:
        return []
    aggs = []
    for i, e in enumerate(exprs):
        aggs += [F.count(e).alias(f"n{i}"), F.min(e).alias(f"a{i}"), F.max(e).alias(f"b{i}")]
    row = df.agg(*aggs).collect()[0]
    return [(row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i in range(len(exprs))]


def _sketched(df: DataFrame, exprs: list[Column], shares: list[float], size: int) -> list[list[float]]:
    """Values at the shares of each expression by a sketch, in one job; none may
    be without values."""
    at = F.array(*(F.lit(float(p)) for p in shares))
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("part")).agg(
        *(F.kll_sketch_agg_double(e, F.lit(size)).alias(f"s{i}") for i, e in enumerate(exprs)))
    merged = parts.agg(*(F.kll_merge_agg_double(f"s{i}", F.lit(size)).alias(f"s{i}") for i in range(len(exprs))))
    return list(merged.select(*(F.kll_sketch_get_quantile_double(f"s{i}", at).alias(f"q{i}") for i in range(len(exprs)))).first())


def _pieces(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets of one series in order, those that overlap as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(set(brackets)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _grouped(df: DataFrame, series: list[tuple[Column, Column | None]], pieces: dict[int, list]) -> DataFrame:
    """(s, m, x, n): rows of series s with value x inside its m-th bracket; x is
    null for those below that bracket and above the one before."""
    structs = []
    for s, brackets in pieces.items():
        value, cond = series[s]
        e = None
        for m, (lo, hi) in enumerate(brackets):
            below = F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"), F.lit(None).cast("double").alias("x"))
            inside = F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"), value.alias("x"))
            e = (F if e is None else e).when(value < F.lit(lo), below).when(value <= F.lit(hi), inside)
        structs.append(e if cond is None else F.when(cond, e))
    rows = df.select(F.explode(F.array(*structs)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    return rows.groupBy("s", "m", "x").agg(F.count(F.lit(1)).alias("n"))


def order_statistics(df: DataFrame, series: list[tuple[Column, Column | None]],
                     brackets: list[dict[int, tuple[float, float]]], final_rows: int) -> list[dict[int, float]]:
    """Values of the wanted ranks (0-based, nulls left out) of several series.

    series: (double value expression, optional row condition) per series.
    brackets: per series, for each wanted rank the values it should lie between.
    """
    found: list[dict[int, float]] = [dict() for _ in series]
    todo = {(s, r): b for s, ranks in enumerate(brackets) for r, b in ranks.items()}
    while todo:
        pieces = {s: _pieces([b for (t, _), b in todo.items() if t == s]) for s in {s for s, _ in todo}}
        grouped = written(df.sparkSession, _grouped(df, series, pieces), "brackets")
        sizes = {(g["s"], g["m"]): g for g in grouped.groupBy("s", "m").agg(
            F.sum(F.when(F.col("x").isNull(), F.col("n"))).alias("gap"), F.sum(F.when(F.col("x").isNotNull(), F.col("n"))).alias("rows"),
            F.count("x").alias("values")).collect()}
        places: dict[tuple[int, int], list[int]] = {}
        again = {}
        for (s, r) in todo:
            before = 0
            for m, (lo, hi) in enumerate(pieces[s]):
                g = sizes.get((s, m))
                gap, rows = (g["gap"] or 0, g["rows"] or 0) if g else (0, 0)
                if r < before + gap:  # the sketch was off: the rank is in this gap
                    again[s, r] = (pieces[s][m - 1][1] if m else -float("inf"), lo)
                    break
                before += gap
                if r < before + rows:
                    places.setdefault((s, m), []).append(r - before)
                    todo[s, r] = (s, m, r - before)
                    break
                before += rows
            else:
                again[s, r] = (pieces[s][-1][1], float("inf"))
        if places:
            got = _picked(grouped, places, max(g["values"] for g in sizes.values()) > final_rows)
            for (s, r), at in todo.items():
                if (s, r) not in again:
                    found[s][r] = got[at]
        todo = again
    return found


def _picked(grouped: DataFrame, places: dict[tuple[int, int], list[int]], many: bool) -> dict[tuple[int, int, int], float]:
    """The values at places (counting rows) of brackets (s, m)."""
    values = grouped.where(F.col("x").isNotNull())
    if many:
        ranked = sums_before(values, ["s", "m"], ["x"], ["n"])
    else:
        before = Window.partitionBy("s", "m").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        ranked = values.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = reduce(or_, ((F.col("s") == s) & (F.col("m") == m) & (F.col("n_before") <= p) & (p < F.col("n_before") + F.col("n"))
                          for (s, m), ps in places.items() for p in sorted(set(ps))))
    out = {}
    for r in ranked.where(wanted).collect():  # one row for each wanted place at most
        for p in places[r["s"], r["m"]]:
            if r["n_before"] <= p < r["n_before"] + r["n"]:
                out[r["s"], r["m"], p] = r["x"]
    return out


def _interpolate(n: int, p: float, vals: dict[int, float]) -> float | None:
    if n == 0:
        return None
    h = (n - 1) * p
    lo = int(math.floor(h))
    hi = min(lo + 1, n - 1)
    a, b = vals[lo], vals[hi]
    return a + (b - a) * (h - lo)


def exact_quantiles(df: DataFrame, exprs: list[Column], probs: list[float], *,
                    stats: list[tuple] | None = None, conds: list[Column | None] | None = None,
                    approx: bool = False, bins: int = 1024, final_rows: int = 50_000) -> list[list[float | None]]:
    """Linear-interpolated quantiles of each double expression (nulls skipped).

    ``approx=True`` trades exactness for one pass (``percentile_approx``).
    bins: size of the sketch; final_rows: values of a bracket that one task
    may sort; stats: (count, min, max) where the caller knows them.
    """
    if not exprs:
        return []
    conds = conds or [None] * len(exprs)
    values = [F.when(c, e) if c is not None else e for e, c in zip(exprs, conds)]
    if approx:
        row = df.agg(*[F.percentile_approx(v, list(probs), 10000).alias(f"q{i}") for i, v in enumerate(values)]).collect()[0]
        return [list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                for i in range(len(exprs))]
    if stats is None:
        stats = column_stats(df, values)
    size = max(8, bins)
    margin = _margin(size)
    shares = sorted({min(1.0, max(0.0, e)) for p in probs for e in (p - margin, p + margin)})
    long = [i for i, (n, least, most) in enumerate(stats) if n > final_rows and least < most]
    known = {i: dict(zip(shares, at)) for i, at in zip(long, _sketched(df, [values[i] for i in long], shares, size) if long else [])}
    found: list[dict] = [dict() for _ in exprs]
    brackets: list[dict] = [dict() for _ in exprs]
    whole: dict[int, list[int]] = {}
    for i, (n, least, most) in enumerate(stats):
        for p in probs if n else []:
            low = int(math.floor((n - 1) * p))
            for r in {low, min(low + 1, n - 1)}:
                if least == most:
                    found[i][r] = least
                elif i not in known:
                    whole.setdefault(i, []).append(r)
                else:
                    lo = known[i][p - margin] if p - margin > 0 else least
                    hi = known[i][p + margin] if p + margin < 1 else most
                    before = brackets[i].get(r, (lo, hi))
                    brackets[i][r] = (min(lo, before[0]), max(hi, before[1]))
    series = list(zip(exprs, conds))
    if whole:
        # Short series are one bracket each, whose first row has rank 0.
        grouped = _grouped(df, series, {i: [stats[i][1:]] for i in whole})
        for (i, _, r), x in _picked(grouped, {(i, 0): sorted(set(rs)) for i, rs in whole.items()}, False).items():
            found[i][r] = x
    for i, more in enumerate(order_statistics(df, series, brackets, final_rows)):
        found[i].update(more)
    return [[_interpolate(n, p, found[i]) for p in probs] for i, (n, _, _) in enumerate(stats)]


def proving_rsd(cap: int) -> float:
    """Largest relative SD (smallest sketch) whose linear-counting estimate
    for ``cap`` distinct values still rounds to at most ``cap``: with m
    registers, n values leave at least m - n registers empty, so the
    estimate is at most m*ln(m/(m-n))."""
    for rsd in (0.05, 0.03, 0.02, 0.01, 0.005):
        m = 2 ** math.ceil(2 * math.log2(1.106 / rsd))
        if m > cap and m * math.log(m / (m - cap)) < cap + 0.5:
            return rsd
    raise ValueError(f"cap {cap} too large for an exact sketch bound")


def distinct_upto(df: DataFrame, exprs: list[Column], cap: int,
                  estimates: list[int] | None = None) -> list[int]:
    """Exact ``min(count_distinct(e), cap)`` for each expression.

    ``approx_count_distinct`` uses linear counting at small cardinalities:
    n distinct values fill at most n registers, so with a sketch chosen by
    ``proving_rsd`` an estimate above ``cap`` proves n > cap. Only
    expressions whose estimate is <= cap are counted exactly, with a grouped
    count whose size is the (small) number of distinct values. Callers may
    pass estimates they computed in their own aggregate.
    """
    if not exprs:
        return []
    if estimates is None:
        rsd = proving_rsd(cap)
        row = df.agg(*[F.approx_count_distinct(e, rsd).alias(f"d{i}")
                       for i, e in enumerate(exprs)]).collect()[0]
        estimates = [row[f"d{i}"] for i in range(len(exprs))]
    out = [cap if est > cap else None for est in estimates]
    small = [i for i, v in enumerate(out) if v is None]
    if small:
        structs = F.array(*[F.struct(F.lit(i).alias("k"), exprs[i].alias("x")) for i in small])
        counted = (df.select(F.inline(structs)).where(F.col("x").isNotNull())
                   .groupBy("k", "x").count().groupBy("k").count().collect())
        got = {r["k"]: r["count"] for r in counted}
        for i in small:
            out[i] = min(got.get(i, 0), cap)
    return out
