"""Catalog: trending, title search, co-purchase recommendations, watchlist
and ratings (G1-G5).

The reference asks a remote service for rankings; here they are computed
from sales lines (item, order, quantity, day) and user events.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.ranks import sums_before
from lumen.session import checkpoint_dir, tasks_for, written

# Executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values from the reference's catalog page.
TRENDING_N = 12
SEARCH_N = 12
RECOMMEND_N = 6
TRENDING_DAYS = 7
NO_RATING = "0.0"


def rating_text(c: Column) -> Column:
    """One decimal, ``0.0`` when missing or zero."""
    return F.when(c.isNull() | (c == 0), F.lit(NO_RATING)).otherwise(F.format_string("%.1f", c))


def trending(lines: DataFrame, items: DataFrame, n: int = TRENDING_N,
             days: int = TRENDING_DAYS) -> DataFrame:
    """G1: the items with most units in the last ``days`` days of activity.

    The latest day is one scalar; the window then becomes a literal filter
    that Parquet can use to skip row groups. Top-n is a TakeOrdered (each
    task keeps n rows) and the item join happens on those n rows only."""
    last = lines.agg(F.max("day")).collect()[0][0]
    if last is None:
        return items.limit(0).select("item", "title", F.lit(0.0).alias("units"),
                                     F.lit(NO_RATING).alias("rating"))
    recent = lines.where(F.col("day") >= F.date_sub(F.lit(last), days - 1))
    units = recent.groupBy("item").agg(F.sum("qty").alias("units"))
    top = units.orderBy(F.desc("units"), F.asc("item")).limit(n)
    return top.join(items, "item").select("item", "title", "units",
                                          rating_text(F.col("vote_average")).alias("rating"))


def search_titles(items: DataFrame, popularity: DataFrame, q: str | None,
                  n: int = SEARCH_N) -> DataFrame:
    """Titles containing the trimmed query (case-insensitive), exact
    titles first, then popularity, then key; an empty query finds nothing."""
    q = (q or "").strip()
    if not q:
        return items.limit(0).select("item", "title", F.lit(0.0).alias("popularity"))
    hits = items.where(F.col("title").ilike("%" + q.replace("\\", "\\\\") + "%"))
    pop = popularity.join(hits.select("item"), "item", "left_semi")
    exact = (F.lower(F.col("title")) == q.lower()).cast("int")
    return (hits.join(pop, "item", "left")
            .select("item", "title", F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
                    exact.alias("_exact"))
            .orderBy(F.desc("_exact"), F.desc("popularity"), F.asc("item")).limit(n).drop("_exact"))


def recommendations(lines: DataFrame, targets: DataFrame, n: int = RECOMMEND_N) -> DataFrame:
    """For each target item, the items bought in the most orders together
    with it (ties by key), top n.

    Linear in the data: the orders that hold a target are found by a join,
    then only their lines are counted; no pair of arbitrary items is ever
    formed. A hot order is a skewed join key that AQE splits."""
    t_orders = (lines.join(targets.select(F.col("item").alias("target")),
                           F.col("item") == F.col("target"))
                .select("ord", "target").distinct())
    co = (lines.select("ord", "item").join(t_orders, "ord")
          .where(F.col("item") != F.col("target"))
          .select("target", "item", "ord").distinct()
          .groupBy("target", "item").agg(F.count(F.lit(1)).alias("orders")))
    w = Window.partitionBy("target").orderBy(F.desc("orders"), F.asc("item"))
    return (co.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("target", F.col("rank").cast("int"), "item", F.col("orders").cast("long")))


def _codes(values: DataFrame, name: str) -> DataFrame:
    """(name, code): whole numbers from 0 in the order of the distinct values."""
    ones = values.select(name).where(F.col(name).isNotNull()).distinct().withColumn("one", F.lit(1))
    return written(values.sparkSession, sums_before(ones, [], [name], ["one"]).select(
        name, F.col("one_before").cast("int").alias(f"{name}_code")), f"codes-{name}")


# Pairs that a task of the fit holds at a time, with the factors they need; at
# least as many blocks as Spark makes by itself.
PAIRS_A_BLOCK, LEAST_BLOCKS = 2_000_000, 10


def item_factors(lines: DataFrame, rank: int = 16, iterations: int = 8, reg: float = 0.05, alpha: float = 10.0,
                 seed: int = 42) -> DataFrame:
    """G3 at scale: (item, factor), what alternating least squares on (order,
    item) pairs learns of each item; factors have length 1.

    An order's lines are never joined with each other: the work is linear in
    the pairs, however long an order is, and a block of the fit holds about
    PAIRS_A_BLOCK of them. Ids of any type are coded first;
    orders and items may each be as many as an int can number. Items of length
    0 (none with a finite fit) are left out."""
    spark = lines.sparkSession
    checkpoint_dir(spark)  # ALS cuts its lineage there
    pairs = written(spark, lines.where(F.col("ord").isNotNull() & F.col("item").isNotNull()).groupBy("ord", "item").agg(
        F.count(F.lit(1)).cast("float").alias("bought")), "bought")
    orders, items = _codes(pairs, "ord"), _codes(pairs, "item")
    coded = written(spark, pairs.join(orders, "ord").join(items, "item").select("ord_code", "item_code", "bought"), "coded-pairs")
    count = coded.count()
    if not count:
        return spark.createDataFrame([], lines.select("item").schema).withColumn("factor", F.array().cast("array<double>"))
    blocks = max(LEAST_BLOCKS, -(-count // PAIRS_A_BLOCK))
    als = ALS(numUserBlocks=blocks, numItemBlocks=blocks, userCol="ord_code", itemCol="item_code", ratingCol="bought", implicitPrefs=True, rank=rank, maxIter=iterations,
              regParam=reg, alpha=alpha, seed=seed, checkpointInterval=4)
    found = als.fit(coded).itemFactors.select(
        F.col("id").alias("item_code"), F.transform("features", lambda x: x.cast("double")).alias("raw"))
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    unit = found.withColumn("size", size).where("size > 0").select(
        "item_code", F.transform("raw", lambda x: x / F.col("size")).alias("factor"))
    return written(spark, unit.join(items, "item_code").select("item", "factor"), "factors")


# Targets whose factors are on the driver, and broadcast, at a time.
TARGETS_AT_ONCE = 32768
# Factors that stand for cells, at most, and rows of a ring.
MOST_CELLS, RING = 4096, 512
# Targets compared with a ring at a time, and rows with all cells.
COMPARED, CELLED = 4096, 256


def _nearest_cells(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and the distance to it."""
    cell = np.concatenate([np.argmin((centers * centers).sum(axis=1) - 2 * (x[s:s + CELLED] @ centers.T), axis=1)
                           for s in range(0, len(x), CELLED)] or [np.zeros(0, np.int64)])
    return cell, np.sqrt(((x - centers[cell]) ** 2).sum(axis=1))


def _celled(factors: DataFrame, centers) -> DataFrame:
    """factors with the cell each lies in and the distance from its center, in
    that order, spread over all tasks."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in factors.schema)

    def cells(batches):
        for batch in batches:
            x = np.stack(batch["factor"].to_numpy()) if len(batch) else np.zeros((0, centers.value.shape[1]))
            cell, far = _nearest_cells(x, centers.value)
            yield batch.assign(cell=cell.astype(np.int32), far=far)

    tasks = tasks_for(factors)
    keys = ["cell", "far", "item"]
    return written(factors.sparkSession, factors.repartition(tasks).mapInPandas(cells, f"{fields}, cell int, far double")
                   .repartitionByRange(tasks, *keys).sortWithinPartitions(*keys), "cells")


def _best(scores: np.ndarray, floors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the n largest rounded scores of each row
    that reach its floor, equal ones by column."""
    least = floors - 1e-11
    if scores.shape[1] > n:
        open_rows = np.flatnonzero(np.count_nonzero(scores >= least[:, None], axis=1) > n)
        if len(open_rows):
            at = scores.shape[1] - n
            least[open_rows] = np.maximum(least[open_rows], np.partition(scores[open_rows], at, axis=1)[:, at] - 1e-11)
    row, column = np.nonzero(scores >= least[:, None])
    found = np.round(scores[row, column], 12)
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], column[place < n], found[place < n]


def similar_items(factors: DataFrame, targets: DataFrame, n: int = RECOMMEND_N,
                  at_once: int = TARGETS_AT_ONCE) -> DataFrame:
    """(target, rank, item, similarity): for each target the n other items whose
    factors are nearest by cosine, ties by item.

    Factors lie in cells around some of them, about as many as the root of
    their number, in rings by the distance from the center. A target is first
    compared with its own cell, which tells how near its n-th item is at least;
    then with each ring that may, by the triangle inequality, hold a factor as
    near. So the result is exact, and most factors are never compared. Blocks
    of targets stream past all factors; what tasks find is ranked per target."""
    spark = factors.sparkSession
    kind = factors.schema["item"].dataType.simpleString()
    known = targets.select("item").distinct().join(factors, "item")
    count = factors.count()
    if not count or known.isEmpty():
        return spark.createDataFrame([], f"target {kind}, rank int, item {kind}, similarity double")
    # Any centers give the same result: those with the smallest hashes.
    some = factors.orderBy(F.xxhash64("item"), "item").limit(min(MOST_CELLS, math.isqrt(count))).select("factor").collect()
    centers = spark.sparkContext.broadcast(np.array([r["factor"] for r in some]))
    cells = _celled(factors, centers)
    ones = known.withColumn("one", F.lit(1))
    queries = written(spark, sums_before(ones, [], ["item"], ["one"]).select(
        "item", "factor", F.floor(F.col("one_before") / at_once).cast("int").alias("block")), "targets")
    blocks = queries.agg(F.max("block")).first()[0]
    w = Window.partitionBy("target").orderBy(F.desc("similarity"), F.asc("item"))

    def ranked(shared):
        def nearest(batches):
            names, wanted, own, floors = shared.value
            length = (wanted * wanted).sum(axis=1)
            for batch in batches:
                if not len(batch):
                    continue
                in_cell, far = batch["cell"].to_numpy(), batch["far"].to_numpy()
                have, items = np.stack(batch["factor"].to_numpy()), batch["item"].to_numpy()
                starts = np.append(0, np.flatnonzero(in_cell[1:] != in_cell[:-1]) + 1)
                for begin, end in zip(starts, np.append(starts[1:], len(batch))):
                    cell = in_cell[begin]
                    apart = None if floors is None else np.sqrt(((wanted - centers.value[cell]) ** 2).sum(axis=1))
                    for s in range(begin, end, RING):
                        e = min(s + RING, end)
                        if floors is None:
                            at = np.flatnonzero(own == cell)
                        else:
                            gap = np.maximum(np.maximum(apart - far[s:e].max(), far[s:e].min() - apart) - 1e-9, 0)
                            longest = (have[s:e] * have[s:e]).sum(axis=1).max()
                            at = np.flatnonzero((length + longest - gap * gap) / 2 >= floors - 1e-11)
                        order = np.argsort(items[s:e], kind="stable") + s
                        for t in range(0, len(at), COMPARED):
                            few = at[t:t + COMPARED]
                            # A target is not its own neighbour, so one more is kept.
                            row, column, score = _best(wanted[few] @ have[order].T, np.full(len(few), -np.inf)
                                                       if floors is None else floors[few], n + 1)
                            found = pd.DataFrame({"target": names[few[row]], "item": items[order[column]], "similarity": score})
                            yield found[found["target"] != found["item"]]

        found = cells.mapInPandas(nearest, f"target {kind}, item {kind}, similarity double")
        return written(spark, found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n), "similar")

    out = None
    for b in range(blocks + 1):
        rows = queries.where(F.col("block") == b).select("item", "factor").toPandas()  # at_once at most
        names, wanted = rows["item"].to_numpy(), np.stack(rows["factor"].to_numpy())
        own = _nearest_cells(wanted, centers.value)[0]
        shared = spark.sparkContext.broadcast((names, wanted, own, None))
        lasts = ranked(shared).where(F.col("rank") == n).select("target", "similarity").toPandas()
        shared.unpersist()
        place = pd.Series(np.arange(len(names)), index=names)
        floors = np.full(len(names), -np.inf)
        floors[place[lasts["target"]].to_numpy()] = lasts["similarity"].to_numpy()
        shared = spark.sparkContext.broadcast((names, wanted, own, floors))
        found = ranked(shared)
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.select("target", F.col("rank").cast("int"), "item", "similarity")


def _event_key() -> Column:
    return F.struct(F.col("ts").alias("ts"), F.col("id").alias("id"))


def watchlist(events: DataFrame, toggle: str = "toggle", remove: str = "remove") -> DataFrame:
    """An item is in a user's list when the toggles since the last
    explicit remove are odd. The last remove is a grouped max (combined
    map-side); counting the later toggles is one join on (user, item)."""
    acts = events.select("user_id", "item_id", "action", "ts", "id").where(
        F.col("action").isin(toggle, remove))
    last_remove = (acts.where(F.col("action") == remove).groupBy("user_id", "item_id")
                   .agg(F.max(_event_key()).alias("cut")))
    toggles = acts.where(F.col("action") == toggle).join(last_remove, ["user_id", "item_id"], "left")
    return (toggles.where(F.col("cut").isNull() | (_event_key() > F.col("cut")))
            .groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("toggles"))
            .where(F.col("toggles") % 2 == 1)
            .select("user_id", "item_id", F.col("toggles").cast("long")))


def ratings(events: DataFrame, rate: str = "rate") -> DataFrame:
    """The last star rating per (user, item) by (time, id); 0 when an
    item seen by the user was never rated."""
    key = F.struct(F.col("ts").alias("ts"), F.col("id").alias("id"), F.col("rating").alias("r"))
    return (events.groupBy("user_id", "item_id")
            .agg(F.max(F.when(F.col("action") == rate, key)).alias("last"))
            .select("user_id", "item_id", F.coalesce(F.col("last.r"), F.lit(0)).cast("int").alias("rating")))
