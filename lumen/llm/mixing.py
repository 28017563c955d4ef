"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of equal source, language and topic. Raking gives
every cell a weight per token: it scales the cells so that the weighted
tokens meet the target shares of one dimension, then of the next, and again,
until all dimensions hold at once, or, for targets that cannot hold together,
until the deviation no longer falls; what is left of it is logged. A document is then drawn with probability
min(1, c * weight), c chosen so that the expected tokens meet the budget.

Only cells take part in the raking, as a Spark table: their number follows
the values of the dimensions, not the documents, but need not be small. The
draw is a hash of the document's id, so that a repeated run or a lost
executor draws the same documents.

Defined cases: null is a value of a dimension like any other; a null or
blank text has no tokens and the topic of no word; cells without tokens keep
weight 1; targets for values without tokens are left out and the others
scaled up; rows with equal ids are drawn together; other columns are kept
and may have any name but those that are added.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import fresh, small_batches, written

TOPICS = 8
# A word of at least so many letters can name a text's topic.
TOPIC_LETTERS = 5
# By default a value's share follows its tokens ** TEMPER.
TEMPER = 0.5
TOLERANCE = 1e-4
# Raking stalls if the deviation falls by less than STALL in so many sweeps.
STALL_SWEEPS, STALL = 10, 0.01
# Share of all tokens to draw.
BUDGET = 0.5

_LOG = logging.getLogger(__name__)


def topic_of(text: str | None, topics: int = TOPICS) -> tuple[int, int]:
    """(tokens, topic): topic is a bucket of the most frequent long word (of
    several the first by spelling), -1 without one."""
    words = text.lower().split() if text else []
    best = min(((-n, w) for w, n in Counter(words).items() if len(w) >= TOPIC_LETTERS), default=None)
    return len(words), -1 if best is None else zlib.crc32(best[1].encode()) % topics


def with_topics(docs: DataFrame, text: str = "text", tokens: str = "tokens", topic: str = "topic",
                topics: int = TOPICS) -> DataFrame:
    """docs with the columns tokens and topic of topic_of."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("tokens long, topic int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([topic_of(t, topics) for t in texts], columns=["tokens", "topic"])

    both = fresh(docs, "tokens_topic")
    return docs.withColumn(both, run(F.col(text))).withColumns(
        {tokens: F.col(both)["tokens"], topic: F.col(both)["topic"]}).drop(both)


def tempered(cells: DataFrame, dim: str, temper: float) -> DataFrame:
    """(dim, share) with shares in proportion to tokens ** temper."""
    return (cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
            .select(dim, F.pow(F.col("t").cast("double"), F.lit(temper)).alias("share")))


def _stalls(offs: list[float]) -> bool:
    before, last = offs[:-STALL_SWEEPS], offs[-STALL_SWEEPS:]
    return bool(before) and min(last) > (1 - STALL) * min(before)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """cells with the column weight: weighted tokens meet the targets.

    cells: the dimensions and tokens (long). targets: for each dimension its
    values and their shares, in any unit. Weights average 1 over the tokens.
    Sweeps go on until no weight changes by more than tolerance (a share of
    it) or stall; a deviation left then is logged as a warning.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for dim, shares in targets.items():
        live = cells.where("tokens > 0").select(dim).distinct()
        goal = written(spark, shares.join(live, shares[dim].eqNullSafe(live[dim]), "left_semi"), "goal")
        whole = goal.agg(F.sum("share")).first()[0] or 1.0
        goals[dim] = goal.select(F.col(dim).alias("_v"), (F.col("share") * total / whole).alias("_goal"))
    now = written(spark, cells.withColumns({"weight": F.lit(1.0), "_off": F.lit(0.0)}), "cells")
    offs: list[float] = []
    while not offs or offs[-1] > tolerance:
        if _stalls(offs):
            _LOG.warning("raking stalled after %d sweeps: margins are off by up to %.3g of their targets", len(offs), offs[-1])
            break
        now = now.withColumn("_off", F.lit(0.0))
        for dim, goal in goals.items():
            got = now.groupBy(F.col(dim).alias("_w")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_got"))
            ratio = written(spark, got.join(goal, F.col("_w").eqNullSafe(F.col("_v"))).where("_got > 0").select(
                "_v", (F.col("_goal") / F.col("_got")).alias("_ratio")), "ratio")
            factor = F.coalesce("_ratio", F.lit(1.0))
            now = written(spark, now.join(ratio, now[dim].eqNullSafe(ratio["_v"]), "left").select(
                *cells.columns, (F.col("weight") * factor).alias("weight"),
                F.greatest("_off", F.abs(factor - 1)).alias("_off")), "cells")
        offs.append(now.agg(F.max("_off")).first()[0] or 0.0)
    return now.drop("_off")


def _scale(cells: DataFrame, budget: float) -> float:
    """c with expected tokens sum(tokens * min(1, c * weight)) = budget share."""
    c = 0.0
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    while True:
        # What is drawn whole at c leaves the rest of the budget to the others.
        full = F.col("weight") * F.lit(c) >= 1
        whole, rest = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if not rest:
            return c or 1.0
        higher = (budget * total - whole) / rest
        if higher <= c * (1 + 1e-12):
            return c
        c = higher


def draw(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"draw {seed}"), key), 11) / F.lit(2.0**53)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("source", "lang", "topic"),
        targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """docs with tokens, topic, weight, probability and sampled.

    targets: shares for each of dims; by default the tempered ones.
    """
    spark = docs.sparkSession
    known = with_topics(docs.drop("weight", "probability", "sampled"), text)
    cells = written(spark, known.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {d: tempered(cells, d, TEMPER) for d in dims}
    raked = rake(cells, targets)
    c = _scale(raked, budget)
    names = {d: fresh(known, f"cell_{d}") for d in dims}
    found = raked.select(*(F.col(d).alias(n) for d, n in names.items()), "weight",
                         F.least(F.lit(1.0), F.col("weight") * F.lit(c)).alias("probability"))
    on = [F.col(d).eqNullSafe(F.col(n)) for d, n in names.items()]
    return known.join(found, on, "left").drop(*names.values()).withColumn(
        "sampled", draw(F.col(key), seed) < F.col("probability"))
