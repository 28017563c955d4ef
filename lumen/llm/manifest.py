"""Merkle manifest of a dataset: a tree of digests over its rows.

Rows are leaves. Per group the leaves ascend by key; every ``fan`` consecutive
nodes become their parent until one remains, the group's subroot. The subroots
in turn make a tree, whose top is the root.

1. Leaves are written with their digests, range-partitioned and sorted by
   (group, key, digest, number), so that a group or a repeated row that holds
   a third of all rows is spread over tasks. Positions inside the partitions
   plus offsets from a table of one row for each partition and group give
   every leaf its index.
2. Every level equijoins its nodes with the indices of a run's siblings, which
   follow from the index of the node in slot zero: the run has ``fan`` places
   from there, or what is left of the group. The rows of slot zero gather the
   run's digests and emit the parents. A run has at most ``fan`` nodes, so no
   key of these joins is hot.
3. From the top down each run learns the path above it, and at last each leaf:
   its slot in its run, followed by the path above. A path has one step for
   each level that has several nodes. Runs, not nodes, carry digests and
   paths, and digests travel as 32 bytes.

The number of levels is the logarithm of the rows; the work of all levels is
that of the first and a share of 1 / (fan - 1). The driver reads one flag a
level and the root.

Defined cases: a null field is ``-`` in the leaf; a null group is a group of
its own, before all others; null keys come before all others, equal keys are
ordered by their digests, so that repeated rows may change places without
changing any result; an empty table has no rows and no root; texts of any
length are hashed whole; other columns of the leaves are kept and may have any
name but those of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm.common import written

FAN = 8
_POSITION_BITS = 33  # of monotonically_increasing_id, below the partition
_STEPS = "array<struct<slot:int,run:array<binary>>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields, each ``-`` if null, else its UTF-8 byte count,
    a colon and its text."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return digest(F.concat(*(field(c) for c in fields)))


def folded(value: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, value, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _joined(digests: Column) -> Column:
    """The text of several digests."""
    return F.array_join(F.transform(digests, _hex), "")


def _numbered(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """rows (g, key, h, ...) as nodes with their index i in the group's order
    and the group's size n."""
    rows = written(spark, rows.withColumn("u", F.monotonically_increasing_id()), f"{name}-unsorted")
    order = ["g", F.asc_nulls_first("key"), "h", "u"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "part": F.spark_partition_id(),
        "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))}).drop("u")
    placed = written(spark, placed, name)
    # One row for each partition and group: partitions plus groups at most.
    parts = placed.groupBy("g", "part").agg(F.count("at").alias("rows"), F.min("at").alias("from"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(spark, parts.select(
        "g", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("from")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("g")).alias("n")), f"{name}-parts")
    return placed.join(parts, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _level(spark: SparkSession, nodes: DataFrame, fan: int) -> DataFrame:
    """(g, up, n, run): the runs of groups of several nodes, each with the index
    of its parent, the parent's group size and the digests."""
    many = nodes.where("n > 1")
    end = F.least(F.col("i") + fan, F.col("n")) - 1
    asked = many.where(F.col("i") % fan == 0).select(
        "g", F.expr(f"i div {fan}").alias("up"), F.ceil(F.col("n") / fan).alias("n"),
        F.explode(F.sequence(F.col("i"), end)).alias("j"))
    met = asked.join(many.select("g", F.col("i").alias("j"), "h"), ["g", "j"])
    runs = met.groupBy("g", "up", "n").agg(F.array_sort(F.collect_list(F.struct("j", "h"))).alias("run"))
    return written(spark, runs.select("g", "up", "n", F.col("run.h").alias("run")), "level")


def _climb(spark: SparkSession, nodes: DataFrame, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level, from the leaves up, and the tops (g, h) that each
    height has; tops[k] stand above levels[k - 1]."""
    levels, tops = [], []
    nodes = nodes.select("g", "i", "n", "h")
    while True:
        tops.append(nodes.where("n = 1").select("g", "h"))
        if nodes.where("n > 1").isEmpty():
            return levels, tops
        levels.append(_level(spark, nodes, fan))
        nodes = levels[-1].select("g", F.col("up").alias("i"), "n", F.unhex(digest(_joined(F.col("run")))).alias("h"))


def _with_path(nodes: DataFrame, index: str, above: DataFrame, fan: int) -> DataFrame:
    """nodes with subroot and path, from the runs above, which (g, index) meets."""
    runs = above.select("g", F.col("up").alias("__up"), F.col("run").alias("__run"), "subroot", F.col("path").alias("__path"))
    met = nodes.withColumn("__up", F.expr(f"{index} div {fan}")).join(runs, ["g", "__up"])
    step = F.struct((F.col(index) % fan).cast("int").alias("slot"), F.col("__run").alias("run"))
    path = F.when(F.col("__run").isNull(), F.col("__path")).otherwise(F.concat(F.array(step), "__path"))
    return met.withColumn("path", path).drop("__up", "__run", "__path")


def _above(levels: list[DataFrame], tops: list[DataFrame], fan: int) -> DataFrame:
    """(g, up, run, subroot, path): the lowest runs and what leads on from
    their parents; run is null for a node that is its group's only one.
    tops: (g, subroot, path)."""
    def alone(k):
        return tops[k].select("g", F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<binary>").alias("run"),
                              "subroot", "path")

    found = alone(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        found = _with_path(levels[k].select("g", "up", "run"), "up", found, fan).unionByName(alone(k))
    return found


def manifest(leaves: DataFrame, leaf: str = "leaf", key: str = "doc_id", group: str = "lang",
             fan: int = FAN) -> DataFrame:
    """leaves (whose ``leaf`` is a digest in hex) with subroot, root and path:
    the digests left and right of the node of each level, from the leaf's run
    to the root.

    Leaves should be narrow: they are written and sorted.
    """
    spark = leaves.sparkSession
    results = ("subroot", "root", "path")
    kept = [c for c in leaves.columns if c not in results]
    row = F.struct(F.lit(0).alias("__"), *(F.col(c) for c in kept if c != leaf)).alias("row")
    # A null group sorts first, others by their bytes.
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    nodes = _numbered(spark, leaves.select(g.alias("g"), F.col(key).alias("key"), F.unhex(leaf).alias("h"), row), "leaves")
    levels, tops = _climb(spark, nodes, fan)

    every = None
    for k, t in enumerate(tops):
        t = t.select(F.lit("").alias("g"), F.col("g").alias("key"), "h", F.lit(k).alias("height"))
        every = t if every is None else every.unionByName(t)
    subs = _numbered(spark, every, "subroots")
    upper, roots = _climb(spark, subs, fan)
    first = [r for t in roots for r in t.select(_hex(F.col("h")).alias("h")).take(1)]  # one root at most
    root = F.lit(first[0]["h"] if first else None).cast("string")
    ends = [t.select("g", F.col("h").alias("subroot"), F.array().cast(_STEPS).alias("path")) for t in roots]
    known = _with_path(subs.select("g", "i", "key", "h", "height"), "i", _above(upper, ends, fan), fan)
    known = written(spark, known.select(F.col("key").alias("g"), F.col("h").alias("subroot"), "height", "path"), "tops")
    lower = [known.where(F.col("height") == k).drop("height") for k in range(len(tops))]
    found = _with_path(nodes.select("g", "i", "h", "row"), "i", _above(levels, lower, fan), fan)
    path = F.transform("path", lambda s: F.struct(
        _joined(F.slice(s["run"], F.lit(1), s["slot"])).alias("left"),
        _joined(F.slice(s["run"], s["slot"] + 2, F.lit(fan))).alias("right")))
    return found.select(*(_hex(F.col("h")).alias(c) if c == leaf else F.col("row").getField(c).alias(c) for c in kept),
                        _hex(F.col("subroot")).alias("subroot"), root.alias("root"), path.alias("path"))
