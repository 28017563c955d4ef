"""Session construction and shared-storage helpers.

Everything in the library is a plain function from DataFrame to DataFrame;
this module only builds a session for scripts/tests and resolves the
shared checkpoint folder that long lineages are cut into.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours should carry. AQE re-plans joins at run time
# (broadcast only when the measured side is small, split skewed partitions)
# and coalesces the many small shuffle partitions a tiny input produces.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "lumen",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster it must be set (a shared file system path). Only where driver
    and executors are one process is a temporary folder used instead.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir: executors cannot read the driver's disk")
        path = tempfile.mkdtemp(prefix="lumen-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    path = os.path.join(checkpoint_dir(spark), name)
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this process has named; results
    that still read them must be written before."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


# Rows of a task that does much work on each of them.
ROWS_A_TASK = 500_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for work that is heavy per row: one a core, or more for many rows.
    Such rows may be few bytes, so that Spark by itself puts them into one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table under the shared checkpoint folder: computed once,
    and reread by whatever follows, also after an executor is lost."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
