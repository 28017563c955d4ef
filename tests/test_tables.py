"""Range lookups that prune, CSV folders by header, row fingerprints, table
versions, date summaries, task detection and risk cards."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen.operators import exposure as X
from lumen.operators import model as M
from lumen.operators import profile as P
from lumen.operators import risk as H
from lumen.sources import sinks as K
from lumen.sources.csv import read_csv_table
from lumen.sources.tables import scan_table


def partitions_read(df):
    """Directories that the scans of an executed frame have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.getClass().getName().endswith("QueryStageExec"):
            todo.append(node.plan())
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
        if "numPartitions" in str(node.metrics().keys()) and "FileSourceScan" in node.getClass().getName():
            found.append(node.metrics().apply("numPartitions").value())
    return found


def test_filtered_secrets_read_few_directories(spark, tmpdir_path):
    words = spark.range(4000).select(F.concat(F.lit("secret "), F.col("id").cast("string")).alias("secret"))
    path = os.path.join(tmpdir_path, "ranges")
    X.write_hash_corpus(X.hash_corpus(words.where("secret not like '%7%'"), "secret"), path)
    corpus = X.read_hash_corpus(spark, path)
    few = X.secret_exposure(words.where("secret in ('secret 11', 'secret 77')"), corpus)
    assert {r.secret: r.breached for r in few.collect()} == {"secret 11": True, "secret 77": False}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p2" in plan or "PartitionFilters: [p2" in plan
    assert partitions_read(few) in ([1], [2])
    every = X.secret_exposure(words, corpus)
    assert every.where("breached").count() == words.where("secret not like '%7%'").count()
    assert partitions_read(every) == [256]


def csv_file(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_csv_folder_is_read_by_header(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "two orders")
    csv_file(folder, "a.csv", "name,age\nann,1\nbob,2\n")
    csv_file(folder, "b 1.csv", "age,name\n3,cid\n4,dee\n")
    csv_file(folder, "c.csv", "name,age,city\neve,5,Rome\n")
    csv_file(folder, "d.csv", "name,age\nfay,6\n")
    csv_file(folder, "empty.csv", "")
    csv_file(folder, "only_header.csv", "age,name\n")
    df = read_csv_table(spark, folder)
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("city", "string")]
    assert {tuple(r) for r in df.collect()} == {("ann", 1, None), ("bob", 2, None), ("cid", 3, None), ("dee", 4, None),
                                                ("eve", 5, "Rome"), ("fay", 6, None)}
    csv_file(folder, "e.csv", "name,age\none,2,3\n")
    with pytest.raises(Exception, match="more than 2 values"):
        read_csv_table(spark, folder).collect()


def test_shape_counts_duplicates_by_fingerprint(spark, monkeypatch):
    nan = float("nan")
    rows = [("ab", "c", 1.0, None), ("a", "bc", 1.0, None), (None, "ab", 0.0, 1), ("ab", None, 0.0, 1), ("ab", None, -0.0, 1),
            (None, None, nan, None), (None, None, nan, None), (None, None, None, None)] + [("x", "y", 2.0, 5)] * 9
    df = spark.createDataFrame(rows, "a string, b string, c double, d int").repartition(4)

    def shape():
        r = P.table_shape(df).first()
        return r.row_count, r.column_count, r.duplicate_rows
    assert shape() == (17, 4, 10)
    # Keys that all rows share: the third hash tells them apart.
    real = P._fingerprints
    monkeypatch.setattr(P, "_fingerprints", lambda d: [F.lit(1).alias("__a"), F.lit(2).alias("__b"), real(d)[2]])
    assert shape() == (17, 4, 10)
    monkeypatch.undo()
    assert P.table_shape(df.limit(0)).first().row_count == 0


def test_replaced_table_keeps_its_readers(spark, tmpdir_path):
    name = "prices_of_test"
    first = K.save_table(spark.createDataFrame([(1, "a")], "k int, v string"), name, tmpdir_path)
    old = scan_table(spark, name)
    second = K.save_table(old.unionByName(spark.createDataFrame([(2, "b")], "k int, v string")), name, tmpdir_path)
    assert {tuple(r) for r in scan_table(spark, name).collect()} == {(1, "a"), (2, "b")}
    assert [tuple(r) for r in old.collect()] == [(1, "a")]
    with pytest.raises(Exception, match="boom"):
        K.save_table(spark.range(1).select(F.raise_error(F.lit("boom"))), name, tmpdir_path)
    assert scan_table(spark, name).count() == 2
    assert first in K.drop_old_versions(spark, name, keep=second)
    assert scan_table(spark, name).count() == 2


def test_dates_are_described(spark):
    rng = random.Random(3)
    days = [dt.datetime(1969, 12, 30) + dt.timedelta(seconds=rng.randrange(10**9), microseconds=rng.randrange(10**6)) for _ in range(201)]
    df = spark.createDataFrame([(d, d.date()) for d in days] + [(None, None)], "t timestamp_ntz, d date")
    got = {r.column: r for r in P.describe_temporal(df).collect()}
    s = pd.Series(days)
    assert got["t"]["count"] == 201 and got["t"].min == s.min() and got["t"].max == s.max()
    for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        assert abs(got["t"][name] - s.quantile(p).to_pydatetime()) <= dt.timedelta(microseconds=1)
    assert abs(got["t"].mean - s.mean().to_pydatetime()) <= dt.timedelta(microseconds=300)
    assert got["d"].min == dt.datetime.combine(min(days).date(), dt.time())
    assert P.describe_temporal(df.limit(0)).count() == len(P.column_roles(df.limit(0)).temporal)


def test_task_rules_need_few_values(spark):
    df = spark.createDataFrame([(i, i % 3, f"v{i}", i % 11, float(i % 10), 0.0 if i % 2 else -0.0) for i in range(500)],
                               "many long, few int, text string, eleven int, ten double, zero double")
    exact = {r.column: r for r in M.detect_task(df).collect()}
    capped = {r.column: r for r in M.detect_task(df, upto=M.DISTINCT_CAP).collect()}
    for c, r in exact.items():
        assert capped[c].n_distinct == min(r.n_distinct if c != "zero" else 1, 11)
        assert (capped[c].library_task, capped[c].service_task) == (r.library_task, r.service_task)
    assert M.task_for(df, "eleven") == "regression" and M.task_for(df, "ten") == "classification"


def test_risk_cards(spark):
    rows = [(i, i / 8, "High Risk" if i > 3 else "Low Risk", c) for i, c in enumerate(["a"] * 4 + ["x", "", "0", None])]
    df = spark.createDataFrame(rows, "k int, risk_score double, risk_tier string, customer_id string")
    got = [tuple(r) for r in H.risk_cards(df, 3, key="k").orderBy("place").collect()]
    assert got == [(1, "CUST-1001", "High Risk", "87.5%"), (2, "CUST-1002", "High Risk", "75.0%"), (3, "CUST-1003", "High Risk", "62.5%")]
    assert [r.id for r in H.risk_cards(df, 9, key="k").orderBy("place").collect()][3] == "x"
    assert H.risk_cards(df.drop("customer_id"), 2).count() == 2
