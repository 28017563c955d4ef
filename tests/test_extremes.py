"""Inputs at the edges: infinities, wide ranges, large integers, many values."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.functions.exprs import number_text
from lumen.functions.quantiles import exact_quantiles
from lumen.operators import charts as C
from lumen.operators import clean as D
from lumen.operators import exposure as X
from lumen.operators import model as M
from lumen.operators import profile as P
from lumen.operators.search import search_snippets
from lumen.sources.csv import read_csv_table


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, float(i % 10)) for i in range(40)] + [(40, math.inf), (41, -math.inf), (42, math.nan), (43, None)]
    return spark.createDataFrame(rows, "k long, x double")


def test_infinities_are_missing_everywhere(odd):
    s = {r.column: r for r in P.numeric_summary(odd).collect()}["x"]
    assert s["mean"] == 4.5 and s["max"] == 9.0
    assert {r.column: r.missing_count for r in P.missing_profile(odd).collect()}["x"] == 4
    bars = [r for r in C.chart_histogram(odd, include=["x"]).collect()]
    assert sum(r["count"] for r in bars) == 40 and len(bars) == 10
    assert D.drop_missing_rows(odd, "x").count() == 40
    for f in (D.fill_mean, D.fill_median):
        assert {r.x for r in f(odd, "x").where("k >= 40").collect()} == {4.5}
    assert {r.x for r in D.fill_mode(odd, "x").where("k >= 40").collect()} == {0.0}
    assert {r.x for r in D.fill_constant(odd, "x", 7.0).where("k >= 40").collect()} == {7.0}


@pytest.mark.parametrize("kind", ["log", "both signs", "one far value", "subnormal", "normal"])
def test_quantiles_of_any_doubles(spark, kind):
    rng = np.random.default_rng(0)
    n = 6000
    x = {"log": 10.0 ** rng.uniform(-300, 300, n), "normal": rng.standard_normal(n),
         "both signs": rng.choice([-1.0, 1.0, 0.0], n) * 10.0 ** rng.uniform(-300, 307, n),
         "one far value": np.append(rng.uniform(0, 1, n), 1e308), "subnormal": rng.integers(0, 50, n) * 5e-324}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, [F.col("x")], probs, bins=64, final_rows=10)[0]
    s = np.sort(x)
    for p, g in zip(probs, got):
        h = (len(s) - 1) * p
        a, b = float(s[int(h)]), float(s[min(int(h) + 1, len(s) - 1)])
        assert g == pytest.approx(a + (b - a) * (h - int(h)), rel=1e-12, abs=0)


def test_number_text(spark):
    values = [0.0, 1e7, 12345678.5, 1e15, 123456789012345.6, 1e16, 1.5e300, 1e-4, 1e-5, 0.000123, -2.5e-7, 0.1, 9007199254740993.0,
              -1e7, 16666666.67]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == {v: repr(v) for v in values}


def test_casts_keep_values(spark):
    big = 2**53 + 1
    ints = spark.createDataFrame([(big,), (None,)], "x long")
    assert {r.x for r in D.cast_int(ints, "x").collect()} == {big, None}
    filled = D.fill_constant(ints, "x", 0.5)
    assert dict(filled.dtypes)["x"] == "double" and {r.x for r in filled.collect()} == {float(big), 0.5}
    assert {r.x for r in D.fill_constant(ints, "x", "none").collect()} == {str(big), "none"}


def test_csv_large_integers_and_ragged_rows(spark, tmpdir_path):
    ids = [9223372036854775807, 1234567890123456789, 1234567890123456788]
    path = os.path.join(tmpdir_path, "ids.csv")
    with open(path, "w") as f:
        f.write("id,v\n" + "".join(f"{i},x\n" for i in ids))
    got = read_csv_table(spark, path)
    assert dict(got.dtypes)["id"] == "bigint" and sorted(r.id for r in got.collect()) == sorted(ids)
    for extra in ("3,4,5\n", "3,4,5,6,7\n"):
        ragged = os.path.join(tmpdir_path, f"ragged{len(extra)}.csv")
        with open(ragged, "w") as f:
            f.write("a,b\n1,2\n" + extra)
        with pytest.raises(Exception, match="more than 2 values"):
            read_csv_table(spark, ragged, infer=False).collect()
    short = os.path.join(tmpdir_path, "short.csv")
    with open(short, "w") as f:
        f.write("a,b\n1,2\n3\n")
    assert sorted((r.a, r.b) for r in read_csv_table(spark, short, infer=False).collect()) == [("1", "2"), ("3", None)]
    folder = os.path.join(tmpdir_path, "export.v2")
    spark.createDataFrame([(1, 2)], "a int, b int").write.option("header", True).csv(folder)
    assert [tuple(r) for r in read_csv_table(spark, folder).collect()] == [(1, 2)]


def test_csv_files_are_split(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "long.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + "".join(f"{i},some text of a row\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        assert read_csv_table(spark, path, infer=False).rdd.getNumPartitions() > 3
        quoted = os.path.join(tmpdir_path, "quoted.csv")
        with open(quoted, "w") as f:
            f.write('a,b\n1,"two\nlines"\n')
        assert read_csv_table(spark, quoted, multi_line=True).first().b == "two\nlines"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stratified_split_of_many_classes(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(12_000) if i % 3 else -1) for i in range(40_000)] + [(50_000, None), (50_001, None)]
    df = spark.createDataFrame(rows, "k long, c long")
    got = M.stratified_split(df, "c", "k").groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("t"))
    assert all(r.t == int(0.8 * (r.n - 1)) + 1 for r in got.collect())


def test_forest_with_many_categories_and_booleans(spark):
    rows = [(i, f"v{i % 400}", i % 2 == 0, i % 2) for i in range(1600)]
    df = spark.createDataFrame(rows, "k long, t string, flag boolean, y int")
    trained, _ = M.fit_model(df, "y", task="classification", features=["t", "flag"], key="k", trees=5, depth=5)
    assert trained.metrics["metric_value"] > 0.95
    scored = M.score_batch(trained, df, keep=["k", "y"])
    assert scored.where("prediction <> y").count() == 0
    codes = M.label_codes(spark.createDataFrame([("a",), ("z",), (None,)], "t string"), ["t"])
    assert {r.value: r.code for r in codes.collect()} == {"a": 0, "nan": 1, "z": 2}


def test_range_table_of_digits_and_null_secrets(spark, tmpdir_path):
    corpus = spark.createDataFrame([("12345", "A" * 35, 1), ("99999", "B" * 35, 2)], "prefix string, suffix string, count long")
    path = os.path.join(tmpdir_path, "ranges")
    X.write_hash_corpus(corpus, path)
    table = X.read_hash_corpus(spark, path)
    assert dict(table.dtypes)["p2"] == "string"
    got = X.secret_exposure(spark.createDataFrame([("hello",)], "secret string"), table).collect()
    assert [r.breached for r in got] == [False]
    for bad in ("", None):
        with pytest.raises(Exception, match="cannot be empty"):
            X.secret_exposure(spark.createDataFrame([(bad,), ("x",)], "secret string"), table).collect()


def test_backslash_in_a_search(spark):
    rows = [(1, "a\\b", "", ""), (2, "ab", "", "")]
    df = spark.createDataFrame(rows, "id long, title string, code string, tags string")
    assert [r.id for r in search_snippets(df, "\\").collect()] == [1]
