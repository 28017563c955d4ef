"""One-scan correlations and bounded-scan quantiles of wide tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen.functions import quantiles as Q
from lumen.functions.gram import pair_correlations
from lumen.functions.quantiles import exact_quantiles
from lumen.operators import charts as C
from lumen.operators import profile as P


def wide(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    x[:, 1] = 1e9 + x[:, 1] * 1e-3  # a mean far larger than the spread
    x[:, 2] = 0.1
    x[rng.random((n, d)) < 0.2] = np.nan
    x[:, 4] = np.where(rng.random(n) < 0.5, x[:, 3] * -2, np.nan)
    x[:, 5] = np.nan
    x[:, 6] = np.where(np.isnan(x[:, 7]), x[:, 6], 3.0)  # constant wherever 7 is known
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])


def plain_r(a, b):
    both = ~(np.isnan(a) | np.isnan(b))
    a, b = a[both], b[both]
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return None
    return float(np.corrcoef(a, b)[0, 1])


def test_correlations_match_numpy(spark):
    pdf = wide(3000, 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    try:
        df = spark.createDataFrame(pdf).repartition(5)
        got = P.correlation_values(df, list(pdf.columns))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 45
    for (i, j), r in got.items():
        want = plain_r(pdf.iloc[:, i].to_numpy(), pdf.iloc[:, j].to_numpy())
        assert r is None if want is None else r == pytest.approx(want, abs=1e-6), (i, j)
    assert got[6, 7] is None and got[3, 4] == pytest.approx(-1.0)


def test_hundred_columns_are_one_scan(spark, tmpdir_path):
    path = f"{tmpdir_path}/wide"
    spark.createDataFrame(wide(200, 100)).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (P.correlation_matrix(df), P.correlation_insights(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1
    assert P.correlation_matrix(df).count() == 100 * 100


def test_correlations_of_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r.r for r in P.correlation_matrix(df).collect()} == {None}
    assert {r.r for r in P.correlation_matrix(df.limit(0)).collect()} == {None}
    two = spark.createDataFrame([(1.0, 5.0), (2.0, 4.0), (None, 3.0), (float("inf"), 9.0)], "a double, b double")
    assert {(r.col_a, r.col_b): r.r for r in P.correlation_matrix(two).collect()}["a", "b"] == -1.0
    assert pair_correlations(two.select("a"), [F.col("a")]).count() == 1


def scans_of(spark, df, fn):
    """fn(df), and how often the rows of df were produced."""
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b
    rows = df.count()
    out = fn(df.mapInArrow(counted, df.schema))
    return out, n.value / rows


@pytest.mark.parametrize(("final", "size"), [(50_000, 1024), (100, 1024), (100, 8), (20, 64)])
def test_quantiles_take_three_scans_at_most(spark, final, size):
    rng = np.random.default_rng(size)
    pdf = pd.DataFrame({"a": rng.normal(size=8000), "b": np.exp(rng.normal(size=8000) * 40), "c": np.repeat(7.5, 8000),
                        "d": np.where(rng.random(8000) < 0.4, 1.0, rng.random(8000)), "e": np.full(8000, np.nan)})
    pdf.loc[::7, "a"] = np.nan
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(pdf).repartition(6)
    got, scans = scans_of(spark, df, lambda d: exact_quantiles(
        d, [F.when(~F.isnan(c), F.col(c)) for c in pdf.columns], probs, bins=size, final_rows=final))
    for name, qs in zip(pdf.columns, got):
        x = pdf[name].dropna()
        assert qs == ([None] * len(probs) if x.empty else pytest.approx([x.quantile(p) for p in probs], rel=1e-9))
    assert scans <= 3


def test_quantiles_stay_exact_if_a_sketch_errs(spark, monkeypatch):
    monkeypatch.setattr(Q, "_margin", lambda size: 1e-6)  # brackets that hardly ever hold the rank
    x = np.random.default_rng(3).normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = exact_quantiles(df, [F.col("x")], [0.1, 0.5, 0.9], bins=8, final_rows=10)[0]
    assert got == pytest.approx([np.quantile(x, p) for p in (0.1, 0.5, 0.9)], rel=1e-12)


def test_quantiles_with_conditions_and_known_counts(spark):
    x = list(range(1000))
    df = spark.createDataFrame([(float(v), v % 3) for v in x], "x double, k int")
    cond = [F.col("k") == 0, F.col("k") == 5, None]
    got = exact_quantiles(df, [F.col("x")] * 3, [0.5], conds=cond, final_rows=50)
    assert got == [[pd.Series(x[::3]).median()], [None], [499.5]]
    assert exact_quantiles(df, [F.col("x")], [0.5], stats=[(1000, 0.0, 999.0)]) == [[499.5]]


def test_catalog_takes_three_scans_and_names_the_payload(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({"key": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "same": 1.5, "five": rng.integers(0, 5, n).astype(str),
                        "six": rng.integers(0, 6, n).astype(str), "when": pd.date_range("2024-01-01", periods=n, freq="h")})
    pdf.loc[3, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumns({"void": F.lit(None).cast("string"), "when": F.col("when").cast("timestamp_ntz"),
                                                 "a": F.when(~F.isnan("a"), F.col("a"))})
    rows, scans = scans_of(spark, df, lambda d: C.chart_catalog(d).collect())
    assert scans <= 3
    kinds = {r.chart_id: r.chart_type for r in rows}
    assert kinds["cat_five"] == "donut" and kinds["cat_six"] == "bar" and "cat_void" not in kinds and "hist_same" not in kinds
    assert kinds["missing_data_overview"] == "bar" and "line_trend_when" in kinds
    points = C.chart_payload(df, ["key"]).collect()
    assert {r.chart_id for r in points} == set(kinds)
    for c in kinds:
        own = sorted(r.point for r in points if r.chart_id == c)
        assert own == list(range(len(own))) or c == "missing_data_overview"
    assert C.chart_catalog(df.limit(0)).count() == 0 and C.chart_payload(df.limit(0), ["key"]).count() == 0
    assert C.chart_summary(df.limit(0)).first().total_charts == 0
