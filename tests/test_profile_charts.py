"""Profiling and chart operators on small hand-made fixtures (gaps, ties,
empties, constants, NaN/Inf) checked against pandas/numpy by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen.functions.exprs import sanitize
from lumen.functions.quantiles import distinct_upto, exact_quantiles
from lumen.functions.roles import column_roles, is_identifier, plot_roles
from lumen.operators import charts as C
from lumen.operators import profile as P


def as_dict(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_roles(employees):
    r = column_roles(employees)
    assert r.numeric == ["User_ID", "Age", "Salary"]
    p = plot_roles(employees)
    assert p.numeric == ["Age", "Salary"] and p.categorical == ["Name", "Country"]
    assert is_identifier(" Unnamed: 0 ") and is_identifier("user_id") and not is_identifier("paid")


def test_shape_and_missing(employees):
    s = P.table_shape(employees).collect()[0]
    assert (s.row_count, s.column_count, s.duplicate_rows) == (7, 5, 1)
    m = as_dict(P.missing_profile(employees), "column", "missing_count")
    assert m == {"User_ID": 0, "Name": 0, "Age": 1, "Salary": 2, "Country": 0}
    pct = as_dict(P.missing_profile(employees), "column", "missing_pct")
    assert pct["Salary"] == round(2 / 7 * 100, 2)
    assert {r.column for r in C.chart_missing(employees).collect()} == {"Age", "Salary"}


def test_exact_quantiles_match_pandas(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])  # a hot value
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    probs = [0.1, 0.25, 0.5, 0.75, 1 / 3]
    # final_rows small forces several refinement rounds
    got = exact_quantiles(df, [F.col("x")], probs, final_rows=100, bins=8)[0]
    exp = [pd.Series(vals).quantile(p) for p in probs]
    assert got == pytest.approx(exp, rel=0, abs=1e-12)


def test_distinct_upto_is_exact(spark):
    df = spark.range(0, 5000).select((F.col("id") % 11).cast("double").alias("a"),
                                     F.col("id").cast("double").alias("b"),
                                     F.lit(1.0).alias("c"))
    assert distinct_upto(df, [F.col("a"), F.col("b"), F.col("c")], 12) == [11, 12, 1]


def test_numeric_summary_and_median(employees):
    s = {r.column: r for r in P.numeric_summary(employees).collect()}
    ages = pd.Series([22, 24, 45, 22, 22, 32.0])
    assert s["Age"].median == ages.median() and s["Age"].mean == round(ages.mean(), 2)
    d = {r.column: r for r in P.describe_numeric(employees).collect()}
    assert d["Age"].p25 == pd.Series([22, 24, 45, 22, 22, 32.0]).quantile(0.25)


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    f = P.categorical_facts(df).collect()[0]
    assert (f.unique_count, f.mode) == (2, "a")
    empty = spark.createDataFrame([(None,), (None,)], "v string")
    assert P.categorical_facts(empty).collect()[0].mode == "N/A"


def test_histogram_matches_numpy_and_last_edge(spark):
    vals = [22.0, 24.0, 45.0, 22.0, 22.0, 32.0, 30.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["count"] for r in C.chart_histogram(df).orderBy("bin").collect()]
    n = min(12, len(set(vals)))
    exp, _ = np.histogram(vals, bins=n)
    assert got == list(exp)  # includes the max sitting on the last edge
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert C.chart_histogram(const).count() == 0
    allnull = spark.createDataFrame([(None,), (None,)], "x double")
    assert C.chart_histogram(allnull).count() == 0


def test_histogram_random_against_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.gamma(2.0, 3.0, size=2000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = [r["count"] for r in C.chart_histogram(df).orderBy("bin").collect()]
    assert got == list(np.histogram(vals, bins=12)[0])


def test_boxplot(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    b = C.chart_boxplot(spark.createDataFrame([(v,) for v in vals], "x double")).collect()[0]
    s = pd.Series(vals)
    assert (b.q1, b.median, b.q3) == (s.quantile(.25), s.median(), s.quantile(.75))
    assert b.outliers_count == 1


@pytest.mark.parametrize("k,kind,other", [(5, "donut", False), (7, "bar", False),
                                          (8, "bar", True), (15, "bar", True), (16, "bar", True)])
def test_categories(spark, k, kind, other):
    rows = [(f"c{i:02d}",) for i in range(k) for _ in range(k - i)]
    df = spark.createDataFrame(rows, "v string")
    out = C.chart_categories(df).orderBy("rank").collect()
    assert {r.chart_type for r in out} == {kind}
    assert (out[-1].category == "Other") == other
    assert sum(r["count"] for r in out) == len(rows)


def test_real_other_value_stays_separate(spark):
    rows = [("Other",)] * 9 + [(f"v{i}",) for i in range(8)]
    out = C.chart_categories(spark.createDataFrame(rows, "v string")).collect()
    assert [r.category for r in out].count("Other") == 2


def test_correlation_constant_is_null(spark):
    df = spark.range(0, 800, numPartitions=8).select(F.lit(0.1).alias("a"), F.col("id").cast("double").alias("b"))
    m = {(r.col_a, r.col_b): r.r for r in P.correlation_matrix(df).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] == 1.0
    assert P.correlation_insights(df).count() == 0


def test_correlation_pairwise_complete(employees):
    pdf = employees.toPandas()
    r = {(x.col_a, x.col_b): x.r for x in P.correlation_matrix(employees).collect()}
    assert r[("Age", "Salary")] == round(pdf["Age"].corr(pdf["Salary"]), 2)


@pytest.mark.parametrize("span,grain", [(90, "day"), (91, "month"), (1095, "month"), (1096, "year")])
def test_trend_grain(span, grain):
    assert C.trend_grain(span) == grain


def test_trend_drops_empty_and_caps_buckets(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(days=d), float(d)) for d in list(range(0, 10)) + [12, 150]]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    out = C.chart_trend(df).collect()
    # span 150 days -> month-end buckets; Jan..May 2024 has 5 buckets, two empty ones dropped
    assert [r.date for r in out if r.date] and all(r.date.endswith(("31", "29", "30")) for r in out)
    days = [(base + dt.timedelta(days=d), 1.0) for d in range(0, 89)] + [(base + dt.timedelta(days=89), 1.0)]
    more = spark.createDataFrame(days, "t timestamp_ntz, v double")
    assert C.chart_trend(more).count() == 90
    long = [(base + dt.timedelta(days=d), 1.0) for d in range(0, 200)]
    span = spark.createDataFrame(long, "t timestamp_ntz, v double")
    assert C.chart_trend(span).count() <= 100


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)], "x double")
    assert [r.x for r in sanitize(df).collect()] == [None, None, None, 1.5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert P.insights(df).collect()[0].sentence == P.EMPTY_SENTENCE
    assert C.chart_catalog(df).count() == 0
    assert C.chart_summary(df).collect()[0].message == C.EMPTY_MESSAGE


def test_insight_sentences(employees):
    s = [r.sentence for r in P.insights(employees).orderBy("seq").collect()]
    assert s[0] == ("The column 'Name' is categorical with 6 unique values. "
                    "The most frequent value is 'Dee'.")
    assert "For 'Salary': values range from 50,000.00 to 98,000.00" in s[-2] or \
        any("For 'Salary': values range from 50,000.00 to 98,000.00" in x for x in s)


def test_select_and_cap_unknown_columns(employees):
    out = P.select_and_cap(employees, ["nope"], 3, ["User_ID"])
    assert out.columns == employees.columns and out.count() == 3


def test_preview_blanks(employees):
    rows = P.preview(employees, ["User_ID"], 100).collect()
    eve = [r for r in rows if r.Name == "Eve"][0]
    assert eve.Age == "" and all(isinstance(v, str) for v in rows[0])


def test_blank_sheet_edge_case(spark):
    """35 unnamed all-null columns x 53 rows: 52 duplicates, no histogram,
    null correlations."""
    cols = [f"Unnamed: {i}" for i in range(35)]
    df = spark.createDataFrame([tuple([None] * 35)] * 53, ", ".join(f"`{c}` double" for c in cols))
    assert P.table_shape(df).collect()[0].duplicate_rows == 52
    assert C.chart_histogram(df).count() == 0
    assert all(r.r is None for r in P.correlation_matrix(df).collect())
