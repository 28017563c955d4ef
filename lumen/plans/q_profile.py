"""Profiling and chart queries (P, C, S3) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.exprs import round_dp
from lumen.operators import charts as C
from lumen.operators import profile as P
from lumen.plans import inputs as I
from lumen.plans import sqlparts as S
from lumen.plans.registry import register
from lumen.sources.tables import standardize_names


def rounded(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every double column (sums and averages depend on summation
    order in the last bits; the comparison is on rounded values)."""
    return df.select(*[round_dp(F.col(f"`{f.name}`"), dp).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


PEOPLE_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]
PEOPLE_TEXT = ["c_name", "c_mktsegment"]
PEOPLE_ALL = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
W_PEOPLE = S.with_(S.PEOPLE)
W_MEASURES = S.with_(S.MEASURES)


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _missing(c):
    return f"({c} IS NULL OR isnan({c}))" if c == "c_acctbal" else f"({c} IS NULL)"


# --------------------------------------------------------------- S3

register("standardize_names", """
SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS account_balance,
       c_mktsegment AS market_segment
FROM customer""")(lambda spark, d: standardize_names(
    I.table(spark, d, "customer").select(
        F.col("c_custkey").alias(" Customer Key"), F.col("c_name").alias("Customer-Name"),
        F.col("c_acctbal").alias("Account Balance "), F.col("c_mktsegment").alias("MARKET-SEGMENT"))))

# --------------------------------------------------------------- P1

register("table_shape", W_PEOPLE + """
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(5 AS BIGINT) AS column_count,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM people)) AS BIGINT) AS duplicate_rows,
       'c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string'
         AS column_types
FROM people""")(lambda spark, d: P.table_shape(I.people(spark, d)))

# --------------------------------------------------------------- P3 / C1

register("missing_profile", W_PEOPLE + _union([
    f"""SELECT {i} AS position, '{c}' AS "column",
       CAST(count(*) FILTER (WHERE {_missing(c)}) AS BIGINT) AS missing_count,
       round(CAST(count(*) FILTER (WHERE {_missing(c)}) AS DOUBLE) * 100.0 / count(*), 2) AS missing_pct
FROM people""" for i, c in enumerate(PEOPLE_ALL)]))(
    lambda spark, d: P.missing_profile(I.people(spark, d)))

PEOPLE_TYPES = ["bigint", "string", "int", "double", "string"]
register("column_details", W_PEOPLE + _union([
    f"""SELECT {i} AS position, '{c}' AS name, '{t}' AS type,
       CAST(count(*) FILTER (WHERE {_missing(c)}) AS BIGINT) AS missing_count,
       round(CAST(count(*) FILTER (WHERE {_missing(c)}) AS DOUBLE) * 100.0 / count(*), 2) AS missing_percentage
FROM people""" for i, (c, t) in enumerate(zip(PEOPLE_ALL, PEOPLE_TYPES))]))(
    lambda spark, d: P.column_details(I.people(spark, d)))

register("chart_missing", W_PEOPLE + "SELECT * FROM (" + _union([
    f"""SELECT '{c}' AS "column",
       CAST(count(*) FILTER (WHERE {_missing(c)}) AS BIGINT) AS missing_count,
       round(CAST(count(*) FILTER (WHERE {_missing(c)}) AS DOUBLE) * 100.0 / count(*), 2)
         AS missing_percentage
FROM people""" for c in PEOPLE_ALL]) + ") WHERE missing_count > 0")(
    lambda spark, d: C.chart_missing(I.people(spark, d)))

# --------------------------------------------------------------- P6 / P11 / P7

register("numeric_summary", W_PEOPLE + _union([
    f"""SELECT '{c}' AS "column", round(avg(CAST({c} AS DOUBLE)), 2) AS mean,
       round(median(CAST({c} AS DOUBLE)), 2) AS median,
       round(min(CAST({c} AS DOUBLE)), 2) AS min, round(max(CAST({c} AS DOUBLE)), 2) AS max
FROM people""" for c in PEOPLE_NUMERIC]))(
    lambda spark, d: P.numeric_summary(I.people(spark, d)))

register("numeric_ranges", W_PEOPLE + _union([
    f"""SELECT {i} AS position, '{c}' AS "column", min(CAST({c} AS DOUBLE)) AS min,
       max(CAST({c} AS DOUBLE)) AS max, round(avg(CAST({c} AS DOUBLE)), 6) AS avg
FROM people HAVING count({c}) > 0""" for i, c in enumerate(PEOPLE_NUMERIC)]))(
    lambda spark, d: rounded(P.numeric_ranges(I.people(spark, d))))

register("describe_numeric", W_PEOPLE + _union([
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count,
       round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std,
       CAST(min({c}) AS DOUBLE) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
       CAST(max({c}) AS DOUBLE) AS max
FROM people""" for c in PEOPLE_NUMERIC]))(
    lambda spark, d: rounded(P.describe_numeric(I.people(spark, d))))


def _mode_parts(src, c, position=None):
    return f"""(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY count(*) DESC, {c} LIMIT 1)"""


register("describe_categorical", W_PEOPLE + _union([
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count,
       CAST(count(DISTINCT {c}) AS BIGINT) AS "unique",
       {_mode_parts('people', c)} AS top,
       CAST((SELECT count(*) FROM people WHERE {c} IS NOT NULL GROUP BY {c}
             ORDER BY count(*) DESC, {c} LIMIT 1) AS BIGINT) AS freq
FROM people""" for c in PEOPLE_TEXT]))(
    lambda spark, d: P.describe_categorical(I.people(spark, d)))

register("describe_temporal", """
WITH t AS (SELECT o_orderdate AS t, epoch_us(o_orderdate) AS u FROM orders),
q AS (SELECT count(t) AS n, avg(u) AS m, min(u) AS a, max(u) AS b, quantile_cont(CAST(u AS DOUBLE), [0.25, 0.5, 0.75]) AS p FROM t)
SELECT 'o_orderdate' AS "column", CAST(n AS BIGINT) AS count, make_timestamp(CAST(floor(m) AS BIGINT)) AS mean,
       make_timestamp(a) AS min, make_timestamp(CAST(floor(p[1]) AS BIGINT)) AS p25,
       make_timestamp(CAST(floor(p[2]) AS BIGINT)) AS p50, make_timestamp(CAST(floor(p[3]) AS BIGINT)) AS p75,
       make_timestamp(b) AS max
FROM q""")(lambda spark, d: P.describe_temporal(I.table(spark, d, "orders")))

register("categorical_facts", W_PEOPLE + _union([
    f"""SELECT {i} AS position, '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count,
       coalesce({_mode_parts('people', c)}, 'N/A') AS mode
FROM people""" for i, c in enumerate(PEOPLE_TEXT)]))(
    lambda spark, d: P.categorical_facts(I.people(spark, d)))

register("top_values", W_PEOPLE + "SELECT \"column\", rank, value, \"count\" FROM (" + _union([
    f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,
       {c} AS value, CAST(count(*) AS BIGINT) AS "count"
FROM people WHERE {c} IS NOT NULL GROUP BY {c}""" for c in PEOPLE_TEXT]) + ") WHERE rank <= 5")(
    lambda spark, d: P.top_values(I.people(spark, d)))

# --------------------------------------------------------------- P8

register("column_summary", W_PEOPLE + _union(
    [f"""SELECT '{c}' AS "column", 'numeric' AS kind, round(avg(CAST({c} AS DOUBLE)), 2) AS mean,
       round(median(CAST({c} AS DOUBLE)), 2) AS median, CAST(NULL AS BIGINT) AS unique_values,
       CAST(count(*) FILTER (WHERE {_missing(c)}) AS BIGINT) AS missing FROM people"""
     for c in PEOPLE_NUMERIC] +
    [f"""SELECT '{c}' AS "column", 'categorical' AS kind, CAST(NULL AS DOUBLE) AS mean,
       CAST(NULL AS DOUBLE) AS median, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values,
       CAST(count(*) FILTER (WHERE {_missing(c)}) AS BIGINT) AS missing FROM people"""
     for c in PEOPLE_TEXT]))(lambda spark, d: P.column_summary(I.people(spark, d)))

# --------------------------------------------------------------- P14 / P15


def _corr(a, b):
    return (f"(CASE WHEN isnan(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) THEN NULL "
            f"ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END)")


register("correlation_matrix", W_PEOPLE + _union([
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr(a, b)}, 2) AS r FROM people"""
    for a in PEOPLE_NUMERIC for b in PEOPLE_NUMERIC]))(
    lambda spark, d: P.correlation_matrix(I.people(spark, d)))

MEAS = I.MEASURE_COLUMNS
PRICED = I.PRICED_COLUMNS
register("correlation_insights", S.with_(S.PRICED) + "SELECT i, j, col_a, col_b, r, strength, direction FROM (" + _union([
    f"""SELECT {i} AS i, {j} AS j, '{PRICED[i]}' AS col_a, '{PRICED[j]}' AS col_b,
       round({_corr(PRICED[i], PRICED[j])}, 6) AS r,
       CASE WHEN abs({_corr(PRICED[i], PRICED[j])}) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
       CASE WHEN {_corr(PRICED[i], PRICED[j])} > 0 THEN 'positive' ELSE 'negative' END AS direction,
       {_corr(PRICED[i], PRICED[j])} AS raw
FROM priced""" for i in range(len(PRICED)) for j in range(i + 1, len(PRICED))]) + """)
WHERE abs(raw) > 0.4""")(lambda spark, d: rounded(P.correlation_insights(I.priced(spark, d))))

# --------------------------------------------------------------- P12 / P13


def _sentence_sql(with_=W_PEOPLE, src="people", text_cols=PEOPLE_TEXT, num_cols=PEOPLE_NUMERIC):
    cat = [f"""SELECT {i} AS seq, 'The column ''{c}'' is categorical with ' ||
        CAST(count(DISTINCT {c}) AS VARCHAR) || ' unique values. The most frequent value is ''' ||
        coalesce({_mode_parts(src, c)}, 'N/A') || '''.' AS sentence FROM {src}"""
           for i, c in enumerate(text_cols)]
    num = [f"""SELECT {len(text_cols) + i} AS seq, 'For ''{c}'': values range from ' ||
        format('{{:,.2f}}', round(min(CAST({c} AS DOUBLE)), 2)) || ' to ' ||
        format('{{:,.2f}}', round(max(CAST({c} AS DOUBLE)), 2)) || ' (Average: ' ||
        format('{{:,.2f}}', round(avg(CAST({c} AS DOUBLE)), 2)) || ').' AS sentence
        FROM {src} HAVING count({c}) > 0""" for i, c in enumerate(num_cols)]
    n = len(num_cols)
    base = len(text_cols) + n
    pairs = [f"""SELECT {base + i * n + j} AS seq, 'Detected a ' ||
        CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END || ' ' ||
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ' relationship (' ||
        printf('%.2f', round(r, 2)) || ') between ''{num_cols[i]}'' and ''{num_cols[j]}''.'
        AS sentence FROM (SELECT {_corr(num_cols[i], num_cols[j])} AS r FROM {src})
        WHERE abs(r) > 0.4""" for i in range(n) for j in range(i + 1, n)]
    return with_ + "SELECT CAST(seq AS INTEGER) AS seq, sentence FROM (" + _union(cat + num + pairs) + ")"


register("insights", _sentence_sql())(lambda spark, d: P.insights(I.people(spark, d)))
register("insights_correlated", _sentence_sql(S.with_(S.PRICED), "priced", [], PRICED))(
    lambda spark, d: P.insights(I.priced(spark, d)))


def _recommend_sql():
    parts = []
    for i, c in enumerate(PEOPLE_TEXT):
        parts.append(f"""SELECT {2 * i} AS seq, 'bar' AS type, '{c}' AS columns,
            'To show the distribution of categories in ''{c}''.' AS reason
            FROM people HAVING count(DISTINCT {c}) <= 15""")
        parts.append(f"""SELECT {2 * i + 1} AS seq, 'pie' AS type, '{c}' AS columns,
            'To visualize the market share/proportion of ''{c}''.' AS reason
            FROM people HAVING count(DISTINCT {c}) <= 15""")
    base = 2 * len(PEOPLE_TEXT)
    for i, c in enumerate(PEOPLE_NUMERIC):
        parts.append(f"""SELECT {base + i} AS seq, 'histogram' AS type, '{c}' AS columns,
            'To view the spread and distribution of values in ''{c}''.' AS reason
            FROM people HAVING count({c}) > 0""")
    n = len(PEOPLE_NUMERIC)
    base += n
    for i in range(n):
        for j in range(i + 1, n):
            a, b = PEOPLE_NUMERIC[i], PEOPLE_NUMERIC[j]
            parts.append(f"""SELECT {base + i * n + j} AS seq, 'scatter' AS type, '{a},{b}' AS columns,
                'To visualize the relationship and correlation between ''{a}'' and ''{b}''.' AS reason
                FROM (SELECT {_corr(a, b)} AS r FROM people) WHERE abs(r) > 0.4""")
    return W_PEOPLE + "SELECT CAST(seq AS INTEGER) AS seq, type, columns, reason FROM (" + _union(parts) + ")"


register("chart_recommendations", _recommend_sql())(
    lambda spark, d: P.chart_recommendations(I.people(spark, d)))

# --------------------------------------------------------------- P16 / P17

register("preview", W_PEOPLE + """
SELECT coalesce(CAST(c_custkey AS VARCHAR), '') AS c_custkey, coalesce(c_name, '') AS c_name,
       coalesce(CAST(c_nationkey AS VARCHAR), '') AS c_nationkey,
       coalesce(CAST(c_acctbal AS VARCHAR), '') AS c_acctbal, coalesce(c_mktsegment, '') AS c_mktsegment
FROM people ORDER BY people.c_custkey LIMIT 100""")(
    lambda spark, d: P.preview(I.people(spark, d), ["c_custkey"]))

register("select_and_cap", W_PEOPLE + """
SELECT c_name, c_acctbal FROM people ORDER BY c_custkey LIMIT 50""")(
    lambda spark, d: P.select_and_cap(I.people(spark, d), ["c_name", "c_acctbal", "no_such_column"],
                                      50, ["c_custkey"]))

# --------------------------------------------------------------- C2..C6

register("chart_histogram", W_MEASURES + S.histogram_sql("measures", MEAS))(
    lambda spark, d: C.chart_histogram(I.measures(spark, d), include=MEAS))

register("chart_boxplot", W_MEASURES + _union([
    f"""SELECT '{c}' AS "column", min({c}) AS min, round(q1, 2) AS q1, round(q2, 2) AS median,
       round(q3, 2) AS q3, max({c}) AS max,
       CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT)
         AS outliers_count
FROM measures, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
                       quantile_cont({c}, 0.75) AS q3 FROM measures)
GROUP BY q1, q2, q3 HAVING count(DISTINCT {c}) > 1""" for c in MEAS]))(
    lambda spark, d: C.chart_boxplot(I.measures(spark, d), include=MEAS))

register("chart_categories", W_PEOPLE + _union([
    f"""SELECT * FROM (
  WITH vc AS (SELECT {c} AS v, count(*) AS n FROM people WHERE {c} IS NOT NULL GROUP BY {c}),
  rk AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rn FROM vc),
  tot AS (SELECT count(*) AS d, sum(n) AS t FROM vc),
  kind AS (SELECT CASE WHEN least(d, 7) <= 5 THEN 'donut' ELSE 'bar' END AS ct FROM tot)
  SELECT '{c}' AS "column", CAST(rn AS INTEGER) AS rank, v AS category, CAST(n AS BIGINT) AS "count",
         ct AS chart_type FROM rk, kind WHERE rn <= 7
  UNION ALL
  SELECT '{c}', 8, 'Other', CAST(t - (SELECT sum(n) FROM rk WHERE rn <= 7) AS BIGINT), ct
  FROM tot, kind WHERE d > 7)""" for c in PEOPLE_TEXT]))(
    lambda spark, d: C.chart_categories(I.people(spark, d)))


def _scatter_sql():
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    score = _union([f"""SELECT {k} AS k, '{MEAS[i]}' AS a, '{MEAS[j]}' AS b,
        coalesce(abs({_corr(MEAS[i], MEAS[j])}), 0.0) AS s FROM measures"""
                    for k, (i, j) in enumerate(pairs)])
    picks = _union([f"""SELECT * FROM (SELECT l_orderkey AS k0, l_linenumber AS k1,
          CAST({MEAS[i]} AS DOUBLE) AS x, CAST({MEAS[j]} AS DOUBLE) AS y, {k} AS k
        FROM measures WHERE {MEAS[i]} IS NOT NULL AND {MEAS[j]} IS NOT NULL
        ORDER BY l_orderkey, l_linenumber LIMIT 150)""" for k, (i, j) in enumerate(pairs)])
    return W_MEASURES + f""", scores AS ({score}),
ranked AS (SELECT k, a, b, s, row_number() OVER (ORDER BY s DESC, k) - 1 AS pair FROM scores),
pts AS ({picks})
SELECT CAST(pair AS INTEGER) AS pair, a AS x_col, b AS y_col, round(s, 2) AS score, k0, k1, x, y
FROM ranked JOIN pts USING (k) WHERE pair < 2""".replace("WITH ", "WITH ", 1)


register("chart_scatter", _scatter_sql())(
    lambda spark, d: C.chart_scatter(I.measures(spark, d), ["l_orderkey", "l_linenumber"], include=MEAS))


def _trend_sql(src_cte: str, tcol: str, vcol: str) -> str:
    return f"""WITH src AS ({src_cte}),
t AS (SELECT {tcol} AS t, CAST({vcol} AS DOUBLE) AS v FROM src WHERE {tcol} IS NOT NULL AND {vcol} IS NOT NULL),
s AS (SELECT min(t) AS a, floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000) AS span FROM t),
b AS (SELECT CASE WHEN span <= 90 THEN CAST(t AS DATE)
                  WHEN span <= 1095 THEN last_day(CAST(t AS DATE))
                  ELSE make_date(year(t), 12, 31) END AS d,
             CASE WHEN span <= 90 THEN date_diff('day', CAST(a AS DATE), CAST(t AS DATE))
                  WHEN span <= 1095 THEN (year(t) - year(a)) * 12 + month(t) - month(a)
                  ELSE year(t) - year(a) END AS idx, v
      FROM t, s)
SELECT strftime(d, '%Y-%m-%d') AS date, round(avg(v), 2) AS value FROM b WHERE idx < 100 GROUP BY d"""


register("chart_trend_day", _trend_sql("SELECT ts, value FROM events", "ts", "value"))(
    lambda spark, d: C.chart_trend(I.table(spark, d, "events").select("ts", "value")))
# All orders, their years folded into two so that the span asks for months.
FOLDED = "make_{}(1995 + year(o_orderdate) % 2, month(o_orderdate), least(day(o_orderdate), 28), 0, 0, 0)"
register("chart_trend_month", _trend_sql(
    f"SELECT {FOLDED.format('timestamp')} AS o_orderdate, o_totalprice FROM orders", "o_orderdate", "o_totalprice"))(
    lambda spark, d: C.chart_trend(I.table(spark, d, "orders").select(
        F.expr(FOLDED.format("timestamp_ntz")).alias("o_orderdate"), "o_totalprice")))
register("chart_trend_year", _trend_sql("SELECT o_orderdate, o_totalprice FROM orders",
                                        "o_orderdate", "o_totalprice"))(
    lambda spark, d: C.chart_trend(I.table(spark, d, "orders").select("o_orderdate", "o_totalprice")))

# --------------------------------------------------------------- C7 / C8

register("chart_summary", W_PEOPLE + """
SELECT CAST(1 + 2 * (SELECT count(*) FROM (
          SELECT 1 FROM people HAVING count(DISTINCT c_custkey) > 1 UNION ALL
          SELECT 1 FROM people HAVING count(DISTINCT c_nationkey) > 1 UNION ALL
          SELECT 1 FROM people HAVING count(DISTINCT c_acctbal) > 1))
       + 2 + 2 AS BIGINT) AS total_charts,
       CAST(3 AS BIGINT) AS numeric_features, CAST(2 AS BIGINT) AS categorical_features,
       CAST(0 AS BIGINT) AS datetime_features, true AS has_missing_data,
       CAST(NULL AS VARCHAR) AS message""")(lambda spark, d: C.chart_summary(I.people(spark, d)))

ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORD_CAT = ["o_orderstatus", "o_orderpriority"]


def _catalog_sql():
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    scores = _union([f"""SELECT {k} AS k, '{ORD_NUM[i]}' AS a, '{ORD_NUM[j]}' AS b,
        coalesce(abs({_corr(ORD_NUM[i], ORD_NUM[j])}), 0.0) AS s FROM orders""" for k, (i, j) in enumerate(pairs)])
    rows = []
    for n, c in enumerate(ORD_NUM):
        rows.append(f"""SELECT {2 * n} AS ord, 'hist_{c}' AS chart_id, 'histogram' AS chart_type,
            'Distribution of {c}' AS title FROM orders HAVING count(DISTINCT {c}) > 1""")
        rows.append(f"""SELECT {2 * n + 1}, 'boxplot_{c}', 'boxplot', '{c} Summary (Box Plot Specs)'
            FROM orders HAVING count(DISTINCT {c}) > 1""")
    for n, c in enumerate(ORD_CAT):
        rows.append(f"""SELECT {10 + n}, 'cat_{c}',
            CASE WHEN least(count(DISTINCT {c}), 7) <= 5 THEN 'donut' ELSE 'bar' END,
            'Top Categories in {c}' FROM orders HAVING count({c}) > 0""")
    rows.append("""SELECT 20 + rk, 'scatter_' || a || '_vs_' || b, 'scatter',
        'Relationship: ' || a || ' vs ' || b || ' (Correlation: ' || CAST(round(s, 2) AS VARCHAR) || ')'
        FROM sc WHERE rk < 2""")
    rows.append("""SELECT 30, 'line_trend_o_orderdate', 'line', 'Trend of o_orderkey over Time (o_orderdate)'
        FROM orders WHERE o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL HAVING count(*) > 0""")
    return f"""WITH sc AS (SELECT k, a, b, s, row_number() OVER (ORDER BY s DESC, k) - 1 AS rk FROM ({scores})),
rows AS ({_union(rows)})
SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS seq, chart_id, chart_type, title FROM rows"""


register("chart_catalog", _catalog_sql())(lambda spark, d: C.chart_catalog(I.table(spark, d, "orders")))

def _payload_sql():
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    box = _union([f"""SELECT 'boxplot_{c}' AS chart_id, unnest(range(6)) AS point,
        unnest(['min', 'q1', 'median', 'q3', 'max', 'outliers_count']) AS label,
        unnest([min({c}), round(q[1], 2), round(q[2], 2), round(q[3], 2), max({c}),
                count(*) FILTER ({c} < q[1] - 1.5 * (q[3] - q[1]) OR {c} > q[3] + 1.5 * (q[3] - q[1]))]) AS y
      FROM orders, (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM orders) GROUP BY q""" for c in ORD_NUM])
    cats = _union([f"""SELECT * FROM (WITH n AS (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r
        FROM orders WHERE {c} IS NOT NULL GROUP BY {c})
      SELECT 'cat_{c}' AS chart_id, least(r, 8) - 1 AS point, CASE WHEN r > 7 THEN 'Other' ELSE v END AS label, sum(n) AS y
      FROM n GROUP BY ALL)""" for c in ORD_CAT])
    scores = _union([f"""SELECT {k} AS k, '{ORD_NUM[i]}' AS a, '{ORD_NUM[j]}' AS b,
        coalesce(abs({_corr(ORD_NUM[i], ORD_NUM[j])}), 0.0) AS s FROM orders""" for k, (i, j) in enumerate(pairs)])
    points = _union([f"""SELECT {k} AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS point,
        CAST({ORD_NUM[i]} AS DOUBLE) AS x, CAST({ORD_NUM[j]} AS DOUBLE) AS y FROM orders
        WHERE {ORD_NUM[i]} IS NOT NULL AND {ORD_NUM[j]} IS NOT NULL QUALIFY point < 150""" for k, (i, j) in enumerate(pairs)])
    parts = [f"""SELECT 'hist_' || "column" AS chart_id, bin AS point, "range" AS label, NULL AS x, "count" AS y
               FROM ({S.histogram_sql("orders", ORD_NUM)})""",
             f"SELECT chart_id, point, label, NULL, y FROM ({box})", f"SELECT chart_id, point, label, NULL, y FROM ({cats})",
             f"""SELECT 'scatter_' || a || '_vs_' || b, point, NULL, x, y FROM
               (SELECT *, row_number() OVER (ORDER BY s DESC, k) AS place FROM ({scores})) JOIN ({points}) USING (k) WHERE place <= 2""",
             f"""SELECT 'line_trend_o_orderdate', row_number() OVER (ORDER BY date) - 1, date, NULL, value
               FROM ({_trend_sql("SELECT * FROM orders", "o_orderdate", "o_orderkey")})"""]
    return ("SELECT chart_id, CAST(point AS INTEGER) AS point, label, round(CAST(x AS DOUBLE), 6) AS x, "
            f"round(CAST(y AS DOUBLE), 6) AS y FROM ({_union(parts)})")


register("chart_payload", _payload_sql())(
    lambda spark, d: rounded(C.chart_payload(I.table(spark, d, "orders"), ["o_orderkey"])))

register("sanitize", S.with_(S.ODD_FLOATS) + """
SELECT l_orderkey, l_linenumber,
       CASE WHEN isnan(l_discount) OR isinf(l_discount) THEN NULL ELSE l_discount END AS l_discount,
       l_returnflag
FROM odd""")(lambda spark, d: C.sanitize(I.odd_floats(spark, d)))
