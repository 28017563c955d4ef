"""Risk (H4-H10) and market (T1-T5) queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.operators import market as T
from lumen.operators import risk as H
from lumen.plans import inputs as I
from lumen.plans.q_profile import rounded
from lumen.plans.registry import register

RISK = """
WITH mm AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
rf AS (SELECT c_custkey, c_name, c_mktsegment, (c_acctbal - lo) / (hi - lo) AS risk_score,
              CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS churn
       FROM customer, mm),
edges AS (SELECT quantile_cont(risk_score, CAST(1 AS DOUBLE) / 3) AS e1,
                 quantile_cont(risk_score, CAST(2 AS DOUBLE) / 3) AS e2 FROM rf),
pred AS (SELECT rf.*, CASE WHEN risk_score <= e1 THEN 'Low Risk'
                           WHEN risk_score <= e2 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_tier
         FROM rf, edges),
hk AS (SELECT count(*) FILTER (WHERE risk_tier = 'High Risk') AS h, count(*) AS n FROM pred)
"""


def predictions(spark, d):
    return H.risk_tiers(I.risk_frame(spark, d))


register("risk_tiers", RISK + """
SELECT c_custkey, c_name, c_mktsegment, round(risk_score, 6) AS risk_score, churn, risk_tier FROM pred""")(
    lambda spark, d: rounded(predictions(spark, d)))

register("risk_kpis", RISK + """
SELECT CAST(n AS BIGINT) AS total_customers,
       CASE WHEN n = 0 THEN 0.0 ELSE round((SELECT avg(risk_score) FROM pred) * 100, 1) END AS avg_risk,
       CAST(h AS BIGINT) AS high_risk_count,
       CASE WHEN n = 0 THEN 0.0 ELSE round(CAST(h AS DOUBLE) / n * 100, 1) END AS high_risk_pct,
       '$' || format('{:,}', h * 450) AS revenue_at_risk
FROM hk""")(lambda spark, d: H.risk_kpis(predictions(spark, d)))

register("risk_distribution", RISK + """
SELECT risk_tier, CAST(count(*) AS BIGINT) AS "count" FROM pred GROUP BY risk_tier""")(
    lambda spark, d: H.risk_distribution(predictions(spark, d)))

register("churn_summary", RISK + """
SELECT CAST(count(*) AS BIGINT) AS total_customers,
       round(avg(CAST(coalesce(churn, 0) AS DOUBLE)), 4) * 100 AS churn_rate_pct FROM pred""")(
    lambda spark, d: H.churn_summary(predictions(spark, d)))

register("top_risk", RISK + """
SELECT c_custkey, c_name, c_mktsegment, round(risk_score, 6) AS risk_score, churn, risk_tier
FROM pred WHERE risk_tier = 'High Risk' ORDER BY risk_score DESC, c_custkey LIMIT 10""")(
    lambda spark, d: rounded(H.top_risk(predictions(spark, d), 10, key="c_custkey")))

register("risk_cards", RISK + """,
top AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, c_custkey) AS place FROM pred WHERE risk_tier = 'High Risk')
SELECT CAST(place AS INTEGER) AS place, CASE WHEN c_custkey % 2 = 0 AND c_custkey <> 0 THEN CAST(c_custkey AS VARCHAR)
         ELSE 'CUST-' || CAST(place + 1000 AS VARCHAR) END AS id, risk_tier,
       printf('%.1f', round(risk_score * 100, 1)) || '%' AS score
FROM top WHERE place <= 10""")(
    lambda spark, d: H.risk_cards(predictions(spark, d).withColumn(
        "customer_id", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))), 10, key="c_custkey"))

register("answer_prompts", RISK + """
SELECT conv_id, turn, text AS prompt,
  CASE WHEN contains(lower(text), 'financial') OR contains(lower(text), 'revenue')
            OR contains(lower(text), 'cost')
       THEN 'Financial Risk Exposure: <strong>$' || format('{:,}', h * 450) || '</strong> across '
            || CAST(h AS VARCHAR) || ' flagged profiles.'
       WHEN contains(lower(text), 'driver') OR contains(lower(text), 'shap') OR contains(lower(text), 'why')
       THEN 'Key Churn Drivers (SHAP Analysis):<br>1. <strong>Low Recent Activity</strong><br>2. '
            || '<strong>Month-to-Month Contract</strong><br>3. <strong>Support Escalations</strong>'
       ELSE 'Analysis: Currently evaluating <strong>' || format('{:,}', n) || '</strong> profiles with <strong>'
            || CAST(h AS VARCHAR) || '</strong> high-risk accounts.' END AS insight
FROM conversations, hk WHERE role = 'user'""")(
    lambda spark, d: H.answer_prompts(I.prompts(spark, d), predictions(spark, d)))

register("retention_cohort", RISK + """
SELECT 'success' AS status, CAST(h AS BIGINT) AS accounts,
       'Autonomous Retention Campaign initialized for ' || format('{:,}', h) || ' flagged accounts.' AS message
FROM hk""")(lambda spark, d: H.retention_cohort(predictions(spark, d))[1])

# ------------------------------------------------------------------ market

ORDER_PRICES = """
WITH op AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day,
                   arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
            FROM orders GROUP BY 1, 2)
"""

EVENT_PRICES = """
WITH ep AS (SELECT symbol, day, close, volume FROM (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS day, value AS close,
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS volume
  FROM events) WHERE rn = 1),
r AS (SELECT symbol, day, close, volume, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prev_close,
             row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn
      FROM ep),
chg AS (SELECT symbol, day, close, prev_close,
               CASE WHEN prev_close = 0 THEN NULL ELSE (close - prev_close) / prev_close END * 100 AS pct
        FROM r WHERE rn = 1),
vol AS (SELECT symbol, round(stddev_samp(CASE WHEN prev_close = 0 THEN NULL ELSE close / prev_close END - 1)
                             * 100, 2) AS volatility FROM r GROUP BY symbol)
"""

register("price_window", ORDER_PRICES + """
SELECT op.symbol, strftime(day, '%Y-%m-%d') AS day, close, CAST(volume AS BIGINT) AS volume
FROM op JOIN (SELECT symbol, max(day) AS last_day FROM op GROUP BY symbol) m USING (symbol)
WHERE day >= last_day - INTERVAL 6 MONTH""")(
    lambda spark, d: T.price_window(I.order_prices(spark, d))
    .select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "close", "volume"))

register("latest_change", EVENT_PRICES + """
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, round(close, 2) AS close,
       round(prev_close, 2) AS prev_close, round(pct, 2) AS change_pct,
       CASE WHEN pct >= 5 THEN 'green' WHEN pct <= -5 THEN 'red' END AS band
FROM chg""")(lambda spark, d: T.latest_change(I.event_prices(spark, d)))

register("volatility", EVENT_PRICES + "SELECT symbol, volatility FROM vol")(
    lambda spark, d: T.volatility(I.event_prices(spark, d)))

register("price_series", EVENT_PRICES + """
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, strftime(day, '%b %d') AS label, close,
       CAST(volume AS BIGINT) AS volume FROM ep""")(
    lambda spark, d: T.price_series(I.event_prices(spark, d)))

register("symbol_summary", EVENT_PRICES + """,
sym AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS place FROM (SELECT DISTINCT event_type AS symbol FROM events)),
prof AS (SELECT symbol, upper(symbol) || ' Holdings' AS long_name, d.text AS summary
         FROM sym JOIN (SELECT text, doc_id % (SELECT count(*) FROM sym) AS place, row_number() OVER (
             PARTITION BY doc_id % (SELECT count(*) FROM sym) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) d
           ON d.place = sym.place AND rn = 1 AND sym.place % 6 <> 5)
SELECT chg.symbol, coalesce(prof.long_name, chg.symbol) AS name, round(close, 2) AS price,
       round(pct, 2) AS change, volatility,
       substring(coalesce(prof.summary, 'No description available.'), 1, 200) || '...' AS description
FROM chg JOIN vol USING (symbol) LEFT JOIN prof ON prof.symbol = chg.symbol""")(
    lambda spark, d: T.symbol_summary(I.event_prices(spark, d), I.symbol_profiles(spark, d)))
