"""Model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumen.functions.ranks import roc_auc
from lumen.operators import model as M
from lumen.operators.risk import TIERS
from lumen.plans import inputs as I
from lumen.plans import sqlparts as S
from lumen.plans.q_profile import rounded
from lumen.plans.registry import register
from lumen.session import scratch_path

LABELED = """
WITH ld AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
DOC_COLS = ["lang", "source", "n_chars", "quality", "toxic"]
NUMERIC_DOC = {"n_chars", "quality", "toxic"}


def _task_row(c):
    d = f"count(DISTINCT {c})"
    lib = f"CASE WHEN {d} > 2 THEN 'regression' ELSE 'classification' END" if c in NUMERIC_DOC \
        else "'classification'"
    svc = f"CASE WHEN {d} <= 10 THEN 'classification' ELSE 'regression' END" if c in NUMERIC_DOC \
        else "'classification'"
    return f"""SELECT '{c}' AS "column", CAST({d} AS BIGINT) AS n_distinct, {lib} AS library_task,
       {svc} AS service_task FROM ld"""


register("detect_task", LABELED + "\nUNION ALL\n".join(_task_row(c) for c in DOC_COLS))(
    lambda spark, d: M.detect_task(I.labeled_docs(spark, d), DOC_COLS))

register("encode_labels", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", {c} AS value, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT {c} FROM documents WHERE {c} IS NOT NULL)""" for c in ["lang", "source"]))(
    lambda spark, d: M.label_codes(I.table(spark, d, "documents"), ["lang", "source"]))

register("impute_median", LABELED + """
SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
       coalesce(CAST(quality AS DOUBLE), (SELECT median(CAST(quality AS DOUBLE)) FROM ld)) AS quality,
       coalesce(CAST(toxic AS DOUBLE), (SELECT median(CAST(toxic AS DOUBLE)) FROM ld)) AS toxic
FROM ld""")(lambda spark, d: M.impute_median(I.labeled_docs(spark, d), ["n_chars", "quality", "toxic"]))

register("split_shares", """
WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality),
s AS (SELECT label, n, CAST(floor(0.8 * (n - 1)) + 1 AS BIGINT) AS tr FROM c)
SELECT label, 'train' AS part, tr AS "rows" FROM s WHERE tr > 0
UNION ALL
SELECT label, 'test' AS part, CAST(n - tr AS BIGINT) AS "rows" FROM s WHERE n - tr > 0""")(
    lambda spark, d: M.split_shares(I.table(spark, d, "labels"), "quality", "doc_id"))

register("accuracy", LABELED + """
SELECT round(avg(CAST(quality = CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS "rows"
FROM ld WHERE quality IS NOT NULL""")(
    lambda spark, d: rounded(M.accuracy(
        I.labeled_docs(spark, d).where("quality IS NOT NULL")
        .withColumn("pred", F.when(F.col("toxic") == 1, 0).otherwise(1)), "quality", "pred")))

register("r2", """
SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, CAST(count(y) AS BIGINT) AS "rows"
FROM (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p
      FROM lineitem JOIN part ON l_partkey = p_partkey)""")(
    lambda spark, d: rounded(M.r2(
        I.table(spark, d, "lineitem").join(I.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p")),
        "y", "p")))

_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
register("coerce_features", S.with_(S.DIRTY_ORDERS) + f"""
SELECT o_orderkey,
  coalesce(CASE WHEN regexp_matches(trim(custkey_text), {_NUM}) THEN TRY_CAST(trim(custkey_text) AS DOUBLE) END, 0.0)
    AS custkey_text,
  coalesce(CASE WHEN regexp_matches(trim(price_text), {_NUM}) THEN TRY_CAST(trim(price_text) AS DOUBLE) END, 0.0)
    AS price_text,
  0.0 AS no_such_feature
FROM dirty""")(lambda spark, d: M.coerce_features(
    I.dirty_orders(spark, d), ["custkey_text", "price_text", "no_such_feature"], keep=["o_orderkey"]))


register("roc_auc", """
WITH c AS (SELECT l_linestatus, l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS pos,
                  count(*) FILTER (l_returnflag <> 'R') AS neg
           FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(neg) OVER (PARTITION BY l_linestatus ORDER BY score) - neg AS below FROM c)
SELECT l_linestatus, round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM w GROUP BY l_linestatus""")(
    lambda spark, d: rounded(roc_auc(
        I.table(spark, d, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int")),
        "returned", "l_quantity", by=["l_linestatus"])))

register("roc_auc_distinct_scores", """
WITH c AS (SELECT l_extendedprice * (1 - l_discount) AS score, count(*) FILTER (l_returnflag = 'R') AS pos,
                  count(*) FILTER (l_returnflag <> 'R') AS neg
           FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM c)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM w""")(
    lambda spark, d: rounded(roc_auc(
        I.table(spark, d, "lineitem").select(
            (F.col("l_returnflag") == "R").cast("int").alias("returned"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price")), "returned", "price")))


# ------------------------------------------------------------------ forests
# A forest's numbers depend on the library. These queries state what the data
# say a useful model must reach: the SQL computes it from the tables, and a
# model that falls short, or scores that get mixed up, give other rows.

CHURN = """
SELECT c_custkey AS customer_id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment,
       coalesce(n, 0) AS n_orders, coalesce(total, 0) AS spent,
       coalesce(date_diff('day', last_order, (SELECT max(o_orderdate) FROM orders)), 9999) AS gap_days,
       CASE WHEN last_order IS NULL OR last_order < TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END AS churn
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order, count(*) AS n, sum(o_totalprice) AS total
                         FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""
BUSY = f"SELECT *, CASE WHEN n_orders >= {I.BUSY_ORDERS} THEN 1 ELSE 0 END AS busy FROM ({CHURN})"


def _busy_model(spark, d):
    return M.fit_model(I.busy_customers(spark, d), "busy", features=I.BUSY_FEATURES, key="customer_id")[0]


def _fitted(spark, d):
    trained = _busy_model(spark, d)
    share = trained.data.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    reached = F.least(F.col("metric_value"), F.lit(share))
    return rounded(M.metrics_frame(spark, trained).select(
        "task", "target", "metric_name", F.lit(share).alias("majority_share"), reached.alias("accuracy_up_to_majority"),
        (F.col("metric_value") > F.lit(share)).alias("beats_majority"), F.round("auc", 2).alias("auc")))


# The label is a threshold of n_orders, which separates the classes: the SQL
# takes the best that any threshold reaches.
register("fit_classifier", f"""
WITH b AS ({BUSY}), m AS (SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM b GROUP BY busy)),
t AS (SELECT sum(CASE WHEN (n_orders >= v) = (busy = 1) THEN 1 ELSE 0 END) / count(*) AS best
      FROM b, (SELECT DISTINCT n_orders AS v FROM b) GROUP BY v),
c AS (SELECT n_orders, count(*) FILTER (busy = 1) AS pos, count(*) FILTER (busy = 0) AS neg FROM b GROUP BY n_orders),
w AS (SELECT *, sum(neg) OVER (ORDER BY n_orders) - neg AS below FROM c),
a AS (SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 2) AS auc FROM w)
SELECT 'classification' AS task, 'busy' AS target, 'Accuracy Score' AS metric_name, round(share, 6) AS majority_share,
       round(share, 6) AS accuracy_up_to_majority, (SELECT max(best) FROM t) > share AS beats_majority, auc
FROM m, a""")(_fitted)


def _importances(spark, d):
    found = M.feature_importances(spark, _busy_model(spark, d))
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))  # one row for each feature
    return found.select("feature", (place == 1).alias("first"))


register("feature_importances", f"""
WITH b AS (SELECT *, dense_rank() OVER (ORDER BY segment) AS code FROM ({BUSY})),
r AS (SELECT 'nation' AS feature, abs(corr(nation, busy)) AS r FROM b UNION ALL
      SELECT 'balance', abs(corr(balance, busy)) FROM b UNION ALL
      SELECT 'n_orders', abs(corr(n_orders, busy)) FROM b UNION ALL
      SELECT 'segment', abs(corr(code, busy)) FROM b)
SELECT feature, r = max(r) OVER () AS first FROM r""")(_importances)


def _scored_from_bundle(spark, d):
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex}")
    M.save_model(_busy_model(spark, d), path)
    rows = I.busy_customers(spark, d).drop("busy")
    scored = M.score_batch(M.load_model(path), rows, keep=["customer_id"])
    return scored.select("customer_id", F.col("prediction").cast("int").alias("predicted"))


register("score_batch", f"SELECT customer_id, busy AS predicted FROM ({BUSY})")(_scored_from_bundle)


# The best straight line on one feature, less a tenth for the held-out rows.
LINE_SHARE = 0.9


def _regressor(spark, d):
    trained, _ = M.fit_model(I.busy_customers(spark, d).drop("busy"), "spent", task="regression",
                             features=["n_orders", "nation", "balance"], key="customer_id")
    line = trained.data.select((F.corr("spent", "n_orders") ** 2 * LINE_SHARE).alias("line"))
    return rounded(M.metrics_frame(spark, trained).crossJoin(F.broadcast(line)).select(  # one row
        "task", "target", "metric_name", "line", F.least("metric_value", "line").alias("r2_up_to_line")))


register("fit_regressor", f"""
WITH l AS (SELECT round(corr(spent, n_orders) * corr(spent, n_orders) * {LINE_SHARE}, 6) AS line FROM ({CHURN}))
SELECT 'regression' AS task, 'spent' AS target, 'R² Score' AS metric_name, line, line AS r2_up_to_line FROM l""")(_regressor)


def _split(spark, d):
    orders = I.table(spark, d, "orders")
    train, test = M.split(orders, "o_orderkey", test_share=M.TEST_SHARE)
    parts = train.select("o_orderkey", F.lit(1).alias("train")).unionAll(test.select("o_orderkey", F.lit(0).alias("train")))
    return parts.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys"),
                     F.avg("train").alias("share")).select(
        "rows", "keys", (F.abs(F.col("share") - (1 - M.TEST_SHARE)) < 0.05).alias("share_as_asked"))


register("split", """
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(DISTINCT o_orderkey) AS BIGINT) AS keys, true AS share_as_asked
FROM orders""")(_split)


NUMBERS = ["nation", "balance", "n_orders", "spent"]


def _feature_auc(features, frm):
    """CTEs up to a(feature, far): how far each feature's AUC is from chance."""
    return "long AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({'code' if f == 'segment' else f} AS DOUBLE) AS score, churn FROM {frm}"
        for f in features) + """),
g AS (SELECT feature, score, count(*) FILTER (churn = 1) AS pos, count(*) FILTER (churn = 0) AS neg FROM long GROUP BY ALL),
w AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY score) - neg AS below FROM g),
a AS (SELECT feature, abs(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) - 0.5) AS far FROM w GROUP BY feature)"""


def _scores(spark, d):
    cust = I.churn_customers(spark, d)
    scored = M.churn_pipeline(cust, "customer_id")[1]
    one = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in NUMBERS)))
    best = roc_auc(cust.select("churn", one), "churn", "score", by=["feature"]).agg(
        (F.max(F.abs(F.col("auc") - 0.5)) + 0.5).alias("best"))
    reached = roc_auc(scored, "churn", "risk_score").select("auc")
    both = best.crossJoin(F.broadcast(reached)).select(F.least("auc", "best").alias("auc_up_to_best_feature"))  # one row each
    scored = scored.crossJoin(F.broadcast(both))
    return rounded(scored.select("customer_id", F.col("churn").cast("int").alias("churn"), "auc_up_to_best_feature"))


register("risk_scores", f"""
WITH c AS ({CHURN}), {_feature_auc(NUMBERS, "c")}
SELECT customer_id, churn, round((SELECT max(far) + 0.5 FROM a), 6) AS auc_up_to_best_feature FROM c""")(_scores)


DRIVER_FEATURES = ["nation", "balance", "segment", "n_orders", "spent", "gap_days"]


def _drivers(spark, d):
    trained, _ = M.churn_pipeline(I.idle_customers(spark, d), "customer_id", tiers=False)
    found = M.risk_drivers(trained, trained.data, "customer_id", "churn")
    place = F.row_number().over(Window.orderBy(F.desc("auc_drop"), "feature"))  # one row for each feature
    return found.select("feature", (place == 1).alias("first"))


register("risk_drivers", f"""
WITH c AS (SELECT *, dense_rank() OVER (ORDER BY segment) AS code FROM ({CHURN})), {_feature_auc(DRIVER_FEATURES, "c")}
SELECT feature, far = max(far) OVER () AS first FROM a""")(_drivers)
