"""Source and sink queries (S1, K1, K2, K3, K5, K6): each writes data Spark
derives from the driver tables into the shared scratch folder, reads it back
and returns it, so the round trip is what gets compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumen.plans import inputs as I
from lumen.plans import sqlparts as S
from lumen.plans.q_profile import rounded
from lumen.plans.q_risk import RISK, predictions
from lumen.plans.registry import register
from lumen.session import scratch_path
from lumen.sources import sinks as K
from lumen.sources.csv import read_csv_table
from lumen.sources.tables import scan_table
from lumen.streaming.submissions import append_submissions, read_log


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _csv_round_trip(spark, d):
    path = _scratch(spark, "people-csv")
    K.export_csv(I.people(spark, d), path)
    return read_csv_table(spark, path)


register("csv_round_trip", S.with_(S.PEOPLE) + """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM people""")(
    _csv_round_trip)


def submissions(spark, d):
    c = I.table(spark, d, "conversations")
    return c.select(F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.com")).alias("email"),
                    F.concat(F.col("role"), F.lit(" turn "), F.col("turn").cast("string")).alias("subject"),
                    F.col("text").alias("message"))


def _stream(spark, d):
    src, sink, ckpt = _scratch(spark, "inbox"), _scratch(spark, "log"), _scratch(spark, "log-ckpt")
    submissions(spark, d).write.mode("overwrite").json(src)
    q = append_submissions(spark, src, sink, ckpt)
    q.awaitTermination()
    return read_log(spark, sink)


def _folder_of_csv(spark, d):
    """Two folders' files under one, their columns in different orders, and one
    without a column."""
    path = _scratch(spark, "mixed-csv")
    people = I.people(spark, d)
    K.export_csv(people.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), f"{path}/even")
    K.export_csv(people.where("c_custkey % 2 = 1").select("c_acctbal", "c_name", "c_custkey"), f"{path}/odd")
    return read_csv_table(spark, path, recursiveFileLookup=True)


register("csv_by_header", S.with_(S.PEOPLE) + """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS DOUBLE) END AS c_nationkey, c_acctbal
FROM people""")(_folder_of_csv)

register("append_submissions", """
SELECT 'user' || CAST(conv_id AS VARCHAR) || '@example.com' AS email,
       role || ' turn ' || CAST(turn AS VARCHAR) AS subject, text AS message
FROM conversations""")(_stream)


def _saved_predictions(spark, d):
    """Written as a table of the catalog, then replaced by a copy of itself
    while the first version is still to be read."""
    name, folder = f"customer_predictions_{uuid.uuid4().hex[:8]}", _scratch(spark, "tables")
    K.save_table(predictions(spark, d).withColumn("risk_tier", F.lit("old")), name, folder)
    old = scan_table(spark, name)
    K.save_table(old.drop("risk_tier").join(predictions(spark, d).select("c_custkey", "risk_tier"), "c_custkey"), name, folder)
    assert old.where("risk_tier <> 'old'").isEmpty()
    return rounded(scan_table(spark, name).select("c_custkey", "c_name", "c_mktsegment", "risk_score", "churn", "risk_tier"))


register("save_table", RISK + """
SELECT c_custkey, c_name, c_mktsegment, round(risk_score, 6) AS risk_score, churn, risk_tier FROM pred""")(_saved_predictions)


def _view(spark, d):
    return K.create_summary_view(spark, predictions(spark, d), "v_customer_summary")


register("summary_view", RISK + """
SELECT CAST(count(*) AS BIGINT) AS total_customers,
       round(avg(CAST(coalesce(churn, 0) AS DOUBLE)), 4) * 100 AS churn_rate_pct FROM pred""")(_view)


def _snippets(spark, d):
    path = _scratch(spark, "snippets")
    part = I.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
                                            F.col("p_brand").alias("code"))
    K.insert_snippets(part, path)
    return spark.read.parquet(path)


register("insert_snippets", """
SELECT p_partkey AS id, p_name AS title, p_brand AS code, '' AS tags, false AS is_favorite FROM part""")(
    _snippets)


def _partitioned_exposure(spark, d):
    """X1 written partitioned by the first two hex digits, then X2 against it."""
    from lumen.operators import exposure as X
    path = _scratch(spark, "hash-ranges")
    X.write_hash_corpus(X.hash_corpus(I.table(spark, d, "events"), "props"), path)
    corpus = X.read_hash_corpus(spark, path)
    return X.secret_exposure(I.secrets(spark, d), corpus)


from lumen.plans.registry import ORACLE  # noqa: E402
from lumen.plans import q_catalog  # noqa: E402,F401  (defines the secret_exposure oracle)

register("secret_exposure_partitioned", ORACLE["secret_exposure"])(_partitioned_exposure)
