"""Cleaning queries (D1-D11) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.operators import clean as D
from lumen.plans import inputs as I
from lumen.plans import sqlparts as S
from lumen.plans.q_profile import rounded
from lumen.plans.registry import register

W_PEOPLE = S.with_(S.PEOPLE)
W_DIRTY = S.with_(S.DIRTY_ORDERS)


def _people_with(col_name: str, expr: str) -> str:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return W_PEOPLE + "SELECT " + ", ".join(
        f"{expr} AS {c}" if c == col_name else c for c in cols) + " FROM people"


register("remove_duplicates", W_PEOPLE + "SELECT DISTINCT * FROM people")(
    lambda spark, d: D.drop_duplicate_rows(I.people(spark, d)))

register("drop_missing_rows", W_PEOPLE +
         "SELECT * FROM people WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)")(
    lambda spark, d: D.drop_missing_rows(I.people(spark, d), "c_acctbal"))

register("drop_column", W_PEOPLE + "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM people")(
    lambda spark, d: D.drop_column(I.people(spark, d), "c_mktsegment"))

register("fill_mean", _people_with(
    "c_acctbal", "round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM people)), 6)"))(
    lambda spark, d: rounded(D.fill_mean(I.people(spark, d), "c_acctbal")))

register("fill_median", _people_with(
    "c_acctbal", "round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM people)), 6)"))(
    lambda spark, d: rounded(D.fill_median(I.people(spark, d), "c_acctbal")))

register("fill_mode", _people_with(
    "c_mktsegment", "coalesce(c_mktsegment, (SELECT c_mktsegment FROM people WHERE c_mktsegment "
    "IS NOT NULL GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1))"))(
    lambda spark, d: D.fill_mode(I.people(spark, d), "c_mktsegment"))

register("fill_constant", _people_with("c_mktsegment", "coalesce(c_mktsegment, 'UNKNOWN')"))(
    lambda spark, d: D.fill_constant(I.people(spark, d), "c_mktsegment", "UNKNOWN"))

register("cast_int", W_DIRTY + "SELECT o_orderkey, TRY_CAST(custkey_text AS BIGINT) AS custkey_text FROM dirty")(
    lambda spark, d: D.cast_int(I.dirty_orders(spark, d), "custkey_text").select("o_orderkey", "custkey_text"))

register("cast_float", W_DIRTY + "SELECT o_orderkey, TRY_CAST(price_text AS DOUBLE) AS price_text FROM dirty")(
    lambda spark, d: D.cast_float(I.dirty_orders(spark, d), "price_text").select("o_orderkey", "price_text"))

register("cast_str", _people_with("c_acctbal", "CAST(c_acctbal AS VARCHAR)"))(
    lambda spark, d: D.cast_str(I.people(spark, d), "c_acctbal"))

register("cast_datetime", W_DIRTY + """
SELECT o_orderkey, strftime(try_strptime(date_text, '%m/%d/%Y'), '%Y-%m-%d %H:%M:%S') AS date_text
FROM dirty""")(lambda spark, d: D.cast_datetime(I.dirty_orders(spark, d), "date_text").select(
    "o_orderkey", F.date_format("date_text", "yyyy-MM-dd HH:mm:ss").alias("date_text")))
