"""Inputs derived from the driver tables, the same way as the oracle SQL.

The driver tables hold no gaps, duplicates or dirty text, so the cleaning
and profiling queries add their own by fixed rules over the whole table
(never a subset of it). Each function reads whole tables and is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S4 over the driver layout: one parquet per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with gaps (acctbal on every 7th key, segment on every 11th)
    and exact duplicates (every 10th key appears twice)."""
    c = table(spark, sf_dir, "customer")
    base = c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return base.unionAll(base.where(F.col("c_custkey") % 10 == 0))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem measures with their key (the key orders limits, it is not charted)."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


MEASURE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


PRICED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "saving", "kept_share"]


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem price measures plus derived amounts, so that strong,
    moderate and negative correlations exist (the raw measures are independent)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_quantity", "l_extendedprice", "l_discount",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("saving"),
        (1 - F.col("l_discount")).alias("kept_share"))


def odd_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with NaN and +-Inf planted by line number, for C8."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan")))
         .when(F.col("l_linenumber") == 6, F.lit(float("inf")))
         .when(F.col("l_linenumber") == 5, F.lit(float("-inf")))
         .otherwise(F.col("l_discount")).alias("l_discount"),
        "l_returnflag")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with every numeric/date field as text and every 5th key dirty."""
    o = table(spark, sf_dir, "orders")
    dirty = F.col("o_orderkey") % 5 == 0
    return o.select(
        "o_orderkey",
        F.when(dirty, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("custkey_text"),
        F.when(dirty, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
        F.when(dirty, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
         .alias("date_text"))


# ----------------------------------------------------------------- risk

def risk_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in for model output over customer: the score is
    the account balance scaled to [0, 1]; churn = negative balance."""
    c = table(spark, sf_dir, "customer")
    lo, hi = c.agg(F.min("c_acctbal"), F.max("c_acctbal")).collect()[0]
    return c.select(
        "c_custkey", "c_name", "c_mktsegment",
        ((F.col("c_acctbal") - F.lit(lo)) / F.lit(hi - lo)).alias("risk_score"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("churn"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations, as questions to the risk assistant."""
    return (table(spark, sf_dir, "conversations").where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("prompt")))


# ----------------------------------------------------------------- market

def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumen.operators.market import daily_prices
    o = table(spark, sf_dir, "orders")
    return daily_prices(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"),
                        F.col("o_orderkey"))


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumen.operators.market import daily_prices
    e = table(spark, sf_dir, "events")
    return daily_prices(e, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"))


def symbol_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profiles: documents are dealt to the symbols by their id, and
    each symbol is described by the longest of its own (of several the one
    with the smallest id). The sixth symbol and each sixth after it has none."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    place = F.row_number().over(Window.orderBy("symbol")) - 1  # one row for each event type
    d = table(spark, sf_dir, "documents")
    longest = d.groupBy((F.col("doc_id") % e.count()).alias("place")).agg(
        F.max_by("text", F.struct("n_chars", -F.col("doc_id"))).alias("summary"))
    return (e.withColumn("place", place).where("place % 6 <> 5").join(longest, "place")
            .select("symbol", F.concat(F.upper("symbol"), F.lit(" Holdings")).alias("long_name"), "summary"))


# ----------------------------------------------------------------- catalog

def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("ord"),
        F.col("l_quantity").alias("qty"), F.to_date("l_shipdate").alias("day"))


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog: a 0-10 rating from the size."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title"),
        (F.col("p_size") / 5.0).alias("vote_average"))


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_lines(spark, sf_dir).groupBy("item").agg(F.sum("qty").alias("popularity"))


def best_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's item on most order lines (ties by key): recommendation targets."""
    sold = sales_lines(spark, sf_dir).groupBy("item").count()
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    first = F.min(F.struct((-F.col("count")).alias("n"), "item"))
    return sold.join(items, "item").groupBy("p_brand").agg(first.alias("first")).select("first.item")


TWINS_OF = 10


def lines_with_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales_lines where every TWINS_OF-th item has a twin, its negative key,
    in all of its orders."""
    lines = sales_lines(spark, sf_dir).select("item", "ord")
    twins = lines.where((F.col("item") > 0) & (F.col("item") % TWINS_OF == 0))
    return lines.unionAll(twins.select((-F.col("item")).alias("item"), "ord"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as catalog actions: click toggles, error removes, view rates."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", (F.col("event_id") % 20).alias("item_id"),
        F.when(F.col("event_type") == "click", "toggle").when(F.col("event_type") == "error", "remove")
         .when(F.col("event_type") == "view", "rate").otherwise(F.col("event_type")).alias("action"),
        (1 + F.col("event_id") % 5).cast("int").alias("rating"), "ts", F.col("event_id").alias("id"))


# ----------------------------------------------------------------- snippets

def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
                    F.col("p_brand").alias("code"),
                    F.concat(F.lower("p_type"), F.lit(",size"), F.col("p_size").cast("string")).alias("tags"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("owner"), F.col("p_name").alias("repo"),
                    F.when(F.col("p_size") > 45, F.col("p_type")).alias("language"))


# ----------------------------------------------------------------- exposure

def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets to check: one per user in the corpus's own format, plus the
    benchmark texts."""
    users = (table(spark, sf_dir, "events").select("user_id").distinct()
             .select(F.concat(F.lit('{"k": '), F.col("user_id").cast("string"), F.lit("}")).alias("secret")))
    bench = table(spark, sf_dir, "benchmark").select(F.col("text").alias("secret"))
    return users.unionAll(bench)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumen.operators.exposure import extract_emails
    return extract_emails(table(spark, sf_dir, "documents"), "text")


def breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breach records by the length of the address: none, Adobe, or Adobe and Canva."""
    n = F.length("email") % 3
    names = F.array_compact(F.array(F.when(n != 0, "Adobe"), F.when(n == 1, "Canva")))
    return emails(spark, sf_dir).select("email", F.explode(names).alias("breach"))


# ----------------------------------------------------------------- models

def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels where known (quality/toxic null otherwise)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def churn_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with order history features; churn = no order since 1999."""
    c = table(spark, sf_dir, "customer")
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"),
              F.max("o_orderdate").alias("last_order")))
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left")
    return j.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"),
        F.when(F.col("last_order").isNull() | (F.col("last_order") < F.lit("1999-01-01").cast("timestamp_ntz")), 1)
         .otherwise(0).alias("churn"))


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """churn_customers with the days since the last order (to the latest order
    of all), which decide churn; 9999 without any."""
    o = table(spark, sf_dir, "orders")
    latest = o.agg(F.max("o_orderdate").alias("d")).first()["d"]
    last = o.groupBy("o_custkey").agg(F.datediff(F.lit(latest), F.max("o_orderdate")).alias("gap"))
    c = churn_customers(spark, sf_dir)
    return c.join(last, c["customer_id"] == last["o_custkey"], "left").select(
        *c.columns, F.coalesce("gap", F.lit(9999)).alias("gap_days"))


BUSY_ORDERS = 11
BUSY_FEATURES = ["nation", "balance", "n_orders", "segment"]


def busy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers labelled busy from BUSY_ORDERS orders on, a rule that a forest
    can learn without error."""
    return churn_customers(spark, sf_dir).select(
        "customer_id", *BUSY_FEATURES, "spent", F.when(F.col("n_orders") >= BUSY_ORDERS, 1).otherwise(0).alias("busy"))
