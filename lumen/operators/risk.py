"""Churn risk reporting over a predictions table.

A predictions table has a ``risk_score`` in [0, 1] per customer and, after
``risk_tiers``, a ``risk_tier``. KPIs are one aggregate; the few numbers they
produce come back as scalars and feed text as literals, never as a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.exprs import col, round_dp
from lumen.functions.quantiles import column_stats, exact_quantiles

# Tier labels, revenue per account, prompt routing words and
# answer texts, as the reference states them (its brand prefix left out).
TIERS = ("Low Risk", "Medium Risk", "High Risk")
HIGH = TIERS[2]
REVENUE_PER_ACCOUNT = 450
ID_COLUMNS = ("customer_id", "customerid")
ID_PREFIX, FIRST_ID = "CUST-", 1001
FINANCIAL_WORDS = ("financial", "revenue", "cost")
DRIVER_WORDS = ("driver", "shap", "why")
DRIVERS_TEXT = ("Key Churn Drivers (SHAP Analysis):<br>1. <strong>Low Recent Activity</strong>"
                "<br>2. <strong>Month-to-Month Contract</strong><br>3. <strong>Support Escalations</strong>")
EXPOSURE_TEXT = "Financial Risk Exposure: <strong>${money}</strong> across {n} flagged profiles."
TOTALS_TEXT = ("Analysis: Currently evaluating <strong>{total}</strong> profiles with "
               "<strong>{n}</strong> high-risk accounts.")
CAMPAIGN_TEXT = "Autonomous Retention Campaign initialized for {n} flagged accounts."


def risk_tiers(df: DataFrame, score: str = "risk_score", approx: bool = False) -> DataFrame:
    """H4: three quantile bins, right-closed, lowest edge included.

    Edges are the exact 0, 1/3, 2/3, 1 quantiles (linear, as pandas ``qcut``);
    repeated edges are an error. ``ntile`` is not used: it would split ties."""
    x = col(score).cast("double")
    stats = column_stats(df, [x])
    (n, lo, hi), = stats
    if n == 0:
        return df.withColumn("risk_tier", F.lit(None).cast("string"))
    e1, e2 = exact_quantiles(df, [x], [1 / 3, 2 / 3], stats=stats, approx=approx)[0]
    edges = [lo, e1, e2, hi]
    if len(set(edges)) < len(edges):
        raise ValueError(f"Bin edges must be unique: {edges}")
    tier = (F.when(x.isNull(), F.lit(None)).when(x <= F.lit(e1), TIERS[0])
            .when(x <= F.lit(e2), TIERS[1]).otherwise(TIERS[2]))
    return df.withColumn("risk_tier", tier)


def _money(n_col):
    return F.concat(F.lit("$"), F.format_number(n_col, 0))


def risk_kpis(df: DataFrame, value: int = REVENUE_PER_ACCOUNT) -> DataFrame:
    """H5: customers, mean risk x100 (1 dp), high-risk count and share (1 dp),
    revenue at risk as ``$n,nnn``; zeros when the table is empty."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.avg(col("risk_score")).alias("avg"),
                 F.count_if(col("risk_tier") == HIGH).alias("high"))
    empty = F.col("n") == 0
    return agg.select(
        F.col("n").cast("long").alias("total_customers"),
        F.when(empty, 0.0).otherwise(round_dp(F.col("avg") * 100, 1)).alias("avg_risk"),
        F.col("high").cast("long").alias("high_risk_count"),
        F.when(empty, 0.0).otherwise(round_dp(F.try_divide(F.col("high"), F.col("n")) * 100, 1))
        .alias("high_risk_pct"),
        _money(F.col("high") * value).alias("revenue_at_risk"))


def risk_distribution(df: DataFrame) -> DataFrame:
    """H6: accounts per tier."""
    return df.groupBy(col("risk_tier").alias("risk_tier")).agg(F.count(F.lit(1)).alias("count"))


def churn_summary(df: DataFrame) -> DataFrame:
    """H7: customers and churn rate; only label columns that exist are used."""
    labels = [c for c in ("churn", "churned") if c in df.columns]
    label = F.coalesce(*[col(c).cast("double") for c in labels], F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("total_customers"),
                  (round_dp(F.avg(label), 4) * 100).alias("churn_rate_pct"))


def top_risk(df: DataFrame, n: int = 10, key: str | None = None) -> DataFrame:
    """H8: High Risk rows by score descending (key ascending on ties), first n."""
    order = [F.desc(col("risk_score"))] + ([F.asc(col(key))] if key else [])
    return df.where(col("risk_tier") == HIGH).orderBy(*order).limit(n)


def risk_cards(df: DataFrame, n: int = 10, key: str | None = None) -> DataFrame:
    """H8 as shown: (place, id, risk_tier, score) of ``top_risk``: the id is the
    customer's, or a number by place where there is none (or it is empty or
    zero), the score a percentage with one decimal."""
    ids = [c for c in ID_COLUMNS if c in df.columns]
    order = [F.desc("risk_score")] + ([F.asc("__key")] if key else [])
    top = top_risk(df, n, key).select(col("risk_score").alias("risk_score"), col("risk_tier").alias("risk_tier"),
                                      *([col(key).alias("__key")] if key else []), *(col(c).cast("string").alias(c) for c in ids))
    place = F.row_number().over(Window.orderBy(*order))  # n rows
    shown = [F.when(~col(c).isin("", "0"), col(c)) for c in ids]
    return top.withColumn("place", place).select(
        "place", F.coalesce(*shown, F.concat(F.lit(ID_PREFIX), (F.col("place") + FIRST_ID - 1).cast("string"))).alias("id"), "risk_tier",
        F.concat(F.format_string("%.1f", round_dp(F.col("risk_score") * 100, 1)), F.lit("%")).alias("score"))


def _high_and_total(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count_if(col("risk_tier") == HIGH).alias("h"),
                 F.count(F.lit(1)).alias("n")).collect()[0]
    return int(row["h"]), int(row["n"])


def answer_prompts(prompts: DataFrame, df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """H9: route each prompt by keywords (first match wins) and answer from
    the predictions' two numbers (computed once, then literals)."""
    high, total = _high_and_total(df)
    p = F.lower(F.coalesce(col(prompt_col), F.lit("")))
    fin = None
    for w in FINANCIAL_WORDS:
        fin = p.contains(w) if fin is None else fin | p.contains(w)
    drv = None
    for w in DRIVER_WORDS:
        drv = p.contains(w) if drv is None else drv | p.contains(w)
    exposure = EXPOSURE_TEXT.format(money=f"{high * REVENUE_PER_ACCOUNT:,}", n=high)
    totals = TOTALS_TEXT.format(total=f"{total:,}", n=high)
    return prompts.withColumn("insight", F.when(fin, F.lit(exposure))
                              .when(drv, F.lit(DRIVERS_TEXT)).otherwise(F.lit(totals)))


def retention_cohort(df: DataFrame, save_as: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The High Risk accounts picked for a campaign (optionally written
    through K1) and a one-row status with their count."""
    cohort = df.where(col("risk_tier") == HIGH)
    if save_as:
        from lumen.sources.sinks import save_table
        save_table(cohort, save_as)
    status = cohort.agg(F.count(F.lit(1)).alias("accounts")).select(
        F.lit("success").alias("status"), F.col("accounts").cast("long"),
        F.concat(F.lit(CAMPAIGN_TEXT.split("{n}")[0]), F.format_number(F.col("accounts"), 0),
                 F.lit(CAMPAIGN_TEXT.split("{n}")[1])).alias("message"))
    return cohort, status
