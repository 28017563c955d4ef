"""Market summary over daily prices.

A price table is keyed by (symbol, day) with close and volume. It is already
an aggregate: a symbol holds at most one row per calendar day, so windows
partitioned by symbol are bounded by the length of the calendar, not by the
raw data behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.exprs import round_dp

# Fixed values from the reference's market page.
UP_BAND = 5.0
DOWN_BAND = -5.0
SUMMARY_CHARS = 200
NO_DESCRIPTION = "No description available."
ELLIPSIS = "..."


def daily_prices(df: DataFrame, symbol: Column, ts: Column, price: Column,
                 tiebreak: Column) -> DataFrame:
    """(symbol, day, close, volume): the last price of each day (by time,
    then ``tiebreak``) and the number of trades. A plain grouped aggregate,
    combined map-side, so a busy symbol-day costs one row per task."""
    return (df.select(symbol.alias("symbol"), F.to_date(ts).alias("day"),
                      F.struct(ts.alias("t"), tiebreak.alias("k")).alias("o"), price.alias("p"))
            .groupBy("symbol", "day")
            .agg(F.max_by("p", "o").alias("close"), F.count(F.lit(1)).alias("volume")))


def price_window(prices: DataFrame, months: int = 6) -> DataFrame:
    """The last ``months`` months of each symbol (from its latest day)."""
    last = prices.groupBy("symbol").agg(F.max("day").alias("last_day"))
    # One row per symbol; AQE broadcasts it when it is measured small.
    return (prices.join(last, "symbol")
            .where(F.col("day") >= F.add_months("last_day", -months)).drop("last_day"))


def _with_returns(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    prev = F.lag("close").over(w)
    return prices.select("symbol", "day", "close", "volume", prev.alias("prev_close"),
                         (F.try_divide(F.col("close"), prev) - 1).alias("ret"))


def latest_change(prices: DataFrame) -> DataFrame:
    """Last close, previous close, percent change (2 dp) and band; the
    change is null with only one day of history."""
    r = _with_returns(prices)
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    last = r.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    pct = F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close")) * 100
    return last.select(
        "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"),
        round_dp("close", 2).alias("close"), round_dp("prev_close", 2).alias("prev_close"),
        round_dp(pct, 2).alias("change_pct"),
        F.when(pct >= UP_BAND, "green").when(pct <= DOWN_BAND, "red").alias("band"))


def volatility(prices: DataFrame) -> DataFrame:
    """Sample std of daily returns x 100 (2 dp); a zero previous close
    gives no return for that day."""
    return (_with_returns(prices).groupBy("symbol")
            .agg(round_dp(F.stddev_samp("ret") * 100, 2).alias("volatility")))


def price_series(prices: DataFrame) -> DataFrame:
    """T4: chart series: date label ``Mon dd``, close and volume."""
    return prices.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"),
                         F.date_format("day", "MMM dd").alias("label"), "close", "volume")


def symbol_summary(prices: DataFrame, profiles: DataFrame) -> DataFrame:
    """T5: T2 + T3 with the company name (default: the symbol) and the first
    200 characters of its description plus ``...`` (always added)."""
    change = latest_change(prices)
    vol = volatility(prices)
    text = F.coalesce(F.col("summary"), F.lit(NO_DESCRIPTION))
    return (change.join(vol, "symbol").join(profiles, "symbol", "left")
            .select("symbol", F.coalesce("long_name", "symbol").alias("name"),
                    F.col("close").alias("price"), F.col("change_pct").alias("change"),
                    "volatility",
                    F.concat(F.substring(text, 1, SUMMARY_CHARS), F.lit(ELLIPSIS)).alias("description")))
