"""Price lookups by day and as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def price_on_day(asks: DataFrame, prices: DataFrame) -> DataFrame:
    """asks (ask_id, ticker, day) with the last close of exactly that day, null without one."""
    last = prices.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.max_by("close", F.struct("ts", "close")).alias("close"))
    return asks.join(last, ["ticker", "day"], "left").select("ask_id", "ticker", "day", "close")


def price_as_of(asks: DataFrame, prices: DataFrame) -> DataFrame:
    """asks (ask_id, ticker, day) with the last close on or before the day, null without one.

    Both sides are reduced to one row per ticker and day, put on one time line, and the last price is carried forward within
    month-long stretches first; a stretch without an earlier price of its own takes the last of the stretches before. So a ticker's
    whole history is never one task's window. Equal times break by the close.
    """
    daily = prices.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.max_by("close", F.struct("ts", "close")).alias("close"))
    month = F.trunc("day", "month")
    line = daily.select("ticker", "day", F.lit(0).alias("o"), "close", F.lit(None).alias("ask_id")).unionByName(asks.select("ticker", "day", F.lit(1).alias("o"), F.lit(None).cast("double").alias("close"), "ask_id"))
    line = line.withColumn("m", month)
    within = W.partitionBy("ticker", "m").orderBy("day", "o").rowsBetween(W.unboundedPreceding, 0)
    carried = line.withColumn("own", F.last("close", ignorenulls=True).over(within)).where("o = 1")
    ends = daily.withColumn("m", month).groupBy("ticker", "m").agg(F.max_by("close", "day").alias("end"))
    months = line.select("ticker", "m").distinct().join(ends, ["ticker", "m"], "left")
    before = months.withColumn("before", F.last("end", ignorenulls=True).over(W.partitionBy("ticker").orderBy("m").rowsBetween(W.unboundedPreceding, -1))).select("ticker", "m", "before")
    return carried.join(before, ["ticker", "m"]).select("ask_id", "ticker", "day", F.coalesce("own", "before").alias("close"))


def as_of_day(year: Column, today: Column) -> Column:
    """The last day of the focus's year, else the day given as today."""
    return F.coalesce(F.make_date(year, F.lit(12), F.lit(31)), today)


def price_chunks(priced: DataFrame) -> DataFrame:
    """Priced asks as chunk rows of their own tier; asks without a price give none."""
    return priced.where("close is not null").select(
        "ask_id", F.lit("market_data").alias("source_type"), F.upper("ticker").alias("ticker"), F.date_format("day", "yyyy-MM-dd").alias("date"),
        X.price_text(F.col("day"), F.col("close"), F.lit(0.0)).alias("chunk_text"), F.lit("Market Data").alias("tier"),
    )


def market_answer(priced: DataFrame) -> DataFrame:
    """One line per ask: the price of the day, or that there is none."""
    day = F.date_format("day", "yyyy-MM-dd")
    line = F.when(F.col("close").isNull(), F.concat(F.lit("**"), "ticker", F.lit("**: No price data for "), day)).otherwise(
        F.concat(F.lit("**"), "ticker", F.lit("** on "), day, F.lit(": $"), F.format_string("%.2f", "close"))
    )
    return priced.select("ask_id", line.alias("line"))
