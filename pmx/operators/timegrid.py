"""Regular time grids: bars per bucket, gaps filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col


def bars(trades: DataFrame, width: str) -> DataFrame:
    """ticker, bar_start and open, high, low, close, volume, net_flow, trade_count, vwap of the buckets that have trades.

    Trades need norm_price, count, signed_flow, created_time and trade_id. First and last are
    by (time, trade_id), as aggregates, so a bucket's trades are combined before the exchange.
    """
    at = F.struct("created_time", "trade_id")
    return trades.groupBy("ticker", F.window(C("created_time").cast("timestamp"), width).start.cast("timestamp_ntz").alias("bar_start")).agg(
        F.min_by("norm_price", at).alias("open"), F.max("norm_price").alias("high"), F.min("norm_price").alias("low"), F.max_by("norm_price", at).alias("close"),
        F.sum("count").alias("volume"), F.sum("signed_flow").alias("net_flow"), F.count("*").alias("trade_count"),
        (F.sum((C("norm_price") * C("count")).cast("double")) / F.nullif(F.sum("count"), F.lit(0))).alias("vwap"))


def gap_filled(b: DataFrame, interval: str) -> DataFrame:
    """All buckets from a ticker's first to its last. Missing prices are the previous close, missing
    amounts are 0, vwap stays null; bar_return and bar_range follow the fill.

    Only buckets with trades are shuffled and sorted: each is followed by the empty ones up to the next, which hold nothing
    but its close, so they are made last, where they are written.
    """
    w, step = W.partitionBy("ticker").orderBy("bar_start"), F.expr(interval)
    x = b.select("*", F.lead("bar_start").over(w).alias("_next"), F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_prev"))
    run = F.sequence("bar_start", F.coalesce(C("_next") - step, C("bar_start")), step)
    own, close = C("_i") == 0, F.coalesce("close", "_prev")
    j = x.select(*b.columns, "_prev", F.posexplode(run).alias("_i", "_at"))
    price = lambda c: F.when(own, F.coalesce(c, "_prev")).otherwise(close)
    return j.select("ticker", C("_at").alias("bar_start"), *[price(c).alias(c) for c in ("open", "high", "low", "close")],
                    *[F.when(own, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c) for c in ("volume", "net_flow", "trade_count")], F.when(own, C("vwap")).alias("vwap"),
                    (close - F.when(own, C("_prev")).otherwise(close)).alias("bar_return"), (price("high") - price("low")).alias("bar_range"))
