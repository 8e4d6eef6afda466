"""Bars over a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def stream_bars(trades: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream (or table) of (trade_id, ticker, created_time, count, norm_price, signed_flow).

    Repeated trades are dropped within the watermark; a bar is final when the watermark passes its end.
    """
    t = trades.withColumn("created_time", C("created_time").cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("created_time", late).dropDuplicatesWithinWatermark(["trade_id"])
    else:
        t = t.dropDuplicates(["trade_id"])
    at = F.struct("created_time", "trade_id")
    b = t.groupBy(F.window("created_time", width), "ticker").agg(
        F.min_by("norm_price", at).alias("open"), F.max("norm_price").alias("high"), F.min("norm_price").alias("low"), F.max_by("norm_price", at).alias("close"),
        F.sum("count").alias("volume"), F.sum("signed_flow").alias("net_flow"), F.count("*").alias("trade_count"))
    return b.select("ticker", C("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "net_flow", "trade_count")
