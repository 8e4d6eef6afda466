"""Resolved trades and the two positions of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmx.functions import maker_price, maker_won, opposite, taker_price, taker_won


def resolved_trades(trades: DataFrame, markets: DataFrame, finalized: bool = True) -> DataFrame:
    """Trades of resolved markets with tp/mp (prices) and tw/mw (won) of taker and maker."""
    m = markets.filter(F.col("result").isin("yes", "no"))
    if finalized:
        m = m.filter("status = 'finalized'")
    j = trades.join(m.select("ticker", "event_ticker", "result", "open_time", "close_time"), "ticker")
    return j.select("*", taker_price().alias("tp"), maker_price().alias("mp"), taker_won().alias("tw"), maker_won().alias("mw"))


def positions(resolved: DataFrame) -> DataFrame:
    """Taker's and maker's position of each trade, from one scan: (price, won, role, side) beside the trade's columns."""
    side = F.col("taker_side")
    both = F.array(
        F.struct(F.col("tp").alias("price"), F.col("tw").alias("won"), F.lit("taker").alias("role"), side.alias("side")),
        F.struct(F.col("mp").alias("price"), F.col("mw").alias("won"), F.lit("maker").alias("role"), opposite(side).alias("side")))
    return resolved.select("count", "created_time", "event_ticker", "ticker", "trade_id", "open_time", "close_time", F.inline(both))
