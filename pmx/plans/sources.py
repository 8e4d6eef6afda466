"""Queries over the ingestion sources and the streaming bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmx.plans.enrichment import _bars_oracle, flow_trades
from pmx.registry import register
from pmx.sources.ingest import interpolate_blocks, parse_timestamp, register_sources
from pmx.streaming import stream_bars
from pmx.views import blocks, oracle, p_markets

C = F.col


@register("ingest_chain_logs", "SELECT b % 5 + 1 AS token, COUNT(*) * 2 AS logs, CAST(SUM(2 * 10 * (b % 9 + 1)) AS BIGINT) AS amount FROM range(0, 3000) t(b) GROUP BY 1")
def ingest_chain_logs(spark, sf_dir):
    """Logs by ranges of blocks, which the provider makes the reader split."""
    register_sources(spark)
    logs = spark.read.format("pmx_chain_logs").options(start="0", end="3000", step="500").load()
    token = F.when(C("maker_asset_id") == "0", C("taker_asset_id")).otherwise(C("maker_asset_id")).cast("long")
    return logs.groupBy(token.alias("token")).agg(F.count("*").alias("logs"), F.sum("maker_amount").alias("amount"))


@register("ingest_market_trades", "SELECT m AS market, 10 + m % 40 AS trades, CAST((SELECT SUM(i % 7 + 1) FROM range(0, 10 + m % 40) r(i)) AS BIGINT) AS contracts FROM range(0, 100) t(m)")
def ingest_market_trades(spark, sf_dir):
    """Trades of markets, by pages; times are parsed whatever their decimals."""
    register_sources(spark)
    t = spark.read.format("pmx_market_trades").options(markets="100", per_partition="25").load().filter(parse_timestamp(C("created_time")).isNotNull())
    return t.groupBy(F.split_part("ticker", F.lit("-"), F.lit(2)).cast("long").alias("market")).agg(F.count("*").alias("trades"), F.sum("count").alias("contracts"))


@register("ingest_markets", "SELECT CASE WHEN i % 4 = 0 THEN 'open' ELSE 'finalized' END AS status, COUNT(*) AS markets, COUNT(DISTINCT i % 9) AS events, CAST(SUM(10 * i) AS BIGINT) AS volume FROM range(0, 120) t(i) GROUP BY 1")
def ingest_markets(spark, sf_dir):
    """The list of markets, by pages."""
    register_sources(spark)
    return spark.read.format("pmx_markets").load().groupBy("status").agg(F.count("*").alias("markets"), F.count_distinct("event_ticker").alias("events"), F.sum("volume").alias("volume"))


@register("block_interpolation", oracle("""SELECT b AS block_number, CAST(COALESCE(t0 + FLOOR((b - b0) * (t1 - t0) / CAST(b1 - b0 AS DOUBLE)), t0) AS BIGINT) AS ts FROM (SELECT b0, t0, b1, t1, UNNEST(generate_series(b0, COALESCE(b1 - 1, b0))) AS b FROM (
  SELECT block_number AS b0, ts AS t0, LEAD(block_number) OVER (ORDER BY block_number) AS b1, LEAD(ts) OVER (ORDER BY block_number) AS t1 FROM (SELECT block_number, CAST(EPOCH(CAST(REPLACE(timestamp, 'Z', '') AS TIMESTAMP)) AS BIGINT) + block_number % 7 AS ts FROM blocks WHERE block_number % 10 = 0)))"""))
def block_interpolation(spark, sf_dir):
    """Every tenth block as a sample, the others between them."""
    ts = F.unix_timestamp(F.to_timestamp(F.regexp_replace("timestamp", "Z$", ""))) + C("block_number") % 7
    return interpolate_blocks(blocks(spark, sf_dir).filter("block_number % 10 = 0").select("block_number", ts.alias("ts")))


@register("stream_bars_5min", oracle("SELECT ticker, bar_start, open, high, low, close, volume, net_flow, trade_count FROM f", **{"f": _bars_oracle("5 minutes")["f"]}))
def stream_bars_5min(spark, sf_dir):
    """The streaming bars over the table at rest."""
    return stream_bars(flow_trades(spark, sf_dir)).withColumn("bar_start", C("bar_start").cast("timestamp_ntz"))


@register("legacy_markets", oracle("SELECT id, LOWER('0X' || id) AS address, closed FROM p_markets WHERE CAST(id AS BIGINT) % 3 = 0 AND closed"))
def legacy_markets(spark, sf_dir):
    """Resolution of pool addresses, in lower case, for pools whose collateral is in a list (here every third)."""
    m = p_markets(spark, sf_dir).filter("closed")
    listed = m.filter(C("id").cast("long") % 3 == 0).select("id")
    return m.join(listed, "id", "left_semi").select("id", F.lower(F.concat(F.lit("0X"), "id")).alias("address"), "closed")
