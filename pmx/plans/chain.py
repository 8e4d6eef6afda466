"""Win rates of the on-chain venue, with the trades of the older pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pmx.functions import d, rnd
from pmx.operators.tokens import pool_positions, pool_resolution, token_positions, token_resolution
from pmx.plans.categories import calibration
from pmx.registry import register
from pmx.views import blocks, collateral_list, oracle, p_markets, p_tokens, p_trades, pool_trades

C = F.col
_POSITIONS = {
    "won_of": """SELECT id, address, CASE WHEN p0 > 0.99 THEN 0 ELSE 1 END AS winner FROM (SELECT id, LOWER(market_maker_address) AS address, CAST(json_extract_string(outcome_prices, '$[0]') AS DOUBLE) AS p0, CAST(json_extract_string(outcome_prices, '$[1]') AS DOUBLE) AS p1 FROM p_markets WHERE closed)
  WHERE (p0 > 0.99 AND p1 < 0.01) OR (p0 < 0.01 AND p1 > 0.99)""",
    "fills": """SELECT 100.0 * CASE WHEN maker_asset_id = '0' THEN maker_amount / taker_amount ELSE taker_amount / maker_amount END AS cents, winner = 0 AS won FROM p_trades JOIN won_of ON id = CASE WHEN maker_asset_id = '0' THEN taker_asset_id ELSE maker_asset_id END WHERE taker_amount > 0 AND maker_amount > 0
  UNION ALL SELECT 100.0 * CAST(amount AS DOUBLE) / CAST(outcome_tokens AS DOUBLE), outcome_index = winner FROM pool_trades t JOIN won_of ON LOWER(t.fpmm_address) = address WHERE address IN (SELECT fpmm_address FROM collateral_list WHERE collateral_symbol = 'USDC') AND CAST(outcome_tokens AS DOUBLE) > 0""",
    "rates": """SELECT price, COUNT(*) AS total_trades, COUNT(*) FILTER (WHERE won) AS wins FROM (SELECT CAST(ROUND(cents) AS INTEGER) AS price, won FROM fills UNION ALL SELECT CAST(ROUND(100.0 - cents) AS INTEGER), NOT won FROM fills) WHERE price BETWEEN 1 AND 99 GROUP BY price""",
}


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and wins at each price from 1 to 99 cents, of order-book fills and pool trades."""
    m = p_markets(spark, sf_dir)
    rows = p_tokens(spark, sf_dir).count()
    fills = token_positions(p_trades(spark, sf_dir), token_resolution(m), rows)
    pools = pool_positions(pool_trades(spark, sf_dir), pool_resolution(m, collateral_list(spark, sf_dir)), rows)
    return fills.unionByName(pools).filter(C("price").between(1, 99)).groupBy("price").agg(F.count("*").alias("total_trades"), F.count_if("won").alias("wins"))


@register("p_win_rate_by_price", oracle("SELECT price, total_trades, wins, ROUND(100.0 * CAST(wins AS DOUBLE) / total_trades, 6) AS win_rate FROM rates", **_POSITIONS))
def p_win_rate_by_price(spark, sf_dir):
    return rates(spark, sf_dir).select("*", rnd(F.lit(100.0) * d("wins") / C("total_trades")).alias("win_rate"))


@register("p_calibration_metrics", oracle("""SELECT CAST(SUM(n) AS BIGINT) AS total_trades, ROUND(SUM(w * (1 - p) * (1 - p) + (n - w) * p * p) / SUM(n), 6) AS brier, ROUND(-SUM(w * LN(p) + (n - w) * LN(1 - p)) / SUM(n), 6) AS log_loss, ROUND(SUM(ABS(w - n * p)) / SUM(n), 6) AS ece
  FROM (SELECT CAST(price AS DOUBLE) / 100 AS p, CAST(total_trades AS DOUBLE) AS n, CAST(wins AS DOUBLE) AS w FROM rates)""", **_POSITIONS))
def p_calibration_metrics(spark, sf_dir):
    """Brier score, log loss and expected calibration error from a row a price."""
    c = rates(spark, sf_dir).select((d("price") / F.lit(100.0)).alias("p"), d("total_trades").alias("n"), d("wins").alias("w"))
    return calibration(c.withColumn("all", F.lit(0)), "all").crossJoin(c.agg(F.sum("n").cast("long").alias("total_trades"))).drop("all")


#: Fills and pool trades by block: the tokens of a pool trade are paid in a collateral of six places, and only those in USDC are dollars.
_ALL = {"paid": """SELECT block_number, CASE WHEN maker_asset_id = '0' THEN maker_amount ELSE taker_amount END AS usd FROM p_trades
  UNION ALL SELECT block_number, CASE WHEN c.fpmm_address IS NOT NULL THEN CAST(amount AS DOUBLE) / 1000000 ELSE 0 END FROM pool_trades t LEFT JOIN (SELECT fpmm_address FROM collateral_list WHERE collateral_symbol = 'USDC') c ON LOWER(t.fpmm_address) = c.fpmm_address"""}


def paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_number, usd) of every trade of the order book and of the pools; trades in other collateral count, but hold no dollars."""
    p = p_trades(spark, sf_dir).select("block_number", F.when(C("maker_asset_id") == "0", C("maker_amount")).otherwise(C("taker_amount")).alias("usd"))
    usdc = collateral_list(spark, sf_dir).filter("collateral_symbol = 'USDC'").select("fpmm_address", F.lit(True).alias("usdc"))
    t = pool_trades(spark, sf_dir).select("block_number", F.lower("fpmm_address").alias("fpmm_address"), "amount").join(usdc, "fpmm_address", "left")
    return p.unionByName(t.select("block_number", F.when(C("usdc"), d("amount") / F.lit(1000000.0)).otherwise(0.0).alias("usd")))


@register("p_all_quarterly", oracle("""SELECT CAST(DATE_TRUNC('quarter', ts) AS TIMESTAMP) AS quarter, CAST(SUM(n) AS BIGINT) AS trades, ROUND(SUM(usd), 2) AS volume FROM (SELECT block_number // 100 AS bucket, COUNT(*) AS n, SUM(usd) AS usd FROM paid GROUP BY 1) t
  JOIN (SELECT block_number // 100 AS bucket, MIN(CAST(REPLACE(timestamp, 'Z', '') AS TIMESTAMP)) AS ts FROM blocks GROUP BY 1) b ON t.bucket = b.bucket GROUP BY 1""", **_ALL))
def p_all_quarterly(spark, sf_dir):
    """Trades and dollars a quarter, pools included: summed by coarse buckets of blocks before the join with their times."""
    bucket = F.floor(C("block_number") / 100).cast("long").alias("bucket")
    t = paid(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    b = blocks(spark, sf_dir).groupBy(bucket).agg(F.min(F.to_timestamp_ntz(F.regexp_replace("timestamp", "Z$", ""))).alias("ts"))
    return t.join(b, "bucket").groupBy(F.date_trunc("quarter", "ts").cast("timestamp_ntz").alias("quarter")).agg(F.sum("n").alias("trades"), rnd(F.sum("usd"), 2).alias("volume"))
