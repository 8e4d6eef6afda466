"""The domain tables, derived from the test tables; the same in Spark and, as CTEs, in the oracle SQL.

k_markets and k_trades are an order-book venue (cent prices); p_trades, p_markets and blocks are on-chain
fills ('0' is the cash asset).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pmx.operators.dealing import dealt

EPOCH = "1995-01-01"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def k_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    event = F.concat(F.lit("KX"), F.upper(F.replace(F.col("c_mktsegment"), F.lit(" "), F.lit(""))), F.lit("-"), F.col("c_nationkey").cast("string"))
    close = F.when(key % 3 == 0, _ts("2024-01-31 00:00:00")).when(key % 3 == 1, _ts("2024-02-05 00:00:00")).otherwise(_ts("2024-03-01 00:00:00"))
    return raw(spark, sf_dir, "customer").select(
        F.concat(event, F.lit("-T"), key.cast("string")).alias("ticker"), event.alias("event_ticker"), key.alias("market_key"),
        F.when(key % 8 == 0, "open").otherwise("finalized").alias("status"),
        F.when(key % 8 == 0, "").when(F.col("c_acctbal") > 4500, "yes").otherwise("no").alias("result"),
        (1 + (key * 31) % 99).cast("int").alias("last_price"), key.cast("double").alias("threshold"),
        (100 + (key * 17) % 5000).cast("long").alias("volume"), _ts("2024-01-01 00:00:00").alias("open_time"), close.alias("close_time"))


def k_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with their market's ticker. The market side has a row per market and Spark picks the join by its size."""
    e, m = raw(spark, sf_dir, "events"), k_markets(spark, sf_dir).select("market_key", "ticker")
    x = (F.col("event_id") * 37 + F.col("user_id") * 11) % 99
    side = F.when(F.col("event_type").isin("click", "purchase"), "yes").when(F.col("event_id") % 2 == 0, "yes").otherwise("no")
    return e.join(m, e.user_id == m.market_key).select(
        F.col("event_id").alias("trade_id"), "ticker", (1 + F.floor("value").cast("long") % 200).cast("int").alias("count"),
        (1 + x).cast("int").alias("yes_price"), (99 - x).cast("int").alias("no_price"), side.alias("taker_side"), F.col("ts").alias("created_time"))


def p_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = dealt(li, li.count(), "l_orderkey")
    sell, part = F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")
    cash = F.col("l_quantity") * (F.lit(0.01) + F.col("l_discount"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit(EPOCH))).cast("long").alias("block_number"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_index"),
        F.concat(F.lit("0x"), F.col("l_suppkey").cast("string")).alias("maker"), F.concat(F.lit("0x"), F.col("o_custkey").cast("string")).alias("taker"),
        F.when(sell, "0").otherwise(part).alias("maker_asset_id"), F.when(sell, part).otherwise("0").alias("taker_asset_id"),
        F.when(sell, cash).otherwise(F.col("l_quantity")).alias("maker_amount"), F.when(sell, F.col("l_quantity")).otherwise(cash).alias("taker_amount"),
        F.col("l_shipdate").alias("trade_ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def p_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of each fill, without the join: for counts."""
    return raw(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("token_id"))


def p_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    return raw(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("Will "), F.col("p_name"), F.lit(" ship as "), F.col("p_type"), F.lit("?")).alias("question"),
        F.concat(F.lit('["'), key, F.lit('","'), key, F.lit('N"]')).alias("clob_token_ids"),
        F.when(size % 3 == 0, '["1","0"]').when(size % 3 == 1, '["0","1"]').otherwise('["0.6","0.4"]').alias("outcome_prices"),
        (size % 5 != 0).alias("closed"), F.col("p_retailprice").alias("volume"), F.concat(F.lit("0X"), key).alias("market_maker_address"))


def pool_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with the pools of markets, amounts as text: returned lines stand for them."""
    part, quantity = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("double")
    whole = lambda x: x.cast("long").cast("string")
    return raw(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit(EPOCH))).cast("long").alias("block_number"), F.concat(F.lit("0x"), part).alias("fpmm_address"), whole(quantity * (1 + (F.col("l_orderkey") + F.col("l_linenumber")) % 97) * 10000).alias("amount"),
        whole(quantity * 1000000).alias("outcome_tokens"), (F.col("l_linenumber") % 2).cast("int").alias("outcome_index"))


def collateral_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fpmm_address, collateral_symbol: every third market stands for those in USDC."""
    key = F.col("p_partkey")
    return raw(spark, sf_dir, "part").select(F.concat(F.lit("0x"), key.cast("string")).alias("fpmm_address"), F.when(key % 3 == 0, "USDC").otherwise("WETH").alias("collateral_symbol"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return raw(spark, sf_dir, "lineitem").select(
        F.datediff(day, F.to_date(F.lit(EPOCH))).cast("long").alias("block_number"), F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("timestamp")).distinct()


#: The same tables for the oracle, as leading CTEs.
CTES = {
    "k_markets": """SELECT CONCAT('KX', UPPER(REPLACE(c_mktsegment,' ','')), '-', CAST(c_nationkey AS VARCHAR), '-T', CAST(c_custkey AS VARCHAR)) AS ticker,
  CONCAT('KX', UPPER(REPLACE(c_mktsegment,' ','')), '-', CAST(c_nationkey AS VARCHAR)) AS event_ticker, c_custkey AS market_key,
  CASE WHEN c_custkey % 8 = 0 THEN 'open' ELSE 'finalized' END AS status,
  CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_acctbal > 4500 THEN 'yes' ELSE 'no' END AS result,
  CAST(1 + (c_custkey * 31) % 99 AS INTEGER) AS last_price, CAST(c_custkey AS DOUBLE) AS threshold, CAST(100 + (c_custkey * 17) % 5000 AS BIGINT) AS volume,
  TIMESTAMP '2024-01-01 00:00:00' AS open_time,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-02-05 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS close_time
  FROM customer""",
    "k_trades": """SELECT event_id AS trade_id, m.ticker AS ticker, CAST(1 + CAST(FLOOR(e.value) AS BIGINT) % 200 AS INTEGER) AS count,
  CAST(1 + (e.event_id * 37 + e.user_id * 11) % 99 AS INTEGER) AS yes_price, CAST(99 - (e.event_id * 37 + e.user_id * 11) % 99 AS INTEGER) AS no_price,
  CASE WHEN e.event_type IN ('click','purchase') THEN 'yes' WHEN e.event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS taker_side, e.ts AS created_time
  FROM events e JOIN k_markets m ON e.user_id = m.market_key""",
    "p_trades": """SELECT CAST(DATEDIFF('day', TIMESTAMP '1995-01-01 00:00:00', l.l_shipdate) AS BIGINT) AS block_number, l.l_orderkey * 10 + l.l_linenumber AS log_index,
  CONCAT('0x', CAST(l.l_suppkey AS VARCHAR)) AS maker, CONCAT('0x', CAST(o.o_custkey AS VARCHAR)) AS taker,
  CASE WHEN l.l_linestatus = 'O' THEN '0' ELSE CAST(l.l_partkey AS VARCHAR) END AS maker_asset_id,
  CASE WHEN l.l_linestatus = 'O' THEN CAST(l.l_partkey AS VARCHAR) ELSE '0' END AS taker_asset_id,
  CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity * (CAST(0.01 AS DOUBLE) + l.l_discount) ELSE l.l_quantity END AS maker_amount,
  CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE l.l_quantity * (CAST(0.01 AS DOUBLE) + l.l_discount) END AS taker_amount,
  l.l_shipdate AS trade_ts, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "p_markets": """SELECT CAST(p_partkey AS VARCHAR) AS id, CONCAT('Will ', p_name, ' ship as ', p_type, '?') AS question,
  CONCAT('["', CAST(p_partkey AS VARCHAR), '","', CAST(p_partkey AS VARCHAR), 'N"]') AS clob_token_ids,
  CASE WHEN p_size % 3 = 0 THEN '["1","0"]' WHEN p_size % 3 = 1 THEN '["0","1"]' ELSE '["0.6","0.4"]' END AS outcome_prices,
  p_size % 5 <> 0 AS closed, p_retailprice AS volume, CONCAT('0X', CAST(p_partkey AS VARCHAR)) AS market_maker_address FROM part""",
    "pool_trades": """SELECT CAST(DATEDIFF('day', TIMESTAMP '1995-01-01 00:00:00', l_shipdate) AS BIGINT) AS block_number, CONCAT('0x', CAST(l_partkey AS VARCHAR)) AS fpmm_address, CAST(CAST(CAST(l_quantity AS DOUBLE) * (1 + (l_orderkey + l_linenumber) % 97) * 10000 AS BIGINT) AS VARCHAR) AS amount,
  CAST(CAST(CAST(l_quantity AS DOUBLE) * 1000000 AS BIGINT) AS VARCHAR) AS outcome_tokens, CAST(l_linenumber % 2 AS INTEGER) AS outcome_index FROM lineitem WHERE l_returnflag = 'R'""",
    "collateral_list": """SELECT CONCAT('0x', CAST(p_partkey AS VARCHAR)) AS fpmm_address, CASE WHEN p_partkey % 3 = 0 THEN 'USDC' ELSE 'WETH' END AS collateral_symbol FROM part""",
    "blocks": """SELECT DISTINCT CAST(DATEDIFF('day', TIMESTAMP '1995-01-01 00:00:00', l_shipdate) AS BIGINT) AS block_number,
  CONCAT(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 'T00:00:00Z') AS timestamp FROM lineitem""",
    # often used
    "resolved": "SELECT ticker, event_ticker, result, open_time, close_time FROM k_markets WHERE status = 'finalized' AND result IN ('yes', 'no')",
    "rt": """SELECT t.*, m.event_ticker, m.result, m.open_time, m.close_time, CASE WHEN taker_side = 'yes' THEN yes_price ELSE no_price END AS tp,
  CASE WHEN taker_side = 'yes' THEN no_price ELSE yes_price END AS mp, CASE WHEN taker_side = m.result THEN 1 ELSE 0 END AS tw, CASE WHEN taker_side <> m.result THEN 1 ELSE 0 END AS mw
  FROM k_trades t JOIN resolved m ON t.ticker = m.ticker""",
    "pos": """SELECT tp AS price, tw AS won, 'taker' AS role, taker_side AS side, count, created_time, event_ticker, ticker, trade_id, open_time, close_time FROM rt
  UNION ALL SELECT mp, mw, 'maker', CASE WHEN taker_side = 'yes' THEN 'no' ELSE 'yes' END, count, created_time, event_ticker, ticker, trade_id, open_time, close_time FROM rt""",
}


def oracle(sql: str, recursive: bool = False, **more: str) -> str:
    """``sql`` with the CTEs it needs in front; ``more`` are further CTEs, in order."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, body in CTES.items():
            if name not in need and name not in more and re.search(rf"\b{name}\b", text):
                add(body)
                if name not in need:
                    need.append(name)

    for text in (*more.values(), sql):
        add(text)
    ctes = [f"{n} AS ({CTES[n]})" for n in need] + [f"{n} AS ({b})" for n, b in more.items()]
    return no_negative_zero(f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + sql if ctes else sql)


def no_negative_zero(sql: str) -> str:
    """ROUND(...) + 0, so that a rounded -0.0000001 is 0.0 and not -0.0, as it is in Spark."""
    out, at = "", 0
    for m in re.finditer(r"\bROUND\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at : m.start()] + "(ROUND(" + no_negative_zero(sql[m.end() : end - 1]) + ") + CAST(0 AS DOUBLE))"
        at = end
    return out + sql[at:]
