"""Analyses over calendar time, market life and time to expiry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.functions import breakpoints, d, excess, life_share, life_stage, price_zone, ratio, rnd, seconds_between
from pmx.operators.positions import positions
from pmx.plans.prices import resolved
from pmx.registry import register
from pmx.views import blocks, k_markets, k_trades, oracle, p_trades

C = F.col


def trunc(unit: str, c: str = "created_time"):
    return F.date_trunc(unit, c).cast("timestamp_ntz")


@register("volume_quarterly", oracle("""SELECT CAST(DATE_TRUNC('quarter', created_time) AS TIMESTAMP) AS quarter, COUNT(*) AS trades, CAST(SUM(count) AS BIGINT) AS contracts, ROUND(SUM(count * CAST(CASE WHEN taker_side = 'yes' THEN yes_price ELSE no_price END AS DOUBLE) / 100.0), 4) AS volume_usd FROM k_trades GROUP BY 1"""))
def volume_quarterly(spark, sf_dir):
    from pmx.functions import taker_price

    return k_trades(spark, sf_dir).groupBy(trunc("quarter").alias("quarter")).agg(F.count("*").alias("trades"), F.sum("count").alias("contracts"), rnd(F.sum(d(C("count") * taker_price()) / F.lit(100.0)), 4).alias("volume_usd"))


@register("maker_taker_gap_quarterly", oracle("""SELECT quarter, MAX(n) FILTER (role = 'taker') AS n, ROUND(MAX(m) FILTER (role = 'maker') - MAX(m) FILTER (role = 'taker'), 6) AS gap, ROUND(1.96 * SQRT(MAX(v) FILTER (role = 'maker') / MAX(n) FILTER (role = 'maker') + MAX(v) FILTER (role = 'taker') / MAX(n) FILTER (role = 'taker')), 6) AS ci FROM s GROUP BY quarter""",
    s="SELECT CAST(DATE_TRUNC('quarter', created_time) AS TIMESTAMP) AS quarter, role, COUNT(*) AS n, AVG(won - price / 100.0) AS m, VAR_SAMP(CAST(won - price / 100.0 AS DOUBLE)) AS v FROM pos GROUP BY 1, 2 HAVING COUNT(*) >= 100"))
def maker_taker_gap_quarterly(spark, sf_dir):
    x = excess(C("won"), C("price"))
    s = positions(resolved(spark, sf_dir)).groupBy(trunc("quarter").alias("quarter")).agg(*[
        f(F.when(C("role") == r, x)).alias(f"{k}_{r}") for r in ("taker", "maker") for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    return s.filter("n_taker >= 100").select("quarter", C("n_taker").alias("n"), rnd(C("m_maker") - C("m_taker")).alias("gap"),
                                            rnd(F.lit(1.96) * F.sqrt(C("v_maker") / C("n_maker") + C("v_taker") / C("n_taker"))).alias("ci"))


@register("longshot_share_quarterly", oracle("""SELECT quarter, bucket, ROUND(v / SUM(v) OVER (PARTITION BY quarter), 6) AS share FROM (
  SELECT CAST(DATE_TRUNC('quarter', created_time) AS TIMESTAMP) AS quarter, CAST(LEAST(FLOOR((price - 1) / 10.0), 9) AS INTEGER) AS bucket, SUM(CAST(count * price AS DOUBLE)) / 100.0 AS v FROM pos WHERE role = 'taker' GROUP BY 1, 2)"""))
def longshot_share_quarterly(spark, sf_dir):
    bucket = F.least(F.floor((C("tp") - 1) / F.lit(10.0)), F.lit(9)).cast("int")
    v = resolved(spark, sf_dir).groupBy(trunc("quarter").alias("quarter"), bucket.alias("bucket")).agg((F.sum(d(C("count") * C("tp"))) / F.lit(100.0)).alias("v"))
    return v.select("quarter", "bucket", rnd(C("v") / F.sum("v").over(W.partitionBy("quarter"))).alias("share"))


@register("longshot_zone_quarterly", oracle("""SELECT CAST(DATE_TRUNC('quarter', created_time) AS TIMESTAMP) AS quarter, CASE WHEN tp < 15 THEN 'longshot' WHEN tp > 85 THEN 'favourite' ELSE 'mid' END AS zone, COUNT(*) AS n, ROUND(AVG(tw - tp / 100.0), 6) AS excess_trade,
  ROUND(SUM(count * CAST(tw - tp / 100.0 AS DOUBLE)) / SUM(count), 6) AS excess_contract FROM rt GROUP BY 1, 2"""))
def longshot_zone_quarterly(spark, sf_dir):
    x = excess(C("tw"), C("tp"))
    return resolved(spark, sf_dir).groupBy(trunc("quarter").alias("quarter"), price_zone(C("tp")).alias("zone")).agg(
        F.count("*").alias("n"), rnd(F.avg(x)).alias("excess_trade"), rnd(ratio(F.sum(C("count") * x), F.sum("count"))).alias("excess_contract"))


@register("yes_bias_quarterly", oracle("""SELECT CAST(DATE_TRUNC('quarter', created_time) AS TIMESTAMP) AS quarter, COUNT(*) FILTER (WHERE taker_side = 'yes') AS yes_n, COUNT(*) FILTER (WHERE taker_side = 'no') AS no_n, ROUND(CAST(COUNT(*) FILTER (WHERE taker_side = 'yes') AS DOUBLE) / COUNT(*), 6) AS yes_share,
  ROUND(AVG(tw - tp / 100.0) FILTER (WHERE taker_side = 'yes'), 6) AS yes_excess, ROUND(AVG(tw - tp / 100.0) FILTER (WHERE taker_side = 'no'), 6) AS no_excess FROM rt GROUP BY 1"""))
def yes_bias_quarterly(spark, sf_dir):
    x, y = excess(C("tw"), C("tp")), C("taker_side") == "yes"
    return resolved(spark, sf_dir).groupBy(trunc("quarter").alias("quarter")).agg(
        F.count_if(y).alias("yes_n"), F.count_if(~y).alias("no_n"), rnd(d(F.count_if(y)) / F.count("*")).alias("yes_share"), rnd(F.avg(F.when(y, x))).alias("yes_excess"), rnd(F.avg(F.when(~y, x))).alias("no_excess"))


@register("maker_alpha_quarterly", oracle("""SELECT CAST(DATE_TRUNC('quarter', created_time) AS TIMESTAMP) AS quarter, ROUND(AVG(mw - mp / 100.0), 6) AS maker_excess, ROUND(AVG(tw - tp / 100.0), 6) AS taker_excess, ROUND(SUM(count * (mw - mp / 100.0)), 4) AS maker_pnl FROM rt GROUP BY 1"""))
def maker_alpha_quarterly(spark, sf_dir):
    m, t = excess(C("mw"), C("mp")), excess(C("tw"), C("tp"))
    return resolved(spark, sf_dir).groupBy(trunc("quarter").alias("quarter")).agg(rnd(F.avg(m)).alias("maker_excess"), rnd(F.avg(t)).alias("taker_excess"), rnd(F.sum(C("count") * m), 4).alias("maker_pnl"))


_STAGE = "CASE WHEN p < 0.05 THEN '0-5%' WHEN p < 0.1 THEN '5-10%' WHEN p < 0.2 THEN '10-20%' WHEN p < 0.4 THEN '20-40%' WHEN p < 0.6 THEN '40-60%' WHEN p < 0.8 THEN '60-80%' WHEN p < 0.95 THEN '80-95%' ELSE '95-100%' END"


@register("early_market_inefficiency", oracle(f"""SELECT stage, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(n * ABS(e)) / SUM(n), 6) AS mae, ROUND(SQRT(SUM(n * e * e) / SUM(n)), 6) AS rmse FROM (
  SELECT {_STAGE} AS stage, tp, COUNT(*) AS n, AVG(CAST(tw AS DOUBLE)) - tp / 100.0 AS e FROM (SELECT *, LEAST(1.0, GREATEST(0.0, EPOCH(created_time - open_time) / EPOCH(close_time - open_time))) AS p FROM rt WHERE close_time > open_time AND tp BETWEEN 1 AND 99) GROUP BY 1, 2) GROUP BY stage"""))
def early_market_inefficiency(spark, sf_dir):
    """Calibration error by stage of life: errors per price, then their weighted mean."""
    r = resolved(spark, sf_dir).filter("close_time > open_time AND tp BETWEEN 1 AND 99").withColumn("stage", life_stage(life_share(C("created_time"), C("open_time"), C("close_time"))))
    e = r.groupBy("stage", "tp").agg(F.count("*").alias("n"), (F.avg(d("tw")) - C("tp") / F.lit(100.0)).alias("e"))
    return e.groupBy("stage").agg(F.sum("n").alias("n"), rnd(F.sum(C("n") * F.abs("e")) / F.sum("n")).alias("mae"), rnd(F.sqrt(F.sum(C("n") * C("e") * C("e")) / F.sum("n"))).alias("rmse"))


_TTE6 = "CASE WHEN h <= 1 THEN '<=1h' WHEN h <= 6 THEN '1-6h' WHEN h <= 24 THEN '6-24h' WHEN h <= 72 THEN '1-3d' WHEN h <= 168 THEN '3-7d' ELSE '7d+' END"


@register("tte_decay", oracle(f"""SELECT {_TTE6} AS bucket, COUNT(*) AS n, ROUND(AVG(CAST(tw AS DOUBLE)), 6) AS win_rate, ROUND(AVG(tw - tp / 100.0), 6) AS taker_excess, ROUND(AVG(mw - mp / 100.0), 6) AS maker_excess FROM (SELECT *, EPOCH(close_time - created_time) / 3600.0 AS h FROM rt WHERE close_time >= created_time) GROUP BY 1"""))
def tte_decay(spark, sf_dir):
    from pmx.functions import TTE_HOURS

    h = seconds_between(C("close_time"), C("created_time")) / F.lit(3600.0)
    return resolved(spark, sf_dir).filter("close_time >= created_time").groupBy(breakpoints(h, TTE_HOURS, "7d+").alias("bucket")).agg(
        F.count("*").alias("n"), rnd(F.avg(d("tw"))).alias("win_rate"), rnd(F.avg(excess(C("tw"), C("tp")))).alias("taker_excess"), rnd(F.avg(excess(C("mw"), C("mp")))).alias("maker_excess"))


@register("volume_regimes", oracle("""SELECT CASE WHEN v <= q1 THEN 'low' WHEN v <= q2 THEN 'medium' ELSE 'high' END AS regime, COUNT(*) AS n, ROUND(AVG(tw - tp / 100.0), 6) AS taker_excess FROM rt JOIN mv ON rt.ticker = mv.ticker CROSS JOIN q GROUP BY 1""",
    mv="SELECT ticker, CAST(SUM(count) AS DOUBLE) AS v FROM rt GROUP BY ticker", q="SELECT QUANTILE_CONT(v, 0.3333) AS q1, QUANTILE_CONT(v, 0.6667) AS q2 FROM mv"))
def volume_regimes(spark, sf_dir):
    """Markets by terciles of volume; the quantiles are one row, joined to all."""
    r = resolved(spark, sf_dir)
    mv = r.groupBy("ticker").agg(d(F.sum("count")).alias("v"))
    q = mv.agg(F.percentile("v", F.lit(0.3333)).alias("q1"), F.percentile("v", F.lit(0.6667)).alias("q2"))
    regime = F.when(C("v") <= C("q1"), "low").when(C("v") <= C("q2"), "medium").otherwise("high")
    labelled = mv.crossJoin(F.broadcast(q)).select("ticker", regime.alias("regime"))  # q is one row
    return r.join(labelled, "ticker").groupBy("regime").agg(F.count("*").alias("n"), rnd(F.avg(excess(C("tw"), C("tp")))).alias("taker_excess"))


@register("volume_spikes", oracle("""SELECT s.spike, COUNT(*) AS n, ROUND(AVG(CASE WHEN t.taker_side = m.result THEN 1.0 ELSE 0.0 END), 6) AS win_rate, COUNT(DISTINCT t.ticker) AS markets FROM k_trades t JOIN r2 m ON t.ticker = m.ticker
  JOIN (SELECT d.ticker, d.day, d.n > 3 * a.mean AS spike FROM dd d JOIN a ON d.ticker = a.ticker) s ON s.ticker = t.ticker AND s.day = CAST(t.created_time AS DATE) GROUP BY s.spike""",
    r2="SELECT ticker, result FROM k_markets WHERE result IN ('yes', 'no')", dd="SELECT ticker, CAST(created_time AS DATE) AS day, COUNT(*) AS n FROM k_trades GROUP BY 1, 2",
    a="SELECT ticker, AVG(n) AS mean FROM dd GROUP BY ticker HAVING COUNT(*) >= 3"))
def volume_spikes(spark, sf_dir):
    """Days with over three times a market's mean daily trades, for markets of three days or more."""
    t = k_trades(spark, sf_dir).withColumn("day", C("created_time").cast("date"))
    w = W.partitionBy("ticker")
    days = t.groupBy("ticker", "day").agg(F.count("*").alias("n")).select("ticker", "day", "n", F.avg("n").over(w).alias("mean"), F.count("*").over(w).alias("days"))
    spike = days.filter("days >= 3").select("ticker", "day", (C("n") > 3 * C("mean")).alias("spike"))
    m = k_markets(spark, sf_dir).filter(C("result").isin("yes", "no")).select("ticker", "result")
    return t.join(m, "ticker").join(spike, ["ticker", "day"]).groupBy("spike").agg(
        F.count("*").alias("n"), rnd(F.avg(F.when(C("taker_side") == C("result"), 1.0).otherwise(0.0))).alias("win_rate"), F.count_distinct("ticker").alias("markets"))


def cumulative_cells(by_period, period: str):
    """Running (n, wins) of each price over all periods present, a row for each period and price from its first trade on."""
    periods = by_period.select(period).distinct()
    prices = by_period.groupBy("price").agg(F.min(period).alias("_first"))
    grid = periods.join(prices, C(period) >= C("_first")).select(period, "price")  # a hundred prices: a small range join
    w = W.partitionBy("price").orderBy(period).rowsBetween(W.unboundedPreceding, 0)
    return grid.join(by_period, [period, "price"], "left").select(period, "price", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"), F.sum(F.coalesce("wins", F.lit(0))).over(w).alias("wins"))


@register("calibration_deviation_weekly", oracle("""SELECT week, CAST(SUM(n) AS BIGINT) AS n, ROUND(AVG(ABS(100.0 * w / n - price)), 6) AS mean_abs_dev FROM (
  SELECT g.week, b.price, SUM(b.n) AS n, SUM(b.w) AS w FROM (SELECT DISTINCT week FROM b) g JOIN b ON b.week <= g.week GROUP BY 1, 2) GROUP BY week""",
    r2="SELECT ticker, result FROM k_markets WHERE result IN ('yes', 'no')",
    b="""SELECT CAST(DATE_TRUNC('week', created_time) AS TIMESTAMP) AS week, price, COUNT(*) AS n, SUM(won) AS w FROM (
      SELECT created_time, CASE WHEN taker_side = 'yes' THEN yes_price ELSE no_price END AS price, CASE WHEN taker_side = result THEN 1 ELSE 0 END AS won FROM k_trades t JOIN r2 ON t.ticker = r2.ticker
      UNION ALL SELECT created_time, CASE WHEN taker_side = 'yes' THEN no_price ELSE yes_price END, CASE WHEN taker_side <> result THEN 1 ELSE 0 END FROM k_trades t JOIN r2 ON t.ticker = r2.ticker) GROUP BY 1, 2"""))
def calibration_deviation_weekly(spark, sf_dir):
    b = positions(resolved(spark, sf_dir, finalized=False)).groupBy(trunc("week").alias("week"), "price").agg(F.count("*").alias("n"), F.sum("won").alias("wins"))
    return cumulative_cells(b, "week").groupBy("week").agg(F.sum("n").alias("n"), rnd(F.avg(F.abs(F.lit(100.0) * C("wins") / C("n") - C("price")))).alias("mean_abs_dev"))


@register("cumulative_calibration", oracle("""SELECT g.day, b.price, CAST(SUM(b.n) AS BIGINT) AS n, ROUND(100.0 * CAST(SUM(b.w) AS DOUBLE) / SUM(b.n), 6) AS win_rate FROM (SELECT DISTINCT day FROM b) g JOIN b ON b.day <= g.day GROUP BY 1, 2""",
    b="SELECT CAST(created_time AS DATE) AS day, price, COUNT(*) AS n, SUM(won) AS w FROM pos GROUP BY 1, 2"))
def cumulative_calibration(spark, sf_dir):
    """Snapshots: all positions up to each day."""
    b = positions(resolved(spark, sf_dir)).groupBy(C("created_time").cast("date").alias("day"), "price").agg(F.count("*").alias("n"), F.sum("won").alias("wins"))
    return cumulative_cells(b, "day").select("day", "price", "n", rnd(F.lit(100.0) * C("wins") / C("n")).alias("win_rate"))


@register("p_trades_by_block", oracle("""SELECT b.block_number, b.timestamp, t.n FROM blocks b JOIN (SELECT block_number, COUNT(*) AS n FROM p_trades GROUP BY 1) t ON b.block_number = t.block_number"""))
def p_trades_by_block(spark, sf_dir):
    """Pre-aggregated per block before the join."""
    return p_trades(spark, sf_dir).groupBy("block_number").agg(F.count("*").alias("n")).join(blocks(spark, sf_dir), "block_number").select("block_number", "timestamp", "n")


@register("p_volume_quarterly", oracle("""SELECT CAST(DATE_TRUNC('quarter', ts) AS TIMESTAMP) AS quarter, ROUND(SUM(usd), 2) AS volume FROM (SELECT block_number // 100 AS bucket, SUM(CASE WHEN maker_asset_id = '0' THEN maker_amount ELSE taker_amount END) AS usd FROM p_trades GROUP BY 1) t
  JOIN (SELECT block_number // 100 AS bucket, MIN(CAST(REPLACE(timestamp, 'Z', '') AS TIMESTAMP)) AS ts FROM blocks GROUP BY 1) b ON t.bucket = b.bucket GROUP BY 1"""))
def p_volume_quarterly(spark, sf_dir):
    """A coarse bucket of blocks as the join key."""
    bucket = F.floor(C("block_number") / 100).cast("long").alias("bucket")
    t = p_trades(spark, sf_dir).groupBy(bucket).agg(F.sum(F.when(C("maker_asset_id") == "0", C("maker_amount")).otherwise(C("taker_amount"))).alias("usd"))
    b = blocks(spark, sf_dir).groupBy(bucket).agg(F.min(F.to_timestamp_ntz(F.regexp_replace("timestamp", "Z$", ""))).alias("ts"))
    return t.join(b, "bucket").groupBy(trunc("quarter", "ts").alias("quarter")).agg(rnd(F.sum("usd"), 2).alias("volume"))
