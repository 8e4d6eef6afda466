"""Sequential context of trades, bars, order flow, signals and life-cycle states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.functions import category, ratio, rnd, seconds_between, signed_count, size_bucket, tte_bucket
from pmx.operators.dealing import dealt
from pmx.operators.prefix import segmented
from pmx.operators.timegrid import bars, gap_filled
from pmx.registry import register
from pmx.views import k_markets, k_trades, oracle, p_markets, p_tokens, p_trades

C = F.col
PAST = (W.unboundedPreceding, 0)


def enrich_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their market and running values per ticker; the days of a ticker are tasks of their own, so a busy one is no hot key."""
    m = k_markets(spark, sf_dir).select("ticker", "event_ticker", "status", "open_time", "close_time")
    t = k_trades(spark, sf_dir).join(m, "ticker", "left").withColumn("norm_price", C("yes_price")).withColumn("signed_flow", signed_count())
    s = segmented(t, ["ticker"], F.date_trunc("day", "created_time"), ["created_time", "trade_id"], {"cumulative_volume": C("count"), "cumulative_net_flow": C("signed_flow")},
                  "trade_sequence_num", {"_price": C("yes_price"), "_time": C("created_time")}, {"next_price": C("yes_price")})
    return s.select(*t.columns, "trade_sequence_num", (C("yes_price") - C("_price")).alias("delta_price"), seconds_between(C("created_time"), C("_time")).alias("time_since_prev"),
                    "cumulative_volume", "cumulative_net_flow", C("trade_sequence_num").alias("cumulative_trade_count"), seconds_between(C("close_time"), C("created_time")).alias("time_to_expiry_seconds"), "next_price")


#: The enriched trades in the oracle.
EK = """SELECT t.trade_id, t.ticker, m.event_ticker, m.status, m.open_time, m.close_time, t.count, t.yes_price, t.no_price, t.taker_side, t.created_time, t.yes_price AS norm_price,
  CASE WHEN taker_side = 'yes' THEN count ELSE -count END AS signed_flow, ROW_NUMBER() OVER w AS seq, yes_price - LAG(yes_price) OVER w AS delta_price, EPOCH(created_time - LAG(created_time) OVER w) AS since,
  CAST(SUM(count) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumvol, CAST(SUM(CASE WHEN taker_side = 'yes' THEN count ELSE -count END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumflow,
  EPOCH(m.close_time - created_time) AS tte FROM k_trades t LEFT JOIN k_markets m ON t.ticker = m.ticker WINDOW w AS (PARTITION BY t.ticker ORDER BY created_time, trade_id)"""


@register("t1a_k", oracle("""SELECT trade_id, ticker, event_ticker, norm_price, signed_flow, seq AS trade_sequence_num, delta_price, ROUND(since, 6) AS time_since_prev, cumvol AS cumulative_volume, cumflow AS cumulative_net_flow, ROUND(tte, 6) AS time_to_expiry_seconds FROM ek""", ek=EK))
def t1a_k(spark, sf_dir):
    return enrich_k(spark, sf_dir).select("trade_id", "ticker", "event_ticker", "norm_price", "signed_flow", "trade_sequence_num", "delta_price", rnd(C("time_since_prev")).alias("time_since_prev"),
                                         "cumulative_volume", "cumulative_net_flow", rnd(C("time_to_expiry_seconds")).alias("time_to_expiry_seconds"))


def enrich_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-chain fills: token, price, cash volume and signed flow by which side pays cash, with running values per token."""
    buy = C("maker_asset_id") == "0"
    t = p_trades(spark, sf_dir).select(
        "block_number", "log_index", C("trade_ts").alias("timestamp"), F.when(buy, C("taker_asset_id")).otherwise(C("maker_asset_id")).alias("token_id"),
        F.when(buy, ratio(C("maker_amount"), C("taker_amount"))).otherwise(ratio(C("taker_amount"), C("maker_amount"))).alias("norm_price"),
        F.when(buy, C("maker_amount")).otherwise(C("taker_amount")).alias("volume"), buy.alias("_buy"), "l_partkey", "l_suppkey")
    t = t.withColumn("signed_flow", F.when(C("_buy"), C("volume")).otherwise(-C("volume"))).drop("_buy")
    t = dealt(t, p_tokens(spark, sf_dir).count(), "token_id")  # for the join and the window
    ids = p_markets(spark, sf_dir).select(C("id").alias("market_id"), F.explode(F.from_json("clob_token_ids", "array<string>")).alias("token_id"))
    w = W.partitionBy("token_id").orderBy("block_number", "log_index", "l_partkey", "l_suppkey", "volume", "norm_price")
    return t.join(ids, "token_id", "left").select("*", F.row_number().over(w).cast("long").alias("trade_sequence_num"), (C("norm_price") - F.lag("norm_price").over(w)).alias("delta_price"),
                                                 F.sum("volume").over(w.rowsBetween(*PAST)).alias("cumulative_volume"), F.sum("signed_flow").over(w.rowsBetween(*PAST)).alias("cumulative_net_flow"))


@register("t1a_p", oracle("""SELECT block_number, log_index, token_id, market_id, ROUND(norm_price, 6) AS norm_price, ROUND(volume, 4) AS volume, ROUND(signed_flow, 4) AS signed_flow, ROW_NUMBER() OVER w AS trade_sequence_num, ROUND(norm_price - LAG(norm_price) OVER w, 6) AS delta_price,
  ROUND(SUM(volume) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS cumulative_volume, ROUND(SUM(signed_flow) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS cumulative_net_flow FROM t LEFT JOIN ids USING (token_id) WINDOW w AS (PARTITION BY token_id ORDER BY block_number, log_index, l_partkey, l_suppkey, volume, norm_price)""",
    t="""SELECT block_number, log_index, l_partkey, l_suppkey, CASE WHEN maker_asset_id = '0' THEN taker_asset_id ELSE maker_asset_id END AS token_id, CASE WHEN maker_asset_id = '0' THEN maker_amount / NULLIF(taker_amount, 0) ELSE taker_amount / NULLIF(maker_amount, 0) END AS norm_price,
      CASE WHEN maker_asset_id = '0' THEN maker_amount ELSE taker_amount END AS volume, CASE WHEN maker_asset_id = '0' THEN maker_amount ELSE -taker_amount END AS signed_flow FROM p_trades""",
    ids="SELECT id AS market_id, UNNEST(CAST(json_extract_string(clob_token_ids, '$[*]') AS VARCHAR[])) AS token_id FROM p_markets"))
def t1a_p(spark, sf_dir):
    r4 = lambda c: rnd(C(c), 4).alias(c)
    return enrich_p(spark, sf_dir).select("block_number", "log_index", "token_id", "market_id", rnd(C("norm_price")).alias("norm_price"), r4("volume"), r4("signed_flow"), "trade_sequence_num", rnd(C("delta_price")).alias("delta_price"), r4("cumulative_volume"), r4("cumulative_net_flow"))


#: The floor of trades that the registered queries pass, for the test markets have few.
FEW_TRADES = 65


def qualifying(spark: SparkSession, sf_dir: str, per_hour: float = 5, floor: int = 100) -> DataFrame:
    """Markets with over ``per_hour`` trades an hour, or over ``floor`` trades."""
    g = k_trades(spark, sf_dir).groupBy(C("ticker").alias("market_id")).agg(F.count("*").alias("total_trades"), (seconds_between(F.max("created_time"), F.min("created_time")) / F.lit(3600.0)).alias("time_span_hours"))
    rate = F.coalesce(ratio(C("total_trades"), C("time_span_hours")), F.lit(0.0))
    return g.select(F.lit("k").alias("platform"), "market_id", "total_trades", "time_span_hours", rate.alias("trades_per_hour")).filter((C("trades_per_hour") > per_hour) | (C("total_trades") > floor))


QUAL = """SELECT ticker AS market_id, COUNT(*) AS total_trades, EPOCH(MAX(created_time) - MIN(created_time)) / 3600.0 AS h FROM k_trades GROUP BY 1"""


@register("t1b_qualifying", oracle("""SELECT 'k' AS platform, market_id, total_trades, ROUND(h, 6) AS time_span_hours, ROUND(COALESCE(total_trades / NULLIF(h, 0), 0), 6) AS trades_per_hour FROM q WHERE COALESCE(total_trades / NULLIF(h, 0), 0) > 5 OR total_trades > 65""", q=QUAL))
def t1b_qualifying(spark, sf_dir):
    """With ``FEW_TRADES`` as the floor."""
    return qualifying(spark, sf_dir, floor=FEW_TRADES).select("platform", "market_id", "total_trades", rnd(C("time_span_hours")).alias("time_span_hours"), rnd(C("trades_per_hour")).alias("trades_per_hour"))


def flow_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_trades(spark, sf_dir).select("ticker", "trade_id", "created_time", "count", C("yes_price").alias("norm_price"), signed_count().alias("signed_flow"))


def _bars_oracle(width: str) -> dict[str, str]:
    return {
        "f": f"""SELECT ticker, TIME_BUCKET(INTERVAL '{width}', created_time) AS bar_start, ARG_MIN(yes_price, (created_time, trade_id)) AS open, MAX(yes_price) AS high, MIN(yes_price) AS low, ARG_MAX(yes_price, (created_time, trade_id)) AS close,
          CAST(SUM(count) AS BIGINT) AS volume, CAST(SUM(CASE WHEN taker_side = 'yes' THEN count ELSE -count END) AS BIGINT) AS net_flow, COUNT(*) AS trade_count, CAST(SUM(yes_price * count) AS DOUBLE) / SUM(count) AS vwap FROM k_trades GROUP BY 1, 2""",
        "g": f"SELECT ticker, UNNEST(generate_series(MIN(bar_start), MAX(bar_start), INTERVAL '{width}')) AS bar_start FROM f GROUP BY ticker",
        "j": "SELECT g.ticker, g.bar_start, f.open, f.high, f.low, f.close, f.volume, f.net_flow, f.trade_count, f.vwap, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g LEFT JOIN f ON g.ticker = f.ticker AND g.bar_start = f.bar_start",
        "k": "SELECT ticker, bar_start, COALESCE(open, prev) AS open, COALESCE(high, prev) AS high, COALESCE(low, prev) AS low, COALESCE(close, prev) AS close, COALESCE(volume, 0) AS volume, COALESCE(net_flow, 0) AS net_flow, COALESCE(trade_count, 0) AS trade_count, ROUND(vwap, 6) AS vwap FROM j",
    }


def _register_bars(name: str, width: str, interval: str):
    sql = "SELECT *, close - LAG(close) OVER (PARTITION BY ticker ORDER BY bar_start) AS bar_return, high - low AS bar_range FROM k"

    @register(name, oracle(sql, **_bars_oracle(width)))
    def query(spark, sf_dir):
        return gap_filled(bars(flow_trades(spark, sf_dir), width), interval).withColumn("vwap", rnd(C("vwap")))

    return query


t1b_bars_5min = _register_bars("t1b_bars_5min", "5 minutes", "INTERVAL 5 MINUTES")
t1b_bars_1h = _register_bars("t1b_bars_1h", "1 hour", "INTERVAL 1 HOUR")
t1b_bars_1d = _register_bars("t1b_bars_1d", "1 day", "INTERVAL 1 DAY")


_SIZE = "CASE WHEN count <= 1 THEN '1' WHEN count <= 10 THEN '2-10' WHEN count <= 100 THEN '11-100' WHEN count <= 1000 THEN '101-1K' ELSE '1K+' END"
_TTE = "CASE WHEN tte < 3600 THEN '<1h' WHEN tte < 21600 THEN '1-6h' WHEN tte < 86400 THEN '6-24h' WHEN tte < 604800 THEN '1-7d' ELSE '7d+' END"
_CAT = "COALESCE(NULLIF(regexp_extract(event_ticker, '^([A-Z0-9]+)', 1), ''), 'independent')"


@register("t2_impact", oracle(f"""SELECT {_CAT} AS category, {_SIZE} AS size_bucket, {_TTE} AS expiry_bucket, COUNT(*) AS n, ROUND(REGR_SLOPE(delta_price, signed_flow), 6) AS slope, ROUND(REGR_R2(delta_price, signed_flow), 6) AS r2,
  ROUND(AVG(ABS(delta_price)), 6) AS avg_abs_delta, ROUND(AVG(ABS(signed_flow)), 6) AS avg_abs_flow FROM ek WHERE delta_price IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 30 AND VAR_POP(signed_flow) > 0""", ek=EK))
def t2_impact(spark, sf_dir):
    """Price impact: slope and fit of price change on signed flow; groups without variance have none."""
    e = enrich_k(spark, sf_dir).filter("delta_price IS NOT NULL")
    return e.groupBy(category(C("event_ticker")).alias("category"), size_bucket(C("count")).alias("size_bucket"), tte_bucket(C("time_to_expiry_seconds")).alias("expiry_bucket")).agg(
        F.count("*").alias("n"), rnd(F.regr_slope("delta_price", "signed_flow")).alias("slope"), rnd(F.regr_r2("delta_price", "signed_flow")).alias("r2"),
        rnd(F.avg(F.abs("delta_price"))).alias("avg_abs_delta"), rnd(F.avg(F.abs("signed_flow"))).alias("avg_abs_flow"), F.var_pop("signed_flow").alias("_v")).filter("n >= 30 AND _v > 0").drop("_v")


@register("t2_ofi", oracle("""SELECT ticker, trade_id, seq AS trade_sequence_num, signed_flow, CAST(SUM(signed_flow) OVER (w ROWS 19 PRECEDING) AS BIGINT) AS ofi_20, CAST(SUM(signed_flow) OVER (w ROWS 49 PRECEDING) AS BIGINT) AS ofi_50, CAST(SUM(signed_flow) OVER (w ROWS 99 PRECEDING) AS BIGINT) AS ofi_100
  FROM ek WHERE ticker IN (SELECT market_id FROM q WHERE COALESCE(total_trades / NULLIF(h, 0), 0) > 5 OR total_trades > 65) WINDOW w AS (PARTITION BY ticker ORDER BY seq)""", ek=EK, q=QUAL))
def t2_ofi(spark, sf_dir):
    """Order-flow imbalance over trailing trades of qualifying markets (a semi join before the windows)."""
    q = qualifying(spark, sf_dir, floor=FEW_TRADES).select(C("market_id").alias("ticker"))
    w = W.partitionBy("ticker").orderBy("trade_sequence_num")
    return enrich_k(spark, sf_dir).join(q, "ticker", "left_semi").select("ticker", "trade_id", "trade_sequence_num", "signed_flow", *[F.sum("signed_flow").over(w.rowsBetween(1 - n, 0)).alias(f"ofi_{n}") for n in (20, 50, 100)])


@register("t2_vpin", oracle("""SELECT ticker, bucket, buy, sell, vol AS volume, ROUND(SUM(ABS(buy - sell)) OVER w / NULLIF(CAST(SUM(vol) OVER w AS DOUBLE), 0), 6) AS vpin_20 FROM b WINDOW w AS (PARTITION BY ticker ORDER BY bucket ROWS 19 PRECEDING)""", ek=EK,
    b="SELECT ticker, CAST(FLOOR(cumvol / 50.0) AS BIGINT) AS bucket, CAST(SUM(GREATEST(signed_flow, 0)) AS BIGINT) AS buy, CAST(SUM(GREATEST(-signed_flow, 0)) AS BIGINT) AS sell, CAST(SUM(count) AS BIGINT) AS vol FROM ek GROUP BY 1, 2"))
def t2_vpin(spark, sf_dir):
    """Volume-synchronised toxicity over buckets of 50 contracts; a trade is never split."""
    flow = C("signed_flow")
    b = enrich_k(spark, sf_dir).groupBy("ticker", F.floor(C("cumulative_volume") / F.lit(50.0)).alias("bucket")).agg(
        F.sum(F.greatest(flow, F.lit(0))).alias("buy"), F.sum(F.greatest(-flow, F.lit(0))).alias("sell"), F.sum("count").alias("volume"))
    w = W.partitionBy("ticker").orderBy("bucket").rowsBetween(-19, 0)
    return b.select("*", rnd(ratio(F.sum(F.abs(C("buy") - C("sell"))).over(w), F.sum("volume").over(w))).alias("vpin_20"))


_OFI = "CASE WHEN o < -0.6 THEN 1 WHEN o < -0.2 THEN 2 WHEN o < -0.05 THEN 3 WHEN o <= 0.05 THEN 4 WHEN o <= 0.2 THEN 5 WHEN o <= 0.6 THEN 6 ELSE 7 END"


@register("t1a_signal_ofi", oracle(f"""SELECT {_OFI} AS bucket, COUNT(*) AS n, ROUND(AVG(fwd), 6) AS mean, ROUND(STDDEV_SAMP(fwd), 6) AS sd FROM (SELECT CAST(cumflow AS DOUBLE) / NULLIF(cumvol, 0) AS o, LEAD(yes_price) OVER (PARTITION BY ticker ORDER BY seq) - yes_price AS fwd FROM ek WHERE seq >= 5) WHERE fwd IS NOT NULL GROUP BY 1""", ek=EK))
def t1a_signal_ofi(spark, sf_dir):
    """Forward return by flow imbalance; only first trades are dropped, so the next kept trade is the next one."""
    e = enrich_k(spark, sf_dir).filter("trade_sequence_num >= 5").select(ratio(C("cumulative_net_flow"), C("cumulative_volume")).alias("o"), (C("next_price") - C("yes_price")).alias("fwd"))
    o = C("o")
    b = F.when(o < -0.6, 1).when(o < -0.2, 2).when(o < -0.05, 3).when(o <= 0.05, 4).when(o <= 0.2, 5).when(o <= 0.6, 6).otherwise(7)
    return e.filter("fwd IS NOT NULL").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), rnd(F.avg("fwd")).alias("mean"), rnd(F.stddev_samp("fwd")).alias("sd"))


@register("t1a_signal_burst", oracle("""SELECT burst, COUNT(*) AS n, ROUND(AVG(ABS(fwd)), 6) AS mean_abs FROM (SELECT LEAD(yes_price) OVER w - yes_price AS fwd, SUM(CASE WHEN since < 3600 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING) >= 4 AS burst FROM ek WINDOW w AS (PARTITION BY ticker ORDER BY seq)) WHERE fwd IS NOT NULL GROUP BY burst""", ek=EK))
def t1a_signal_burst(spark, sf_dir):
    """Bursts: four of the last five gaps are short (an hour, in the sparse test data)."""
    w = W.partitionBy("ticker").orderBy("trade_sequence_num")
    e = enrich_k(spark, sf_dir).select((C("next_price") - C("yes_price")).alias("fwd"), (F.sum(F.when(C("time_since_prev") < 3600, 1).otherwise(0)).over(w.rowsBetween(-4, 0)) >= 4).alias("burst"))
    return e.filter("fwd IS NOT NULL").groupBy("burst").agg(F.count("*").alias("n"), rnd(F.avg(F.abs("fwd"))).alias("mean_abs"))


@register("t1a_signal_streak", oracle("""SELECT streak, up, COUNT(*) AS n, ROUND(AVG(fwd), 6) AS mean FROM (SELECT CASE WHEN s <> l1 THEN 1 WHEN s <> COALESCE(l2, 0) OR l1 IS NULL THEN 2 WHEN s <> COALESCE(l3, 0) THEN 3 ELSE 4 END AS streak, s > 0 AS up, fwd
  FROM (SELECT s, fwd, LAG(s) OVER w AS l1, LAG(s, 2) OVER w AS l2, LAG(s, 3) OVER w AS l3 FROM (SELECT ticker, seq, SIGN(delta_price) AS s, LEAD(yes_price) OVER (PARTITION BY ticker ORDER BY seq) - yes_price AS fwd FROM ek) WHERE s <> 0 WINDOW w AS (PARTITION BY ticker ORDER BY seq)) WHERE fwd IS NOT NULL) GROUP BY 1, 2""", ek=EK))
def t1a_signal_streak(spark, sf_dir):
    """Length of a run of moves in one direction; a first move counts as two."""
    w = W.partitionBy("ticker").orderBy("trade_sequence_num")
    e = enrich_k(spark, sf_dir).select("ticker", "trade_sequence_num", F.signum("delta_price").alias("s"), (C("next_price") - C("yes_price")).alias("fwd")).filter("s <> 0")
    e = e.select("s", "fwd", *[F.lag("s", k).over(w).alias(f"l{k}") for k in (1, 2, 3)]).filter("fwd IS NOT NULL")
    z = F.lit(0.0)
    streak = F.when(C("s") != C("l1"), 1).when((C("s") != F.coalesce("l2", z)) | C("l1").isNull(), 2).when(C("s") != F.coalesce("l3", z), 3).otherwise(4)
    return e.groupBy(streak.alias("streak"), (C("s") > 0).alias("up")).agg(F.count("*").alias("n"), rnd(F.avg("fwd")).alias("mean"))


@register("t1a_signal_tte", oracle("""SELECT b AS bucket, sig AS signal, COUNT(*) AS n, ROUND(AVG(CASE WHEN sig * fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM (SELECT CASE WHEN tte > 604800 THEN '>7d' WHEN tte > 86400 THEN '1-7d' WHEN tte > 3600 THEN '1-24h' WHEN tte > 600 THEN '10-60m' ELSE '<10m' END AS b,
  CASE WHEN CAST(cumflow AS DOUBLE) / NULLIF(cumvol, 0) > 0.2 THEN 1 WHEN CAST(cumflow AS DOUBLE) / NULLIF(cumvol, 0) < -0.2 THEN -1 ELSE 0 END AS sig, LEAD(yes_price) OVER (PARTITION BY ticker ORDER BY seq) - yes_price AS fwd FROM ek) WHERE fwd IS NOT NULL AND sig <> 0 GROUP BY 1, 2""", ek=EK))
def t1a_signal_tte(spark, sf_dir):
    w = W.partitionBy("ticker").orderBy("trade_sequence_num")
    tte, o = C("time_to_expiry_seconds"), ratio(C("cumulative_net_flow"), C("cumulative_volume"))
    b = F.when(tte > 604800, ">7d").when(tte > 86400, "1-7d").when(tte > 3600, "1-24h").when(tte > 600, "10-60m").otherwise("<10m")
    e = enrich_k(spark, sf_dir).select(b.alias("bucket"), F.when(o > 0.2, 1).when(o < -0.2, -1).otherwise(0).alias("signal"), (C("next_price") - C("yes_price")).alias("fwd"))
    return e.filter("fwd IS NOT NULL AND signal <> 0").groupBy("bucket", "signal").agg(F.count("*").alias("n"), rnd(F.avg(F.when(C("signal") * C("fwd") > 0, 1.0).otherwise(0.0))).alias("hit_rate"))


def _bar_signal(name: str, spark_value, sql_value: str):
    """Forward return of hourly bars with trades by a bar value in five steps of its scale."""
    f = _bars_oracle("1 hour")["f"]

    @register(name, oracle(f"SELECT CAST(LEAST(4, GREATEST(0, FLOOR(v))) AS INTEGER) AS step, COUNT(*) AS n, ROUND(AVG(fwd), 6) AS mean FROM (SELECT {sql_value} AS v, LEAD(close) OVER w - close AS fwd FROM f WINDOW w AS (PARTITION BY ticker ORDER BY bar_start)) WHERE fwd IS NOT NULL AND v IS NOT NULL GROUP BY 1", f=f))
    def query(spark, sf_dir):
        w = W.partitionBy("ticker").orderBy("bar_start")
        b = bars(flow_trades(spark, sf_dir), "1 hour").select(spark_value(w).alias("v"), (F.lead("close").over(w) - C("close")).alias("fwd"))
        step = F.least(F.lit(4), F.greatest(F.lit(0), F.floor("v"))).cast("int")
        return b.filter("fwd IS NOT NULL AND v IS NOT NULL").groupBy(step.alias("step")).agg(F.count("*").alias("n"), rnd(F.avg("fwd")).alias("mean"))

    return query


t1b_signal_flow = _bar_signal("t1b_signal_flow", lambda w: (ratio(C("net_flow"), C("volume")) + 1) * 2.5, "(CAST(net_flow AS DOUBLE) / NULLIF(volume, 0) + 1) * 2.5")
t1b_signal_vwap = _bar_signal("t1b_signal_vwap", lambda w: ratio(rnd(C("close") - C("vwap")), C("high") - C("low")) * 2.5 + 2.5, "ROUND(close - vwap, 6) / NULLIF(CAST(high - low AS DOUBLE), 0) * 2.5 + 2.5")
t1b_signal_surge = _bar_signal("t1b_signal_surge", lambda w: ratio(C("volume"), F.avg("volume").over(w.rowsBetween(-12, -1))), "volume / NULLIF(AVG(volume) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0)")
t1b_signal_range = _bar_signal("t1b_signal_range", lambda w: ratio(C("high") - C("low"), F.avg(C("high") - C("low")).over(w.rowsBetween(-12, -1))), "(high - low) / NULLIF(AVG(high - low) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0)")


# ---- life cycle


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each trade's market: the first rule that holds names it."""
    e = enrich_k(spark, sf_dir)
    six = F.expr("COUNT(*) OVER (PARTITION BY ticker ORDER BY created_time RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW)")
    e = e.withColumn("rate", six / F.lit(6.0)).withColumn("age", seconds_between(C("created_time"), C("open_time")))
    n, price = C("trade_sequence_num"), C("yes_price")
    state = (F.when(C("status") == "finalized", "SETTLED").when(((price > 90) | (price < 10)) & (C("rate") > 2), "RESOLVING").when(C("time_to_expiry_seconds") < 86400, "APPROACHING_EXPIRY")
             .when(C("rate") > 5, "HIGH_ACTIVITY").when((C("rate") >= 1) & (C("cumulative_volume") >= 10), "ACTIVE").when((C("time_since_prev") > 86400) & (n > 5), "DORMANT")
             .when((n <= 5) & (C("age") < 86400), "NEWLY_LISTED").otherwise("EARLY_TRADING"))
    w = W.partitionBy("ticker").orderBy("created_time", "trade_id")
    return e.withColumn("state", state).withColumn("previous", F.lag("state").over(w)).withColumn("stint", F.sum(F.when(C("state").eqNullSafe(C("previous")), 0).otherwise(1)).over(w.rowsBetween(*PAST)))


_TL = dict(ek=EK, tr="SELECT *, COUNT(*) OVER (PARTITION BY ticker ORDER BY created_time RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) / 6.0 AS rate, EPOCH(created_time - open_time) AS age FROM ek",
           ts="""SELECT *, CASE WHEN status = 'finalized' THEN 'SETTLED' WHEN (yes_price > 90 OR yes_price < 10) AND rate > 2 THEN 'RESOLVING' WHEN tte < 86400 THEN 'APPROACHING_EXPIRY' WHEN rate > 5 THEN 'HIGH_ACTIVITY' WHEN rate >= 1 AND cumvol >= 10 THEN 'ACTIVE'
             WHEN since > 86400 AND seq > 5 THEN 'DORMANT' WHEN seq <= 5 AND age < 86400 THEN 'NEWLY_LISTED' ELSE 'EARLY_TRADING' END AS state FROM tr""",
           tp="SELECT *, LAG(state) OVER (PARTITION BY ticker ORDER BY created_time, trade_id) AS previous FROM ts",
           tl="SELECT *, SUM(CASE WHEN state IS NOT DISTINCT FROM previous THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY created_time, trade_id ROWS UNBOUNDED PRECEDING) AS stint FROM tp")


@register("t8_timeline", oracle("SELECT ticker, trade_id, state, previous, CAST(stint AS BIGINT) AS stint, ROUND(CAST(rate AS DOUBLE), 6) AS rate FROM tl", **_TL))
def t8_timeline(spark, sf_dir):
    return timeline(spark, sf_dir).select("ticker", "trade_id", "state", "previous", "stint", rnd(C("rate")).alias("rate"))


@register("t8_state_stats", oracle("SELECT state, COUNT(*) AS n, COUNT(DISTINCT ticker) AS markets, ROUND(AVG(ABS(delta_price)), 6) AS avg_move, ROUND(STDDEV_SAMP(delta_price), 6) AS sd, ROUND(AVG(count), 6) AS avg_size FROM tl GROUP BY state", **_TL))
def t8_state_stats(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("markets"), rnd(F.avg(F.abs("delta_price"))).alias("avg_move"), rnd(F.stddev_samp("delta_price")).alias("sd"), rnd(F.avg("count")).alias("avg_size"))


#: Transitions that should not happen, and their names.
ODD = {("EARLY_TRADING", "RESOLVING"): "information_event", ("NEWLY_LISTED", "HIGH_ACTIVITY"): "bot_or_manipulation",
       ("DORMANT", "RESOLVING"): "sudden_resolution", ("ACTIVE", "NEWLY_LISTED"): "impossible_regression"}
_ODD = "CASE " + " ".join(f"WHEN previous = '{a}' AND state = '{b}' THEN '{n}'" for (a, b), n in ODD.items()) + " END"


def odd_transition():
    out = F.lit(None).cast("string")
    for (a, b), name in ODD.items():
        out = F.when((C("previous") == a) & (C("state") == b), name).otherwise(out)
    return out


@register("t8_anomalies", oracle(f"SELECT ticker, created_time, previous AS from_state, state AS to_state, norm_price, seq AS trade_sequence_num, {_ODD} AS transition_type FROM tl WHERE {_ODD} IS NOT NULL", **_TL))
def t8_anomalies(spark, sf_dir):
    t = timeline(spark, sf_dir).withColumn("transition_type", odd_transition()).filter("transition_type IS NOT NULL")
    return t.select("ticker", "created_time", C("previous").alias("from_state"), C("state").alias("to_state"), "norm_price", "trade_sequence_num", "transition_type")


@register("t8_transitions", oracle(f"SELECT previous AS from_state, state AS to_state, {_ODD} AS transition_type, COUNT(*) AS n, COUNT(DISTINCT ticker) AS markets FROM tl WHERE previous <> state GROUP BY 1, 2, 3", **_TL))
def t8_transitions(spark, sf_dir):
    """All changes of state, the odd ones named."""
    t = timeline(spark, sf_dir).filter("previous != state")
    return t.groupBy(C("previous").alias("from_state"), C("state").alias("to_state"), odd_transition().alias("transition_type")).agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("markets"))


@register("t8_durations", oracle("""SELECT state, COUNT(*) AS stints, ROUND(AVG(h), 6) AS mean, ROUND(QUANTILE_CONT(h, 0.25), 6) AS p25, ROUND(QUANTILE_CONT(h, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(h, 0.75), 6) AS p75 FROM (SELECT ticker, stint, state, EPOCH(MAX(created_time) - MIN(created_time)) / 3600.0 AS h FROM tl GROUP BY 1, 2, 3) GROUP BY state""", **_TL))
def t8_durations(spark, sf_dir):
    """Gaps and islands: the length of each stay in a state."""
    s = timeline(spark, sf_dir).groupBy("ticker", "stint", "state").agg((seconds_between(F.max("created_time"), F.min("created_time")) / F.lit(3600.0)).alias("h"))
    q = lambda p: rnd(F.percentile("h", F.lit(p)))
    return s.groupBy("state").agg(F.count("*").alias("stints"), rnd(F.avg("h")).alias("mean"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))
