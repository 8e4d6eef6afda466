"""Samples, budgets, smoothing and identifier choices."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.functions import d, excess, rnd
from pmx.operators.positions import positions
from pmx.plans.enrichment import FEW_TRADES, _bars_oracle, qualifying
from pmx.plans.prices import resolved
from pmx.plans.surfaces import _PAIRS, _RET, _TOP, pairs, returns
from pmx.registry import register
from pmx.views import k_markets, k_trades, oracle

C = F.col


@register("yes_bias_smoothed", oracle("""SELECT price, ROUND(bias, 6) AS bias, ROUND(smooth, 6) AS smooth FROM (SELECT price, bias, AVG(bias) OVER w AS smooth, COUNT(*) OVER w AS k FROM b WINDOW w AS (ORDER BY price ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE k = 5""",
    b="SELECT price, AVG(won - price / 100.0) FILTER (side = 'yes') - AVG(won - price / 100.0) FILTER (side = 'no') AS bias FROM pos WHERE role = 'taker' GROUP BY price HAVING COUNT(DISTINCT side) = 2"))
def yes_bias_smoothed(spark, sf_dir):
    """The gap of YES and NO takers by price, with a mean over five prices where all five are there."""
    x = excess(C("won"), C("price"))
    side = lambda s: F.avg(F.when(C("side") == s, x))
    b = positions(resolved(spark, sf_dir)).filter("role = 'taker'").groupBy("price").agg((side("yes") - side("no")).alias("bias")).filter("bias IS NOT NULL")
    w = W.partitionBy(F.lit(0)).orderBy("price").rowsBetween(-2, 2)  # a hundred rows
    return b.select("price", "bias", F.avg("bias").over(w).alias("s"), F.count("*").over(w).alias("k")).filter("k = 5").select("price", rnd(C("bias")).alias("bias"), rnd(C("s")).alias("smooth"))


@register("every_hundredth_trade", oracle("SELECT ticker, trade_id, CAST(n AS BIGINT) AS n FROM (SELECT ticker, trade_id, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY created_time, trade_id) AS n FROM k_trades) WHERE n % 100 = 1"))
def every_hundredth_trade(spark, sf_dir):
    """Every hundredth row of each ticker's order."""
    w = W.partitionBy("ticker").orderBy("created_time", "trade_id")
    return k_trades(spark, sf_dir).select("ticker", "trade_id", F.row_number().over(w).cast("long").alias("n")).filter("n % 100 = 1")


@register("hash_sample", oracle("SELECT trade_id, ticker, SUBSTR(sha256('42:' || CAST(trade_id AS VARCHAR)), 1, 16) AS h FROM k_trades ORDER BY h, trade_id LIMIT 500"))
def hash_sample(spark, sf_dir, rows: int = 500, seed: int = 42):
    """A repeatable sample: the rows with the smallest hashes, by a hash that other engines have too."""
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), C("trade_id").cast("string")), 256), 1, 16)
    return k_trades(spark, sf_dir).select("trade_id", "ticker", h.alias("h")).orderBy("h", "trade_id").limit(rows)


@register("budgeted_markets", oracle("""SELECT ticker, stratum, volume FROM (SELECT ticker, 'open' AS stratum, volume FROM k_markets WHERE status = 'open' ORDER BY volume DESC, ticker LIMIT 20) UNION ALL SELECT * FROM (SELECT ticker, 'finalized' AS stratum, volume FROM k_markets WHERE status <> 'open' ORDER BY volume DESC, ticker LIMIT 30)"""))
def budgeted_markets(spark, sf_dir, budget: int = 50, first: int = 20):
    """A budget over two strata: the largest open markets, then the largest others."""
    m = k_markets(spark, sf_dir)
    top = lambda test, name, n: m.filter(test).select("ticker", F.lit(name).alias("stratum"), "volume").orderBy(F.desc("volume"), "ticker").limit(n)
    return top("status = 'open'", "open", first).unionByName(top("status != 'open'", "finalized", budget - first))


@register("event_tickers", oracle("""SELECT event_ticker, ARG_MAX(t.ticker, (n, t.ticker)) AS ticker, MAX(n) AS trades FROM (SELECT ticker, COUNT(*) AS n FROM k_trades GROUP BY 1) t JOIN k_markets m ON t.ticker = m.ticker WHERE t.ticker IN (SELECT market_id FROM q WHERE COALESCE(total_trades / NULLIF(h, 0), 0) > 5 OR total_trades > 65) GROUP BY 1""",
    q="SELECT ticker AS market_id, COUNT(*) AS total_trades, EPOCH(MAX(created_time) - MIN(created_time)) / 3600.0 AS h FROM k_trades GROUP BY 1"))
def event_tickers(spark, sf_dir):
    """The most traded qualifying market of each event."""
    q = qualifying(spark, sf_dir, floor=FEW_TRADES).select(C("market_id").alias("ticker"), C("total_trades").alias("n"))
    j = q.join(k_markets(spark, sf_dir).select("ticker", "event_ticker"), "ticker")
    return j.groupBy("event_ticker").agg(F.max_by("ticker", F.struct("n", "ticker")).alias("ticker"), F.max("n").alias("trades"))


#: Bars of a rolling window; windows overlap by half.
BARS = 288
_HALF = BARS // 2


_SIGNS = ", ".join(f"AVG(CASE WHEN lag {x} 0 THEN 1.0 ELSE 0.0 END)" for x in "><=")


@register("rolling_xcorr", oracle(f"""SELECT a, b, COUNT(*) AS windows, ROUND(AVG(lag), 6) AS mean_lag, ROUND(STDDEV_POP(lag), 6) AS sd, ROUND(GREATEST({_SIGNS}), 6) AS same_sign FROM (
  SELECT q.a, q.b, q.w, ARG_MIN(q.lag, (-ROUND(ABS(q.v) / SQRT(x.s * y.s), 9), q.lag)) AS lag FROM (
    SELECT a, b, lag, w, SUM(xy) AS v FROM (
      SELECT p.a, p.b, l.lag, UNNEST(range(GREATEST(x.h // {_HALF}, y.h // {_HALF}) - 1, LEAST(x.h // {_HALF}, y.h // {_HALF}) + 1)) AS w, x.r * y.r AS xy
      FROM prs p CROSS JOIN (SELECT UNNEST(range(-12, 13)) AS lag) l JOIN rts x ON x.ticker = p.a JOIN rts y ON y.ticker = p.b AND y.h = x.h - l.lag) GROUP BY 1, 2, 3, 4) q
    JOIN nw x ON x.ticker = q.a AND x.w = q.w JOIN nw y ON y.ticker = q.b AND y.w = q.w GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    f=_bars_oracle("1 hour")["f"], rts=_RET, tops=_TOP, prs=_PAIRS, nw=f"SELECT ticker, UNNEST([h // {_HALF} - 1, h // {_HALF}]) AS w, SUM(r * r) AS s FROM rts GROUP BY 1, 2"))
def rolling_xcorr(spark, sf_dir):
    """Peak lags of cross-correlation over windows of 288 hours, half overlapping: their mean, spread and how often the sign agrees.

    Products of changes are summed once for each half window, and a window is two halves: a product counts where both of its hours are in. A pair's windows
    cost no more than its products, and no group holds a pair's series.
    """
    r = returns(spark, sf_dir).withColumn("k", F.floor(C("h") / _HALF))
    norm = r.select("ticker", F.explode(F.array(C("k") - 1, C("k"))).alias("w"), (C("r") * C("r")).alias("s")).groupBy("ticker", "w").agg(F.sum("s").alias("s"))
    side = lambda s: r.select(C("ticker").alias(s), *[C(c).alias(f"{c}{s}") for c in "hrk"])
    p = pairs(spark, sf_dir).select("a", "b").withColumn("lag", F.explode(F.sequence(F.lit(-12), F.lit(12))))
    j = p.join(side("a"), "a").withColumn("hb", C("ha") - C("lag")).join(side("b"), ["b", "hb"])
    v = j.select("a", "b", "lag", F.explode(F.sequence(F.greatest("ka", "kb") - 1, F.least("ka", "kb"))).alias("w"), (C("ra") * C("rb")).alias("v")).groupBy("a", "b", "lag", "w").agg(F.sum("v").alias("v"))
    of = lambda s: norm.select(C("ticker").alias(s), "w", C("s").alias(f"s{s}"))
    peak = F.min_by("lag", F.struct(-F.round(F.abs("v") / F.sqrt(C("sa") * C("sb")), 9), C("lag"))).alias("lag")
    best = v.join(of("a"), ["a", "w"]).join(of("b"), ["b", "w"]).groupBy("a", "b", "w").agg(peak)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return best.groupBy("a", "b").agg(F.count("*").alias("windows"), rnd(F.avg("lag")).alias("mean_lag"), rnd(F.stddev_pop("lag")).alias("sd"), rnd(F.greatest(share(C("lag") > 0), share(C("lag") < 0), share(C("lag") == 0))).alias("same_sign"))


@register("price_correlation", oracle("SELECT role, ROUND(CORR(price, won), 6) AS pearson, COUNT(*) AS n FROM pos GROUP BY role"))
def price_correlation(spark, sf_dir):
    return positions(resolved(spark, sf_dir)).groupBy("role").agg(rnd(F.corr(d("price"), d("won"))).alias("pearson"), F.count("*").alias("n"))
