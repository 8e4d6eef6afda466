"""Implied distributions of threshold events, lead-lag and dependence of paired markets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.functions import d, rnd
from pmx.operators.timegrid import bars
from pmx.plans.categories import threshold_of
from pmx.plans.enrichment import _bars_oracle, flow_trades
from pmx.registry import register
from pmx.stats import cross_correlation_peak, fit_survival, granger, isotonic_falling
from pmx.views import k_markets, k_trades, oracle

C = F.col


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with three thresholds or more and more than one price: (event_ticker, threshold, price, result)."""
    m = k_markets(spark, sf_dir).withColumn("t", threshold_of(C("ticker"))).filter("t IS NOT NULL")
    one = m.groupBy("event_ticker", "t").agg(F.max("last_price").alias("price"), F.max("result").alias("result"))
    ok = one.groupBy("event_ticker").agg(F.count("*").alias("k"), F.count_distinct("price").alias("p")).filter("k >= 3 AND p > 1").select("event_ticker")
    return one.join(ok, "event_ticker", "left_semi").select("event_ticker", C("t").alias("threshold"), "price", "result")


_STRIKES = """SELECT event_ticker, threshold, price, result FROM (SELECT *, COUNT(*) OVER (PARTITION BY event_ticker) AS k, MIN(price) OVER (PARTITION BY event_ticker) AS lo, MAX(price) OVER (PARTITION BY event_ticker) AS hi FROM (
  SELECT event_ticker, TRY_CAST(NULLIF(regexp_extract(ticker, '-T(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS threshold, MAX(last_price) AS price, MAX(result) AS result FROM k_markets GROUP BY 1, 2) WHERE threshold IS NOT NULL) WHERE k >= 3 AND lo < hi"""


@register("t4_surface_summary", oracle("""SELECT event_ticker, COUNT(*) AS strikes, ROUND(MIN(threshold), 3) AS low, ROUND(MAX(threshold), 3) AS high, ROUND(CASE WHEN MAX(threshold) FILTER (result = 'yes') IS NULL THEN MIN(threshold) FILTER (result = 'no') WHEN MIN(threshold) FILTER (result = 'no') IS NULL THEN MAX(threshold) FILTER (result = 'yes')
  ELSE (MAX(threshold) FILTER (result = 'yes') + MIN(threshold) FILTER (result = 'no')) / 2 END, 3) AS actual FROM s GROUP BY event_ticker""", s=_STRIKES))
def t4_surface_summary(spark, sf_dir):
    """Range of an event's thresholds, and where it settled: between the highest YES and the lowest NO."""
    y, n = F.max(F.when(C("result") == "yes", C("threshold"))), F.min(F.when(C("result") == "no", C("threshold")))
    actual = F.when(y.isNull(), n).when(n.isNull(), y).otherwise((y + n) / 2)
    return strikes(spark, sf_dir).groupBy("event_ticker").agg(F.count("*").alias("strikes"), rnd(F.min("threshold"), 3).alias("low"), rnd(F.max("threshold"), 3).alias("high"), rnd(actual, 3).alias("actual"))


def _curve(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("threshold")
    s = np.clip(isotonic_falling(g["price"].to_numpy() / 100.0), 0, 1)
    return pd.DataFrame({"event_ticker": g["event_ticker"], "threshold": g["threshold"], "raw": g["price"] / 100.0, "survival": s, "density": np.append(s[:-1] - s[1:], s[-1:])})


@register("t4_pava")
def t4_pava(spark, sf_dir):
    """Survival curves made non-increasing, and their differences; a group has an event's thresholds."""
    return strikes(spark, sf_dir).groupBy("event_ticker").applyInPandas(_curve, "event_ticker string, threshold double, raw double, survival double, density double")


def _fit(g: pd.DataFrame) -> pd.DataFrame:
    c = _curve(g)
    rows = []
    for kind in ("normal", "lognormal"):
        f = fit_survival(c["threshold"].to_numpy(), c["survival"].to_numpy(), kind)
        if f:
            rows.append((c["event_ticker"].iloc[0], kind, f["mu"], f["sigma"], f["ks"]))
    return pd.DataFrame(rows, columns=["event_ticker", "kind", "mu", "sigma", "ks"])


@register("t4_fits")
def t4_fits(spark, sf_dir):
    """Normal and lognormal fits with their largest gap; best marks the closer one."""
    f = strikes(spark, sf_dir).groupBy("event_ticker").applyInPandas(_fit, "event_ticker string, kind string, mu double, sigma double, ks double")
    return f.withColumn("best", C("ks") == F.min("ks").over(W.partitionBy("event_ticker")))


def surface_evolution(spark: SparkSession, sf_dir: str, coverage: float = 0.7) -> DataFrame:
    """Mean, spread, skew and kurtosis of an event's implied distribution at the end of each day on which ``coverage`` of its strikes have traded."""
    s = strikes(spark, sf_dir).select("event_ticker", "threshold")
    t = k_trades(spark, sf_dir).withColumn("threshold", threshold_of(C("ticker"))).withColumn("day", C("created_time").cast("date"))
    last = t.join(k_markets(spark, sf_dir).select("ticker", "event_ticker"), "ticker").groupBy("event_ticker", "threshold", "day").agg(F.max_by("yes_price", F.struct("created_time", "trade_id")).alias("price"))
    days = last.select("event_ticker", "day").distinct()
    w = W.partitionBy("event_ticker", "threshold").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    grid = s.join(days, "event_ticker").join(last, ["event_ticker", "threshold", "day"], "left").withColumn("price", F.last("price", ignorenulls=True).over(w))
    known = F.count("price").over(W.partitionBy("event_ticker", "day"))
    total = F.count("*").over(W.partitionBy("event_ticker", "day"))
    grid = grid.withColumn("known", known).withColumn("total", total).filter((C("known") >= 3) & (C("known") >= coverage * C("total")) & C("price").isNotNull())

    def one(g: pd.DataFrame) -> pd.DataFrame:
        c = _curve(g)
        x, p = c["threshold"].to_numpy(), c["density"].to_numpy()
        p = p / p.sum() if p.sum() > 0 else np.full(len(p), 1 / len(p))
        mean = float((x * p).sum())
        sd = float(np.sqrt(((x - mean) ** 2 * p).sum()))
        skew, kurtosis = (float((((x - mean) / sd) ** k * p).sum()) if sd > 0 else 0.0 for k in (3, 4))
        return pd.DataFrame({"event_ticker": [c["event_ticker"].iloc[0]], "day": [g["day"].iloc[0]], "strikes": [len(c)], "mean": [mean], "sd": [sd], "skew": [skew], "kurtosis": [kurtosis - 3 if sd > 0 else 0.0]})

    return grid.groupBy("event_ticker", "day").applyInPandas(one, "event_ticker string, day date, strikes long, mean double, sd double, skew double, kurtosis double")


@register("t4_evolution")
def t4_evolution(spark, sf_dir):
    """With a coverage of 10 %, for the test markets trade seldom."""
    return surface_evolution(spark, sf_dir, 0.1)


# ---- pairs


def pairs(spark: SparkSession, sf_dir: str, per_family: int = 4) -> DataFrame:
    """Pairs of the most traded tickers of a family (the event's first part)."""
    n = k_trades(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n")).withColumn("family", F.split_part("ticker", F.lit("-"), F.lit(1)))
    top = n.withColumn("rank", F.row_number().over(W.partitionBy("family").orderBy(F.desc("n"), "ticker"))).filter(C("rank") <= per_family)
    a, b = (top.select("family", C("ticker").alias(s), C("rank").alias(f"r{s}")) for s in "ab")
    return a.join(b, "family").filter("ra < rb").select("family", "a", "b")


_PAIRS = """SELECT x.family, x.ticker AS a, y.ticker AS b FROM tops x JOIN tops y ON x.family = y.family AND x.rank < y.rank"""
_TOP = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY family ORDER BY n DESC, ticker) AS rank FROM (SELECT ticker, split_part(ticker, '-', 1) AS family, COUNT(*) AS n FROM k_trades GROUP BY 1, 2)) WHERE rank <= 4"""


@register("t5_pairs", oracle(_PAIRS, tops=_TOP))
def t5_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the close from one traded hour to the next, per ticker and hour (number of hours since 2024)."""
    w = W.partitionBy("ticker").orderBy("bar_start")
    b = bars(flow_trades(spark, sf_dir), "1 hour").withColumn("r", C("close") - F.lag("close").over(w)).filter("r IS NOT NULL")
    hour = F.timestamp_diff("HOUR", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), C("bar_start"))
    return b.select("ticker", hour.alias("h"), d("r").alias("r"))


_RET = """SELECT ticker, DATEDIFF('hour', TIMESTAMP '2024-01-01', bar_start) AS h, CAST(r AS DOUBLE) AS r FROM (SELECT ticker, bar_start, close - LAG(close) OVER (PARTITION BY ticker ORDER BY bar_start) AS r FROM f) WHERE r IS NOT NULL"""


@register("t5_xcorr", oracle("""SELECT p.a, p.b, CAST(l.lag AS INTEGER) AS lag, ROUND(COALESCE(SUM(x.r * y.r), 0) / SQRT(ANY_VALUE(na.s) * ANY_VALUE(nb.s)), 6) AS corr FROM prs p CROSS JOIN (SELECT UNNEST(range(-12, 13)) AS lag) l JOIN nrm na ON na.ticker = p.a JOIN nrm nb ON nb.ticker = p.b
  JOIN rts x ON x.ticker = p.a JOIN rts y ON y.ticker = p.b AND y.h = x.h - l.lag GROUP BY 1, 2, 3""", f=_bars_oracle("1 hour")["f"], rts=_RET, nrm="SELECT ticker, SUM(r * r) AS s FROM rts GROUP BY 1", tops=_TOP, prs=_PAIRS))
def t5_xcorr(spark, sf_dir):
    """Cross-correlation of hourly changes at lags of 12 hours either way (parity sign), hours without a change being 0.

    Only hours in which both changed add to a lag's product, so the lags are an equi-join of the sparse series.
    """
    r = returns(spark, sf_dir)
    norm = r.groupBy("ticker").agg(F.sum(C("r") * C("r")).alias("s"))
    x, y = r.select(C("ticker").alias("a"), C("h").alias("ha"), C("r").alias("ra")), r.select(C("ticker").alias("b"), C("h").alias("hb"), C("r").alias("rb"))
    p = pairs(spark, sf_dir).select("a", "b").withColumn("lag", F.explode(F.sequence(F.lit(-12), F.lit(12))))
    j = p.join(x, "a").withColumn("hb", C("ha") - C("lag")).join(y, ["b", "hb"]).groupBy("a", "b", "lag").agg(F.sum(C("ra") * C("rb")).alias("v"))
    n = lambda c: norm.select(C("ticker").alias(c), C("s").alias(f"s{c}"))
    return j.join(n("a"), "a").join(n("b"), "b").select("a", "b", "lag", rnd(C("v") / F.sqrt(C("sa") * C("sb"))).alias("corr"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which either of a pair changed, with both changes (0 where there is none)."""
    r, p = returns(spark, sf_dir), pairs(spark, sf_dir).select("a", "b")
    x = p.join(r.withColumnRenamed("ticker", "a"), "a").select("a", "b", "h", C("r").alias("ra"))
    y = p.join(r.withColumnRenamed("ticker", "b"), "b").select("a", "b", "h", C("r").alias("rb"))
    return x.join(y, ["a", "b", "h"], "full_outer").select("a", "b", "h", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ra", "rb")])


@register("t5_lead_lag")
def t5_lead_lag(spark, sf_dir):
    """Peak lag, its correlation and the Granger test (lags 1 to 12) in the peak's direction; a group is one pair's hours."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("h")
        a, b = g["ra"].to_numpy(), g["rb"].to_numpy()
        lag, c = cross_correlation_peak(a, b)
        p, at = granger(a, b) if lag >= 0 else granger(b, a)
        return pd.DataFrame({"a": [g["a"].iloc[0]], "b": [g["b"].iloc[0]], "hours": [len(g)], "peak_lag": [lag], "peak": [c], "granger_p": [p], "granger_lag": [at]})

    return aligned(spark, sf_dir).groupBy("a", "b").applyInPandas(one, "a string, b string, hours long, peak_lag long, peak double, granger_p double, granger_lag long")


_AL = """SELECT COALESCE(x.a, y.a) AS a, COALESCE(x.b, y.b) AS b, COALESCE(x.h, y.h) AS h, COALESCE(x.r, 0) AS ra, COALESCE(y.r, 0) AS rb FROM (SELECT p.a, p.b, h, r FROM prs p JOIN rts ON rts.ticker = p.a) x FULL OUTER JOIN (SELECT p.a, p.b, h, r FROM prs p JOIN rts ON rts.ticker = p.b) y ON x.a = y.a AND x.b = y.b AND x.h = y.h"""
_DEP = dict(f=_bars_oracle("1 hour")["f"], rts=_RET, tops=_TOP, prs=_PAIRS, al=_AL)


@register("t9c_corr", oracle("SELECT a, b, COUNT(*) AS n, ROUND(CORR(ra, rb), 6) AS pearson FROM al GROUP BY 1, 2", **_DEP))
def t9c_corr(spark, sf_dir):
    return aligned(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n"), rnd(F.corr("ra", "rb")).alias("pearson"))


def _middle_rank(value: str, by: list[str]) -> Column:
    """Middle ranks need the counts of values only: those before, and half of the equal ones."""
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return F.sum("n").over(w) - (C("n") - 1) / F.lit(2.0)


@register("t9c_spearman", oracle("""SELECT a, b, COUNT(*) AS n, ROUND(CORR(x, y), 6) AS spearman FROM (SELECT a, b, RANK() OVER (PARTITION BY a, b ORDER BY ra) + (COUNT(*) OVER (PARTITION BY a, b, ra) - 1) / 2.0::DOUBLE AS x, RANK() OVER (PARTITION BY a, b ORDER BY rb) + (COUNT(*) OVER (PARTITION BY a, b, rb) - 1) / 2.0::DOUBLE AS y FROM al) GROUP BY 1, 2""", **_DEP))
def t9c_spearman(spark, sf_dir):
    """Rank correlation of a pair's changes: equal changes share their middle rank, found from counts of values."""
    x = aligned(spark, sf_dir)
    for v, r in (("ra", "x"), ("rb", "y")):
        ranks = x.groupBy("a", "b", v).agg(F.count("*").alias("n")).withColumn(r, _middle_rank(v, ["a", "b"])).select("a", "b", v, r)
        x = x.join(ranks, ["a", "b", v])
    return x.groupBy("a", "b").agg(F.count("*").alias("n"), rnd(F.corr("x", "y")).alias("spearman"))


@register("t9c_tail", oracle("""SELECT al.a, al.b, ROUND(AVG(CASE WHEN rb >= q.bu THEN 1.0 ELSE 0.0 END) FILTER (ra >= q.au), 6) AS upper, ROUND(AVG(CASE WHEN rb <= q.bl THEN 1.0 ELSE 0.0 END) FILTER (ra <= q.al), 6) AS lower FROM al JOIN q ON al.a = q.a AND al.b = q.b GROUP BY 1, 2""",
    **_DEP, q="SELECT a, b, QUANTILE_CONT(ra, 0.95) AS au, QUANTILE_CONT(rb, 0.95) AS bu, QUANTILE_CONT(ra, 0.05) AS al, QUANTILE_CONT(rb, 0.05) AS bl FROM al GROUP BY 1, 2"))
def t9c_tail(spark, sf_dir):
    """Chance that b is in its tail when a is: upper and lower twentieth."""
    x = aligned(spark, sf_dir)
    q = lambda c, p: F.percentile(c, F.lit(p))
    cut = x.groupBy("a", "b").agg(q("ra", 0.95).alias("au"), q("rb", 0.95).alias("bu"), q("ra", 0.05).alias("al"), q("rb", 0.05).alias("bl"))
    hit = lambda c: F.when(c, 1.0).otherwise(0.0)
    return x.join(cut, ["a", "b"]).groupBy("a", "b").agg(rnd(F.avg(F.when(C("ra") >= C("au"), hit(C("rb") >= C("bu"))))).alias("upper"), rnd(F.avg(F.when(C("ra") <= C("al"), hit(C("rb") <= C("bl"))))).alias("lower"))
