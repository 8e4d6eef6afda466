"""Hold-to-resolution backtests: strategies, payoffs, metrics, sweeps, equity, sizing and bootstraps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.functions import category, cent_bucket, d, fee, ratio, rnd, seconds_between, tte_bucket
from pmx.operators.distributions import fit_student, kolmogorov, shapiro_sample, student_cdf, value_counts
from pmx.operators.graph import checkpointed
from pmx.operators.prefix import running_total
from pmx.plans.prices import resolved
from pmx.registry import register
from pmx.views import oracle

C = F.col
CAT = "COALESCE(NULLIF(regexp_extract(event_ticker, '^([A-Z0-9]+)', 1), ''), 'independent')"
TTE = "CASE WHEN tte < 3600 THEN '<1h' WHEN tte < 21600 THEN '1-6h' WHEN tte < 86400 THEN '6-24h' WHEN tte < 604800 THEN '1-7d' ELSE '7d+' END"


@dataclass(frozen=True)
class Strategy:
    """What to take, when, at what fee; ``where`` and ``prepare`` are plan builders, not text."""

    name: str
    side: str  # yes, no, taker or maker
    where: Callable[[], Column]
    prepare: Callable[[DataFrame, SparkSession, str], DataFrame] = field(default=lambda df, spark, sf_dir: df)
    fee: Callable[[Column], Column] = fee


def fade_longshot(max_price: int, min_tte: int = 0, categories: list[str] | None = None) -> Strategy:
    """Take NO against YES takers under a price."""

    def where() -> Column:
        test = (C("taker_side") == "yes") & (C("entry_price") < max_price) & (C("time_to_expiry_s") >= min_tte)
        return test & category(C("event_ticker")).isin(categories) if categories else test

    return Strategy(f"fade_{max_price}", "no", where)


def calibration_surface(edge_pp: float = 5.0, lag_days: int = 7, max_price: int = 100) -> Strategy:
    """Take NO where YES takers of the same cell were overpriced ``lag_days`` ago by ``edge_pp`` or more."""

    def prepare(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = surface(spark, sf_dir, lag_days)
        day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
        keyed = df.select("*", category(C("event_ticker")).alias("category"), cent_bucket(C("entry_price"), 10).alias("price_bucket"), tte_bucket(C("time_to_expiry_s")).alias("tte_bucket"), day.alias("day"))
        return keyed.join(cells, ["category", "price_bucket", "tte_bucket", "taker_side", "day"])

    return Strategy("cal_surface", "no", lambda: (C("taker_side") == "yes") & (C("edge_pp") >= edge_pp) & (C("entry_price") < max_price), prepare)


def surface(spark: SparkSession, sf_dir: str, lag_days: int) -> DataFrame:
    """Each cell's overpricing on a day, to be used ``lag_days`` later."""
    t = resolved_for_backtest(spark, sf_dir)
    day = (F.date_trunc("day", "timestamp") + F.make_dt_interval(F.lit(lag_days))).cast("timestamp_ntz")
    return t.groupBy(category(C("event_ticker")).alias("category"), cent_bucket(C("entry_price"), 10).alias("price_bucket"), tte_bucket(C("time_to_expiry_s")).alias("tte_bucket"), "taker_side", day.alias("day")).agg(
        rnd(F.avg(d("entry_price")) - F.avg(d("taker_won") * 100)).alias("edge_pp"))


def resolved_for_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical input: one row a resolved trade."""
    return resolved(spark, sf_dir).select(
        "trade_id", C("ticker").alias("market_id"), F.lit("k").alias("platform"), "taker_side", "result", "event_ticker", C("created_time").alias("timestamp"), C("tp").alias("entry_price"),
        C("mp").alias("maker_entry"), C("tw").alias("taker_won"), C("count").alias("contracts"), seconds_between(C("close_time"), C("created_time")).alias("time_to_expiry_s"))


def payoff(side: str, fee_of: Callable[[Column], Column]) -> list[Column]:
    """won, gross and net cents of a contract, and its cost; NO is taken against the taker's price."""
    p, m = d("entry_price"), d("maker_entry")
    won, cost = {"yes": (C("result") == "yes", p), "no": (C("result") == "no", F.lit(100.0) - p), "taker": (C("taker_won") == 1, p), "maker": (C("taker_won") == 0, m)}[side]
    gross = F.when(won, F.lit(100.0) - cost).otherwise(-cost)
    return [won.alias("won"), gross.alias("gross"), fee_of(p).alias("fee"), (gross - fee_of(p)).alias("net"), cost.alias("cost")]


def run(strategy: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy's trades with their payoffs."""
    t = strategy.prepare(resolved_for_backtest(spark, sf_dir), spark, sf_dir)
    return t.filter(strategy.where()).select("trade_id", "market_id", "timestamp", "entry_price", "contracts", *payoff(strategy.side, strategy.fee), F.lit(strategy.name).alias("strategy"))


_FEE = "LEAST(LEAST(tp, 100 - tp) * CAST(0.07 AS DOUBLE), 3.0)"
_RUN = f"""SELECT trade_id, ticker AS market_id, created_time AS timestamp, tp AS entry_price, count AS contracts, result = 'no' AS won, CAST(CASE WHEN result = 'no' THEN tp ELSE tp - 100 END AS DOUBLE) AS gross, {_FEE} AS fee, CASE WHEN result = 'no' THEN tp ELSE tp - 100 END - {_FEE} AS net, CAST(100 - tp AS DOUBLE) AS cost FROM rt WHERE taker_side = 'yes' AND EPOCH(close_time - created_time) >= 0"""
_OUT = "SELECT trade_id, market_id, entry_price, contracts, won, ROUND(gross, 6) AS gross, ROUND(fee, 6) AS fee, ROUND(net, 6) AS net FROM r"


def _show(df: DataFrame) -> DataFrame:
    return df.select("trade_id", "market_id", "entry_price", "contracts", "won", *[rnd(C(c)).alias(c) for c in ("gross", "fee", "net")])


for _p in (5, 10, 15, 20):
    register(f"bt_fade_{_p}", oracle(_OUT + f" WHERE entry_price < {_p}", r=_RUN))(lambda spark, sf_dir, p=_p: _show(run(fade_longshot(p), spark, sf_dir)))

_SURFACE = f"""SELECT category, price_bucket, tte_bucket, taker_side, DATE_TRUNC('day', created_time) + INTERVAL 7 DAYS AS day, ROUND(AVG(tp) - AVG(tw * 100.0), 6) AS edge_pp FROM k GROUP BY ALL"""
_KEYED = f"SELECT *, {CAT} AS category, CAST(FLOOR(tp / 10.0) * 10 AS INTEGER) AS price_bucket, {TTE} AS tte_bucket FROM (SELECT *, EPOCH(close_time - created_time) AS tte FROM rt)"


@register("bt_cal_surface", oracle("""SELECT k.trade_id, k.ticker AS market_id, k.tp AS entry_price, k.count AS contracts, result = 'no' AS won, ROUND(CAST(CASE WHEN result = 'no' THEN tp ELSE tp - 100 END AS DOUBLE), 6) AS gross, ROUND(%s, 6) AS fee, ROUND(CASE WHEN result = 'no' THEN tp ELSE tp - 100 END - %s, 6) AS net FROM k JOIN s
  ON k.category = s.category AND k.price_bucket = s.price_bucket AND k.tte_bucket = s.tte_bucket AND k.taker_side = s.taker_side AND DATE_TRUNC('day', k.created_time) = s.day WHERE k.taker_side = 'yes' AND edge_pp >= 5 AND tp < 100""" % (_FEE, _FEE), k=_KEYED, s=_SURFACE))
def bt_cal_surface(spark, sf_dir):
    return _show(run(calibration_surface(), spark, sf_dir))


def metrics(r: DataFrame, *keys) -> DataFrame:
    """Trades, win rate, mean, Sharpe and Sortino per trade (population deviation); PnL, fees and profit factor by contracts."""
    net, n = C("net"), C("contracts")
    down = F.sqrt(F.avg(F.when(net < 0, net * net).otherwise(0.0)))
    return r.groupBy(*keys).agg(
        F.count("*").alias("trades"), rnd(F.avg(d(C("won").cast("int")))).alias("win_rate"), rnd(F.avg(net)).alias("avg_net"), rnd(ratio(F.avg(net), F.stddev_pop(net))).alias("sharpe"), rnd(ratio(F.avg(net), down)).alias("sortino"),
        rnd(F.sum(net * n), 3).alias("pnl"), rnd(F.sum(C("fee") * n), 3).alias("fees"),
        rnd(ratio(F.sum(F.when(C("gross") > 0, C("gross") * n).otherwise(0.0)), -F.sum(F.when(C("gross") < 0, C("gross") * n).otherwise(0.0)))).alias("profit_factor"))


_METRICS = """COUNT(*) AS trades, ROUND(AVG(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS win_rate, ROUND(AVG(net), 6) AS avg_net, ROUND(AVG(net) / NULLIF(STDDEV_POP(net), 0), 6) AS sharpe, ROUND(AVG(net) / NULLIF(SQRT(AVG(LEAST(net, 0) * LEAST(net, 0))), 0), 6) AS sortino,
  ROUND(SUM(net * contracts), 3) AS pnl, ROUND(SUM(fee * contracts), 3) AS fees, ROUND(SUM(GREATEST(gross, 0) * contracts) / NULLIF(-SUM(LEAST(gross, 0) * contracts), 0), 6) AS profit_factor"""


@register("bt_metrics", oracle(f"SELECT {_METRICS} FROM r WHERE entry_price < 20", r=_RUN))
def bt_metrics(spark, sf_dir):
    return metrics(run(fade_longshot(20), spark, sf_dir))


SWEEP = list(range(5, 55, 5))


@register("bt_sweep", oracle(f"SELECT CAST(t AS INTEGER) AS threshold, {_METRICS} FROM r JOIN (SELECT UNNEST(range(5, 55, 5)) AS t) ON entry_price < t GROUP BY t", r=_RUN))
def bt_sweep(spark, sf_dir):
    """All thresholds in one plan: each trade counts for the thresholds above its price; the input is read once."""
    t = run(fade_longshot(max(SWEEP)), spark, sf_dir)
    above = F.filter(F.array(*map(F.lit, SWEEP)), lambda x: x > C("entry_price"))
    return metrics(t.withColumn("threshold", F.explode(above)), "threshold")


def equity(spark: SparkSession, sf_dir: str, strategy: Strategy) -> DataFrame:
    r = run(strategy, spark, sf_dir).withColumn("pnl", C("net") * C("contracts"))
    return running_total(r, F.date_trunc("day", "timestamp"), ["timestamp", "trade_id"], "pnl")


_EQ = "SELECT *, MAX(cum) OVER (ORDER BY timestamp, trade_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, SUM(net * contracts) OVER (ORDER BY timestamp, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM r WHERE entry_price < 20)"


@register("bt_equity_curve", oracle("SELECT trade_id, timestamp, ROUND(net * contracts, 4) AS pnl, ROUND(cum, 3) AS cum, ROUND(peak, 3) AS peak FROM q", r=_RUN, q=_EQ))
def bt_equity_curve(spark, sf_dir):
    return equity(spark, sf_dir, fade_longshot(20)).select("trade_id", "timestamp", rnd(C("pnl"), 4).alias("pnl"), rnd(C("cum"), 3).alias("cum"), rnd(C("peak"), 3).alias("peak"))


@register("bt_drawdown", oracle("SELECT ROUND(MIN(cum - peak), 3) AS max_drawdown, ROUND(MAX(cum), 3) AS top FROM q", r=_RUN, q=_EQ))
def bt_drawdown(spark, sf_dir):
    return equity(spark, sf_dir, fade_longshot(20)).agg(rnd(F.min("drawdown"), 3).alias("max_drawdown"), rnd(F.max("cum"), 3).alias("top"))


@register("bt_kelly", oracle("""SELECT ROUND(p, 6) AS p, ROUND(w, 6) AS avg_win, ROUND(l, 6) AS avg_loss, ROUND((p * (w / l) - (1 - p)) / (w / l), 6) AS kelly, ROUND(m / c, 6) AS edge_per_dollar FROM (SELECT AVG(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS p, AVG(net) FILTER (net > 0) AS w, -AVG(net) FILTER (net <= 0) AS l, AVG(net) AS m, AVG(cost) AS c FROM r WHERE entry_price < 20)""", r=_RUN))
def bt_kelly(spark, sf_dir):
    return kelly(run(fade_longshot(20), spark, sf_dir))


def kelly(r: DataFrame) -> DataFrame:
    net = C("net")
    s = r.agg(F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("p"), F.avg(F.when(net > 0, net)).alias("w"), (-F.avg(F.when(net <= 0, net))).alias("l"), F.avg(net).alias("m"), F.avg("cost").alias("c"))
    b = C("w") / C("l")
    return s.select(rnd(C("p")).alias("p"), rnd(C("w")).alias("avg_win"), rnd(C("l")).alias("avg_loss"), rnd((C("p") * b - (1 - C("p"))) / b).alias("kelly"), rnd(C("m") / C("c")).alias("edge_per_dollar"))


@register("bt_distribution", oracle("""SELECT n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, ROUND(m3 / POWER(m2, 1.5), 5) AS skew, ROUND(m4 / (m2 * m2) - 3, 5) AS kurtosis, ROUND(n / 6.0 * (POWER(m3 / POWER(m2, 1.5), 2) + POWER(m4 / (m2 * m2) - 3, 2) / 4), 2) AS jarque_bera, ROUND(p1, 6) AS p1, ROUND(p50, 6) AS p50, ROUND(p99, 6) AS p99 FROM (
  SELECT COUNT(*) AS n, ANY_VALUE(mu) AS mean, SQRT(AVG(POWER(net - mu, 2))) AS sd, AVG(POWER(net - mu, 2)) AS m2, AVG(POWER(net - mu, 3)) AS m3, AVG(POWER(net - mu, 4)) AS m4, QUANTILE_CONT(ROUND(net, 6), 0.01) AS p1, QUANTILE_CONT(ROUND(net, 6), 0.5) AS p50, QUANTILE_CONT(ROUND(net, 6), 0.99) AS p99
  FROM (SELECT * FROM r WHERE entry_price < 20) CROSS JOIN (SELECT AVG(net) AS mu FROM r WHERE entry_price < 20))""", r=_RUN))
def bt_distribution(spark, sf_dir):
    """Moments, percentiles and the Jarque-Bera statistic of returns."""
    q = lambda p: rnd(F.percentile(rnd(C("net")), F.lit(p)))
    s = run(fade_longshot(20), spark, sf_dir).agg(F.count("*").alias("n"), rnd(F.avg("net")).alias("mean"), rnd(F.stddev_pop("net")).alias("sd"), F.skewness("net").alias("s"), F.kurtosis("net").alias("k"), q(0.01).alias("p1"), q(0.5).alias("p50"), q(0.99).alias("p99"))
    jb = C("n") / 6 * (C("s") * C("s") + C("k") * C("k") / 4)
    return s.select("n", "mean", "sd", rnd(C("s"), 5).alias("skew"), rnd(C("k"), 5).alias("kurtosis"), rnd(jb, 2).alias("jarque_bera"), "p1", "p50", "p99")


@register("bt_fits")
def bt_fits(spark, sf_dir):
    """Student-t fit of the returns with its distance to them, and the tests for a normal one (W of at most 5,000 trades)."""
    r = checkpointed(run(fade_longshot(20), spark, sf_dir).select("trade_id", rnd(C("net")).alias("net")))
    counts = value_counts(r, "net")
    t, (w, wp) = fit_student(counts), shapiro_sample(r, "net", "trade_id")
    distance, p = kolmogorov(counts, student_cdf(t["df"], t["loc"], t["scale"])) if t else (None, None)
    t = t or dict.fromkeys(("df", "loc", "scale"))
    return spark.createDataFrame([(t["df"], t["loc"], t["scale"], distance, p, w, float(wp))], "df double, loc double, scale double, ks double, ks_p double, shapiro double, shapiro_p double")


PATHS, MOST_TRADES = 10_000, 100_000
#: Different trades (net, contracts, won) that paths draw from, at most: 24 bytes each in every task.
MOST_KINDS = 4_000_000
_PATH = {"path": pa.int64(), "total": pa.float64(), "mean": pa.float64(), "max_drawdown": pa.float64(), "longest_loss": pa.int64(), "sharpe": pa.float64(), "win_rate": pa.float64()}


def monte_carlo(r: DataFrame, paths: int = PATHS, trades: int | None = None, seed: int = 42) -> DataFrame:
    """Bootstrap paths: path, total, mean, max_drawdown, longest_loss, sharpe, win_rate.

    A path draws as many trades as there are, MOST_TRADES at most, unless ``trades`` says otherwise. Total and drawdown
    are of net * contracts, the rest of net, as in the reference; without ``contracts`` a trade is of one, without
    ``won`` it is won if net is above 0. Counts of equal trades (price, outcome and contracts; MOST_KINDS at most, else an error)
    are drawn from, not the rows; each path has a generator of its own, so results do not depend on the partitions.
    """
    spark = r.sparkSession
    size = d("contracts") if "contracts" in r.columns else F.lit(1.0)
    won = d(C("won").cast("int")) if "won" in r.columns else F.when(C("net") > 0, 1.0).otherwise(0.0)
    kinds = r.groupBy(rnd(C("net")).alias("net"), size.alias("contracts"), won.alias("won")).agg(F.count("*").alias("n"))
    rows = kinds.limit(MOST_KINDS + 1).toPandas().sort_values(["net", "contracts", "won"])
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of trades: bin contracts before the bootstrap")
    counts = rows[["net", "contracts", "won", "n"]].to_numpy(float).reshape(-1, 4)
    upto = np.cumsum(counts[:, 3].astype(np.int64))
    n = int(upto[-1]) if len(upto) else 0
    length = trades or min(n, MOST_TRADES)
    shared = spark.sparkContext.broadcast((counts[:, 0].copy(), counts[:, 0] * counts[:, 1], counts[:, 2].copy(), upto))

    def one(path: int) -> tuple:
        net, pnl, win, ends = shared.value
        if not n:
            return path, 0.0, 0.0, 0.0, 0, 0.0, 0.0
        at = np.searchsorted(ends, np.random.default_rng([seed, path]).integers(0, n, length), side="right")
        x, cum = net[at], np.cumsum(pnl[at])
        loss = np.flatnonzero(np.diff(np.concatenate([[0], (x < 0).astype(int), [0]])))
        sd = float(x.std())
        return (path, float(cum[-1]), float(x.mean()), float((cum - np.maximum.accumulate(cum)).min()), int((loss[1::2] - loss[::2]).max()) if len(loss) else 0,
                float(x.mean()) / sd if sd > 0 else 0.0, float(win[at].mean()))

    def walk(it):
        for batch in it:
            out = [one(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(_PATH, o, strict=True)) for o in out], schema=pa.schema(_PATH))

    return spark.range(paths).mapInArrow(walk, "path long, total double, mean double, max_drawdown double, longest_loss long, sharpe double, win_rate double")


@register("bt_monte_carlo")
def bt_monte_carlo(spark, sf_dir):
    """The reference's summary of the bootstrap; drawdowns are labelled by severity (p95 is the 5th percentile)."""
    m = monte_carlo(run(fade_longshot(20), spark, sf_dir))
    q = lambda c, p: F.percentile(c, F.lit(p))
    at = lambda c, *ps: [q(c, p).alias(f"{c}_p{round(p * 100)}") for p in ps]
    return m.agg(F.count("*").alias("paths"), *at("total", 0.05, 0.25, 0.5, 0.75, 0.95), F.avg("total").alias("total_mean"), F.stddev_pop("total").alias("total_sd"),
                 *[q("max_drawdown", 1 - p).alias(f"drawdown_p{round(p * 100)}") for p in (0.5, 0.75, 0.9, 0.95, 0.99)], F.stddev_pop("mean").alias("mean_sd"), F.median("mean").alias("mean_median"),
                 *at("sharpe", 0.05, 0.5, 0.95), F.median("win_rate").alias("win_rate_median"), F.stddev_pop("win_rate").alias("win_rate_sd"))


@register("bt_kelly_adjusted")
def bt_kelly_adjusted(spark, sf_dir):
    """Kelly's share, cut by the spread of the bootstrap's path means."""
    cv = monte_carlo(run(fade_longshot(20), spark, sf_dir)).agg(F.abs(F.stddev_pop("mean") / F.median("mean")).alias("cv"))  # one row
    return bt_kelly(spark, sf_dir).crossJoin(F.broadcast(cv)).select("kelly", "cv", (C("kelly") * F.greatest(F.lit(1.0) - C("cv"), F.lit(0.0))).alias("kelly_adjusted"))


# ---- rolling calibration

_DAILY = f"""SELECT category, price_bucket, tte_bucket, taker_side, trade_date, total, win_rate, ABS(win_rate - price_bucket / 100.0) AS error FROM (SELECT {CAT} AS category, CAST(FLOOR(tp / 5.0) * 5 AS INTEGER) AS price_bucket, {TTE} AS tte_bucket, taker_side, CAST(created_time AS DATE) AS trade_date,
  CAST(SUM(count) AS DOUBLE) AS total, CAST(SUM(tw * count) AS DOUBLE) / SUM(count) AS win_rate FROM (SELECT *, EPOCH(close_time - created_time) AS tte FROM rt) GROUP BY ALL)"""
_ROLL = "SELECT *, " + ", ".join(f"SUM(error * total) OVER w{n} / SUM(total) OVER w{n} AS mae_{n}d, SUM(total) OVER w{n} AS vol_{n}d" for n in (7, 30, 90)) + " FROM dly WINDOW " + ", ".join(
    f"w{n} AS (PARTITION BY category, price_bucket, tte_bucket, taker_side ORDER BY trade_date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)" for n in (7, 30, 90))
_CELL = ["category", "price_bucket", "tte_bucket", "taker_side"]


def daily_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract-weighted error of each cell and day, with trailing means over 7, 30 and 90 days.

    The day is that of the trade here, for the test markets close on three days only.
    """
    r = resolved(spark, sf_dir).withColumn("tte", seconds_between(C("close_time"), C("created_time")))
    g = r.groupBy(category(C("event_ticker")).alias("category"), cent_bucket(C("tp")).alias("price_bucket"), tte_bucket(C("tte")).alias("tte_bucket"), "taker_side", C("created_time").cast("date").alias("trade_date")).agg(
        d(F.sum("count")).alias("total"), ratio(F.sum(C("tw") * C("count")), F.sum("count")).alias("win_rate")).withColumn("error", F.abs(C("win_rate") - C("price_bucket") / F.lit(100.0)))
    w = lambda n: W.partitionBy(*_CELL).orderBy(F.unix_date("trade_date")).rangeBetween(1 - n, 0)
    return g.select("*", *[e for n in (7, 30, 90) for e in ((F.sum(C("error") * C("total")).over(w(n)) / F.sum("total").over(w(n))).alias(f"mae_{n}d"), F.sum("total").over(w(n)).alias(f"vol_{n}d"))])


@register("t6_daily", oracle("""SELECT category, price_bucket, tte_bucket, taker_side, trade_date, total, ROUND(win_rate, 6) AS win_rate, ROUND(mae_7d, 6) AS mae_7d, ROUND(mae_30d, 6) AS mae_30d, ROUND(mae_90d, 6) AS mae_90d, vol_7d,
  ROUND(mae_7d * LN(1 + vol_7d) * (1 + ABS(CASE WHEN taker_side = 'yes' THEN 1.0 ELSE 0.0 END - 0.5)), 6) AS opportunity FROM rl""", dly=_DAILY, rl=_ROLL))
def t6_daily(spark, sf_dir):
    yes = F.when(C("taker_side") == "yes", 1.0).otherwise(0.0)
    r6 = lambda c: rnd(C(c)).alias(c)
    return daily_calibration(spark, sf_dir).select(*_CELL, "trade_date", "total", r6("win_rate"), r6("mae_7d"), r6("mae_30d"), r6("mae_90d"), "vol_7d", rnd(C("mae_7d") * F.log1p("vol_7d") * (1 + F.abs(yes - 0.5))).alias("opportunity"))


#: The thresholds of the sweep, half a point to ten.
CALIBRATION_SWEEP = [i * 0.005 for i in range(1, 21)]


def calibration_sweep(spark: SparkSession, sf_dir: str, thresholds: list[float] = CALIBRATION_SWEEP, max_price: int = 50, lag_days: int = 7, min_trades: int = 50) -> DataFrame:
    """Metrics of taking NO against YES takers whose cell had a 7-day error over each threshold ``lag_days`` ago.

    One plan: the trades are joined to the lagged cells once, and a trade counts for every threshold under its cell's error.
    """
    cells = daily_calibration(spark, sf_dir).filter((C("total") >= min_trades) & (C("taker_side") == "yes")).select(
        "category", "price_bucket", "tte_bucket", F.date_add("trade_date", lag_days).alias("day"), F.round("mae_7d", 9).alias("mae"))
    trades = resolved_for_backtest(spark, sf_dir).select(
        "*", category(C("event_ticker")).alias("category"), cent_bucket(C("entry_price")).alias("price_bucket"), tte_bucket(C("time_to_expiry_s")).alias("tte_bucket"), C("timestamp").cast("date").alias("day"))
    base = fade_longshot(max_price)
    t = trades.filter(base.where()).join(cells, ["category", "price_bucket", "tte_bucket", "day"])
    under = F.filter(F.array(*map(F.lit, thresholds)), lambda x: x < C("mae"))
    return metrics(t.select("contracts", *payoff(base.side, base.fee), F.explode(under).alias("threshold")), "threshold")


@register("bt_cal_sweep", oracle(f"""SELECT ROUND(i * CAST(0.005 AS DOUBLE), 3) AS threshold, {_METRICS} FROM r JOIN k5 ON r.trade_id = k5.id JOIN rl ON rl.category = k5.category AND rl.price_bucket = k5.price_bucket AND rl.tte_bucket = k5.tte_bucket AND rl.taker_side = 'yes' AND rl.trade_date = k5.lagged
  JOIN (SELECT UNNEST(range(1, 21)) AS i) ON ROUND(mae_7d, 9) > i * CAST(0.005 AS DOUBLE) WHERE entry_price < 50 AND rl.total >= 50 GROUP BY i""", r=_RUN, dly=_DAILY, rl=_ROLL,
    k5=f"SELECT trade_id AS id, {CAT} AS category, CAST(FLOOR(tp / 5.0) * 5 AS INTEGER) AS price_bucket, {TTE} AS tte_bucket, CAST(created_time AS DATE) - 7 AS lagged FROM (SELECT *, EPOCH(close_time - created_time) AS tte FROM rt)"))
def bt_cal_sweep(spark, sf_dir):
    return calibration_sweep(spark, sf_dir).withColumn("threshold", rnd(C("threshold"), 3))


@register("t6_regime", oracle("""SELECT category, trade_date, COUNT(*) AS cells, COUNT(*) FILTER (WHERE ROUND(mae_7d, 9) > ROUND(mae_90d, 9)) AS worse, COUNT(*) FILTER (WHERE ROUND(mae_7d, 9) < ROUND(mae_90d, 9)) AS better FROM rl GROUP BY 1, 2""", dly=_DAILY, rl=_ROLL))
def t6_regime(spark, sf_dir):
    a, b = F.round("mae_7d", 9), F.round("mae_90d", 9)
    return daily_calibration(spark, sf_dir).groupBy("category", "trade_date").agg(F.count("*").alias("cells"), F.count_if(a > b).alias("worse"), F.count_if(a < b).alias("better"))


@register("t6_lag", oracle(f"""SELECT {CAT} AS category, COUNT(*) AS n, ROUND(AVG(h), 4) AS mean, QUANTILE_DISC(h, 0.5) AS p50, QUANTILE_DISC(h, 0.9) AS p90 FROM (SELECT *, ROUND(EPOCH(close_time - created_time) / 3600.0, 4) AS h FROM rt) GROUP BY 1"""))
def t6_lag(spark, sf_dir):
    """Hours from trade to resolution, with quantiles that are data points."""
    h = resolved(spark, sf_dir).select(category(C("event_ticker")).alias("category"), rnd(seconds_between(C("close_time"), C("created_time")) / F.lit(3600.0), 4).alias("h"))
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY h)")
    return h.groupBy("category").agg(F.count("*").alias("n"), rnd(F.avg("h"), 4).alias("mean"), q(0.5).alias("p50"), q(0.9).alias("p90"))
