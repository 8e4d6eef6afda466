"""Win rates and returns by price, side, role, size and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pmx.functions import d, excess, log_bin, ratio, rnd, size_bucket
from pmx.operators.graph import checkpointed
from pmx.operators.positions import positions, resolved_trades
from pmx.operators.quantiles import exact_quantiles
from pmx.registry import register
from pmx.views import k_markets, k_trades, oracle

C = F.col


def resolved(spark: SparkSession, sf_dir: str, finalized: bool = True) -> DataFrame:
    return resolved_trades(k_trades(spark, sf_dir), k_markets(spark, sf_dir), finalized)


def cells(spark: SparkSession, sf_dir: str, *keys) -> DataFrame:
    """Positions summed over ``keys``: n, wins, contracts, won contracts, and the sums of excess and its square."""
    x = excess(C("won"), C("price"))
    return positions(resolved(spark, sf_dir)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("won").alias("wins"), F.sum("count").alias("contracts"), F.sum(C("won") * C("count")).alias("won_contracts"),
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))


@register("win_rate_by_price", oracle("""SELECT price, COUNT(*) AS total_trades, CAST(SUM(won) AS BIGINT) AS wins, ROUND(100.0 * CAST(SUM(won) AS DOUBLE) / COUNT(*), 6) AS win_rate FROM pos GROUP BY price"""))
def win_rate_by_price(spark, sf_dir):
    return positions(resolved(spark, sf_dir)).groupBy("price").agg(
        F.count("*").alias("total_trades"), F.sum("won").alias("wins"), rnd(F.lit(100.0) * d(F.sum("won")) / F.count("*")).alias("win_rate"))


@register("mispricing_by_price", oracle("""SELECT price, role, COUNT(*) AS n, ROUND(AVG(CAST(won AS DOUBLE)) * 100 - price, 6) AS mispricing_pp,
  ROUND((AVG(CAST(won AS DOUBLE)) * 100 - price) / price, 6) AS relative FROM pos GROUP BY price, role"""))
def mispricing_by_price(spark, sf_dir):
    gap = d(C("wins")) / C("n") * 100 - C("price")
    return cells(spark, sf_dir, "price", "role").select("price", "role", "n", rnd(gap).alias("mispricing_pp"), rnd(gap / C("price")).alias("relative"))



@register("maker_vs_taker_by_price", oracle("""SELECT t.price, t.n AS taker_n, m.n AS maker_n, ROUND(t.m, 6) AS taker_excess, ROUND(m.m, 6) AS maker_excess,
  ROUND(1.96 * SQRT(t.v / t.n), 6) AS taker_ci, ROUND(1.96 * SQRT(m.v / m.n), 6) AS maker_ci FROM s t JOIN s m ON t.price = m.price WHERE t.role = 'taker' AND m.role = 'maker'""",
    s="SELECT price, role, COUNT(*) AS n, AVG(won - price / 100.0) AS m, VAR_POP(CAST(won - price / 100.0 AS DOUBLE)) AS v FROM pos GROUP BY price, role"))
def maker_vs_taker_by_price(spark, sf_dir):
    x = excess(C("won"), C("price"))
    s = positions(resolved(spark, sf_dir)).groupBy("price").agg(*[
        f(F.when(C("role") == r, x)).alias(f"{r}_{k}") for r in ("taker", "maker") for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    ci = lambda r: rnd(F.lit(1.96) * F.sqrt(C(f"{r}_v") / C(f"{r}_n"))).alias(f"{r}_ci")
    return s.filter("taker_n > 0 AND maker_n > 0").select("price", "taker_n", "maker_n", rnd(C("taker_m")).alias("taker_excess"), rnd(C("maker_m")).alias("maker_excess"), ci("taker"), ci("maker"))


@register("ev_yes_vs_no", oracle("""SELECT CAST(p.price AS BIGINT) AS price, COALESCE(y.n, 0) AS yes_n, COALESCE(o.n, 0) AS no_n, ROUND(y.r * 100 - p.price, 6) AS yes_ev, ROUND(o.r * 100 - p.price, 6) AS no_ev
  FROM (SELECT UNNEST(range(1, 100)) AS price) p LEFT JOIN s y ON y.price = p.price AND y.side = 'yes' LEFT JOIN s o ON o.price = p.price AND o.side = 'no'""",
    r2="SELECT ticker, result FROM k_markets WHERE result IN ('yes', 'no')",
    s="""SELECT price, side, COUNT(*) AS n, CAST(SUM(won * count) AS DOUBLE) / SUM(count) AS r FROM (
      SELECT yes_price AS price, 'yes' AS side, count, CASE WHEN result = 'yes' THEN 1 ELSE 0 END AS won FROM k_trades t JOIN r2 ON t.ticker = r2.ticker
      UNION ALL SELECT no_price, 'no', count, CASE WHEN result = 'no' THEN 1 ELSE 0 END FROM k_trades t JOIN r2 ON t.ticker = r2.ticker) WHERE price BETWEEN 1 AND 99 GROUP BY price, side"""))
def ev_yes_vs_no(spark, sf_dir):
    """Contract-weighted value of either side at each price of the fixed domain 1..99."""
    both = F.array(*[F.struct(C(f"{s}_price").alias("price"), F.lit(s).alias("side"), F.when(C("result") == s, 1).otherwise(0).alias("won")) for s in ("yes", "no")])
    s = resolved(spark, sf_dir, finalized=False).select("count", F.inline(both)).filter(C("price").between(1, 99))
    agg = s.groupBy("price").agg(*[e for k in ("yes", "no") for e in (
        F.count_if(C("side") == k).alias(f"{k}_n"), ratio(F.sum(F.when(C("side") == k, C("won") * C("count"))), F.sum(F.when(C("side") == k, C("count")))).alias(f"{k}_r"))])
    domain = spark.range(1, 100).withColumnRenamed("id", "price")
    out = domain.join(agg.withColumn("price", C("price").cast("long")), "price", "left")
    return out.select("price", *[F.coalesce(f"{k}_n", F.lit(0)).alias(f"{k}_n") for k in ("yes", "no")], *[rnd(C(f"{k}_r") * 100 - C("price")).alias(f"{k}_ev") for k in ("yes", "no")])


@register("yes_vs_no_by_price", oracle("""SELECT price, CAST(SUM(CASE WHEN role = 'taker' AND side = 'yes' THEN count END) AS BIGINT) AS taker_yes, CAST(SUM(CASE WHEN role = 'taker' AND side = 'no' THEN count END) AS BIGINT) AS taker_no,
  CAST(SUM(CASE WHEN role = 'maker' AND side = 'yes' THEN count END) AS BIGINT) AS maker_yes, CAST(SUM(CASE WHEN role = 'maker' AND side = 'no' THEN count END) AS BIGINT) AS maker_no FROM pos GROUP BY price"""))
def yes_vs_no_by_price(spark, sf_dir):
    """Four pre-aggregates by price as one conditional aggregate."""
    part = lambda r, s: F.sum(F.when((C("role") == r) & (C("side") == s), C("count"))).alias(f"{r}_{s}")
    return positions(resolved(spark, sf_dir)).groupBy("price").agg(*[part(r, s) for r in ("taker", "maker") for s in ("yes", "no")])


@register("maker_direction_returns", oracle("""SELECT price, side, COUNT(*) AS n, ROUND(AVG(won - price / 100.0), 6) AS excess, ROUND(STDDEV_SAMP(CAST(won - price / 100.0 AS DOUBLE)), 6) AS sd FROM pos WHERE role = 'maker' GROUP BY price, side"""))
def maker_direction_returns(spark, sf_dir):
    x = excess(C("won"), C("price"))
    return positions(resolved(spark, sf_dir)).filter("role = 'maker'").groupBy("price", "side").agg(F.count("*").alias("n"), rnd(F.avg(x)).alias("excess"), rnd(F.stddev_samp(x)).alias("sd"))


@register("maker_direction_win_rate", oracle("""SELECT COALESCE(y.price, o.price) AS price, ROUND(y.r, 6) AS yes_rate, ROUND(o.r, 6) AS no_rate, ROUND(y.r - o.r, 6) AS gap FROM (SELECT price, r FROM s WHERE side = 'yes') y FULL OUTER JOIN (SELECT price, r FROM s WHERE side = 'no') o ON y.price = o.price""",
    s="SELECT price, side, CAST(SUM(won * count) AS DOUBLE) / SUM(count) AS r FROM pos WHERE role = 'maker' GROUP BY price, side"))
def maker_direction_win_rate(spark, sf_dir):
    s = cells(spark, sf_dir, "price", "side", "role").filter("role = 'maker'").withColumn("r", ratio(C("won_contracts"), C("contracts")))
    y, n = (s.filter(C("side") == k).select("price", C("r").alias(f"{k}_r")) for k in ("yes", "no"))
    return y.join(n, "price", "full_outer").select("price", rnd(C("yes_r")).alias("yes_rate"), rnd(C("no_r")).alias("no_rate"), rnd(C("yes_r") - C("no_r")).alias("gap"))


@register("returns_by_hour", oracle("""SELECT CAST(EXTRACT(HOUR FROM created_time) AS INTEGER) AS hour_et, COUNT(*) AS n, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_SAMP(x), 6) AS sd, ROUND(AVG(x) / NULLIF(STDDEV_SAMP(x) / SQRT(COUNT(*)), 0), 5) AS t
  FROM (SELECT created_time, CAST(tw - tp / 100.0 AS DOUBLE) AS x FROM rt) GROUP BY 1"""))
def returns_by_hour(spark, sf_dir):
    r = resolved(spark, sf_dir).select(F.hour("created_time").alias("hour_et"), excess(C("tw"), C("tp")).alias("x"))
    return r.groupBy("hour_et").agg(F.count("*").alias("n"), rnd(F.avg("x")).alias("mean"), rnd(F.stddev_samp("x")).alias("sd"),
                                    rnd(F.avg("x") / F.nullif(F.stddev_samp("x") / F.sqrt(F.count("*")), F.lit(0.0)), 5).alias("t"))


@register("vwap_by_hour", oracle("""SELECT CAST(EXTRACT(HOUR FROM created_time) AS INTEGER) AS hour_et, CAST(SUM(count) AS BIGINT) AS volume, ROUND(CAST(SUM(tp * count) AS DOUBLE) / NULLIF(SUM(count), 0), 6) AS vwap, ROUND(STDDEV_SAMP(CAST(tp AS DOUBLE)), 6) AS sd FROM rt GROUP BY 1"""))
def vwap_by_hour(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy(F.hour("created_time").alias("hour_et")).agg(
        F.sum("count").alias("volume"), rnd(ratio(F.sum(C("tp") * C("count")), F.sum("count"))).alias("vwap"), rnd(F.stddev_samp(d("tp"))).alias("sd"))


@register("win_rate_by_trade_size", oracle("""SELECT b AS size_bin, COUNT(*) AS n, ROUND(AVG(CAST(tw AS DOUBLE)), 6) AS win_rate, ROUND(AVG(tw - tp / 100.0), 6) AS excess, ROUND(1.96 * SQRT(VAR_POP(CAST(tw - tp / 100.0 AS DOUBLE)) / COUNT(*)), 6) AS ci
  FROM (SELECT *, ROUND(POWER(10, FLOOR(LOG10(GREATEST(count * tp / 100.0, 0.01)) * 4) / 4), 6) AS b FROM rt) GROUP BY b HAVING COUNT(*) >= 10"""))
def win_rate_by_trade_size(spark, sf_dir):
    x = excess(C("tw"), C("tp"))
    return resolved(spark, sf_dir).groupBy(rnd(log_bin(d(C("count") * C("tp")) / F.lit(100.0))).alias("size_bin")).agg(
        F.count("*").alias("n"), rnd(F.avg(d("tw"))).alias("win_rate"), rnd(F.avg(x)).alias("excess"), rnd(F.lit(1.96) * F.sqrt(F.var_pop(x) / F.count("*"))).alias("ci")).filter("n >= 10")


@register("trade_size_by_role", oracle("""SELECT role, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(MEDIAN(v), 6) AS median, ROUND(QUANTILE_CONT(v, 0.25), 6) AS p25, ROUND(QUANTILE_CONT(v, 0.75), 6) AS p75, ROUND(QUANTILE_CONT(v, 0.95), 6) AS p95
  FROM (SELECT role, CAST(count * price / 100.0 AS DOUBLE) AS v FROM pos) GROUP BY role"""))
def trade_size_by_role(spark, sf_dir):
    v = checkpointed(positions(resolved(spark, sf_dir)).select("role", (d(C("count") * C("price")) / F.lit(100.0)).alias("v")))
    names = ["p25", "median", "p75", "p95"]
    q = spark.createDataFrame([(r, *x) for r, x in exact_quantiles(v, "v", [0.25, 0.5, 0.75, 0.95], "role").items()], "role string, " + ", ".join(f"{n} double" for n in names))
    return v.groupBy("role").agg(F.count("*").alias("n"), rnd(F.avg("v")).alias("mean")).join(F.broadcast(q), "role").select("role", "n", "mean", *[rnd(C(n)).alias(n) for n in names])  # a row a role


_SIZE = "CASE WHEN count <= 1 THEN '1' WHEN count <= 10 THEN '2-10' WHEN count <= 100 THEN '11-100' WHEN count <= 1000 THEN '101-1K' ELSE '1K+' END"


@register("size_segmentation", oracle(f"""SELECT {_SIZE} AS size_bucket, COUNT(*) AS n, CAST(SUM(count) AS BIGINT) AS contracts, ROUND(AVG(tw - tp / 100.0), 6) AS taker_excess, ROUND(AVG(mw - mp / 100.0), 6) AS maker_excess FROM rt GROUP BY 1"""))
def size_segmentation(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy(size_bucket(C("count")).alias("size_bucket")).agg(
        F.count("*").alias("n"), F.sum("count").alias("contracts"), rnd(F.avg(excess(C("tw"), C("tp")))).alias("taker_excess"), rnd(F.avg(excess(C("mw"), C("mp")))).alias("maker_excess"))


@register("size_by_category", oracle(f"""SELECT category, size_bucket, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(n * w) / SUM(n), 6) AS win_rate FROM (
  SELECT COALESCE(NULLIF(regexp_extract(event_ticker, '^([A-Z0-9]+)', 1), ''), 'independent') AS category, {_SIZE} AS size_bucket, tp, COUNT(*) AS n, AVG(CAST(tw AS DOUBLE)) AS w FROM rt GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def size_by_category(spark, sf_dir):
    """Cross-tab per price, re-weighted into category and size."""
    from pmx.functions import category

    by_price = resolved(spark, sf_dir).groupBy(category(C("event_ticker")).alias("category"), size_bucket(C("count")).alias("size_bucket"), "tp").agg(F.count("*").alias("n"), F.avg(d("tw")).alias("w"))
    return by_price.groupBy("category", "size_bucket").agg(F.sum("n").alias("n"), rnd(F.sum(C("n") * C("w")) / F.sum("n")).alias("win_rate"))


@register("asymmetry_by_range", oracle("""SELECT r AS price_range, COUNT(*) FILTER (side = 'yes') AS yes_n, COUNT(*) FILTER (side = 'no') AS no_n, ROUND(AVG(x) FILTER (side = 'yes'), 6) AS yes_excess, ROUND(AVG(x) FILTER (side = 'no'), 6) AS no_excess,
  ROUND(AVG(x) FILTER (side = 'yes') - AVG(x) FILTER (side = 'no'), 6) AS asymmetry FROM (SELECT CAST(LEAST(GREATEST(FLOOR((price - 1) / 10.0) + 1, 1), 10) AS INTEGER) AS r, side, CAST(won - price / 100.0 AS DOUBLE) AS x FROM pos WHERE role = 'taker') GROUP BY r"""))
def asymmetry_by_range(spark, sf_dir):
    from pmx.functions import price_decile

    p = positions(resolved(spark, sf_dir)).filter("role = 'taker'").select(price_decile(C("price")).alias("price_range"), "side", excess(C("won"), C("price")).alias("x"))
    y, n = (F.avg(F.when(C("side") == s, C("x"))) for s in ("yes", "no"))
    return p.groupBy("price_range").agg(F.count_if(C("side") == "yes").alias("yes_n"), F.count_if(C("side") == "no").alias("no_n"), rnd(y).alias("yes_excess"), rnd(n).alias("no_excess"), rnd(y - n).alias("asymmetry"))


@register("opposite_side_check", oracle("""SELECT role, side, CAST(SUM(won) AS BIGINT) AS wins, COUNT(*) AS n FROM pos GROUP BY role, side"""))
def opposite_side_check(spark, sf_dir):
    """Wins by role and side; a taker's and a maker's wins add up to the trades."""
    return positions(resolved(spark, sf_dir)).groupBy("role", "side").agg(F.sum("won").alias("wins"), F.count("*").alias("n"))
