"""Categories and event families, calibration metrics and significance tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.functions import cent_bucket, category, d, excess, keyword_group, ratio, rnd
from pmx.operators.patterns import first_match
from pmx.operators.positions import positions
from pmx.plans.prices import cells, resolved
from pmx.registry import register
from pmx.stats import normal_two_sided, student_two_sided
from pmx.views import k_markets, k_trades, oracle, p_markets, raw

C = F.col
#: The keyword table of the test markets: (pattern, group), the first match counts. Others may be passed instead.
KEYWORDS = [("AUTO", "Transport"), ("MACH", "Industry"), ("BUILD", "Industry"), ("HOUSE", "Home"), ("FURN", "Home")]
_GROUP = "CASE " + " ".join(f"WHEN CONTAINS(UPPER({{0}}), '{p}') THEN '{g}'" for p, g in KEYWORDS) + " ELSE 'Other' END"
_CAT = "COALESCE(NULLIF(regexp_extract(event_ticker, '^([A-Z0-9]+)', 1), ''), 'independent')"
GROUP = _GROUP.format(_CAT)


def group_of(c="event_ticker"):
    return keyword_group(category(C(c)), KEYWORDS)


@register("category_returns", oracle("""SELECT grp, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(v * te) / SUM(v), 6) AS taker_excess, ROUND(SUM(v * me) / SUM(v), 6) AS maker_excess, ROUND(SUM(v * me) / SUM(v) - SUM(v * te) / SUM(v), 6) AS gap FROM (
  SELECT %s AS grp, %s AS category, COUNT(*) AS n, CAST(SUM(count) AS DOUBLE) AS v, AVG(tw - tp / 100.0) AS te, AVG(mw - mp / 100.0) AS me FROM rt GROUP BY 1, 2) GROUP BY grp""" % (GROUP, _CAT)))
def category_returns(spark, sf_dir):
    """Per category, then rolled up into groups weighted by volume."""
    c = resolved(spark, sf_dir).groupBy(category(C("event_ticker")).alias("category")).agg(
        F.count("*").alias("n"), d(F.sum("count")).alias("v"), F.avg(excess(C("tw"), C("tp"))).alias("te"), F.avg(excess(C("mw"), C("mp"))).alias("me"))
    w = lambda x: F.sum(C("v") * C(x)) / F.sum("v")
    return c.groupBy(keyword_group(C("category"), KEYWORDS).alias("grp")).agg(F.sum("n").alias("n"), rnd(w("te")).alias("taker_excess"), rnd(w("me")).alias("maker_excess"), rnd(w("me") - w("te")).alias("gap"))


@register("market_types", oracle(f"""SELECT level, grp, category, event, CAST(v AS BIGINT) AS volume, markets FROM (
  SELECT CASE WHEN GROUPING(event_ticker) = 0 THEN 3 WHEN GROUPING(category) = 0 THEN 2 ELSE 1 END AS level, grp, category, event_ticker AS event, SUM(volume) AS v, COUNT(*) AS markets FROM (SELECT *, {GROUP} AS grp, {_CAT} AS category FROM k_markets) GROUP BY ROLLUP (grp, category, event_ticker) HAVING GROUPING(grp) = 0)"""))
def market_types(spark, sf_dir):
    """A tree of group, category and event by one rollup; every event is there, however small."""
    m = k_markets(spark, sf_dir).select(group_of().alias("grp"), category(C("event_ticker")).alias("category"), C("event_ticker").alias("event"), "volume")
    g = m.rollup("grp", "category", "event").agg(F.sum("volume").alias("volume"), F.count("*").alias("markets"), F.grouping_id().alias("g"))
    level = F.when(C("g") == 0, 3).when(C("g") == 1, 2).otherwise(1)
    return g.filter("g < 7").select(level.alias("level"), "grp", "category", "event", "volume", "markets")


def part_patterns(spark, sf_dir):
    """A pattern table of the test tables, most specific first: whole names of every other part, then their nouns, then their adjectives."""
    p = raw(spark, sf_dir, "part").select("p_partkey", F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("n"))
    row = lambda pattern, grp, category, sub: F.struct(pattern.alias("pattern"), F.lit(grp).alias("grp"), category.alias("category"), sub.alias("subcategory"))
    both = F.array(row(C("n"), "Noun", C("n"), F.lit("Other")), row(C("a"), "Adjective", F.lit("Other"), C("a")))
    whole = F.array(row(F.concat("a", F.lit(" "), "n"), "Name", C("n"), C("a")))
    t = p.select(F.inline(F.when(C("p_partkey") % 97 == 0, F.concat(whole, both)).otherwise(both))).distinct()
    return t.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.length("pattern")), "pattern")).cast("long"))  # a row a pattern


@register("market_hierarchy", oracle("""SELECT COALESCE(grp, 'Other') AS grp, COALESCE(category, 'Other') AS category, COALESCE(subcategory, 'Other') AS subcategory, COUNT(*) AS markets, ROUND(SUM(volume), 2) AS volume FROM p_markets m
  LEFT JOIN (SELECT question, MIN(place) AS place FROM (SELECT DISTINCT question FROM p_markets) q JOIN t ON CONTAINS(UPPER(question), pattern) GROUP BY 1) f ON f.question = m.question LEFT JOIN t ON t.place = f.place GROUP BY 1, 2, 3""",
    w="SELECT p_partkey, UPPER(split_part(p_name, ' ', 1)) AS a, UPPER(split_part(p_name, ' ', 2)) AS n FROM part",
    t="""SELECT *, ROW_NUMBER() OVER (ORDER BY length(pattern) DESC, pattern) AS place FROM (SELECT n AS pattern, 'Noun' AS grp, n AS category, 'Other' AS subcategory FROM w UNION SELECT a, 'Adjective', 'Other', a FROM w
      UNION SELECT a || ' ' || n, 'Name', n, a FROM w WHERE p_partkey % 97 = 0)"""))
def market_hierarchy(spark, sf_dir):
    """Markets by the first pattern of an ordered table that their title contains: group, category, subcategory."""
    m = first_match(p_markets(spark, sf_dir).select("question", "volume"), "question", part_patterns(spark, sf_dir))
    level = lambda c: F.coalesce(c, F.lit("Other")).alias(c)
    return m.groupBy(level("grp"), level("category"), level("subcategory")).agg(F.count("*").alias("markets"), rnd(F.sum("volume"), 2).alias("volume"))


def _miscalibration(*keys):
    def plan(spark, sf_dir):
        r = resolved(spark, sf_dir).select(*(k() for k in keys), cent_bucket(C("tp"), 10).alias("bucket"), "tp", "tw")
        names = [c for c in r.columns if c not in ("bucket", "tp", "tw")]
        b = r.groupBy(*names, "bucket").agg(F.count("*").alias("n"), F.abs(F.avg(d("tw")) - F.avg(d("tp")) / F.lit(100.0)).alias("e")).filter("n >= 20")
        return b.groupBy(*names).agg(F.sum("n").alias("n"), rnd(F.sum(C("n") * C("e")) / F.sum("n"), 5).alias("mae"))

    return plan


_MIS = """SELECT {0}, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(n * e) / SUM(n), 5) AS mae FROM (SELECT {1}, CAST(FLOOR(tp / 10.0) * 10 AS INTEGER) AS bucket, COUNT(*) AS n, ABS(AVG(CAST(tw AS DOUBLE)) - AVG(tp) / 100.0) AS e FROM rt GROUP BY ALL HAVING COUNT(*) >= 20) GROUP BY ALL"""
register("category_miscalibration", oracle(_MIS.format("grp", f"{GROUP} AS grp")))(_miscalibration(lambda: group_of().alias("grp")))
register("category_calibration_yearly", oracle(_MIS.format("year, grp", f"CAST(EXTRACT(YEAR FROM created_time) AS INTEGER) AS year, {GROUP} AS grp")))(_miscalibration(lambda: F.year("created_time").alias("year"), lambda: group_of().alias("grp")))


# ---- event families


@register("intra_event_parity", oracle("""SELECT outcomes, COUNT(*) AS events, ROUND(AVG(dev), 6) AS avg_dev, ROUND(AVG(CASE WHEN dev > 0 THEN 1.0 ELSE 0.0 END), 6) AS over, ROUND(AVG(CASE WHEN dev < 0 THEN 1.0 ELSE 0.0 END), 6) AS under FROM (SELECT event_ticker, COUNT(*) AS outcomes, SUM(last_price) - 100 AS dev FROM k_markets GROUP BY 1 HAVING COUNT(*) >= 2) GROUP BY outcomes"""))
def intra_event_parity(spark, sf_dir):
    e = k_markets(spark, sf_dir).groupBy("event_ticker").agg(F.count("*").alias("outcomes"), (F.sum("last_price") - 100).alias("dev")).filter("outcomes >= 2")
    share = lambda c: rnd(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return e.groupBy("outcomes").agg(F.count("*").alias("events"), rnd(F.avg("dev")).alias("avg_dev"), share(C("dev") > 0).alias("over"), share(C("dev") < 0).alias("under"))


@register("event_family_stats", oracle("""SELECT split_part(event_ticker, '-', 1) AS family, COUNT(*) AS n, COUNT(DISTINCT event_ticker) AS events, ROUND(AVG(last_price), 6) AS mean, ROUND(STDDEV_SAMP(last_price), 6) AS sd, ROUND(MEDIAN(last_price), 6) AS median, CAST(SUM(volume) AS BIGINT) AS volume, MAX(last_price) - MIN(last_price) AS price_range FROM k_markets GROUP BY 1"""))
def event_family_stats(spark, sf_dir):
    return k_markets(spark, sf_dir).groupBy(F.split_part("event_ticker", F.lit("-"), F.lit(1)).alias("family")).agg(
        F.count("*").alias("n"), F.count_distinct("event_ticker").alias("events"), rnd(F.avg("last_price")).alias("mean"), rnd(F.stddev_samp("last_price")).alias("sd"),
        rnd(F.median("last_price")).alias("median"), F.sum("volume").alias("volume"), (F.max("last_price") - F.min("last_price")).alias("price_range"))


_PARSE = "TRY_CAST(NULLIF(regexp_extract(ticker, '-T(\\d+\\.?\\d*)', 1), '') AS DOUBLE)"


def threshold_of(ticker):
    """The number after -T, or null."""
    return F.nullif(F.regexp_extract(ticker, r"-T(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


@register("monotonicity_violations", oracle(f"""SELECT event_ticker, COUNT(*) AS pairs, COUNT(*) FILTER (WHERE nxt > last_price) AS violations, CAST(MAX(nxt - last_price) AS DOUBLE) AS worst FROM (SELECT event_ticker, last_price, LEAD(last_price) OVER (PARTITION BY event_ticker ORDER BY {_PARSE}) AS nxt FROM k_markets) WHERE nxt IS NOT NULL GROUP BY 1"""))
def monotonicity_violations(spark, sf_dir):
    """Adjacent thresholds of an event whose prices rise."""
    w = W.partitionBy("event_ticker").orderBy("t")
    m = k_markets(spark, sf_dir).withColumn("t", threshold_of(C("ticker"))).select("event_ticker", "last_price", F.lead("last_price").over(w).alias("nxt")).filter("nxt IS NOT NULL")
    return m.groupBy("event_ticker").agg(F.count("*").alias("pairs"), F.count_if(C("nxt") > C("last_price")).alias("violations"), rnd(F.max(C("nxt") - C("last_price"))).alias("worst"))


@register("cross_family", oracle("""SELECT date_key, ROUND(MAX(p) FILTER (kind = 'even'), 6) AS even_price, ROUND(MAX(p) FILTER (kind = 'odd'), 6) AS odd_price, ROUND(ABS(MAX(p) FILTER (kind = 'even') - MAX(p) FILTER (kind = 'odd')), 6) AS gap FROM (
  SELECT split_part(event_ticker, '-', 2) AS date_key, CASE WHEN market_key % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, AVG(last_price) AS p FROM k_markets GROUP BY 1, 2) GROUP BY date_key HAVING COUNT(*) = 2"""))
def cross_family(spark, sf_dir):
    """Two families of one key (the event's second part) side by side: here even and odd markets."""
    kind = F.when(C("market_key") % 2 == 0, "even").otherwise("odd")
    p = k_markets(spark, sf_dir).groupBy(F.split_part("event_ticker", F.lit("-"), F.lit(2)).alias("date_key")).agg(*[F.avg(F.when(kind == k, C("last_price"))).alias(k) for k in ("even", "odd")])
    return p.filter("even IS NOT NULL AND odd IS NOT NULL").select("date_key", rnd(C("even")).alias("even_price"), rnd(C("odd")).alias("odd_price"), rnd(F.abs(C("even") - C("odd"))).alias("gap"))


_SPREAD = "(1 + market_key * 7 % 12)"


@register("spread_stats", oracle(f"""SELECT {_CAT} AS category, COUNT(*) AS n, ROUND(AVG({_SPREAD}), 6) AS mean, ROUND(MEDIAN({_SPREAD}), 6) AS median, ROUND(CORR({_SPREAD}, volume), 6) AS corr_volume, ROUND(CORR({_SPREAD}, LN(1 + volume)), 6) AS corr_log_volume FROM k_markets GROUP BY 1"""))
def spread_stats(spark, sf_dir):
    """Bid-ask spreads (derived, as the test markets have no quotes) against volume and its logarithm."""
    s = (1 + C("market_key") * 7 % 12).alias("s")
    m = k_markets(spark, sf_dir).select(category(C("event_ticker")).alias("category"), s, d("volume").alias("v"))
    return m.groupBy("category").agg(F.count("*").alias("n"), rnd(F.avg("s")).alias("mean"), rnd(F.median("s")).alias("median"), rnd(F.corr(d("s"), C("v"))).alias("corr_volume"), rnd(F.corr(d("s"), F.log1p("v"))).alias("corr_log_volume"))


# ---- metrics and tests


@register("meta_stats", oracle("""SELECT metric, value FROM (SELECT COUNT(*) AS trades, COUNT(DISTINCT ticker) AS traded_markets, CAST(SUM(count) AS BIGINT) AS contracts, COUNT(DISTINCT CAST(created_time AS DATE)) AS days, COUNT(DISTINCT CASE WHEN taker_side = 'yes' THEN ticker END) AS yes_markets FROM k_trades)
  UNPIVOT (value FOR metric IN (trades, traded_markets, contracts, days, yes_markets))"""))
def meta_stats(spark, sf_dir):
    s = k_trades(spark, sf_dir).agg(F.count("*").alias("trades"), F.count_distinct("ticker").alias("traded_markets"), F.sum("count").alias("contracts"), F.count_distinct(C("created_time").cast("date")).alias("days"),
                                   F.count_distinct(F.when(C("taker_side") == "yes", C("ticker"))).alias("yes_markets"))
    return s.unpivot([], s.columns, "metric", "value")


@register("calibration_metrics", oracle("""SELECT role, ROUND(SUM(w * (1 - p) * (1 - p) + (n - w) * p * p) / SUM(n), 6) AS brier, ROUND(-SUM(w * LN(LEAST(GREATEST(p, 1e-6), 1 - 1e-6)) + (n - w) * LN(LEAST(GREATEST(1 - p, 1e-6), 1 - 1e-6))) / SUM(n), 6) AS log_loss, ROUND(SUM(ABS(w - n * p)) / SUM(n), 6) AS ece
  FROM (SELECT role, price, CAST(price AS DOUBLE) / 100 AS p, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(won) AS DOUBLE) AS w FROM pos GROUP BY 1, 2) GROUP BY role"""))
def calibration_metrics(spark, sf_dir):
    """Brier score, log loss and expected calibration error from a hundred price rows."""
    c = cells(spark, sf_dir, "role", "price").select("role", d(C("price")).alias("price"), d("n").alias("n"), d("wins").alias("w")).withColumn("p", C("price") / F.lit(100.0))
    return calibration(c, "role")


def calibration(c, *keys):
    """Metrics of rows (p, n, w) per ``keys``."""
    p, n, w = C("p"), C("n"), C("w")
    ln = lambda x: F.log(F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)))
    return c.groupBy(*keys).agg(rnd(F.sum(w * (1 - p) * (1 - p) + (n - w) * p * p) / F.sum(n)).alias("brier"), rnd(-F.sum(w * ln(p) + (n - w) * ln(1 - p)) / F.sum(n)).alias("log_loss"), rnd(F.sum(F.abs(w - n * p)) / F.sum(n)).alias("ece"))


@register("two_proportion_z", oracle("""SELECT n1, n2, ROUND(p1, 6) AS p1, ROUND(p2, 6) AS p2, ROUND((p1 - p2) / SQRT(p * (1 - p) * (1.0 / n1 + 1.0 / n2)), 6) AS z FROM (SELECT *, (n1 * p1 + n2 * p2) / (n1 + n2) AS p FROM (
  SELECT COUNT(*) FILTER (WHERE taker_side = 'yes') AS n1, COUNT(*) FILTER (WHERE taker_side = 'no') AS n2, AVG(CAST(tw AS DOUBLE)) FILTER (WHERE taker_side = 'yes') AS p1, AVG(CAST(tw AS DOUBLE)) FILTER (WHERE taker_side = 'no') AS p2 FROM rt))"""))
def two_proportion_z(spark, sf_dir):
    y = C("taker_side") == "yes"
    s = resolved(spark, sf_dir).agg(F.count_if(y).alias("n1"), F.count_if(~y).alias("n2"), F.avg(F.when(y, d("tw"))).alias("p1"), F.avg(F.when(~y, d("tw"))).alias("p2"))
    s = s.withColumn("p", (C("n1") * C("p1") + C("n2") * C("p2")) / (C("n1") + C("n2")))
    z = (C("p1") - C("p2")) / F.sqrt(C("p") * (1 - C("p")) * (F.lit(1.0) / C("n1") + F.lit(1.0) / C("n2")))
    return s.select("n1", "n2", rnd(C("p1")).alias("p1"), rnd(C("p2")).alias("p2"), rnd(z).alias("z"))


def group_moments(spark, sf_dir):
    x = excess(C("tw"), C("tp"))
    return resolved(spark, sf_dir).groupBy(group_of().alias("grp")).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))


@register("welch_by_group", oracle(f"""SELECT a.grp AS a, b.grp AS b, ROUND((a.m - b.m) / SQRT(a.v / a.n + b.v / b.n), 5) AS t, ROUND(POWER(a.v / a.n + b.v / b.n, 2) / (POWER(a.v / a.n, 2) / (a.n - 1) + POWER(b.v / b.n, 2) / (b.n - 1)), 3) AS df,
  ROUND((a.m - b.m) / SQRT(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohen_d FROM g a JOIN g b ON a.grp < b.grp""", g=f"SELECT {GROUP} AS grp, COUNT(*) AS n, AVG(CAST(tw - tp / 100.0 AS DOUBLE)) AS m, VAR_SAMP(CAST(tw - tp / 100.0 AS DOUBLE)) AS v FROM rt GROUP BY 1"))
def welch_by_group(spark, sf_dir):
    return welch(group_moments(spark, sf_dir)).drop("p")


def welch(g):
    """Welch's t of every pair of groups with (grp, n, m, v): a self join of a row a group."""
    a, b = (g.select(*[C(c).alias(f"{c}{s}") for c in ("grp", "n", "m", "v")]) for s in "ab")
    va, vb = C("va") / C("na"), C("vb") / C("nb")
    t, df = (C("ma") - C("mb")) / F.sqrt(va + vb), F.pow(va + vb, F.lit(2.0)) / (va * va / (C("na") - 1) + vb * vb / (C("nb") - 1))
    pooled = F.sqrt(((C("na") - 1) * C("va") + (C("nb") - 1) * C("vb")) / (C("na") + C("nb") - 2))
    return a.join(b, C("grpa") < C("grpb")).select(C("grpa").alias("a"), C("grpb").alias("b"), rnd(t, 5).alias("t"), rnd(df, 3).alias("df"), rnd((C("ma") - C("mb")) / pooled).alias("cohen_d"), student_two_sided(t, df).alias("p"))


@register("mann_whitney", oracle("""SELECT n1, n2, ROUND(u, 3) AS u, ROUND(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, ROUND((u - n1 * n2 / 2.0) / SQRT(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 5) AS z FROM (
  SELECT n1, n2, ties, r1 - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT SUM(a) AS n1, SUM(b) AS n2, SUM(a * avg_rank) AS r1, SUM(CAST(a + b AS DOUBLE) * (a + b) * (a + b) - (a + b)) AS ties FROM (
    SELECT v, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, SUM(a + b) OVER (ORDER BY v) - (a + b - 1) / 2.0 AS avg_rank FROM (SELECT count AS v, COUNT(*) FILTER (WHERE taker_side = 'yes') AS a, COUNT(*) FILTER (WHERE taker_side = 'no') AS b FROM rt GROUP BY 1))))"""))
def mann_whitney(spark, sf_dir):
    """Sizes of YES against NO takers. Ranks come from the counts of distinct values, so the ordered window has a row a value."""
    y = C("taker_side") == "yes"
    v = resolved(spark, sf_dir).groupBy(C("count").alias("v")).agg(d(F.count_if(y)).alias("a"), d(F.count_if(~y)).alias("b"))
    s = C("a") + C("b")
    r = v.withColumn("rank", F.sum(s).over(W.partitionBy(F.lit(0)).orderBy("v").rowsBetween(W.unboundedPreceding, 0)) - (s - 1) / 2)
    t = r.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(C("a") * C("rank")).alias("r1"), F.sum(s * s * s - s).alias("ties")).withColumn("u", C("r1") - C("n1") * (C("n1") + 1) / 2)
    n, m = C("n1") * C("n2"), C("n1") + C("n2")
    z = (C("u") - n / 2) / F.sqrt(n / 12 * ((m + 1) - C("ties") / (m * (m - 1))))
    return t.select("n1", "n2", rnd(C("u"), 3).alias("u"), rnd(1 - 2 * C("u") / n).alias("rank_biserial"), rnd(z, 5).alias("z"))


@register("size_correlation", oracle("""SELECT COUNT(*) AS n, ROUND(CORR(count, x), 6) AS pearson, ROUND((SELECT CORR(rc, rx) FROM (SELECT RANK() OVER (ORDER BY count) + (COUNT(*) OVER (PARTITION BY count) - 1) / 2.0 AS rc, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx FROM r)), 6) AS spearman FROM r""",
    r="SELECT count, ROUND(CAST(tw - tp / 100.0 AS DOUBLE), 6) AS x FROM rt"))
def size_correlation(spark, sf_dir):
    """Pearson and Spearman. Average ranks come from the counts of each distinct value, joined back, not from a global sort of the rows."""
    r = resolved(spark, sf_dir).select("count", rnd(excess(C("tw"), C("tp"))).alias("x"))

    def ranks(c: str):
        v = r.groupBy(c).agg(F.count("*").alias("k"))
        return v.select(c, (F.sum("k").over(W.partitionBy(F.lit(0)).orderBy(c).rowsBetween(W.unboundedPreceding, 0)) - (C("k") - 1) / 2).alias(f"r_{c}"))

    j = r.join(ranks("count"), "count").join(ranks("x"), "x")
    return j.agg(F.count("*").alias("n"), rnd(F.corr(d("count"), C("x"))).alias("pearson"), rnd(F.corr("r_count", "r_x")).alias("spearman"))


@register("statistical_tests")
def statistical_tests(spark, sf_dir):
    """Test, statistic and p value: Welch by group, two proportions and Mann-Whitney; tails are our own approximations."""
    w = welch(group_moments(spark, sf_dir)).select(F.concat(F.lit("welch:"), "a", F.lit("/"), "b").alias("test"), C("t").alias("statistic"), "p")
    z = lambda df, name: df.select(F.lit(name).alias("test"), C("z").alias("statistic"), normal_two_sided(C("z")).alias("p"))
    return w.unionByName(z(two_proportion_z(spark, sf_dir), "two_proportion_z")).unionByName(z(mann_whitney(spark, sf_dir), "mann_whitney"))


@register("maker_direction_weighted", oracle("""SELECT side, CAST(SUM(k) AS BIGINT) AS weight, ROUND(SUM(k * x) / SUM(k), 6) AS mean, ROUND(SUM(k * x * x) / SUM(k) - POWER(SUM(k * x) / SUM(k), 2), 6) AS var FROM (SELECT side, LEAST(count, 100) AS k, CAST(won - price / 100.0 AS DOUBLE) AS x FROM pos WHERE role = 'maker') GROUP BY side"""))
def maker_direction_weighted(spark, sf_dir):
    """Moments with a weight of the size, held to 100: no row is repeated."""
    p = positions(resolved(spark, sf_dir)).filter("role = 'maker'").select("side", F.least("count", F.lit(100)).alias("k"), excess(C("won"), C("price")).alias("x"))
    m = ratio(F.sum(C("k") * C("x")), F.sum("k"))
    return p.groupBy("side").agg(F.sum("k").alias("weight"), rnd(m).alias("mean"), rnd(ratio(F.sum(C("k") * C("x") * C("x")), F.sum("k")) - m * m).alias("var"))


@register("longshot_regression", oracle("""SELECT COUNT(*) AS bins, ROUND(REGR_SLOPE(y, x), 6) AS slope, ROUND(REGR_INTERCEPT(y, x), 6) AS intercept, ROUND(REGR_R2(y, x), 6) AS r2 FROM (SELECT CAST(LEAST(FLOOR((price - 1) / 4.9), 19) AS INTEGER) AS b, AVG(price) AS x, AVG(100.0 * won) AS y FROM pos WHERE role = 'taker' GROUP BY 1)"""))
def longshot_regression(spark, sf_dir):
    """Win rate on price over twenty bins of equal width."""
    b = F.least(F.floor((C("tp") - 1) / F.lit(4.9)), F.lit(19))
    s = resolved(spark, sf_dir).groupBy(b.alias("b")).agg(F.avg(d("tp")).alias("x"), F.avg(d("tw") * 100).alias("y"))
    return s.agg(F.count("*").alias("bins"), rnd(F.regr_slope("y", "x")).alias("slope"), rnd(F.regr_intercept("y", "x")).alias("intercept"), rnd(F.regr_r2("y", "x")).alias("r2"))
