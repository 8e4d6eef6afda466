"""Operators against results worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pmx import functions as fx
from pmx.operators.bandjoin import band_join
from pmx.operators.graph import label_propagation
from pmx.operators.prefix import running_total
from pmx.operators.timegrid import bars, gap_filled
from pmx.operators.tokens import pool_positions, pool_resolution, token_positions, token_resolution
from pmx.plans import backtest, semantic
from pmx.plans.categories import threshold_of
from pmx.sources import ingest
from pmx.sources.datasets import Dataset, Runner, append_new, latest, write_table
from pmx.streaming import stream_bars

C = F.col


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


TRADES = [(1, "A", 10, 40, "yes", at(0, 10)), (2, "A", 5, 42, "no", at(3)), (3, "A", 50, 45, "yes", at(4, 59)), (4, "A", 20, 41, "no", at(21)), (5, "B", 1, 90, "yes", at(0))]


@pytest.fixture
def trades(spark):
    t = spark.createDataFrame(TRADES, "trade_id long, ticker string, count int, norm_price int, taker_side string, created_time timestamp_ntz")
    return t.withColumn("signed_flow", fx.signed_count())


def test_bars_and_gaps(trades):
    got = {r["bar_start"]: r for r in gap_filled(bars(trades, "5 minutes"), "INTERVAL 5 MINUTES").filter("ticker = 'A'").collect()}
    r = got[at(0)]
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"], r["net_flow"], r["trade_count"], r["vwap"], r["bar_return"], r["bar_range"]) == (40, 45, 40, 45, 65, 55, 3, 44.0, None, 5)
    for m in (5, 10, 15):
        r = got[at(m)]
        assert (r["open"], r["close"], r["volume"], r["vwap"], r["bar_return"], r["bar_range"]) == (45, 45, 0, None, 0, 0)
    r = got[at(20)]
    assert (r["open"], r["volume"], r["net_flow"], r["vwap"], r["bar_return"]) == (41, 20, -20, 41.0, -4)


def test_band_join(spark):
    x = spark.createDataFrame([("x", 100), ("y", 105), ("z", 110), ("w", 160)], "id string, b long").withColumn("k", F.lit(1))
    fwd = band_join(x, x, ["k"], "b", 50, C("r_b") > C("l_b")).select("l_id", "r_id").collect()
    assert {tuple(r) for r in fwd} == {("x", "y"), ("x", "z"), ("y", "z"), ("z", "w")}
    near = band_join(x, x, ["k"], "b", 9, C("l_b") < C("r_b")).select("l_id", "r_id").collect()
    assert {tuple(r) for r in near} == {("x", "y"), ("y", "z")}


def test_fees_and_payoffs(spark):
    rows = [(8, 92, "no"), (8, 92, "yes"), (60, 40, "no"), (60, 40, "yes"), (50, 50, "no")]
    t = spark.createDataFrame(rows, "entry_price int, maker_entry int, result string").withColumn("taker_won", F.when(C("result") == "yes", 1).otherwise(0))
    no = [round(r["net"], 6) for r in t.select(*backtest.payoff("no", fx.fee)).collect()]
    yes = [round(r["net"], 6) for r in t.select(*backtest.payoff("yes", fx.fee)).collect()]
    assert no[:4] == [7.44, -92.56, 57.2, -42.8] and yes[:4] == [-8.56, 91.44, -62.8, 37.2]
    assert [round(r[0], 6) for r in t.select(fx.fee(C("entry_price"))).collect()] == [0.56, 0.56, 2.8, 2.8, 3.0]


def test_drawdown_and_ratios(spark):
    pnl = [5.0, -3.0, -4.0, 10.0, -12.0, 2.0]
    df = spark.createDataFrame(list(enumerate(pnl)), "i int, pnl double")
    for width in (1, 2, 10):
        got = running_total(df, F.floor(C("i") / width), ["i"], "pnl").orderBy("i").collect()
        assert [r["cum"] for r in got] == [5, 2, -2, 8, -4, -2] and [r["peak"] for r in got] == [5, 5, 5, 8, 8, 8]
        assert min(r["drawdown"] for r in got) == -12
    r = spark.createDataFrame([(6.0,), (6.0,), (6.0,), (-9.0,)], "net double").select("net", F.lit(1).alias("contracts"), C("net").alias("gross"), F.lit(0.0).alias("fee"), (C("net") > 0).alias("won"), F.lit(10.0).alias("cost"))
    m = backtest.metrics(r).first()
    assert m["sharpe"] == pytest.approx(0.346410, abs=1e-6) and m["sortino"] == 0.5
    assert backtest.kelly(r).first()["kelly"] == 0.375


def test_monte_carlo_does_not_depend_on_partitions(spark):
    r = spark.createDataFrame([(1.0,)] * 3 + [(-2.0,)], "net double")
    a, b = (sorted(map(tuple, backtest.monte_carlo(x, 20, 50).collect())) for x in (r, r.repartition(3)))
    assert a == b and all(x[3] <= 0 for x in a)


def test_monte_carlo_draws_trades_with_their_contracts(spark):
    """Paths are as long as the table (100,000 trades at most), and weigh trades by contracts."""
    kinds = [(10.0, 3, True, 500), (-90.0, 1, False, 60), (5.0, 40, True, 200)]
    r = spark.createDataFrame([k[:3] for k in kinds for _ in range(k[3])], "net double, contracts long, won boolean")
    x = np.array([k[:3] for k in kinds for _ in range(k[3])], float)
    got = backtest.monte_carlo(r, 300).toPandas()
    n, pnl = len(x), x[:, 0] * x[:, 1]
    assert abs(got.total.mean() - n * pnl.mean()) < 5 * n**0.5 * pnl.std() / 300**0.5
    assert got.total.std() == pytest.approx(n**0.5 * pnl.std(), rel=0.2)
    assert got["mean"].std() == pytest.approx(x[:, 0].std() / n**0.5, rel=0.2)
    assert got.win_rate.mean() == pytest.approx(x[:, 2].mean(), abs=0.005) and got.sharpe.mean() == pytest.approx(x[:, 0].mean() / x[:, 0].std(), rel=0.1)
    assert backtest.PATHS == 10_000 and backtest.MOST_TRADES == 100_000
    one = backtest.monte_carlo(spark.range(100_500).select(F.lit(1.0).alias("net"), F.lit(2).alias("contracts"), F.lit(True).alias("won")), 1).first()
    assert one["total"] == 200_000 and one["win_rate"] == 1 and one["sharpe"] == 0
    assert backtest.monte_carlo(r.limit(0), 2).count() == 2


def test_tokens(spark):
    m = spark.createDataFrame([("m1", '["t1","t2"]', '["1","0"]', True), ("m2", '["u1","u2"]', '["0.6","0.4"]', True), ("m3", '["v1","v2"]', "[]", True), ("m4", '["w1","w2"]', "bad", True), ("m5", '["x1"]', '["1"]', False)],
                              "id string, clob_token_ids string, outcome_prices string, closed boolean")
    strict = {r["token_id"]: r["won"] for r in token_resolution(m, "strict").collect()}
    lenient = {r["token_id"]: (r["resolved"], r["won"]) for r in token_resolution(m, "lenient").collect()}
    assert strict == {"t1": True, "t2": False}
    assert lenient["t1"] == (True, True) and lenient["u1"] == lenient["u2"] == (True, False) and lenient["v1"][0] is False and lenient["w1"][0] is False and "x1" not in lenient


def test_text_helpers(spark):
    t = spark.createDataFrame([(None,), ("",), ("abc",), ("NFLGAME-25",), ("KXBTCD-1",)], "t string")
    assert [r[0] for r in t.select(fx.category(C("t"))).collect()] == ["independent"] * 3 + ["NFLGAME", "KXBTCD"]
    t = spark.createDataFrame([("X-T85000",), ("X-T87249.99",), ("X-B12",), ("TOM",)], "t string")
    assert [r[0] for r in t.select(threshold_of(C("t"))).collect()] == [85000.0, 87249.99, None, None]
    t = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("2024-01-01T10:00:00.123456789Z",), ("2024-01-01T10:00:00.5+02:00",), ("x",)], "t string")
    assert [r[0] is None for r in t.select(ingest.parse_timestamp(C("t"))).collect()] == [False, False, False, True]


def test_set_similarity_join_against_all_pairs(spark):
    import random

    r = random.Random(1)
    sets = {i: frozenset(r.sample("abcdefghij", r.randint(1, 7))) for i in range(120)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<string>")
    got = {(x["a"], x["b"]) for x in semantic.set_similarity_join(df, "id", "w").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want


def test_exact_pairs_in_blocks(spark):
    x = np.random.default_rng(2).standard_normal((60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] >= 0.7}
    assert {(r["a"], r["b"]) for r in semantic.exact_pairs(df, 0.7, 16).collect()} == want


def test_label_propagation(spark):
    e = [(a, b, 1.0) for g in (range(4), range(10, 14)) for a in g for b in g if a < b] + [(3, 10, 0.1)]
    labels = {r["node"]: r["label"] for r in label_propagation(spark.createDataFrame(e, "a long, b long, weight double")).collect()}
    assert {labels[i] for i in range(4)} == {0} and {labels[i] for i in range(10, 14)} == {10}


def test_statistics():
    from pmx import stats

    assert stats.isotonic_falling(np.array([0.9, 0.7, 0.75, 0.3, 0.35, 0.05])) == pytest.approx([0.9, 0.725, 0.725, 0.325, 0.325, 0.05])
    a = np.array([0, 1, 0, 0, -1, 0, 0, 2, 0, 0.0])
    assert stats.cross_correlation_peak(a, np.roll(a, 2)) == (-2, pytest.approx(0.985714, abs=1e-6))
    assert stats.cross_correlation_peak(a, np.roll(a, 2), fixed=True)[0] == 2
    assert stats.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    x = np.linspace(-2, 2, 9)
    f = stats.fit_survival(x, stats.normal_survival((x - 0.3) / 0.8))
    assert f["mu"] == pytest.approx(0.3, abs=0.01) and f["sigma"] == pytest.approx(0.8, abs=0.02)
    r = np.random.default_rng(0)
    lead = r.standard_normal(400)
    follow = np.roll(lead, 2) + 0.1 * r.standard_normal(400)
    assert stats.granger(lead, follow, 4)[0] < 1e-6 < stats.granger(follow, lead, 4)[0]


def test_lead_lag_finds_a_lead_of_more_than_four_bars(spark, monkeypatch):
    from pmx.plans import surfaces

    r = np.random.default_rng(3)
    a, b = r.standard_normal(400), r.standard_normal(400)
    for t in range(8, 400):  # b is led by a by 8; a follows b by 6, which is the peak and sets the direction
        b[t] += 0.5 * a[t - 8]
        a[t] = b[t - 6] + 0.3 * a[t]
    rows = [("a", "b", h, float(x), float(y)) for h, (x, y) in enumerate(zip(a, b, strict=True))]
    monkeypatch.setattr(surfaces, "aligned", lambda *_: spark.createDataFrame(rows, "a string, b string, h long, ra double, rb double"))
    got = surfaces.t5_lead_lag(spark, "").first()
    assert got["peak_lag"] == 6 and got["granger_lag"] >= 8 and got["granger_p"] < 1e-6


def test_tails(spark):
    from pmx.stats import normal_two_sided, student_two_sided

    r = spark.range(1).select(normal_two_sided(F.lit(1.96)).alias("z"), student_two_sided(F.lit(2.0), F.lit(60.0)).alias("t")).first()
    assert r["z"] == pytest.approx(0.05, abs=1e-4) and r["t"] == pytest.approx(0.05, abs=1e-3)


def test_ingest_helpers(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    waits = []
    assert ingest.with_retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    assert len(list(ingest.read_range(ingest.offline_logs, 0, 1000))) == 2000
    p = tmp_path / "c.json"
    p.write_text('{"0xAB": {"collateral_address": "0x1", "collateral_symbol": "USDC"}}')
    assert [tuple(r) for r in ingest.collateral(spark, str(p)).collect()] == [("0xab", "0x1", "USDC")]
    s = spark.createDataFrame([(0, 0), (10, 25), (2500, 10_000)], "block_number long, ts long")
    got = {r["block_number"]: r["ts"] for r in ingest.interpolate_blocks(s).collect()}
    assert len(got) == 2501 and got[3] == 7 and got[10] == 25 and got[2500] == 10_000


def test_sinks_and_runner(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert append_new(df, path, "k") == 2 and append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, "k") == 1
    assert write_table(df, str(tmp_path / "p"), ["v"]) == 3
    assert latest(spark.createDataFrame([(1, 1), (1, 5)], "k int, t int"), "k", "t").collect()[0]["t"] == 5
    made = []

    def make(name, n):
        def f(s, inputs):
            made.append(name)
            return s.range(n) if not inputs else next(iter(inputs.values()))

        return f

    run = Runner(spark, str(tmp_path / "run"), [Dataset("b", make("b", 0), ["a"]), Dataset("a", make("a", 3))])
    assert run.run() == {"a": 3, "b": 3} and made == ["a", "b"]
    assert run.run(["b"]) == {"a": 3, "b": 3} and made == ["a", "b"]
    run.run(["b"], force=True)
    assert made == ["a", "b", "a", "b"]


def test_streaming_bars_equal_batch(spark, trades, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    both = trades.unionByName(trades.limit(2))  # repeated trades
    both.write.parquet(src)
    stream = stream_bars(spark.readStream.schema(both.schema).parquet(src))
    q = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    final = {(r["ticker"], r["bar_start"]): tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {(r["ticker"], r["bar_start"]): tuple(r) for r in stream_bars(trades).collect()}
    assert final and all(batch[k] == v for k, v in final.items())


def test_busy_answers_are_tried_again_and_others_are_not():
    answers, waits = [429, 503, None], []

    def call():
        status = answers.pop(0)
        if status:
            raise ingest.HttpStatus(status)
        return "ok"

    assert ingest.with_retry(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    answers[:] = [404, None]
    with pytest.raises(ingest.HttpStatus):
        ingest.with_retry(call, sleep=waits.append)
    assert answers == [None] and len(waits) == 2


def test_injected_providers(spark, tmp_path):
    module = tmp_path / "own_service.py"
    module.write_text("""
from pmx.sources.ingest import RangeTooLarge

def pages(cursor):
    return ([(f"m{cursor or 0}", 1.5)], None if cursor == "2" else str(int(cursor or 0) + 1))

def blocks(start, end):
    if end - start > 3:
        raise RangeTooLarge
    return [(b, f"0x{b}") for b in range(start, end)]
""")
    spark.sparkContext.addPyFile(str(module))
    ingest.register_sources(spark)
    own = spark.read.format("pmx_markets").schema("id string, price double").option("provider", "own_service:pages")
    assert sorted(own.load().collect()) == [("m0", 1.5), ("m1", 1.5), ("m2", 1.5)]
    assert sorted(own.option("cursor", "2").load().collect()) == [("m2", 1.5)]
    logs = spark.read.format("pmx_chain_logs").schema("block long, pool string").options(provider="own_service:blocks", start="0", end="20", step="8").load()
    assert sorted(r["block"] for r in logs.collect()) == list(range(20))
    with pytest.raises(ValueError):
        ingest.provider({"provider": "own_service"}, None)


def test_pools(spark):
    markets = spark.createDataFrame(
        [("1", "0XAa", '["1","0"]', True), ("2", "0xBB", '["0","1"]', True), ("3", "0xcc", '["0","1"]', True), ("4", "0xdd", '["0.6","0.4"]', True), ("5", "0xee", '["1","0"]', False), ("6", None, '["1","0"]', True),
         ("7", "0xff", None, True), ("8", "0xab", '["0.005","0.995"]', True)],
        "id string, market_maker_address string, outcome_prices string, closed boolean")
    listed = spark.createDataFrame([(a, "USDC") for a in ("0xaa", "0xBB", "0xdd", "0xee", "0xff", "0xab")] + [("0xcc", "WETH")], "fpmm_address string, collateral_symbol string")
    pools = pool_resolution(markets, listed)
    assert sorted(map(tuple, pools.collect())) == [("0xaa", 0), ("0xab", 1), ("0xbb", 1)]
    trades = spark.createDataFrame([("0xAA", "30", "100", 0), ("0xbb", "255", "1000", 0), ("0xbb", "1", "0", 0), ("0xcc", "1", "2", 1), ("0xaa", None, "5", 0)],
                                   "fpmm_address string, amount string, outcome_tokens string, outcome_index int")
    got = sorted((r["price"], r["won"]) for r in pool_positions(trades, pools).filter("price IS NOT NULL").collect())
    assert got == [(26, False), (30, True), (70, False), (75, True)]  # halves go up: 25.5 and 74.5
    fills = spark.createDataFrame([("0", "A", 40.0, 100.0), ("B", "0", 50.0, 10.0), ("0", "A", 0.0, 5.0), ("0", "Z", 1.0, 2.0)], "maker_asset_id string, taker_asset_id string, maker_amount double, taker_amount double")
    tokens = spark.createDataFrame([("A", True), ("B", False)], "token_id string, won boolean")
    assert sorted(map(tuple, token_positions(fills, tokens).collect())) == [(20, False), (40, True), (60, False), (80, True)]
