"""Queries without SQL against plain Python over the smallest tables."""

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from pmx import registry
from pmx.operators.graph import label_propagation
from pmx.plans import surfaces
from pmx.plans.semantic import exact_pairs
from pmx.views import k_markets, k_trades

COSINE = 0.3


@pytest.fixture(scope="module")
def pairs(sf):
    """All pairs of vectors over the bound, by one product."""
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x = np.array(e["embedding"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, s = e["vec_id"].to_numpy(), x @ x.T
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])): s[i, j] for i, j in zip(*np.nonzero(np.triu(s >= COSINE, 1)), strict=True)}


def plain_labels(edges, rounds=50):
    """Label propagation by dictionaries: {node: label}, at the first state that comes again."""
    near = defaultdict(dict)
    for (a, b), w in edges.items():
        near[a][b] = near[b][a] = w
    for n in near:
        near[n][n] = max(near[n].values())
    labels, seen = {n: n for n in near}, []
    for _ in range(rounds):
        seen.append(labels)
        new = {}
        for n in near:
            votes = defaultdict(float)
            for o, w in near[n].items():
                votes[labels[o]] += w
            new[n] = min(votes, key=lambda x: (-round(votes[x], 9), x))
        labels = new
        if labels in seen:
            return labels
    raise AssertionError("labels did not settle")


def test_lsh_pairs_have_high_recall_and_no_false_ones(spark, sf, pairs):
    got = {(r["a"], r["b"]): r["cosine"] for r in registry.queries()["t9a_pairs_lsh"](spark, sf).collect()}
    assert len(pairs) > 500
    assert len(got.keys() & pairs.keys()) >= 0.9 * len(pairs)
    assert all(c >= COSINE - 1e-6 for c in got.values())
    assert all(got[k] == pytest.approx(pairs[k], abs=1e-5) for k in got.keys() & pairs.keys())


def test_exact_pairs_over_several_blocks(spark, sf, pairs):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    got = {(r["a"], r["b"]): r["cosine"] for r in exact_pairs(v, COSINE, block=64).collect()}
    assert got.keys() == pairs.keys() and all(got[k] == pytest.approx(pairs[k], abs=1e-9) for k in got)


def test_classified_pairs(spark, sf, pairs):
    got = {(r["a"], r["b"]): r["relation"] for r in registry.queries()["t9b_classified"](spark, sf).collect()}
    assert got == {k: "equivalent" if c >= 0.95 else "correlated" if c >= 0.8 else "unrelated" for k, c in pairs.items()}


def test_clusters(spark, sf, pairs):
    got = {r["node"]: r["label"] for r in registry.queries()["t9a_clusters"](spark, sf).collect()}
    assert got == plain_labels(pairs)


@pytest.mark.parametrize("edges", [
    {(i, i + 1): 1.0 for i in range(40)},  # a long path
    {(0, i): 1.0 for i in range(1, 30)},  # a star
    {(a, b): 1.0 for a in range(6) for b in range(6, 12)},  # two sides, whose labels can swing
    {(1, 2): 0.5},
])
def test_label_propagation_settles(spark, edges):
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, weight double")
    assert {r["node"]: r["label"] for r in label_propagation(df).collect()} == plain_labels(edges)


def test_label_propagation_of_nothing(spark):
    assert label_propagation(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_label_propagation_does_not_end_early(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a long, b long, weight double")
    with pytest.raises(RuntimeError):
        label_propagation(path, 2)


def falling(y):
    """The least-squares non-increasing fit: the smallest over starts of the largest over ends of averages."""
    n = len(y)
    return [min(max(np.mean(y[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize(("coverage", "some"), [(0.1, True), (0.3, True), (0.7, False)])
def test_evolution(spark, sf, coverage, some):
    sf = sf.replace("sf0.001", "sf0.01")  # on the smallest tables no day has enough strikes
    strikes = {(r["event_ticker"], r["threshold"]) for r in surfaces.strikes(spark, sf).collect()}
    event_of = {r["ticker"]: r["event_ticker"] for r in k_markets(spark, sf).collect()}
    last, days = {}, defaultdict(set)
    for r in sorted(k_trades(spark, sf).collect(), key=lambda r: (r["created_time"], r["trade_id"])):
        m = re.search(r"-T(\d+\.?\d*)", r["ticker"])
        key = (event_of[r["ticker"]], float(m[1]))
        last.setdefault(key, {})[r["created_time"].date()] = r["yes_price"]
        days[key[0]].add(r["created_time"].date())
    want = {}
    for event in {e for e, _ in strikes}:
        xs = sorted(t for e, t in strikes if e == event)
        for day in days[event]:
            known = [(t, p[max(u for u in p if u <= day)]) for t in xs if (p := last.get((event, t))) and min(p) <= day]
            if len(known) < 3 or len(known) < coverage * len(xs):
                continue
            x = np.array([t for t, _ in known])
            s = np.clip(falling(np.array([p for _, p in known]) / 100.0), 0, 1)
            p = np.append(s[:-1] - s[1:], s[-1])
            p = p / p.sum()
            mean = (x * p).sum()
            sd = math.sqrt(((x - mean) ** 2 * p).sum())
            want[event, day] = (len(known), mean, sd)
    got = {(r["event_ticker"], r["day"]): (r["strikes"], r["mean"], r["sd"]) for r in surfaces.surface_evolution(spark, sf, coverage).collect()}
    assert got.keys() == want.keys() and (want or not some)
    for k, (n, mean, sd) in want.items():
        assert got[k][0] == n and got[k][1:] == (pytest.approx(mean), pytest.approx(sd, abs=1e-6))


def test_odd_transitions_are_found(spark, tmp_path):
    """Bursts of one time after quiet markets: each odd change of state that can be, with the SQL's rows."""
    import datetime

    import duckdb

    from pmx import registry

    day, rows = datetime.datetime(2024, 1, 1), []

    def price(event, user):
        return 1 + (event * 37 + user * 11) % 99

    def trade(user, hours, wanted):
        event = next(e for e in range(len(rows) * 200, len(rows) * 200 + 200) if wanted(price(e, user)))
        rows.append((event, user, day + datetime.timedelta(hours=hours), "click", 3.0, "{}"))

    mid, edge = (lambda p: 20 < p < 80), (lambda p: p > 90)
    for hours in (1, 40):  # quiet, then a burst at the edge: EARLY_TRADING or NEWLY_LISTED before
        trade(8, hours, mid)
    for _ in range(16):
        trade(8, 60, edge)
    for hours in (1, 2):
        trade(16, hours, mid)
    for _ in range(40):  # new, then a burst in the middle
        trade(16, 3, mid)
    for k in range(7):  # one a day and a half: dormant, then a burst at the edge
        trade(24, 36 * k, mid)
    for _ in range(20):
        trade(24, 36 * 7, edge)
    spark.createDataFrame([(u, f"c{u}", "BUILDING", 1, 1.0) for u in (8, 16, 24)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["t8_anomalies"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["t8_anomalies"])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    assert {"sudden_resolution"} <= {r["transition_type"] for r in got.collect()} and got.count() >= 2


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    from pyspark.sql import functions as F

    from pmx.sources.datasets import in_batches

    done, fail_at = [], 3

    def work(part):
        ids = [r["i"] for r in part.select("i").collect()]
        if len(done) == fail_at:
            raise RuntimeError("the service went away")
        done.append(ids)
        return part.withColumn("out", F.col("i") * 10)

    df = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("i"))
    path = f"{tmp_path}/results"
    with pytest.raises(RuntimeError):
        in_batches(df, ["i"], work, path, 5)
    (tmp_path / "results" / "run-1" / "batch-999999").mkdir()  # half written: no mark
    fail_at = -1
    out = in_batches(df, ["i"], work, path, 5)
    assert sorted((r["i"] or 0, r["out"] or 0) for r in out.collect()) == [(i, 10 * i) for i in range(100)]
    assert sum(len(x) for x in done) == 100 and len(done) == 5  # no row twice
    more = spark.range(90, 120).select(F.col("id").alias("i"))
    assert in_batches(more, ["i"], work, path, 5).count() == 120
    assert sum(len(x) for x in done) == 120
    assert in_batches(more, ["i"], work, path, 5).count() == 120 and sum(len(x) for x in done) == 120
    assert in_batches(df.limit(0), ["i"], work, f"{tmp_path}/none", 8).count() == 0


def test_walk_forward_never_sees_the_future(spark, monkeypatch):
    import datetime

    from pmx.plans import learning

    rows = [(k, datetime.datetime(2024, 1, 1, 5) + datetime.timedelta(hours=7 * k), float(k % 3 == 0), 0.3, float(k % 5)) for k in range(120)]
    table = spark.createDataFrame(rows, "trade_id long, created_time timestamp_ntz, label double, implied double, x double")
    seen = []

    def fit_and_score(train, test, columns, trees=10):
        seen.append((train.count(), trees, columns, train.toPandas()["created_time"].max() < test.toPandas()["created_time"].min()))
        return test.withColumn("p", test["label"] * 0.5 + 0.25 if columns == ["x"] else test["implied"])

    monkeypatch.setattr(learning, "fit_and_score", fit_and_score)
    got = learning.walk_forward(table, 7, {"a": ["implied"], "b": ["x"]}).collect()
    fold = {k: (t - datetime.datetime(2024, 1, 1)).days // 7 for k, t, *_ in rows}
    assert sorted((r["trade_id"], r["fold"], r["choice"]) for r in got) == sorted((k, f, "b") for k, f in fold.items() if f >= 2)
    assert all(before for *_, before in seen) and len(seen) == 3 * (max(fold.values()) - 1)
    assert [n for n, trees, *_ in seen if trees == 10] == [sum(f < k for f in fold.values()) for k in range(2, max(fold.values()) + 1)]
    assert learning.walk_forward(table.limit(0)).count() == 0
