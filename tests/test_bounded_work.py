"""Work that stays bounded as tables grow: a worker's blocks of vectors, rounds without shuffles."""

import numpy as np
from pyspark.sql import functions as F


def _plan(df):
    """The executed plan, without what made the tables that it reads from the executors' disks."""
    df.collect()
    lines, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n"):
        at = len(line) - len(line.lstrip(" +-:*("))
        if skip is not None and at > skip:
            continue
        skip = at if "InMemoryRelation" in line else None
        lines.append(line)
    return "\n".join(lines)


def test_exact_pairs_group_by_group(spark):
    """A worker gets one pair of blocks at a time, blocks without a vector among them, and finds the pairs of brute force."""
    from pmx.plans.semantic import exact_pairs

    r = np.random.default_rng(4)
    x = r.standard_normal((150, 6))
    vectors = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    want = {(7 * i, 7 * j): s[i, j] for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.3}
    for block, rows in ((4096, 512), (16, 5), (1, 1)):
        pairs = exact_pairs(vectors.limit(150 if block > 1 else 20), 0.3, block, rows)
        got = pairs.collect()
        part = want if block > 1 else {k: v for k, v in want.items() if max(k) < 140}
        assert {(p["a"], p["b"]) for p in got} == set(part) and len(got) == len(part)
        assert all(abs(p["cosine"] - part[p["a"], p["b"]]) < 1e-9 for p in got)
        assert "FlatMapGroupsInArrow" in _plan(pairs) and "MapInArrow(" not in _plan(pairs).replace("GroupsInArrow", "")
    assert exact_pairs(vectors.limit(0), 0.3).collect() == []


def test_rounds_over_links_by_node_do_not_shuffle(spark):
    from pmx.operators.graph import by_node

    links = by_node(spark.range(400).select((F.col("id") % 20).alias("node"), (F.col("id") % 33).alias("other"), F.lit(1.0).alias("weight")))
    assert links.count() == 400  # kept from here on
    labels = spark.range(33).select(F.col("id").alias("other"), (F.col("id") % 4).alias("label"))
    votes = links.join(F.broadcast(labels), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("node").agg(F.max_by("label", "w"))
    text = _plan(best)
    links.unpersist()
    assert "InMemoryTableScan" in text and "hashpartitioning" not in text


def test_moves_over_links_by_node_do_not_shuffle_links(spark):
    """A round looks at each node's communities without a shuffle of links, at those of a node without links too."""
    from pmx.operators.graph import _WEIGHT, _moves, by_node, checkpointed

    pairs = [(i, j, 1.0) for i in range(200) for j in range(200) if i != j] + [(i, i, 0.0) for i in range(201)]  # links are the larger table, as they are in a graph
    links = by_node(spark.createDataFrame(pairs, "node long, other long, w double").select("node", "other", F.col("w").cast(_WEIGHT).alias("w")))
    assert links.count() == len(pairs)  # kept from here on
    nodes = checkpointed(spark.range(201).select(F.col("id").alias("node"), F.lit(199).cast(_WEIGHT).alias("k"), F.lit(0).cast(_WEIGHT).alias("loop"), F.col("id").alias("c")))
    moved = _moves(links, nodes, 200 * 199.0, 0)
    text, got = _plan(moved), {r["node"]: r for r in moved.collect()}
    links.unpersist()
    assert "hashpartitioning(node" not in text and "hashpartitioning(other" not in text and "hashpartitioning(oc" not in text
    assert len(got) == 201 and got[200]["to"] == 200 and not got[200]["wish"] and got[200]["own_in"] == 0


def test_gaps_are_filled_after_the_shuffle(spark):
    """Only buckets with trades are shuffled and sorted, however many empty ones lie between them."""
    from pmx.operators.timegrid import gap_filled

    rows = [("A", "2024-01-01 00:00:00", 5, 7, 4, 6, 3, 1, 2, 5.5), ("A", "2024-01-01 00:15:00", None, None, None, None, None, None, 1, None), ("A", "2024-01-01 00:25:00", 8, 8, 8, 8, 1, 1, 1, 8.0), ("B", "2024-01-01 00:00:00", 1, 1, 1, 1, 1, 1, 1, 1.0)]
    b = spark.createDataFrame(rows, "ticker string, t string, open int, high int, low int, close int, volume long, net_flow long, trade_count long, vwap double").withColumn("bar_start", F.to_timestamp_ntz("t")).drop("t")
    filled = gap_filled(b, "INTERVAL 5 MINUTES")
    text = _plan(filled)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text and text.index("Generate") < text.index("Exchange")  # the plan is written from its end
    got = [tuple(r)[2:] for r in filled.filter("ticker = 'A'").orderBy("bar_start").collect()]
    gap, quiet = (6, 6, 6, 6, 0, 0, 0, None, 0, 0), (6, 6, 6, 6, 0, 0, 1, None, 0, 0)
    assert got == [(5, 7, 4, 6, 3, 1, 2, 5.5, None, 3), gap, gap, quiet, gap, (8, 8, 8, 8, 1, 1, 1, 8.0, 2, 0)]
    assert filled.filter("ticker = 'B'").count() == 1


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks grow with the rows, whatever the session's partitions; hot keys are those with more rows than the bound, and go their own way."""
    from pmx.operators import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    monkeypatch.setattr(dealing, "HOT_ROWS", 40)
    df = spark.range(200).select(F.when(F.col("id") < 100, "a").otherwise(F.col("id").cast("string")).alias("k"))
    assert dealing.dealt(df, 2000, "k").rdd.getNumPartitions() == 201
    assert "Exchange" not in _plan(dealing.dealt(df, 5, "k"))
    hot = dealing.hot_keys(df, "k")
    assert [tuple(r) for r in hot.collect()] == [("a",)]
    assert dealing.hot_keys(df.filter("k != 'a'"), "k") is None
    got = dealing.by_heat(df, hot, "k", lambda x: x.withColumn("w", F.lit(1)), lambda x: x.withColumn("w", F.lit(2))).groupBy("w").count().collect()
    assert dict(map(tuple, got)) == {1: 100, 2: 100}


def test_the_ledger_and_linked_trades_are_shuffled_once(spark, sf):
    """Beside the join of fills, by the ledger's key or by the token; what follows needs no shuffle."""
    from pmx import registry

    for name in ("t3_ledger", "t7_cascade", "t7_sybil"):
        df = registry.queries()[name](spark, sf)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        kinds = {line.split("hashpartitioning(")[1].split("#")[0] for line in text.split("\n") if "hashpartitioning(" in line and "orderkey" not in line}
        assert len(kinds) == 1 and kinds <= {"address", "token_id"}, (name, kinds)


def test_the_index_multiplies_some_rows_at_a_time(spark, monkeypatch):
    """A worker holds the products of ``ROWS`` rows, not of two blocks; pairs are the same."""
    from pmx.operators import vectors as o

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 6)))], "id long, v array<double>")
    got = []
    for rows in (512, 7):
        monkeypatch.setattr(o, "ROWS", rows)
        got.append({(r["a"], r["b"]): round(r["cosine"], 9) for r in o.approximate_pairs(v, "id", "v", 0.5, 2, cells=5).collect()})
    assert got[0] == got[1] and got[0]


def test_overlaps_shuffle_no_pairs(spark, monkeypatch):
    """Pairs are counted in the tasks that read two bands, some at a time; they are those of brute force, of rows that come twice and of groups and keys of one alike."""
    from collections import Counter
    from itertools import combinations

    from pmx.operators import overlap

    rng = np.random.default_rng(11)
    rows = [(f"k{k}", f"g{g}", int(n)) for k, g, n in zip(rng.integers(0, 90, 3000), rng.integers(0, 70, 3000), rng.integers(1, 4, 3000), strict=True)]
    rows += [("alone", "g1", 2**33), ("k1", "nobody else's", 1), (None, "g1", 1)]
    at = {}
    for k, g, n in rows:
        if k:
            at.setdefault(k, Counter())[g] += n
    want = {(a, b): (len(c), sum(at[a][g] * at[b][g] for g in c)) for a, b in combinations(sorted(at), 2) if len(c := at[a].keys() & at[b].keys()) >= 4}
    for size, pairs, pack in ((4000, 2_000_000, 500_000), (1, 50, 100)):
        for c, v in (("LIST", size), ("PAIRS", pairs), ("PACK", pack)):
            monkeypatch.setattr(overlap, c, v, raising=False)
        df = overlap.overlaps(spark.createDataFrame(rows, "k string, g string, n long"), "k", "g", 4)
        got = df.collect()
        assert {(r["a"], r["b"]): (r["shared"], r["weight"]) for r in got} == want and len(got) == len(want) > 1000
        assert "hashpartitioning" not in _plan(df) and "CartesianProduct" in _plan(df)


def _disk(spark, folder, name, vectors):
    """The rows of a query over vectors alone, and the bytes of the tables that it wrote."""
    from pathlib import Path

    from pmx import registry
    from pmx.operators import graph

    vectors.write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    before = len(graph._written)
    rows = registry.queries()[name](spark, str(folder)).collect()
    return rows, sum(f.stat().st_size for path in graph._written[before:] for f in Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_pairs_of_vectors_are_not_written(spark, tmp_path, monkeypatch):
    """Vectors that are all pairs: clusters write labels and no pairs, classified pairs are written once; blocks of any size find the same."""
    from pmx.operators.graph import label_propagation
    from pmx.plans import semantic

    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)) * 0.4 + np.repeat(np.eye(8)[:4] * 2, 100, axis=0)
    vectors = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)] + [(5000, [-1.0] * 8)], "vec_id long, embedding array<float>")
    pairs = semantic.exact_pairs(vectors, 0.3).cache()
    n = pairs.count()
    assert n > 15_000
    want = {tuple(r) for r in label_propagation(pairs.select("a", "b", F.col("cosine").alias("weight"))).collect()}
    found = {(r["a"], r["b"]): r["cosine"] for r in pairs.collect()}
    pairs.unpersist()
    for stripe, cell in ((1024, 4096), (90, 70)):
        for c, v in (("STRIPE", stripe), ("CELL", cell), ("HELD", 500_000 if stripe > 90 else 100)):
            monkeypatch.setattr(semantic, c, v, raising=False)
        rows, size = _disk(spark, tmp_path / str(stripe), "t9a_clusters", vectors)
        assert {tuple(r) for r in rows} == want and len(rows) == len(want) and size < 8 * n
        rows, size = _disk(spark, tmp_path / str(stripe), "t9b_classified", vectors)
        assert len(rows) == n and all(abs(found[r["a"], r["b"]] - r["cosine"]) < 1e-9 for r in rows) and size < 20 * n
    assert semantic.vector_labels(vectors.limit(0), 0.3).count() == 0
