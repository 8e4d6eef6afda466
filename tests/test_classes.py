"""Copies are classes: joins and clusters over them never make the pairs of equal rows, and lose no link between different ones."""

import itertools
import random

from pmx.operators.density import density_clusters


def test_density_of_copies_is_that_of_every_one(spark):
    r = random.Random(4)
    n = {k: r.choice([1, 1, 2, 3, 6, 9]) for k in range(30)}
    at = {k: (k % 5 * 3 + r.gauss(0, 0.5), k % 3 * 4 + r.gauss(0, 0.5)) for k in n}
    far = lambda a, b: round(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, 6)
    pairs = [(100 * a, 100 * b, far(a, b)) for a, b in itertools.combinations(n, 2) if far(a, b) < 2.5]
    every = [100 * k + i for k in n for i in range(n[k])]
    known = {(a, b): d for a, b, d in pairs}
    whole = [(a, b, 0.0 if a // 100 == b // 100 else known[a // 100 * 100, b // 100 * 100]) for a, b in itertools.combinations(every, 2) if a // 100 == b // 100 or (a // 100 * 100, b // 100 * 100) in known]
    schema = "a long, b long, distance double"
    want = {x["node"]: x["cluster"] for x in density_clusters(spark.createDataFrame(whole, schema), 5, 4, 3.0).collect()}
    copies = spark.createDataFrame([(100 * k, m) for k, m in n.items()], "node long, n long")
    got = {x["node"]: x["cluster"] for x in density_clusters(spark.createDataFrame(pairs, schema), 5, 4, 3.0, copies=copies).collect()}
    assert {100 * k + i: got[100 * k] for k in n if 100 * k in got for i in range(n[k])} == want
    assert len(set(want.values())) > 3


def repeated_parts(spark, sf, folder, times):
    from pyspark.sql import functions as F

    part = spark.read.parquet(f"{sf}/part.parquet")
    n = part.count()
    part.crossJoin(spark.range(times).withColumnRenamed("id", "i")).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * n).drop("i").write.parquet(f"{folder}/part.parquet")
    return n * times


def test_title_queries_grow_with_the_titles(spark, sf, tmp_path):
    from pmx import registry

    few, many = (repeated_parts(spark, sf, str(tmp_path / str(k)), k) for k in (1, 4))
    q = registry.queries()
    one, four = ([q[name](spark, str(tmp_path / k)).count() for name in ("t9a_title_pairs", "t9a_title_vectors", "t9a_title_clusters")] for k in ("1", "4"))
    assert four[0] - one[0] == many - few == 3 * few  # a row for each further market, not for each pair of copies
    assert (one[1], four[1]) == (few, many) and four[2] == many  # every market has copies now
    recall = q["t9a_index_recall"](spark, str(tmp_path / "4")).first()
    assert recall["rows"] < few and recall["recall"] >= 0.9


def test_keyword_pairs_grow_with_the_markets(spark, sf, tmp_path):
    import duckdb
    from pmx import registry

    n = repeated_parts(spark, sf, str(tmp_path), 4)
    got = {tuple(r) for r in registry.queries()["keyword_jaccard"](spark, str(tmp_path)).select("a", "b", "shared", "jaccard").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == set(con.execute(registry.oracle_sql()["keyword_jaccard"]).fetchall())
    assert 3 * n / 4 <= len(got) < n  # not the pairs of copies
