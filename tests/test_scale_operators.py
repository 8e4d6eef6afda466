"""Operators made for hot keys and large groups: quantiles, running values by segments, ranges, patterns, vectors and their index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_exact_quantiles(spark, monkeypatch):
    from pmx.operators import quantiles

    r = random.Random(1)
    groups = {"normal": [r.gauss(0, 1) for _ in range(500)], "ties": [float(r.randint(0, 3)) for _ in range(300)], "one": [7.5], "same": [2.0] * 50, "wide": [10.0 ** r.randint(-6, 6) * r.choice([-1, 1]) for _ in range(120)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("normal", None), ("nothing", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").cache()
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for rows_a_pass in (65_536, 1_000):  # many bins, or few and more passes
        monkeypatch.setattr(quantiles, "HISTOGRAM_ROWS", rows_a_pass)
        got = quantiles.exact_quantiles(df, "v", qs, "g")
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert got[g] == pytest.approx(np.quantile(vs, qs), rel=1e-12)
    every = [v for vs in groups.values() for v in vs]
    assert quantiles.exact_quantiles(df, "v", [0.5, 0.95])[None] == pytest.approx(np.quantile(every, [0.5, 0.95]), rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "v", qs) == {}
    monkeypatch.setattr(quantiles, "MOST_GROUPS", 2)
    with pytest.raises(ValueError, match="groups"):
        quantiles.exact_quantiles(df, "v", qs, "g")


def test_segmented_against_one_window(spark):
    from pyspark.sql import Window as W

    from pmx.operators.prefix import segmented

    r = random.Random(2)
    rows = [(k, t, i, r.choice([None, *range(-5, 6)])) for i, (k, t) in enumerate((r.choice("aaaab"), r.randint(0, 60)) for _ in range(300))]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    w = W.partitionBy("k").orderBy("t", "i")
    want = df.select("*", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).cast("long").alias("n"), F.lag("v").over(w).alias("p"), F.lead("t").over(w).alias("q"))
    got = segmented(df, ["k"], F.floor(F.col("t") / 7), ["t", "i"], {"s": F.col("v")}, "n", {"p": F.col("v")}, {"q": F.col("t")})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and plan.count("Sort [k#") >= 1


@pytest.mark.parametrize(("before", "after"), [(-9, 9), (1, 50), (-3, 0)])
def test_range_sums(spark, before, after):
    from pmx.operators.ranges import range_sums

    r = random.Random(3)
    rows = [(k, b, r.randint(1, 9)) for k in "ab" for b in r.sample(range(-60, 200), 90)]
    df = spark.createDataFrame(rows, "k string, b long, n long")
    got = range_sums(df, ["k"], "b", before, after, {"s": F.sum("n"), "hi": F.max("n")}, size=16).collect()
    assert len(got) == len(rows)
    for x in got:
        inside = [n for k, b, n in rows if k == x["k"] and x["b"] + before <= b <= x["b"] + after]
        assert (x["s"], x["hi"]) == ((sum(inside), max(inside)) if inside else (None, None))


def test_coordinated_trades_against_pairs(spark):
    from pmx.plans.addresses import coordinated, follow_ups

    r = random.Random(4)
    rows = list({(c, t, d, a, b): (c, t, d, a, b, r.randint(1, 3)) for c, t, d, a, b in ((r.choice("xy"), r.choice("tu"), r.choice(["buy", "sell"]), f"0x{r.randint(0, 5)}", r.randint(0, 120)) for _ in range(260))}.values())
    linked = spark.createDataFrame(rows, "cluster string, token_id string, direction string, address string, block_number long, n long")
    want, lags = {}, {}
    for c, t, d, a, b, n in rows:
        for c2, t2, d2, a2, b2, n2 in rows:
            if (c, t) == (c2, t2):
                if d == d2 and a < a2 and abs(b - b2) < 10:
                    w = want.setdefault((c, t, d), [0, set(), set(), b])
                    w[0] += n * n2
                    w[1].add(a)
                    w[2].add(a2)
                    w[3] = min(w[3], b)
                if a != a2 and b < b2 <= b + 50:
                    x = lags.setdefault((c, t), [0, 0])
                    x[0] += n * n2
                    x[1] += n * n2 * (b2 - b)
    got = {tuple(x[:3]): (x["pairs"], x["distinct_addresses"], x["first_block"]) for x in coordinated(linked).filter("pairs > 0").collect()}
    assert got == {k: (p, len(a) + len(b), first) for k, (p, a, b, first) in want.items()}
    assert {tuple(x[:2]): (x["follow_ups"], x["avg_lag"]) for x in follow_ups(linked).collect()} == {k: (n, round(m / n, 6)) for k, (n, m) in lags.items()}


def test_first_pattern_against_a_plain_scan(spark, tmp_path):
    from pmx.operators.patterns import first_match, read_patterns

    r = random.Random(5)
    patterns = ["".join(r.choices("ABC", k=r.randint(1, 4))) for _ in range(500)]
    (tmp_path / "p.csv").write_text("place,pattern,grp,category,subcategory\n" + "".join(f"{i},{p},g{i % 5},c{i},s\n" for i, p in enumerate(patterns)))
    table = read_patterns(spark, str(tmp_path / "p.csv"))
    texts = [None, "", "zzz", *["".join(r.choices("abcdX", k=r.randint(0, 7))) for _ in range(200)]]
    got = first_match(spark.createDataFrame([(t,) for t in texts], "t string"), "t", table).collect()
    first = lambda t: next((i for i, p in enumerate(patterns) if t and p in t.upper()), None)
    assert sorted((str(x["t"]), str(x["place"]), str(x["category"])) for x in got) == sorted((str(t), str(first(t)), str(None if first(t) is None else f"c{first(t)}")) for t in texts)
    none = table.limit(0)
    assert first_match(spark.createDataFrame([("a",)], "t string"), "t", none).collect()[0]["place"] is None


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)


def test_moments_and_components_against_numpy(spark):
    from pmx.operators.vectors import moments, principal_components, project

    r = np.random.default_rng(6)
    x = r.normal(size=(200, 8)) @ np.diag([5, 3, 2, 1, 1, 0.5, 0.2, 0.1]) + 3
    v = vectors(spark, x)
    n, mean, cov = moments(v, "v")
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    mean, parts, values = principal_components(v, "v", 3)
    want = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(values, want[0][::-1][:3])
    assert np.allclose(np.abs((parts * want[1].T[::-1][:3]).sum(1)), 1) and (parts[np.arange(3), np.abs(parts).argmax(1)] > 0).all()
    got = {a["id"]: a["vector"] for a in project(v, "id", "v", mean, parts, unit=False).collect()}
    assert np.allclose([got[i] for i in range(200)], (x - x.mean(0)) @ parts.T)
    assert moments(v.limit(0), "v")[0] == 0


def test_hashed_tfidf(spark):
    from pmx.operators.vectors import hashed_tfidf

    rows = [(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "a", "c"]), (4, [])]
    got = {r["id"]: np.array(r["vector"]) for r in hashed_tfidf(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", 64).collect()}
    assert set(got) == {1, 2, 3} and (got[1] == got[2]).all() and len(got[1]) == 64
    assert sorted(np.abs(got[3][got[3] != 0])) == pytest.approx(sorted([(1 + np.log(2)) * (np.log(5 / 4) + 1), np.log(5 / 2) + 1]))


def test_index_finds_planted_neighbours(spark, monkeypatch):
    """Recall of 0.9 or more at under a tenth of all pairs compared; what is found is exact."""
    from pmx.operators import vectors as o

    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 24))
    x = np.concatenate([c + 0.25 * r.normal(size=(30, 24)) for c in centres])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(s >= 0.85, 1)))}
    monkeypatch.setattr(o, "BLOCK", 16)  # several blocks a cell
    v = vectors(spark, x)
    blocks = o.index_blocks(v, "id", "v", o.fit_cells(v, "id", "v"), 2)
    got = {(p["a"], p["b"]): p["cosine"] for p in o.near_pairs(blocks, 0.85).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    assert all(abs(s[k] - c) < 1e-9 for k, c in got.items())
    assert o.compared(blocks).first()[0] < 0.1 * len(x) * (len(x) - 1) / 2
    assert max(len(b["ids"]) for b in blocks.select("ids").collect()) <= 64
    every = o.approximate_pairs(v, "id", "v", 0.85, probes=40).count()  # all cells probed: all pairs
    assert every == len(want)
    assert o.approximate_pairs(v.limit(0), "id", "v", 0.85, 2).count() == 0


def test_titles_index_recall(spark, sf):
    from pmx import registry

    row = registry.queries()["t9a_index_recall"](spark, sf).first()
    assert row["pairs"] > 0 and row["recall"] >= 0.9


def test_student_fit_is_the_greatest_likelihood(spark):
    from math import lgamma, log, pi

    from pmx.operators.distributions import fit_student, kolmogorov, student_cdf, value_counts
    from pmx.stats import beta_fraction

    r = np.random.default_rng(8)
    x = np.round(1.5 + 2 * r.standard_t(4, 4000), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    counts = value_counts(df, "v")
    t = fit_student(counts)

    def like(d, m, s):
        z = (x - m) / s
        return len(x) * (lgamma((d + 1) / 2) - lgamma(d / 2) - 0.5 * log(d * pi) - log(s)) - (d + 1) / 2 * np.log1p(z * z / d).sum()

    top = like(t["df"], t["loc"], t["scale"])
    assert t["log_likelihood"] == pytest.approx(top)
    h = 1e-4
    for k, v in (("df", t["df"]), ("loc", 1.0), ("scale", t["scale"])):
        up, down = (like(*({**{c: t[c] for c in ("df", "loc", "scale")}, k: t[k] + s * h * v}.values())) for s in (1, -1))
        assert abs((up - down) / (2 * h)) < 1e-3 and up < top and down < top  # no slope, and a top
    assert 3 < t["df"] < 5.5 and abs(t["loc"] - 1.5) < 0.2 and abs(t["scale"] - 2) < 0.2
    d, p = kolmogorov(counts, student_cdf(t["df"], t["loc"], t["scale"]))
    s = np.sort(x)
    z = (s - t["loc"]) / t["scale"]
    tail = np.array([0.5 * beta_fraction(t["df"] / 2, 0.5, t["df"] / (t["df"] + v * v)) for v in z])
    f = np.where(z > 0, 1 - tail, tail)
    share = np.searchsorted(s, s, "right") / len(s), np.searchsorted(s, s, "left") / len(s)
    assert d == pytest.approx(max(np.abs(share[0] - f).max(), np.abs(share[1] - f).max())) and p > 0.2
    assert fit_student(value_counts(df.filter("v > 1e9"), "v")) is None


def test_shapiro_wilk():
    from pmx.operators.distributions import shapiro_wilk

    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])  # a published example
    assert w == pytest.approx(0.7888, abs=2e-4) and p == pytest.approx(0.0067, abs=2e-4)
    r = np.random.default_rng(9)
    ps = [shapiro_wilk(r.normal(size=200))[1] for _ in range(200)]
    assert 0.01 < np.mean(np.array(ps) < 0.05) < 0.12
    assert shapiro_wilk(r.exponential(size=200))[1] < 1e-6 and shapiro_wilk([1, 1, 1]) == (1.0, 1.0)
