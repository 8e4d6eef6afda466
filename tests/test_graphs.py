"""Communities, spanning forests and density clusters against plain versions."""

import itertools
import random

import pytest

from pmx.operators import density, graph


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight double")


def plain_modularity(edges, label):
    m = sum(w for _, _, w in edges)
    d, inside = {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            d[label[x]] = d.get(label[x], 0) + w
        inside += w * (label[a] == label[b])
    return inside / m - sum(x * x for x in d.values()) / (4 * m * m)


def planted(seed, groups=6, size=12, inner=0.6, outer=0.03):
    r = random.Random(seed)
    n = groups * size
    return [(a, b, float(r.randint(1, 5))) for a, b in itertools.combinations(range(n), 2) if r.random() < (inner if a // size == b // size else outer)]


def labels_of(df):
    return {r["node"]: r["label"] for r in df.collect()}


def test_louvain_finds_planted_communities(spark):
    edges = planted(1)
    t = edge_table(spark, edges)
    got, other = labels_of(graph.louvain(t)), labels_of(graph.label_propagation(t))
    assert got == {n: n // 12 * 12 for n in range(72)}
    assert plain_modularity(edges, got) >= plain_modularity(edges, other) - 1e-9
    table = spark.createDataFrame(list(got.items()), "node long, label long")
    assert graph.modularity(t, table).first()[0] == pytest.approx(plain_modularity(edges, got), abs=1e-12)


def test_louvain_against_the_best_partition(spark):
    """Random graphs of 7 nodes: near the best of all partitions."""

    def partitions(n):
        def grow(i, label, k):
            if i == n:
                yield dict(enumerate(label))
                return
            for x in range(k + 1):
                yield from grow(i + 1, [*label, x], max(k, x + 1))

        return grow(0, [], 0)

    all_of = list(partitions(7))
    graphs = []
    for seed in range(2):
        r = random.Random(seed)
        graphs.append([(a, b, float(r.randint(1, 9))) for a, b in itertools.combinations(range(7), 2) if r.random() < 0.45] + [(0, 1, 1.0)])
    for g in graphs:
        g = list({(a, b): (a, b, w) for a, b, w in g}.values())
        got = labels_of(graph.louvain(edge_table(spark, g)))
        for n in range(7):
            got.setdefault(n, n)
        best = max(plain_modularity(g, p) for p in all_of)
        assert plain_modularity(g, got) >= best - 0.05


def test_louvain_edges(spark):
    assert graph.louvain(edge_table(spark, [])).count() == 0
    assert labels_of(graph.louvain(edge_table(spark, [(5, 5, 1.0)]))) == {5: 5}
    assert labels_of(graph.louvain(edge_table(spark, [(3, 9, 1.0), (3, 9, 2.0), (4, 4, 2.0)]))) == {3: 3, 9: 3, 4: 4}


def kruskal(edges):
    up, out = {}, []

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            up[x] = y
            out.append((a, b, w))
    return out


def test_spanning_forest_against_kruskal(spark):
    for seed in range(1):
        r = random.Random(seed)
        edges = [(a, b, float(r.randint(1, 4))) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.08 and (a < 30) == (b < 30)] + [(50, 50, 1.0)]
        got = graph.spanning_forest(edge_table(spark, edges)).collect()
        assert sorted(map(tuple, got)) == sorted(kruskal([e for e in edges if e[0] != e[1]]))


def plain_density(pairs, smallest, samples, beyond, single=False):
    """From above: the tree of single linkage is cut edge by edge, heaviest first."""
    near = {}
    for a, b, d in pairs:
        near.setdefault(a, []).append(d)
        near.setdefault(b, []).append(d)
    k = max(samples - 1, 1)
    core = {n: sorted(x)[k - 1] if len(x) >= k else beyond for n, x in near.items()}
    tree = sorted((w, a, b) for a, b, w in kruskal([(a, b, max(d, core[a], core[b])) for a, b, d in pairs]))
    stability, children, cluster_of, names = {}, {}, {}, itertools.count()

    def halves(nodes, edges):
        """Without the heaviest edge: the two sides, with their edges."""
        *rest, (w, a, b) = edges
        side, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for _, p, q in rest:
                for y, z in ((p, q), (q, p)):
                    if y == x and z not in side:
                        side.add(z)
                        todo.append(z)
        return w, [(s, [e for e in rest if e[1] in s]) for s in (side, nodes - side)]

    def descend(nodes, edges, me, birth):
        while True:
            if not edges:
                return
            w, parts = halves(nodes, edges)
            rate = 1 / max(w, 1e-9)
            big = [p for p in parts if len(p[0]) >= smallest]
            if len(big) == 2:
                stability[me] += len(nodes) * (rate - birth)
                for part in big:
                    child = next(names)
                    stability[child], children[child] = 0.0, []
                    children[me].append(child)
                    descend(*part, child, rate)
                return
            for part in parts:
                if part not in big:
                    stability[me] += len(part[0]) * (rate - birth)
                    cluster_of.update(dict.fromkeys(part[0], me))
            if not big:
                return
            nodes, edges = big[0]

    up, comps = {n: n for n in near}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, a, b in tree:
        up[find(a)] = find(b)
    for n in near:
        comps.setdefault(find(n), set()).add(n)
    roots = []
    for nodes in comps.values():
        if len(nodes) >= smallest:
            me = next(names)
            stability[me], children[me] = 0.0, []
            roots.append(me)
            descend(nodes, [e for e in tree if e[1] in nodes], me, 0.0)
    chosen = set()

    def best(c):
        below = sum(best(x) for x in children[c])
        if stability[c] >= below - 1e-12:
            chosen.add(c)
            return stability[c]
        return below

    for c in roots:
        best(c)
    if len(roots) == 1 and not single:
        chosen -= set(roots)
    parent = {x: c for c, xs in children.items() for x in xs}
    top = {}
    for n in near:
        c, t = cluster_of.get(n), None
        while c is not None:
            t = c if c in chosen else t
            c = parent.get(c)
        top[n] = t
    least = {}
    for n in sorted(near):
        least.setdefault(top[n], n)
    return {n: None if top[n] is None else least[top[n]] for n in near}


def density_cases(seeds=(1, 2)):
    for seed in seeds:
        r = random.Random(seed)
        spread = (0.3, 0.02, 1.0, 0.5, 0.1)[seed]
        points = [(k % 4 * 3 + r.gauss(0, spread), k % 3 * (seed + 1) + r.gauss(0, spread)) for k in range(60)]
        pairs = [(a, b, round(((points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2) ** 0.5, 6)) for a, b in itertools.combinations(range(60), 2)]
        yield [p for p in pairs if p[2] < (1.5, 9, 2.5, 9, 1.2)[seed]]


def test_density_clusters_against_a_plain_version(spark, monkeypatch):
    for i, pairs in enumerate(density_cases()):
        monkeypatch.setattr(density, "BLOCK_EDGES", 25 if i % 2 else 200_000)  # in several blocks, or in one
        got = density.density_clusters(spark.createDataFrame(pairs, "a long, b long, distance double"), 4, 3, 5.0).collect()
        want = plain_density(pairs, 4, 3, 5.0)
        assert {r["node"]: r["cluster"] for r in got} == want
        assert len(set(want.values())) > 2


def test_density_without_pairs(spark):
    none = spark.createDataFrame([], "a long, b long, distance double")
    assert density.density_clusters(none).count() == 0
    few = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1)], "a long, b long, distance double")
    assert [r["cluster"] for r in density.density_clusters(few).collect()] == [None] * 3
