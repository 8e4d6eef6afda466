"""Density clusters of a sparse graph of distances: mutual reachability, spanning forest, condensed tree, excess of mass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmx.operators.graph import checkpointed, spanning_forest

C = F.col
#: Edges of the forest that one task merges, about; what they join is passed on to the next such block.
BLOCK_EDGES = 200_000
#: Distances are this much at least where they divide.
LEAST = 1e-9
_STATE = "size long, cluster long, mass double, below double, members array<long>"
_OUT = f"kind string, id long, target long, {_STATE}, stability double, selected boolean"


def core_distances(pairs: DataFrame, samples: int, beyond: float, salts: int = 32, copies: DataFrame | None = None, both: bool = False) -> DataFrame:
    """node, core: the distance to the ``samples``-th nearest, itself the first; ``beyond`` where fewer are known.

    The nearest are taken within shares of a node's neighbours first, so that no task sorts those of one node. With ``copies``
    (node, n) a node stands for n of one place: so many count as its neighbours' neighbour, and the others of its own at distance 0.
    ``both``: ``pairs`` are (node, other, distance), of each node the nearest at least.
    """
    both = pairs if both else pairs.select(C("a").alias("node"), C("b").alias("other"), "distance").unionByName(pairs.select(C("b").alias("node"), C("a").alias("other"), "distance"))
    if copies is None:
        both = both.withColumn("n", F.lit(1).cast("long"))
    else:
        own = copies.filter("n > 1").select("node", C("node").alias("other"), F.lit(0.0).alias("distance"), (C("n") - 1).alias("n"))
        both = both.join(copies.select(C("node").alias("other"), "n"), "other").unionByName(own)
    k = max(samples - 1, 1)
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("distance", "other"))
    few = both.withColumn("share", F.pmod(F.xxhash64("other"), F.lit(salts))).withColumn("i", place("node", "share")).filter(C("i") <= k)
    near = few.withColumn("i", place("node")).filter(C("i") <= k)
    near = near.withColumn("sum", F.sum("n").over(W.partitionBy("node").orderBy("i")))
    full = F.min(F.when(C("sum") >= k, C("distance")))
    return near.groupBy("node").agg(F.coalesce(full, F.lit(float(beyond))).alias("core"))


def mutual_reachability(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """(a, b, weight): the distance, or a core distance (node, core) of its ends if that is larger."""
    at = lambda c: core.select(C("node").alias(c), C("core").alias(f"{c}_core"))
    return pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.greatest("distance", "a_core", "b_core").alias("weight"))


def _merge(smallest: int):
    """What one block of edges, in order, does to the components at their ends."""

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        state, up, out = {}, {}, []
        for side in ("a", "b"):
            for r in block[[f"{side}_{c}" for c in ("comp", "size", "cluster", "mass", "below", "members")]].itertuples(index=False):
                state[r[0]] = (int(r[1]), None if pd.isna(r[2]) else int(r[2]), float(r[3]), float(r[4]), list(r[5]))
                up[r[0]] = r[0]

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for r in block.sort_values(["weight", "a", "b"]).itertuples(index=False):
            x, y = find(r.a_comp), find(r.b_comp)
            if x == y:
                continue
            rate, new = 1.0 / max(r.weight, LEAST), int(r.rank)
            (sx, cx, mx, bx, px), (sy, cy, my, by, py) = state.pop(x), state.pop(y)
            size, members = sx + sy, []
            if cx is not None and cy is not None:  # a split, seen from above
                values = []
                for s, c, m, b in ((sx, cx, mx, bx), (sy, cy, my, by)):
                    stability = m - s * rate
                    out.append(("cluster", c, new, s, None, None, None, None, stability, stability >= b))
                    values.append(max(stability, b))
                cluster, mass, below = new, size * rate, sum(values)
            elif cx is not None or cy is not None:  # points leave a cluster
                cluster, mass, below = (cx, mx + sy * rate, bx) if cx is not None else (cy, my + sx * rate, by)
                out += [("point", p, cluster, None, None, None, None, None, None, None) for p in (py if cx is not None else px)]
            elif size >= smallest:  # a cluster without others in it
                cluster, mass, below = new, size * rate, 0.0
                out += [("point", p, new, None, None, None, None, None, None, None) for p in px + py]
            else:
                cluster, mass, below, members = None, 0.0, 0.0, px + py
            root, leaf = min(x, y), max(x, y)
            up[leaf] = root
            state[root] = (size, cluster, mass, below, members)
        for c in up:
            root = find(c)
            out.append(("comp", c, root, *state[root], None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.replace("array<long>", "list").split(", ")]).astype(
            {"id": "int64", "target": "Int64", "size": "Int64", "cluster": "Int64", "selected": "boolean"})

    return merge


def density_clusters(pairs: DataFrame, smallest: int = 5, samples: int = 5, beyond: float = 1.0, single: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """node, cluster, of every node of pairs (a, b: long, distance); cluster is its smallest node, null for noise.

    The hierarchy of single linkage over mutual reachability, without splits that leave fewer than ``smallest`` nodes; of it the clusters
    with the most excess of mass stay. It is built from below: edges of the spanning forest are merged in order, a bounded
    block in a task, and a component is passed on as its size, its cluster and two sums (with its nodes only while these
    are fewer than ``smallest``). A component with all clusters in it is the root and no cluster itself, unless ``single``. Pairs that are not given count as infinitely far apart.

    ``copies`` (node, n) says how many of one place each node stands for: they count as n nodes, joined at the node's core distance, and
    are never made. A node of two or more is a node without pairs too.
    """
    core = checkpointed(core_distances(pairs, samples, beyond, copies=copies))
    return clusters_of_forest(checkpointed(spanning_forest(mutual_reachability(pairs, core))), core, smallest, single, copies)


def clusters_of_forest(forest: DataFrame, core: DataFrame, smallest: int = 5, single: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """``density_clusters`` from the spanning forest (a, b, weight) of mutual reachability and the core distances (node, core), both written."""
    blocks = max(1, -(-forest.count() // BLOCK_EDGES))
    # a range of weights is a partition, and the partition's number is the block; places in it are in order
    edges = forest.repartitionByRange(blocks, "weight", "a", "b").sortWithinPartitions("weight", "a", "b") if blocks > 1 else forest.coalesce(1).sortWithinPartitions("weight", "a", "b")
    edges = checkpointed(edges.withColumn("rank", F.monotonically_increasing_id()))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if copies is None:
        nodes = nodes.withColumn("n", F.lit(1).cast("long"))
    else:
        nodes = nodes.unionByName(copies.filter("n > 1").select("node")).distinct().join(copies, "node")
    # enough copies are a cluster from the start, of a number below those of the merges
    nodes = checkpointed(nodes.join(core, "node").withColumn("first", F.when(C("n") >= smallest, -1 - F.monotonically_increasing_id())))
    now = checkpointed(nodes.select("node", C("node").alias("comp")))
    mass, members = C("n") / F.greatest("core", F.lit(LEAST)), F.array("node")
    state = checkpointed(nodes.select(C("node").alias("comp"), C("n").alias("size"), C("first").alias("cluster"), F.when(C("first").isNull(), 0.0).otherwise(mass).alias("mass"), F.lit(0.0).alias("below"),
                                      F.when(C("first").isNull(), members).otherwise(F.slice(members, 1, 0)).alias("members")))
    nodes, points, clusters = nodes.select("node"), nodes.filter("first IS NOT NULL").select("node", C("first").alias("id")), None
    for block in range(blocks):
        part = edges.filter(F.shiftright("rank", 33) == block)
        for side in ("a", "b"):
            of = now.select(C("node").alias(side), C("comp").alias(f"{side}_comp"))
            with_state = state.select(*[C(c).alias(f"{side}_{c}") for c in state.columns])
            part = part.join(of, side).join(with_state, f"{side}_comp")
        done = checkpointed(part.groupBy(F.lit(block).alias("block")).applyInPandas(_merge(smallest), _OUT))
        comp = done.filter("kind = 'comp'")
        keep = ["size", "cluster", "mass", "below", "members"]
        state = checkpointed(state.join(comp.select(C("id").alias("comp")), "comp", "left_anti").unionByName(comp.filter("id = target").select(C("id").alias("comp"), *keep)))
        now = checkpointed(now.join(comp.select(C("id").alias("comp"), "target"), "comp", "left").select("node", F.coalesce("target", "comp").alias("comp")))
        p, c = done.filter("kind = 'point'").select(C("id").alias("node"), C("target").alias("id")), done.filter("kind = 'cluster'").select("id", C("target").alias("up"), "selected")
        points, clusters = points.unionByName(p), c if clusters is None else clusters.unionByName(c)
    tops = checkpointed(state.filter("cluster IS NOT NULL").select(C("cluster").alias("id"), F.lit(None).cast("long").alias("up"), (C("mass") >= C("below")).alias("selected")))
    if not single and len(tops.take(2)) < 2:
        tops = tops.withColumn("selected", F.lit(False))
    owner = _uppermost(clusters.unionByName(tops))
    named = checkpointed(nodes.join(points, "node", "left").join(owner, "id", "left").select("node", "top"))
    least = named.filter("top IS NOT NULL").groupBy("top").agg(F.min("node").alias("cluster"))
    return named.join(least, "top", "left").select("node", "cluster")


def _uppermost(clusters: DataFrame) -> DataFrame:
    """(id, top): the uppermost selected cluster on the way from each to its root, by pointer doubling."""
    at = checkpointed(clusters.select("id", "up", F.when(C("selected"), C("id")).alias("top")))
    while at.filter("up IS NOT NULL").take(1):
        above = at.select(C("id").alias("up"), C("up").alias("next"), C("top").alias("higher"))
        at = checkpointed(at.join(above, "up", "left").select("id", C("next").alias("up"), F.coalesce("higher", "top").alias("top")))
    return at.select("id", "top")
