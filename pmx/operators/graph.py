"""Communities and spanning forests of a weighted undirected graph."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def label_propagation(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label by weighted label propagation over edges (a, b, weight), until no label changes.

    Each round a node takes the label with the most weight among its neighbours and itself (its own counts with the
    weight of its heaviest edge), the smallest of equals. Deterministic; each round is one join and two aggregates, written to
    the checkpoint folder. Links are dealt by node once and kept so on disk: where labels are few enough to be broadcast, a round shuffles nothing. Labels that swing between states stop at the first state that comes again; more than
    ``rounds`` is an error.
    """
    both = edges.select(C("a").alias("node"), C("b").alias("other"), "weight").unionByName(edges.select(C("b").alias("node"), C("a").alias("other"), "weight"))
    loops = both.groupBy("node").agg(F.max("weight").alias("weight")).select("node", C("node").alias("other"), "weight")
    links = by_node(checkpointed(both.unionByName(loops)))  # read in every round
    labels = links.select("node").distinct().withColumn("label", C("node"))
    seen = {_state(labels)}
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        # sums of weights in another order may differ in the last digits, which must not decide
        labels = checkpointed(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.round(C("w").cast("double"), 9), C("label"))).alias("label")))
        state = _state(labels)
        if state in seen:
            links.unpersist()
            return labels
        seen.add(state)
    links.unpersist()
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


#: Links that a task reads in a round, about.
TASK_LINKS = 1_000_000


def by_node(links: DataFrame) -> DataFrame:
    """Links (node, ...) dealt by node and kept on the executors' disks, from where an aggregate by node needs no shuffle. A lost part is made again from the table."""
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, links.count() // TASK_LINKS + 1)
    return links.repartition(tasks, "node").persist(StorageLevel.DISK_ONLY)


_WEIGHT = "decimal(28,6)"


def modularity(edges: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """One row: the modularity of ``labels`` over edges (a, b, weight)."""
    at = lambda c: labels.select(C(node).alias(c), C(label).alias(f"{c}_label"))
    e = edges.join(at("a"), "a").join(at("b"), "b")
    ends = e.select(F.explode(F.array("a_label", "b_label")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("d"))
    inside = e.agg(F.sum(F.when(C("a_label") == C("b_label"), C("weight")).otherwise(0)).cast("double").alias("inside"), F.sum("weight").cast("double").alias("m"))
    square = ends.agg(F.sum(C("d").cast("double") * C("d").cast("double")).alias("square"))
    return inside.crossJoin(F.broadcast(square)).select((C("inside") / C("m") - C("square") / (4 * C("m") * C("m"))).alias("modularity"))


def louvain(edges: DataFrame, levels: int = 12, rounds: int = 24, least: float = 1e-4) -> DataFrame:
    """node, label by modularity over edges (a, b, weight): local moving, then the same on the graph of communities, level by level.

    In a round every node looks at the communities of its neighbours, and half of the nodes, another half each
    time, move to where modularity gains most (of equals the smallest label); a node alone joins another one alone only if that has the smaller label, so two never
    swap. Rounds of a level end when two of them raise modularity by less than ``least``, and the best state counts. Then
    communities become nodes, their inner weight a loop. A round is two joins and two aggregates over
    tables, and over links dealt by node once a level; no task holds a community. Weights are decimals of six places, so sums do not depend on their order. Labels are the smallest node.
    """
    w = C("weight").cast(_WEIGHT)
    links = edges.filter("a != b").select(C("a").alias("node"), C("b").alias("other"), w.alias("w")).unionByName(edges.filter("a != b").select(C("b").alias("node"), C("a").alias("other"), w.alias("w")))
    links = checkpointed(links.groupBy("node", "other").agg(F.sum("w").cast(_WEIGHT).alias("w")))
    loops = edges.filter("a = b").groupBy(C("a").alias("node")).agg((F.sum(w) * 2).cast(_WEIGHT).alias("loop"))
    # of a node that has nothing but a loop nothing can change, but it is a node
    members = checkpointed(links.select("node").union(loops.select("node")).distinct().withColumn("top", C("node")))
    for level in range(levels):
        nodes = links.groupBy("node").agg(F.sum("w").alias("d")).join(loops, "node", "full").select(
            "node", (F.coalesce("d", F.lit(0)) + F.coalesce("loop", F.lit(0))).cast(_WEIGHT).alias("k"), F.coalesce("loop", F.lit(0)).cast(_WEIGHT).alias("loop"), C("node").alias("c"))
        nodes = checkpointed(nodes)
        total, inner = (float(x or 0) for x in nodes.agg(F.sum("k"), F.sum("loop")).first())
        if not total:
            break
        # with a link of weight 0 to itself a node sees its own community too
        dealt = by_node(links.select("node", "other", "w").unionByName(nodes.select("node", C("node").alias("other"), F.lit(0).cast(_WEIGHT).alias("w"))))
        start, best, best_q = nodes, None, None
        for r in range(rounds):
            moved = checkpointed(_moves(dealt, nodes, total, level * rounds + r))
            if r % 2 == 0:  # both halves have had their turn
                square = nodes.groupBy("c").agg(F.sum("k").cast("double").alias("t")).agg(F.sum((C("t") / total) * (C("t") / total)))
                inside, wish, square = moved.agg(F.sum("own_in").cast("double"), F.count_if("wish")).crossJoin(F.broadcast(square)).first()  # one row each
                q = (inside + inner) / total - square
                if best is not None and q < best_q + least:
                    best = nodes if q > best_q else best
                    break
                best, best_q = nodes, q
                if not wish:
                    break
            nodes = moved.select("node", "k", "loop", C("to").alias("c"))
        dealt.unpersist()
        if best is None or best is start or not best.filter("node != c").take(1):
            break
        to = best.select("node", "c")
        members = checkpointed(members.join(to.select(C("node").alias("top"), "c"), "top", "left").select("node", F.coalesce("c", "top").alias("top")))
        e = links.join(to, "node").join(to.select(C("node").alias("other"), C("c").alias("oc")), "other").groupBy("c", "oc").agg(F.sum("w").cast(_WEIGHT).alias("w"))
        e = checkpointed(e)
        own = best.groupBy("c").agg(F.sum("loop").alias("loop")).join(e.filter("c = oc").select("c", "w"), "c", "left")
        loops = checkpointed(own.select(C("c").alias("node"), (C("loop") + F.coalesce("w", F.lit(0))).cast(_WEIGHT).alias("loop")))
        links = e.filter("c != oc").select(C("c").alias("node"), C("oc").alias("other"), "w")
    names = members.groupBy("top").agg(F.min("node").alias("label"))
    return members.join(names, "top").select("node", "label")


def _moves(links: DataFrame, nodes: DataFrame, total: float, turn: int) -> DataFrame:
    """For links that lead to the node itself too: node, k, loop, to, own_in (weight into the own community now) and wish (whether another one is better)."""
    sums = nodes.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
    pull = links.join(nodes.select(C("node").alias("other"), C("c").alias("oc")), "other").groupBy("node", "oc").agg(F.sum("w").cast("double").alias("w"))
    own = C("oc") == C("c")
    k = C("k").cast("double")
    x = pull.join(nodes, "node").join(sums.withColumnRenamed("c", "oc"), "oc")
    x = x.withColumn("gain", F.round(C("w") - k * (C("t").cast("double") - F.when(own, k).otherwise(0.0)) / total, 9))
    seen = x.groupBy("node").agg(
        F.first("k").alias("k"), F.first("loop").alias("loop"), F.first("c").alias("c"), F.max(F.when(own, C("w"))).alias("own_in"), F.max(F.when(own, C("n"))).alias("own_n"), F.max(F.when(own, C("gain"))).alias("own_gain"),
        F.min_by(F.struct("oc", "n", "gain"), F.struct(-C("gain"), C("oc"))).alias("best"))
    wish = (C("best.gain") > C("own_gain")) & ~((C("own_n") == 1) & (C("best.n") == 1) & (C("best.oc") > C("c")))
    turns = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
    return seen.select("node", "k", "loop", F.when(wish & turns, C("best.oc")).otherwise(C("c")).alias("to"), "own_in", wish.alias("wish"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest (a, b, weight) of edges (a, b, weight), by Boruvka's rounds.

    Each round every tree takes its lightest edge outwards (of equal ones by a, then b), trees that meet become one by pointer doubling,
    and of the edges between two trees the lightest stays. Rounds grow with the logarithm of the nodes; trees are labels on edges, never groups in a task.
    """
    live = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    live = checkpointed(live.groupBy("a", "b").agg(F.min("weight").alias("weight")).select("a", "b", "weight", C("a").alias("ca"), C("b").alias("cb")))
    forest = live.select("a", "b", "weight").limit(0)
    edge = F.struct("weight", "a", "b")
    while live.take(1):
        both = live.select(C("ca").alias("c"), C("cb").alias("o"), edge.alias("e")).unionByName(live.select(C("cb").alias("c"), C("ca").alias("o"), edge.alias("e")))
        chosen = checkpointed(both.groupBy("c").agg(F.min(F.struct("e", "o")).alias("x")).select("c", C("x.o").alias("up"), C("x.e").alias("e")))
        forest = checkpointed(forest.unionByName(chosen.select("e.a", "e.b", "e.weight").distinct()))
        # two trees that took the same edge: the smaller label is the root
        back = chosen.select(C("c").alias("up"), C("up").alias("back"))
        root = pointer_roots(chosen.join(back, "up").select("c", F.when((C("back") == C("c")) & (C("c") < C("up")), C("c")).otherwise(C("up")).alias("up")))
        to = lambda c: root.select(C("c").alias(c), C("up").alias(f"{c}_new"))  # noqa: B023, E731
        moved = live.join(to("ca"), "ca").join(to("cb"), "cb").filter("ca_new != cb_new").select("a", "b", "weight", F.least("ca_new", "cb_new").alias("ca"), F.greatest("ca_new", "cb_new").alias("cb"))
        live = checkpointed(moved.groupBy("ca", "cb").agg(F.min(edge).alias("e")).select("e.a", "e.b", "e.weight", "ca", "cb"))
    return forest


def pointer_roots(up: DataFrame) -> DataFrame:
    """(c, up) with ``up`` the root of c: what points to itself, by pointer doubling."""
    up = checkpointed(up)
    while True:
        above = up.select(C("c").alias("up"), C("up").alias("above"))
        new = checkpointed(up.join(above, "up").select("c", C("above").alias("up"), (C("above") != C("up")).alias("moved")))
        if not new.filter("moved").take(1):
            return new.select("c", "up")
        up = new.select("c", "up")


def _state(labels: DataFrame) -> tuple:
    """What tells one assignment of labels from another: one row."""
    return tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")), F.sum(F.xxhash64("label", "node").cast("decimal(38,0)"))).first())


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder that the session names (``spark.checkpoint.dir``) and read back: lineage and plan start anew.

    A checkpoint of its own kind would carry the constraints of the plan on, which grow from round to round. A folder of
    its own is used only on a single machine (tests); a cluster has to name one. Tables go when the driver ends.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/pmx-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


_written: list[str] = []


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return
