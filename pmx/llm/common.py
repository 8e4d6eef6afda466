"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in blocks of about this many characters inside a Python worker.
BLOCK_CHARS = 2_000_000

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A default is used only on a single machine (tests); a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pmx-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote, once all that reads it is written itself."""
    for df in tables:
        _delete(df.sparkSession, df.durable_path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver's garbage is collected.

    A short wait lets go of the plan that just ended, which listeners still hold.
    """
    time.sleep(0.3)
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_residue(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def text_blocks(batch: pa.RecordBatch, column: str = "text", chars: int = BLOCK_CHARS):
    """Yield (first row, list of texts) with about ``chars`` characters each; null is ''."""
    col = batch.column(batch.schema.get_field_index(column))
    start, size, texts = 0, 0, []
    for i in range(len(col)):
        t = col[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= chars:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts
    release()


def column_blocks(batch: pa.RecordBatch, column: str = "text", chars: int = BLOCK_CHARS):
    """Yield (first row, slice of the column) with about ``chars`` bytes each; null is ''."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("")
    end = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(end, (end[start - 1] if start else 0) + chars)) + 1
        yield start, col.slice(start, stop - start)
        start = stop
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on, and what one stage freed would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not in every C library
        return


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``rows`` rows at most, picked by a hash of ``key``: the same at every run and layout."""
    h = F.xxhash64(F.col(key), F.lit(17))
    return df.withColumn("_h", h).orderBy("_h", key).limit(rows).drop("_h")


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, quality) of ``rows`` labelled ids at most; of an id with several labels the lowest counts."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    return bounded_sample(known, "doc_id", rows).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def bounded_rows(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` distinct rows (doc_id, text) of ``df`` at most, picked by a hash: the same at every run and layout.

    The bound on the hash comes from hashes alone, so no text moves but those picked; equal rows count once.
    """
    (h,) = fresh(df, "_h")
    d = df.withColumn(h, F.xxhash64("doc_id", "text", F.lit(17)))
    last = d.select(h).orderBy(h).limit(rows).agg(F.max(h)).first()[0]
    return (d.filter(F.col(h) <= last) if last is not None else d.limit(0)).dropDuplicates([h]).drop(h)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Filter:
    """A Bloom filter over well-mixed 64-bit keys; false alarms only. Its size is bounded, whatever the number of keys."""

    SHIFTS, MOST_BITS = (0, 11, 22, 33), 1 << 27

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        bits = 1 << 16
        while bits < min(16 * n, self.MOST_BITS):
            bits *= 2
        self.mask = bits - 1
        pos = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(self.mask)) for s in self.SHIFTS])).alias("pos")
        words = keys.select(pos).selectExpr("pos >> 6 AS word", "shiftleft(1L, CAST(pos & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).view(np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.int64, copy=False).view(np.uint64) if keys.dtype != np.uint64 else keys
        ok = np.ones(len(k), bool)
        for s in self.SHIFTS:
            pos = (k >> np.uint64(s)) & np.uint64(self.mask)
            ok &= (self.words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list, as (node, component) with the
    smallest node of each component; nodes without an edge do not appear.

    Alternating large-star and small-star rounds; each round's edges are written
    to the shared folder, so lineage stays short and executors may be lost. A
    star's minimum is a partial aggregate, joined back, so that no task has to
    hold the neighbours of one node. The number of rounds grows with the logarithm of the longest
    path; more than ``rounds`` is an error, never a partial answer.
    """
    e = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                .filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: link each larger neighbour to the smallest of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        # small star: link smaller neighbours and the node to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        after = durable(small, "edges")
        discard(e)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = durable(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(e)
    return out


def merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) with further edges (a, b): only components that an edge touches move."""
    if not more.take(1):
        return comp
    old = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
    between = more.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("a_now", "a").alias("a"), F.coalesce("b_now", "b").alias("b"))
    joined = components(between)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = comp.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # nodes that had no link before stand for themselves
    own = moved.select(F.col("component").alias("node"), F.col("to").alias("component")).join(comp, "node", "left_anti")
    out = durable(known.unionByName(own), "components")
    discard(comp, joined)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def text_hash(text: str = "text"):
    """What tells rows of the same id apart: with equal id and text they are one document, found several times."""
    return F.xxhash64(F.col(text))


def one_of_each(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without what ``marks`` (doc_id, h, stays, n: a row for each document in question, n times there) says:
    documents that do not stay go, those found several times stay once."""
    h, i, j = fresh(docs, "_h", "_i", "_j")
    d = docs.withColumn(h, text_hash())
    same = lambda m: d["doc_id"].eqNullSafe(m[i]) & (d[h] == m[j])
    m = marks.select(F.col("doc_id").alias(i), F.col("h").alias(j), "stays", "n")
    twice = m.filter("stays and n > 1").select(i, j)
    if not twice.take(1):
        gone = m.filter("not stays").select(i, j)
        return d.join(gone, same(gone), "left_anti").select(*docs.columns)
    gone = m.select(i, j)
    rest = d.join(gone, same(gone), "left_anti")
    return rest.unionByName(d.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", h])).select(*docs.columns)
