"""Bound-certified best-fit packing.

Documents are encoded, cut into pieces of at most ``CAPACITY`` ids, and the pieces dealt by hash
into groups of bounded size. Each group is packed by best-fit decreasing, and a
lower bound from dual feasible functions certifies its number of bins. While the
total stands above the bound of all lengths, groups that are not certified, or have slack of half a bin,
put the pieces of their loosest bins together, a few groups at a time, and best-fit decreasing
runs again; a repacking counts only if it saves a bin.

Edge cases: null and empty texts are the end id alone; null ids are packed like
others; rows with the same id are pieces of their own, dealt by their place too, so equal rows spread over the groups;
ties in length go by id and piece; a very long text is cut into many pieces; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, table, text_blocks
from .tokens import encoder

CAPACITY, GROUP, MERGE, ROUNDS, END = 2048, 8192, 6, 4, 0
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps; the pipeline's workers outlive the stage, and hold them on.
KEEP_WORDS = 300_000


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the dual feasible functions.

    f_e takes sizes over ``capacity - e`` as full and those under e as nothing; u_k rounds
    (k+1) x / capacity down to a multiple of 1/k unless it is whole.
    """
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same from the number of pieces of each size."""
    size = np.arange(capacity + 1, dtype=np.int64)
    n_over = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])  # of size >= i
    s_over = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    e = np.arange(0, capacity // 2 + 1)
    high = capacity - e + 1  # sizes from here are full
    total = n_over[high] * capacity + s_over[e] - s_over[high]
    best = int((-(-total // capacity)).max())
    for k in range(1, 21):
        x = (k + 1) * size
        value = np.where(x % capacity == 0, k * size, (x // capacity) * capacity)  # times k * capacity
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin, offset) of each size, and the number of bins.

    Open bins stand in stacks by room left; a bit for each non-empty stack finds the
    tightest in one step.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    to, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        m = mask >> n
        if m:
            room = n + (m & -m).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        to[i], at[i] = b, capacity - room
        left = room - n
        if left:
            stacks[left].append(b)
            mask |= 1 << left
    return to, at, bins


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids, cut where a document is over the capacity."""
    d = docs.select("doc_id", "text")

    def cut(it):
        for batch in it:
            for at, texts in text_blocks(batch):
                row, piece, size, crc = [], [], [], []
                for i, ids in enumerate(encoder(vocabulary, False, KEEP_WORDS).encode(texts)):
                    x = np.frombuffer(ids + END.to_bytes(2, "little"), np.uint16).astype("<u4")
                    for p, s in enumerate(range(0, len(x), capacity)):
                        part = x[s : s + capacity]
                        row.append(at + i)
                        piece.append(p)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return d.mapInArrow(cut, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _packed(kind: str) -> str:
    return f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, loose boolean"


def _pack_group(capacity: int, slack: int):
    """Packs one group. ``loose``: the bin has slack, and the group is not certified or could give up half a bin."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        size = t.column("length").to_numpy()
        to, at, n = best_fit(size, capacity)
        fill = np.bincount(to, size, n)
        gap = n > lower_bound(size, capacity) or n * capacity - size.sum() >= capacity // 2
        loose = (fill[to] < capacity - slack) & gap
        for name in ("bin", "offset", "loose"):
            if name in t.column_names:
                t = t.drop_columns(name)
        return t.append_column("bin", pa.array(to)).append_column("offset", pa.array(at)).append_column("loose", pa.array(loose))

    return pack


def best_fit_packing(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, merge: int = MERGE, rounds: int = ROUNDS) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset."""
    parts = durable(parts, "pieces")
    kind = parts.schema["doc_id"].dataType.simpleString()
    count = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # as many rows as there are lengths
        count[r["length"]] = r["count"]
    total, bound = int(count.sum()), bound_of_counts(count, capacity)
    groups = max(1, -(-total // group))
    slack = capacity // 256
    # the place a row was written at parts rows that are equal otherwise; the table is written, so it does not change
    items = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    run = lambda df, s: df.groupBy("grp").applyInArrow(_pack_group(capacity, s), _packed(kind))
    packed = durable(run(items, slack), "packed")
    base = groups
    bins = lambda df: df.select("grp", "bin").distinct().count()
    now = bins(packed)
    for _ in range(rounds):
        if now <= bound:
            break
        loose = packed.filter("loose")
        n_loose = loose.count()
        if not n_loose:
            break
        supers = max(1, -(-n_loose // (group * merge)))
        # a group's loose bins move together, so what a repacking does not improve can stay as it was
        key = F.pmod(F.xxhash64("grp", F.lit(base)), F.lit(supers)) + F.lit(base)
        again = durable(run(loose.select("doc_id", "piece", "start", "length", "ids_crc32", key.alias("grp")), slack), "packed")
        before = loose.select(key.alias("sup"), "grp", "bin").distinct().groupBy("sup").agg(F.count("*").alias("was"))
        after = again.select("grp", "bin").distinct().groupBy(F.col("grp").alias("sup")).agg(F.count("*").alias("is"))
        better = before.join(after, "sup").filter("is < was").select("sup")
        better = durable(better, "better")  # its size grows with the groups, so Spark decides how to join it
        kept = packed.withColumn("sup", F.when(F.col("loose"), key)).join(better.withColumn("won", F.lit(True)), "sup", "left")
        won = again.join(better, again.grp == better.sup, "left_semi")
        after_all = durable(kept.filter("won is null").drop("sup", "won").unionByName(won), "packed")
        discard(packed, again, better)
        packed = after_all
        base += supers
        last, now = now, bins(packed)
        if now >= last:
            break
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("grp") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(pieces(docs, public_tokenizers.path(VOCABULARY)))


NAME, ORACLE = "op8_packing", None
