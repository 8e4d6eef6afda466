"""Periodic run detection: stretches of words that repeat with a period, four times or more.

The words of a block of texts become numbers. For each period p only the words at multiples of p, the grid, are compared with
the next ones: a run of four periods holds four points of the grid, so three equal neighbours in a row are probed for, which costs n/p a period and n log n
in all. What survives is extended to both sides by comparing chunks of the array with itself p further on. Points of the grid that lie, with
their neighbour, in a run found before whose period divides p are skipped: what has period p there is that run itself. Periods rise, so a stretch that is
found has its smallest period. Texts of a block are parted by numbers that occur once, so no run goes over an end.

Edge cases: null and empty texts have no words and no runs, and collapse to the empty string; very long texts are read whole, a million bytes at a time, in arrays of
some ten bytes a word; runs that start together are ordered by period; null ids pass through; repeated rows stay; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_blocks, table

#: A run has so many periods, and so many words, at least.
PERIODS, LEAST = 4, 6
#: Texts are split so many bytes at a time; comparisons start with a chunk of the first size and grow to the second.
SPLIT_BYTES, CHUNKS = 1 << 20, (32, 1 << 16)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(data: bytes):
    """The words of a text, in lists, a bounded part of the text at a time."""
    at = 0
    while at < len(data):
        end = at + SPLIT_BYTES
        cut = _SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _first_other(w: np.ndarray, p: int, i: int) -> int:
    """The first k >= i where word k and word k+p differ, or the last word has no such partner."""
    size, end = CHUNKS[0], len(w) - p
    while i < end:
        k = min(size, end - i)
        other = w[i : i + k] != w[i + p : i + p + k]
        a = int(other.argmax())
        if other[a]:
            return i + a
        i, size = i + k, min(size * 4, CHUNKS[1])
    return end


def _last_other(w: np.ndarray, p: int, i: int) -> int:
    """The last k < i where word k and word k+p differ, or -1."""
    size = CHUNKS[0]
    while i > 0:
        k = min(size, i)
        other = w[i - k : i][::-1] != w[i - k + p : i + p][::-1]
        a = int(other.argmax())
        if other[a]:
            return i - 1 - a
        i, size = i - k, min(size * 4, CHUNKS[1])
    return -1


def runs_of(w: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; ``longest``: words that a run has at most."""
    out: list[tuple[int, int, int]] = []
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # starts and ends of the runs of a period
    for p in range(1, (len(w) if longest is None else longest) // PERIODS + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        if len(same) < PERIODS - 1:
            break
        x = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        if not len(x):
            continue
        for d in {p // 3, p // 2, p - 1} - {0}:  # the words between the points of the grid repeat as well
            x = x[w[x + d] == w[x + d + p]]
        for q in [q for q in known if p % q == 0]:
            starts, ends = known[q]
            k = np.searchsorted(starts, x, "right") - 1
            x = x[(k < 0) | (ends[k] <= x + p)]
        new, i = [], 0
        while i < len(x):
            at = int(x[i])
            right = _first_other(w, p, at)
            left = _last_other(w, p, at) + 1
            if right + p - left >= max(LEAST, PERIODS * p):
                new.append((left, right + p - left, p))
            i = int(np.searchsorted(x, max(right, at + 1)))  # points before lie in what was just looked at
        if new:
            known[p] = np.array([s for s, _, _ in new]), np.array([s + n for s, n, _ in new])
            out += new
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def block_runs(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs of each text, and the text without what repeats."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    parts, start, at = [], [], 0
    for k, t in enumerate(texts):
        start.append(at)
        for some in _words(t):
            parts.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
            at += len(some)
        parts.append(np.array([-1 - k], np.int32))
        at += 1
    w, start = np.concatenate(parts), np.array([*start, at])
    found = runs_of(w, int(np.diff(start).max()) - 1)
    owner = np.searchsorted(start, [s for s, _, _ in found], "right") - 1
    by_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (s, n, p) in zip(owner, found, strict=True):
        by_text[k].append((int(s - start[k]), n, p))
    words, out = list(number), []
    for k, runs in enumerate(by_text):
        own = w[start[k] : start[k + 1] - 1]
        kept = own[~repeated(len(own), runs)] if runs else own
        out.append((runs, b" ".join([words[i] for i in kept])))
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed (the words that no run repeats, joined by one space) of every document."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(it):
        for batch in it:
            for at, col in column_blocks(batch):
                found = block_runs(col.cast(pa.large_string()).cast(pa.large_binary()).to_pylist())
                ends = np.cumsum([0] + [len(r) for r, _ in found])
                flat = [x for r, _ in found for x in r]
                struct = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], fields=list(run))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), pa.array([t.decode("utf-8", "replace") for _, t in found])],
                                                 names=["doc_id", "runs", "collapsed"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32(doc_id) repeats some of its words from a place on; both follow from the id, and null ids are left alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    d = d.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get("w", F.col("a") + i % F.col("p")))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the most periods, by exact comparison; of equal ones the first."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    text = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


NAME, ORACLE = "op13_periodic_runs", None
