"""Candidate pairs from posting lists, for the similarity joins.

Postings (token, node, size) travel packed: a row holds all postings that a block of documents has
for one bucket of tokens, so the exchange moves few, large rows. A bucket is sorted in
numpy; tokens with one node vanish there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket long, x binary, y binary, z binary"
FOUND = "kind int, a long, b long, n long, m long, s binary"



def packed(b: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    """One row a bucket: tokens x, nodes y (64 bits) and sizes z (32 bits)."""
    order = np.argsort(b, kind="stable")
    b, x, y, z = b[order], x[order], y[order], z[order]
    cut, end = runs(b)
    return pa.RecordBatch.from_arrays(
        [pa.array(b[cut])] + [pa.array([v[i:j].tobytes() for i, j in zip(cut, end, strict=True)], pa.binary()) for v in (x, y, z)], names=["bucket", "x", "y", "z"])


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return first, np.append(first[1:], len(x))


def gather(buckets: int):
    """From a bucket's blobs: tokens of two nodes or more (kind 1: token a, node b, size n, nodes of the token m); from buckets
    after ``buckets`` members (kind 2: the first of y as a, x as b, size n, the rest of y as parity map s), one for each x."""

    def done(bucket: int, parts: list) -> pa.RecordBatch:
        x, y, z = (np.frombuffer(b"".join(p), t) for p, t in zip(zip(*parts, strict=True), (np.uint64, np.uint64, np.int32), strict=True))
        if bucket >= buckets:
            y = y.reshape(len(x), -1)
            _, one = np.unique(x, return_index=True)
            return batch_of(2, y[one, 0], x[one], z[one], np.zeros(len(one)), np.ascontiguousarray(y[one, 1:]))
        order = np.argsort(x)
        alike = x[order[1:]] == x[order[:-1]]
        order = order[np.concatenate([[False], alike]) | np.concatenate([alike, [False]])]  # most tokens have one node and go
        if not len(order):
            return batch_of(1, *[np.zeros(0, np.int64)] * 4)
        order = order[np.lexsort((y[order], x[order]))]
        x, y, z = x[order], y[order], z[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        x, y, z = x[new], y[new], z[new]
        first, end = runs(x)
        m = np.repeat(end - first, end - first)
        many = m > 1
        return batch_of(1, x[many], y[many], z[many], m[many])

    def rows(it):
        now, parts = None, []
        for batch in it:
            b = batch.column(0).to_pylist()
            cols = [batch.column(i) for i in (1, 2, 3)]
            for i, k in enumerate(b):
                if k != now and parts:
                    yield done(now, parts)
                    parts = []
                now = k
                parts.append(tuple(c[i].as_py() for c in cols))
        if parts:
            yield done(now, parts)

    return rows


def batch_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, s: np.ndarray | None = None) -> pa.RecordBatch:
    maps = pa.nulls(len(a), pa.binary()) if s is None else pa.array([r.tobytes() for r in s], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64)), maps], names=["kind", "a", "b", "n", "m", "s"])


def parity_map(s: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each of so many slots: whether an odd number of the set's hashes fall into it.

    Two maps differ in no more bits than the sets have elements not in common, which bounds
    their overlap from above.
    """
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def stars(posted: DataFrame, weight: DataFrame) -> DataFrame:
    """(a, b, shared): each node b with one centre a, the one it shares most tokens with.

    A token's centre is its node with the most popular tokens (``weight``: node, pop), so the least
    altered of a group of near copies. A star has a pair for each node, however large.
    """
    centre = posted.join(weight, "node").groupBy("token").agg(F.max_by("node", F.struct("pop", "node")).alias("centre"))
    arms = posted.join(centre, "token").filter("node != centre").groupBy("centre", "node").agg(F.count("*").alias("shared"))
    return arms.groupBy("node").agg(F.max_by(F.struct("centre", "shared"), F.struct("shared", "centre")).alias("p")).select(F.col("p.centre").alias("a"), F.col("node").alias("b"), "p.shared")


#: Nodes of a token that are compared in one piece; a token with more is cut into cells of two such blocks.
CELL = 4096
#: Tokens of so many nodes are compared all at once.
FEW = 32


def cells(posted: DataFrame, many: str = "m") -> DataFrame:
    """``posted`` with a token for each cell and a side: 0 all pairs of the cell, else only those of two sides.

    A token of up to CELL nodes (column ``many``) is one cell. The nodes of a larger one fall into blocks by hash, and each
    pair of blocks is a cell of its own, so no task has to hold or compare all nodes of a token.
    """
    blocks = F.ceil(F.col(many) / CELL).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    small = posted.filter(F.col(many) <= CELL).withColumn("side", F.lit(0))
    large = posted.filter(F.col(many) > CELL).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    large = large.withColumn("token", F.xxhash64("token", lo, hi)).withColumn("side", F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0))
    return small.unionByName(large.drop("own", "other"))


def across(percent: int, masked: bool = False, names: tuple = ("u", "v", "n")):
    """From (token, node, n, comp, most, at, side, s) sorted by token: pairs of nodes in different components that may link,
    with the number of tokens they were found by. Ruled out are pairs whose sizes are too different and whose parity
    maps differ too much (``masked``: a map is followed by the bits in which all sets of the node agree, and only those count).
    Prefix tokens rule out more: a pair where one has too few tokens that others
    share (``most``), and a token so late in a prefix (``at``) that the pair must share an earlier one too."""

    def linked(v, r, q):
        """Which of the pairs (r, q) of rows of ``v`` stay."""
        c, n, k, most, at, side, s, agree, size = v
        lo, hi = np.minimum(n[r], n[q]), np.maximum(n[r], n[q])
        ok = (k[r] != k[q]) & ((side[r] != side[q]) | (side[r] == 0)) & (hi <= lo * 100 // percent)
        r, q, lo, hi = r[ok], q[ok], lo[ok], hi[ok]
        need = -(-percent * (lo + hi) // (100 + percent))  # the overlap of two sets that link
        least = need - np.maximum(n[r] - size[r], n[q] - size[q])  # prefix tokens that they share, if they link
        ok = (np.minimum(most[r], most[q]) >= least) & (np.maximum(at[r] - size[r], at[q] - size[q]) <= -np.maximum(least, 1))
        r, q, need, total = r[ok], q[ok], need[ok], (lo + hi)[ok]
        apart = s[r] ^ s[q]
        if masked:
            apart &= agree[r] & agree[q]
        ok = 2 * need + np.bitwise_count(apart).sum(1, dtype=np.int64) <= total
        return r[ok], q[ok]

    def pairs(token, c, n, k, most, at, side, s):
        """All pairs within tokens; a token's rows are neighbours."""
        first, end = runs(token)
        s = np.ascontiguousarray(s).view(np.uint64)
        s, agree = np.split(s, 2, axis=1) if masked else (s, None)
        v = c, n, k, most, at, side, s, agree, n - -(-percent * n // 100) + 1
        mixed = np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)  # tokens of one component have nothing to say
        left = np.where(mixed & (end - first <= FEW), end - first, 0)  # few nodes: all pairs a distance apart at once
        left = np.repeat(left, end - first) - (np.arange(len(token)) - np.repeat(first, end - first))
        for d in range(1, FEW):
            r = np.flatnonzero(left > d)
            if not len(r):
                break
            r, q = linked(v, r, r + d)
            yield c[r], c[q]
        for i, j in zip(first[mixed & (end - first > FEW)], end[mixed & (end - first > FEW)], strict=True):
            order = i + np.argsort(n[i:j], kind="stable")
            top = np.searchsorted(n[order], n[order] * 100 // percent, side="right")  # sizes up to n / t may link
            step = max(1, 200_000 // len(order))
            for x in range(0, len(order), step):
                y = min(x + step, len(order))
                rows, cols = np.arange(x, y)[:, None], np.arange(x, int(top[y - 1]))[None, :]
                r, q = np.nonzero((cols > rows) & (cols < top[rows]) & (k[order[cols]] != k[order[rows]]))
                r, q = linked(v, order[r + x], order[q + x])
                yield c[r], c[q]

    def emit(out: list) -> pa.RecordBatch:
        a, b = (np.concatenate([o[j] for o in out]) for j in (0, 1))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pair, count = np.unique(np.stack([lo, hi]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(count.astype(np.int64))], names=names)

    def values(col: pa.Array) -> np.ndarray:
        if pa.types.is_integer(col.type):
            return col.to_numpy()
        return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)

    def rows(it):
        left, out, held = None, [], 0
        for batch in it:
            if not batch.num_rows:
                continue
            now = [values(c) for c in batch.columns]
            if left is not None:
                now = [np.concatenate(v) for v in zip(left, now, strict=True)]
            last = runs(now[0])[0][-1]  # the token that may go on in the next batch
            left = [v[last:] for v in now]
            if not last:
                continue
            for p in pairs(*(v[:last] for v in now)):
                out.append(p)
                held += len(p[0])
                if held > 2_000_000:
                    yield emit(out)
                    out, held = [], 0
        if left is not None:
            out.extend(pairs(*left))
        if out:
            yield emit(out)

    return rows
