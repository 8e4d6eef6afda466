"""Fuzzy line dedup: MinHash with banding, exact Jaccard, distributed union-find.

A line (trimmed of white space) of ``SHINGLE`` characters or more is a set of ``SHINGLE``-character shingles. One hash
of each shingle fills a signature of one-permutation MinHash (empty slots borrow from
others), bands of ``ROWS`` slots give tokens, and lines that share a token are candidates: first each
line against one centre of its tokens, then all that are still in different components and whose
parity maps do not rule a link out. Candidates are verified on their texts; equal lines are one node from the start. Of each component the
first line in order of (doc_id, hash of the text, line number) stays. Shorter lines have no set, and only equal ones are
one node; empty lines always stay.

With 16 bands of 5 slots a pair at the threshold of 0.75 is found with probability 0.987,
at 0.85 with 0.9999.

Edge cases: null and empty texts have one empty line, which stays; a line repeated in
a document counts like one of another document; null ids sort first; rows with the same id and
different texts are documents of their own; equal rows are one document found several times, so ``line_dedup`` keeps
one of them if it has a word; a very long text is cut into lines in one worker, and a very long line is one set there,
about 100 bytes a character; an empty table gives an empty
result; other columns of the documents are carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, column_blocks, components, discard, durable, fresh, merged, mix64, settle, table, text_hash
from .pairs import FOUND, PACKED, across, cells, gather, packed, stars

SHINGLE, PERCENT = 8, 75
BANDS, ROWS = 16, 5
#: Band tokens in a bucket, about.
BUCKET = 250_000
#: Bits of a line's parity map.
PARITY = 2048
_SLOTS = BANDS * ROWS
_NONE = np.uint32(0xFFFFFFFF)
#: Slot i borrows from _BORROW[t, i] at attempt t.
_BORROW = np.stack([(mix64(np.arange(_SLOTS, dtype=np.uint64) + np.uint64(1000 * (t + 1))) % np.uint64(_SLOTS)).astype(np.int64) for t in range(64)])


_WHITE = " \t\n\v\f\r"


def _line_list(text: str) -> list[str]:
    return [x.strip(_WHITE) for x in text.split("\n")]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Text, number, trimmed line and length before that, of every line of some texts."""
    parts = pc.split_pattern(texts, "\n")
    count = parts.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    flat = parts.flatten()
    return row, number.astype(np.int32), pc.ascii_trim(flat, characters=_WHITE), pc.utf8_length(flat).to_numpy()


def _long_lines(texts: pa.Array) -> pa.Array:
    """The distinct lines of SHINGLE characters or more."""
    lines = _lines(texts)[2].unique()
    return lines.filter(pc.greater_equal(pc.utf8_length(lines), SHINGLE))


def line_nodes(lines: pa.Array) -> np.ndarray:
    """The 64-bit nodes of lines."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines.cast(pa.binary()).to_pylist()), np.uint64, len(lines))


def shingle_codes(text: str) -> np.ndarray:
    """All ``SHINGLE``-character windows of a text as integers: the characters' bytes where each has one, else a hash."""
    if len(text) < SHINGLE:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(c) - SHINGLE + 1
    out = np.ndarray((n,), "<u8", c.astype(np.uint8), 0, (1,)).copy()
    wide = np.flatnonzero(c > 255)
    if len(wide):
        edge = np.zeros(len(c) + 1, np.int32)
        np.add.at(edge, np.maximum(wide - SHINGLE + 1, 0), 1)
        np.add.at(edge, wide + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[:n])
        code = np.full(len(at), 1, np.uint64)
        for k in range(SHINGLE):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + c[at + k])
        out[at] = code
    return out


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines of SHINGLE characters or more, and the line of each."""
    size = np.array([len(x) for x in lines], np.int64)
    h = shingle_codes("".join(lines))
    inside = np.ones(len(h) + SHINGLE - 1, bool)
    for k in range(1, SHINGLE):  # windows that reach over the end of a line
        inside[np.cumsum(size) - k] = False
    return h[inside[: len(h)]], np.repeat(np.arange(len(lines)), size - SHINGLE + 1)


def _distinct(code: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each distinct (shingle, line), in order, and where it stands first or again."""
    key = mix64(code ^ mix64(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    return key[new], order[new]


def sizes_and_maps(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles and parity map of each line."""
    code, own = _windows(lines)
    _, at = _distinct(code, own)
    slot = (mix64(code[at]) >> np.uint64(40)) % np.uint64(PARITY)
    maps = np.zeros(len(lines) * (PARITY // 64), np.uint64)
    np.bitwise_xor.at(maps, own[at] * (PARITY // 64) + (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return np.bincount(own[at], minlength=len(lines)), maps.reshape(len(lines), -1)


def alike(a: list[str], b: list[str], percent: int = PERCENT) -> np.ndarray:
    """Whether line i of ``a`` and line i of ``b`` reach the threshold."""
    (x, p), (y, q) = _windows(a), _windows(b)
    (kx, ax), (ky, ay) = _distinct(x, p), _distinct(y, q)
    size = np.bincount(p[ax], minlength=len(a)) + np.bincount(q[ay], minlength=len(a))
    both = np.bincount(q[ay[np.isin(ky, kx, assume_unique=True)]], minlength=len(a))
    return 100 * both >= percent * (size - both)


def signature(lines: list[str]) -> np.ndarray:
    """(line, slot) minima of one-permutation MinHash over lines of SHINGLE characters or more."""
    h, own = _windows(lines)
    for shift, factor in ((29, 0x9E3779B97F4A7C15), (32, 0xC2B2AE3D27D4EB4F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    slot = h >> np.uint64(40)
    slot *= np.uint64(_SLOTS)
    slot >>= np.uint64(24)
    own *= _SLOTS
    own += slot.view(np.int64)
    out = np.full(len(lines) * _SLOTS, _NONE, np.uint32)
    h &= np.uint64(0x7FFFFFFF)
    np.minimum.at(out, own, h.astype(np.uint32))
    out = out.reshape(len(lines), _SLOTS)
    row, col = np.nonzero(out == _NONE)
    full = out.copy()
    for t in range(len(_BORROW)):
        if not len(row):
            break
        got = out[row, _BORROW[t, col]]
        hit = got != _NONE
        full[row[hit], col[hit]] = got[hit] + np.uint32(t + 1)
        row, col = row[~hit], col[~hit]
    full[row, col] = out.min(1)[row] + np.uint32(len(_BORROW) + 1)  # of very short lines, whose few slots are not met
    return full


_FACTORS = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_tokens(sig: np.ndarray) -> np.ndarray:
    """(line, band) tokens of 64 bits."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    s *= _FACTORS
    return mix64(s.sum(2) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), line (number), node, n_chars of every line; node is null for empty lines."""
    d = docs.select("doc_id", text_hash().alias("h"), "text")

    def rows(it):
        for batch in it:
            for at, texts in column_blocks(batch):
                row, number, lines, chars = _lines(texts)
                row = pa.array(row + at)
                blank = pc.equal(pc.binary_length(lines), 0)
                node = pc.if_else(blank, pa.scalar(None, pa.int64()), pa.array(line_nodes(lines).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(number), node, pa.array(chars)], names=["doc_id", "h", "line", "node", "n_chars"])

    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, h long, line int, node long, n_chars int")


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    def rows(it):
        for batch in it:
            for _, texts in column_blocks(batch, chars=500_000):
                lines = _long_lines(texts)
                if not len(lines):
                    continue
                token = band_tokens(signature(lines.to_pylist())).ravel()
                node = np.repeat(line_nodes(lines), BANDS)
                yield packed((token % np.uint64(buckets)).astype(np.int64), token, node, np.zeros(len(node), np.int32))

    return docs.select("text").mapInArrow(rows, PACKED)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text, set size and parity map of the lines in question (and a few more): one pass over the documents with a bounded filter."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(nodes, "node"))

    def rows(it):
        for batch in it:
            for _, texts in column_blocks(batch, chars=500_000):
                lines = _long_lines(texts)
                node = line_nodes(lines)
                at = np.flatnonzero(shared.value(node))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), lines.take(pa.array(at))], names=["node", "text"])

    def maps(it):
        for batch in it:
            for at, lines in column_blocks(batch, chars=500_000):
                n, s = sizes_and_maps(lines.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lines)), lines, pa.array(n), pa.array([x.tobytes() for x in s], pa.binary())], names=["node", "text", "n", "s"])

    found = docs.select("text").mapInArrow(rows, "node long, text string").dropDuplicates(["node"])
    return durable(found.mapInArrow(maps, "node long, text string, n long, s binary"), "texts")


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose lines reach the threshold."""

    def check(it):
        for batch in it:
            for at, x in column_blocks(batch, "x", 250_000):
                a, b, y = (batch.column(i).slice(at, len(x)) for i in (0, 1, 3))
                ok = pa.array(alike(x.to_pylist(), y.to_pylist()))
                yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    side = lambda c, s: texts.select(F.col("node").alias(c), F.col("text").alias(s))
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def line_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), line, n_chars, blank, removed for every line; equal rows of ``docs`` have the same verdicts."""
    spark = docs.sparkSession
    lines = durable(line_table(docs), "lines")
    total = lines.filter("node is not null").count() * BANDS
    buckets = max(16, total // BUCKET)
    found = durable(_deal(docs, buckets).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather(buckets), FOUND), "bands")
    settle(spark)
    posted = found.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "m")
    weight = durable(posted.groupBy("node").agg(F.sum("m").alias("pop")), "weights")
    settle(spark)
    texts = _texts(docs, weight.select("node"))
    links = durable(_verify(texts, stars(posted, weight)), "links")
    settle(spark)
    comp = components(links)
    where = posted.join(comp, "node", "left").join(texts.select("node", "n", "s"), "node").withColumn("comp", F.coalesce("component", "node"))
    met = cells(where.select("token", "node", "n", "comp", F.lit(1 << 40).alias("most"), F.lit(-(1 << 40)).alias("at"), "s", "m"))
    met = met.select("token", "node", "n", "comp", "most", "at", "side", "s").repartition("token").sortWithinPartitions("token").mapInArrow(across(PERCENT, names=("a", "b", "n")), "a long, b long, n long")
    pairs = durable(met.select("a", "b").distinct(), "pairs")
    more = durable(_verify(texts, pairs), "links")
    discard(found, weight, texts, pairs)
    settle(spark)
    comp = merged(comp, more)
    discard(links, more)
    place = F.struct("doc_id", "h", "line")
    nodes = lines.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    nodes = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    firsts = nodes.filter("component is not null").groupBy("comp").agg(F.min("first").alias("keep"))
    keep = nodes.filter("n > 1 or component is not null").join(firsts, "comp", "left").select("node", F.coalesce("keep", "first").alias("keep"))
    return lines.join(keep, "node", "left").select(
        "doc_id", "h", "line", "n_chars", F.col("node").isNull().alias("blank"), F.coalesce(~place.eqNullSafe(F.col("keep")) & F.col("keep").isNotNull(), F.lit(False)).alias("removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with the removed lines taken out; those that lose their last line with a word are gone.

    The documents move once, to meet their verdicts.
    """
    h, i, j, n, gone, stays = fresh(docs, "_h", "_i", "_j", "_n", "_gone", "_stays")
    marks = line_verdicts(docs).groupBy("doc_id", "h").agg(
        F.count_if(F.col("line") == 0).alias("n"), F.count_if(~F.col("blank")).alias("full"), F.collect_set(F.when(F.col("removed"), F.col("line"))).alias("gone"))
    marks = marks.filter("full > 0 and (n > 1 or size(gone) > 0)").withColumn("stays", F.col("full") > F.col("n") * F.size("gone"))
    marks = durable(marks.select(F.col("doc_id").alias(i), F.col("h").alias(j), F.col("n").alias(n), F.col("gone").alias(gone), F.col("stays").alias(stays)), "removed")
    settle(docs.sparkSession)
    d = docs.withColumn(h, text_hash())
    d = d.join(marks, d["doc_id"].eqNullSafe(marks[i]) & (d[h] == marks[j]), "left").filter(F.coalesce(F.col(stays), F.lit(True)))
    # an array of one binds the lines to a name, so that the text is split once
    left = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda k: F.get(x, k)), "\n")
    rest = F.transform(F.array(F.split("text", "\n", -1)), left)[0]
    d = d.withColumn("text", F.when(F.size(gone) > 0, rest).otherwise(F.col("text")))
    several = F.coalesce(F.col(n) > 1, F.lit(False))
    if marks.filter(F.col(n) > 1).take(1):  # equal rows: one stays
        d = d.filter(~several).unionByName(d.filter(several).dropDuplicates(["doc_id", h]))
    return d.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; of equal rows the first has the verdict and the others lose all their lines."""
    line = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("line"))))
    v = line_verdicts(table(spark, sf_dir, "documents")).groupBy("doc_id", "h").agg(
        F.count_if(F.col("line") == 0).alias("n"), F.count("*").alias("n_lines"), line(F.col("removed")).alias("removed_lines"), line(F.col("blank")).alias("blank"),
        F.sum(F.when(~F.col("removed"), F.col("n_chars")).otherwise(0)).alias("chars_kept"), F.sum(F.when(F.col("blank"), F.col("n_chars")).otherwise(0)).alias("chars_blank"))
    v = v.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    first = F.col("copy") == 1
    whole = lambda c: (c / F.col("n")).cast("long")
    full = F.array_except(F.sequence(F.lit(0), whole(F.col("n_lines")).cast("int") - 1), F.col("blank"))
    v = v.withColumn("removed_lines", F.when(first, F.col("removed_lines")).otherwise(full))
    return v.select("doc_id", whole(F.col("n_lines")).alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines",
                    whole(F.when(first, F.col("chars_kept")).otherwise(F.col("chars_blank"))).alias("chars_kept"))


NAME, ORACLE = "op9_line_dedup", None
