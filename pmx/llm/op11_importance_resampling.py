"""Target-distribution importance resampling: documents whose words and word pairs look like the target's are drawn more often.

Two Arrow passes over the texts. In the first every partition counts its features into hashed buckets with ``np.bincount``,
and ``treeReduce`` merges those vectors, a fixed 10,000 numbers each, for the corpus and for the target. They make one gain a bucket. In the
second the gains, broadcast (80 KB), are gathered for the features of each document and summed by a weighted ``np.bincount``. Gumbel
noise from a hash of the id makes the top scores a weighted draw without replacement. Ranks over all documents come
from a range-partitioned sort: places within a partition, plus the sizes of the partitions before it.

Edge cases: null and empty texts, and texts without a word, have no feature, weight 0 and are never drawn; a word of any length is
hashed whole, a very long text is one document; documents of equal score are ordered by doc_id (null last), then by a hash of the text;
a null id takes its noise from the empty string; repeated rows are documents of their own and get ranks of their own; an empty target makes the gains those of a
uniform one; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_blocks, durable, fresh, table, text_hash

BUCKETS = 10_000
#: Of the documents with so many words at least, so many in a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 25
#: Gains, weights and noise are in units of 1/SCALE; the noise is that of SEED.
SCALE, SEED = 1000, 7
#: Words up to so many bytes are hashed side by side; longer ones each by itself.
SIDE_BY_SIDE = 48
# upper case becomes lower; bytes of words are digits, letters and all that is not ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte).astype(np.uint8)] ^ state >> np.uint32(8)


def _crc(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc register after the words, for all words at once, a byte of each at a time."""
    order = np.argsort(-length, kind="stable")
    s, at, n = state[order], start[order], length[order]
    some = int(np.searchsorted(-n, -SIDE_BY_SIDE, "left"))  # the words before are longer
    for i in range(some):
        whole = data[at[i] : at[i] + n[i]].tobytes()
        s[i] = zlib.crc32(whole, int(s[i] ^ _ALL)) ^ 0xFFFFFFFF
    for i in range(int(n[some]) if some < len(n) else 0):
        k = int(np.searchsorted(-n, -i, "left"))  # the words longer than i
        s[some:k] = _step(s[some:k], data[at[some:k] + i])
    out = np.empty_like(s)
    out[order] = s
    return out


def features(col: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, its bucket, words of each document) of a column of texts without nulls."""
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    n = int(off[-1] - off[0])
    data = _LOWER[np.frombuffer(col.buffers()[2], np.uint8)[int(off[0]) : int(off[-1])]] if n else np.zeros(0, np.uint8)
    off = off - off[0]
    w = _WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    edges = off[(off > 0) & (off < n)]
    before[edges] = after[edges - 1] = False  # no word goes over the end of its text
    start = np.flatnonzero(w & ~before)
    length = np.flatnonzero(w & ~after) + 1 - start
    doc = np.searchsorted(off, start, "right") - 1
    one = _crc(np.full(len(start), _ALL), data, start, length)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    two = _crc(_step(one[pair], np.uint32(32)), data, start[pair + 1], length[pair + 1])
    bucket = (np.concatenate([one, two]) ^ _ALL) % np.uint32(buckets)
    return np.concatenate([doc, doc[pair]]), bucket, np.bincount(doc, minlength=len(col))


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def count(it):
        total = np.zeros(buckets, np.int64)
        for batch in it:
            for _, col in column_blocks(batch):
                total += np.bincount(features(col, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    vectors = df.select("text").mapInArrow(count, "v binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r["v"], np.int64)).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The floored, scaled log of how much likelier each bucket is in the target; counts have one added."""
    s, t, b = source.astype(float), target.astype(float), len(source)
    return np.floor(scale * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_features and weight (floored mean gain of the features) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def rows(it):
        g = shared.value
        for batch in it:
            for at, col in column_blocks(batch):
                doc, bucket, words = features(col, len(g))
                n = np.bincount(doc, minlength=len(col))
                total = np.bincount(doc, g[bucket], minlength=len(col)).astype(np.int64)  # exact: far below 2 ** 53
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(col)) for i in (0, 1)] + [pa.array(x.astype(np.int64)) for x in (words, n, total // np.maximum(n, 1))],
                                                 names=["doc_id", "h", "n_words", "n_features", "weight"])

    d = docs.select("doc_id", text_hash().alias("h"), "text")
    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, h long, n_words long, n_features long, weight long")


def noise(seed: int = SEED, scale: int = SCALE):
    """Gumbel noise of a document, from a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, h, n_features, weight, score and rank (null if not drawn) of every document."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = durable(weigh(docs, gain).withColumn("score", F.col("weight") + noise()), "scored")
    able = F.col("n_words") >= least
    # a range-partitioned sort; an id of this kind holds the partition above 33 bits and the place in it
    placed = durable(scored.filter(able).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "h").withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)])
    starts = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before[:-1], strict=True)], "part long, before long")
    drawn = int(before[-1]) * percent // 100
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    cols = ["doc_id", "h", "n_features", "weight", "score"]
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").select(*cols, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~able).select(*cols, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn documents, with all their columns; of rows of equal id and text all stay if one is drawn."""
    h, i, j = fresh(docs, "_h", "_i", "_j")
    d = docs.withColumn(h, text_hash())
    some = resample(docs, target, percent).filter("rank is not null").select(F.col("doc_id").alias(i), F.col("h").alias(j)).distinct()
    return d.join(some, d["doc_id"].eqNullSafe(some[i]) & (d[h] == some[j]), "left_semi").drop(h)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


NAME = "op11_importance_resampling"

ORACLE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) AS r(i)),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
pieces AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT side, id, f, count(*) AS n FROM pieces GROUP BY side, id, f),
vocabulary AS (SELECT DISTINCT f FROM counted),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(hex(encode(f))), 2), lambda i: CAST('0x' || substr(hex(encode(f)), i, 2) AS BIGINT)),
                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table),
sides AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM sides),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM sides, totals),
weights AS (
  SELECT id, sum(n) AS n_features, floor(CAST(sum(n * g) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, CAST(COALESCE(n_features, 0) AS BIGINT) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
         CAST(COALESCE(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(w.id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights ON weights.id = w.id WHERE w.side = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= n * 25 // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked ON ranked.doc_id = s.doc_id"""
