"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms are the words (folded, hashed to ``LEXICAL`` terms), pairs of byte classes (letters keep their case and kind, every sign is
its own class) and repetition marks. TF-IDF rows of a bounded labelled sample are
factorised; the labelled vectors in latent space are broadcast (their number is
the documented bound ``FIT_ROWS``), and every document takes the exact cosine with all of them in
blocks. The nearest ``K`` vote with weights that fall with distance; of equal cosines at the K-th place the first in order of doc_id vote.

Edge cases: empty and null texts, and those without a word, have no vector and score the share of label 1 among labelled ones of their kind, with one
of label 0 added; a very long text is one vector, made in a pass over it; null ids pass through; repeated rows stay; an empty table gives an empty result;
other columns are not read. Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, split_residue, table, text_blocks, text_hash
from .op10_ngram_jaccard import word_hashes

#: Labelled rows learnt from, at most; also the bound of the broadcast.
FIT_ROWS = 4000
DIMS, K, SHARP, BLOCK = 40, 15, 30.0, 512
_SIGNS = b" \t\n.,;:!?'\"()-#*$%&|<>/=@_"
# classes: 0 other, 1 lower vowel, 2 lower consonant, 3 upper, 4 digit, 5 lead or continuation byte, 6.. signs
_CLASS = np.zeros(256, np.uint16)
_CLASS[list(range(97, 123))] = 2
_CLASS[list(b"aeiou")] = 1
_CLASS[list(range(65, 91))] = 3
_CLASS[list(range(48, 58))] = 4
_CLASS[list(range(128, 256))] = 5
for _i, _b in enumerate(_SIGNS):
    _CLASS[_b] = 6 + _i
_N = 6 + len(_SIGNS)
#: Hashed words, and their weight against the other terms.
LEXICAL, WORD_WEIGHT = 1024, 0.25
#: Words, pairs, then a word equal to the previous one, a repeated line and a word seen before.
TERMS = LEXICAL + _N * _N + 3


def counts(texts: list[str]) -> np.ndarray:
    """Term counts of each text over its length, as a dense block."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        words = b.split()
        if not words:
            continue
        c = _CLASS[np.frombuffer(b, np.uint8)]
        if len(c) > 1:
            out[i, LEXICAL : LEXICAL + _N * _N] = np.bincount(c[:-1] * np.uint16(_N) + c[1:], minlength=_N * _N)
        h = word_hashes(words)
        out[i, :LEXICAL] = WORD_WEIGHT * np.bincount(word_hashes(b.lower().split()) % np.uint64(LEXICAL), minlength=LEXICAL)
        lines = [x for x in b.split(b"\n") if x.strip()]
        out[i, -3] = 4 * (h[1:] == h[:-1]).sum()
        out[i, -2] = 4 * len(words) * (len(lines) - len(set(lines))) / len(lines)
        out[i, -1] = 0.5 * (len(words) - len(set(words)))
    return out


class Neighbours:
    """Labelled latent vectors with the projection that made them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = DIMS):
        full = x.any(1)
        self.empty = float(y[~full].sum() / ((~full).sum() + 1))
        x, y = x[full], y[full]
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        a = self.weigh(x)
        _, s, vt = np.linalg.svd(a.T @ a, hermitian=True)
        self.v = vt[: min(dims, (s > 1e-6 * max(s[0], 1e-30)).sum())].T.astype(np.float32)
        self.z, self.y = self.unit(a @ self.v), y.astype(np.float32)

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        share = x / np.maximum(x.sum(1, keepdims=True), 1)
        return self.unit(np.sqrt(share) * self.idf).astype(np.float32)

    def score(self, x: np.ndarray, k: int = K) -> np.ndarray:
        out = np.empty(len(x))
        k = min(k, len(self.z))
        if not k:
            return np.where(x.any(1), 0.5, self.empty)
        for i in range(0, len(x), BLOCK):
            part = x[i : i + BLOCK]
            cos = self.unit(self.weigh(part) @ self.v) @ self.z.T
            last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            first = np.where(cos > last, 2, cos == last)  # of those equal to the last the first vote, however rows are dealt
            near = np.argsort(-first, axis=1, kind="stable")[:, :k]
            sim = np.take_along_axis(cos, near, 1)
            w = np.exp(SHARP * (sim - sim.max(1, keepdims=True)))
            vote = (w * self.y[near]).sum(1) / w.sum(1)
            out[i : i + BLOCK] = np.where(part.any(1), np.clip(vote, 0, 1), self.empty)
        return out


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Neighbours | None:
    """Learn from ``rows`` labelled documents at most: of an id one label (the lower) and one text (by its hash) count."""
    some = labelled_sample(labels, rows)

    def terms(it):
        for batch in it:
            for at, texts in text_blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, len(texts)) for i in range(3)] + [pa.array([r.tobytes() for r in counts(texts)], pa.binary())], names=["doc_id", "quality", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", text_hash().alias("h"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "h", "text").mapInArrow(terms, f"doc_id {kind}, quality int, h long, x binary")
    got = made.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    return Neighbours(np.stack([np.frombuffer(r, np.float32) for r in got.x]), got.quality.to_numpy())


def knn_quality(docs: DataFrame, model: Neighbours | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it):
        m = shared.value
        for batch in it:
            for at, texts in text_blocks(batch):
                s = m.score(counts(texts)) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", F.coalesce(split_residue(3) == 1, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return knn_quality(docs, train(docs, table(spark, sf_dir, "labels").filter(split_residue(3) != 1)))


NAME, ORACLE = "op2_quality_knn", None
