"""Language identification by nearest centroid.

Documents become normalised TF-IDF vectors of hashed byte trigrams (case folded);
every language has several centroids from spherical k-means over a bounded
sample of its documents; the most similar centroid by cosine names the language. A document
farther from it than nearly all training documents of that language is
``rejected`` (its nearest language is still reported in ``lang_pred``).

Edge cases: null texts and texts without a letter give ``und`` and score 0; equal cosines give the first name; a very long
text is one vector, made in a pass over its bytes; null ids pass through; repeated rows stay; an empty table, or one without a
learnable language, gives ``und`` for every row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import split_residue, table, text_blocks

#: Documents learnt from, in all (if each language has its least) and of one language, at most and at least.
FIT_ROWS, PER_LANGUAGE, LEAST = 3000, 700, 20
#: Names of languages whose counts are broadcast, at most.
MOST_SENT = 10_000
CENTROIDS, DIMS, TEMPERATURE, REJECT_QUANTILE, REJECT_MARGIN = 4, 4096, 0.03, 0.002, 0.15
# classes: 0 anything else, 1-26 letters of either case, 27 lead bytes, 28-59 continuation bytes by their low 5 bits
_CLASS = np.zeros(256, np.uint32)
_CLASS[list(range(65, 91))] = _CLASS[list(range(97, 123))] = np.arange(1, 27)
_CLASS[192:] = 27
_CLASS[128:192] = 28 + (np.arange(128, 192) & 31)


def grams(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        c = _CLASS[np.frombuffer(f" {t} ".encode("utf-8", "surrogatepass"), np.uint8)]
        g = c[:-2] << np.uint32(12) | c[1:-1] << np.uint32(6) | c[2:]
        out[i] = np.bincount((g * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
        out[i, 0] = 0  # the trigram of three other signs
    return out


def has_letter(t: str) -> bool:
    return any(map(str.isalpha, t))


class Centroids:
    """Centroids per language, with the similarity under which a document is rejected."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, per_language: int = CENTROIDS):
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        z = self.weigh(x)
        self.names = sorted(set(langs))
        parts, owner, floor = [], [], []
        for k, name in enumerate(self.names):
            own = z[langs == name]
            c = self.cluster(own, per_language)
            parts.append(c)
            owner += [k] * len(c)
            floor.append(float(np.quantile((own @ c.T).max(1), REJECT_QUANTILE)) - REJECT_MARGIN)
        self.c, self.owner, self.floor = np.concatenate(parts), np.array(owner), np.array(floor)

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        return self.unit(np.sqrt(x) * self.idf)

    def cluster(self, z: np.ndarray, k: int) -> np.ndarray:
        """Spherical k-means; seeds are taken farthest first, so there is no chance in it."""
        c = self.unit(z.mean(0, keepdims=True))
        while len(c) < min(k, len(z)):
            c = np.concatenate([c, z[[int((z @ c.T).max(1).argmin())]]])
        for _ in range(12):
            near = (z @ c.T).argmax(1)
            c = np.stack([self.unit(z[near == j].mean(0, keepdims=True))[0] if (near == j).any() else c[j] for j in range(len(c))])
        return c

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = self.weigh(x) @ self.c.T
        best = np.stack([cos[:, self.owner == k].max(1) for k in range(len(self.names))], 1)
        p = np.exp((best - best.max(1, keepdims=True)) / TEMPERATURE)
        k = best.argmax(1)
        return k, 1 / p.sum(1), best.max(1) < self.floor[k]


def train(docs: DataFrame, rows: int = FIT_ROWS, per_language: int = PER_LANGUAGE) -> Centroids | None:
    """Learn from (text, lang) of an equal share of ``rows`` for each language, ``per_language`` at most and LEAST at least, about.

    A language with fewer documents than its share gives all; a document found several times counts once.
    """
    h = F.xxhash64("doc_id", "text", F.lit(5))
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null").withColumn("h", h)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))
    quota = F.greatest(F.least(F.lit(per_language), F.lit(rows) / F.count("*").over(Window.partitionBy())), F.lit(LEAST))
    sizes = sizes.withColumn("quota", quota)
    # a row a language: sent to all tasks where its size is checked, so that no text moves; else Spark joins as it sees fit
    some = known.join(F.broadcast(sizes) if sizes.count() <= MOST_SENT else sizes, "lang").filter(share * F.col("n") < F.col("quota")).dropDuplicates(["h"]).select("doc_id", "lang", "text")

    def vectors(it):
        for batch in it:
            for at, texts in text_blocks(batch):
                x = [np.minimum(r, 65535).astype(np.uint16).tobytes() if has_letter(t) else None for t, r in zip(texts, grams(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(texts)) for i in (0, 1)] + [pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = some.mapInArrow(vectors, f"doc_id {kind}, lang string, x binary").filter("x is not null").toPandas().sort_values(["doc_id", "lang"])
    return Centroids(np.stack([np.frombuffer(r, np.uint16) for r in got.x]).astype(np.float32), got.lang.to_numpy(object)) if len(got) else None


def language_id(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it):
        m = shared.value
        for batch in it:
            for at, texts in text_blocks(batch, chars=1_000_000):
                ok = np.array([bool(m) and has_letter(t) for t in texts])
                lang, score, far = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
                for i in range(0, len(texts) if m else 0, 256):
                    k, s, r = m.predict(grams(texts[i : i + 256]))
                    o = ok[i : i + 256]
                    lang[i : i + 256][o] = np.array(m.names, object)[k][o]
                    score[i : i + 256][o], far[i : i + 256][o] = s[o], r[o]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score), pa.array(far)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    d = docs.select("doc_id", F.coalesce(split_residue(5) == 0, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, train(docs.filter(split_residue(5) != 0)))


NAME, ORACLE = "op7_language_id", None
