"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` computes one row of numbers per document; ``fit`` grows boosted
regression trees on a bounded labelled sample, with monotonic constraints on
chosen features; the trees are flattened into numpy node arrays, and ``quality_rules`` scores
every document with them, a level of all trees at a time.

Edge cases: a null or empty text has no words, fails the base rule and scores as
a document of zeros; a very long text is read whole, in arrays of some 60 bytes a word; a split value that ties with a
threshold goes left; null ids pass through; repeated rows give repeated rows; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, so other
columns, whatever their names, change nothing. Without labels of both kinds
there is no model and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table, text_blocks, text_hash

#: Labelled rows used for the fit, at most (picked by a hash of doc_id).
FIT_ROWS = 6000
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 60, 3, 0.2, 32, 10, 1.0
#: A document is rejected where its probability of label 1 is under this.
KEEP_AT = 0.5
#: Feature names, and whether quality may only fall (-1) or is free (0) in each.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "same_as_previous_share": -1, "distinct_word_share": 0, "upper_share": -1, "digit_share": -1, "bang_share": -1,
    "pipe_share": -1, "punct_share": 0, "non_ascii_share": 0, "words_per_line": 0,
}
# byte classes: 0 other, 1 space, 2 symbol, 3 upper, 4 lower, 5 digit, 6 bang, 7 punctuation, 8 continuation, 9 lead, 10 pipe
_CLASS = np.zeros(256, np.uint8)
for _bytes, _c in ((b" \t\n\v\f\r", 1), (b"#*$%&<>", 2), (bytes(range(65, 91)), 3), (bytes(range(97, 123)), 4),
                   (bytes(range(48, 58)), 5), (b"!", 6), (b".,;:?'\"()-", 7), (bytes(range(128, 192)), 8),
                   (bytes(range(192, 256)), 9), (b"|", 10)):
    _CLASS[list(_bytes)] = _c
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(h: np.ndarray, window: int = 8) -> int:
    """Words that lie in a ``window``-word window found twice or more; h: 64-bit word hashes."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    w = h.view(np.uint64)
    width, p = 1, w
    while width < window:  # doubling: the hash of 2k words from those of k
        p = p[:-width] * np.uint64(0x9E3779B97F4A7C15 ^ (width << 40)) + (p[width:] ^ (p[width:] >> np.uint64(29)))
        width *= 2
    order = np.argsort(p, kind="stable")
    s = p[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + window, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    k = np.bincount(_CLASS[np.frombuffer(b, np.uint8)], minlength=11)
    points = len(b) - int(k[8])
    chars = points - int(k[1])
    symbols = int(k[2] + k[10])
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    h = np.fromiter(map(hash, words), np.int64, n)
    rep = repeat_words(h)
    same = int((h[1:] == h[:-1]).sum())
    return [n, chars, symbols, dup, rep], [
        float(np.log1p(n)), chars / n, symbols / chars, dup / len(lines), rep / n, same / n, len(set(words)) / n, k[3] / chars,
        k[5] / chars, k[6] / chars, k[10] / n, k[7] / chars, k[9] / chars, n / len(lines)]


@dataclass
class Trees:
    """Complete binary trees as arrays of (tree, node); node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.start + self.leaf[trees, node - (2**DEPTH - 1)].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None) -> Trees | None:
    """Boosted trees on the logistic loss with histogram splits.

    A split on a constrained feature is taken only if the children's values have
    the wanted order, and the middle of the two bounds what lies below on either side.
    """
    monotone = list(FEATURES.values()) if monotone is None else monotone
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return None
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner, leaves = np.full(n, start), 2**DEPTH - 1, 2**DEPTH
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        value = lambda m: float(g[m].sum() / (h[m].sum() + L2))
        nodes = {0: (np.arange(n), -np.inf, np.inf)}
        for node in range(inner):
            rows, low, high = nodes.pop(node)
            best, gs, hs = (1e-9, None), g[rows].sum(), h[rows].sum()
            for j in range(d if len(rows) >= 2 * MIN_LEAF else 0):
                size = len(cuts[j]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(binned[rows, j], w, size))[:-1] for w in (g[rows], h[rows], None))
                ok = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF)
                vl, vr = np.clip(gl / (hl + L2), low, high), np.clip((gs - gl) / (hs - hl + L2), low, high)
                if monotone[j]:
                    ok &= (vr - vl) * monotone[j] >= 0
                gain = np.where(ok, gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2), 0)
                if len(gain) and gain.max() > best[0]:
                    c = int(gain.argmax())
                    best = (float(gain[c]), (j, c, vl[c], vr[c]))
            left, right = 2 * node + 1, 2 * node + 2
            if best[1] is None:
                nodes[left], nodes[right] = (rows, low, high), (rows[:0], low, high)
                continue
            j, c, vl, vr = best[1]
            out.feature[t, node], out.threshold[t, node] = j, cuts[j][c]
            m, mid = binned[rows, j] <= c, (vl + vr) / 2
            bound_l, bound_r = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high))
            nodes[left], nodes[right] = (rows[m], *bound_l), (rows[~m], *bound_r)
        for node, (rows, low, high) in nodes.items():
            if len(rows):
                v = RATE * float(np.clip(value(rows), low, high))
                out.leaf[t, node - inner] = v
                margin[rows] += v
    return out


def _verdicts(texts: list[str], model: Trees | None):
    """Base counts, base_failed, kept and score of some texts."""
    base, feats = zip(*map(statistics, texts), strict=True)
    base, x = np.array(base, np.int64).reshape(len(texts), 5), np.array(feats).reshape(len(texts), -1)
    failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
    score = model.probability(x) if model else np.where(failed, 0.0, 1.0)
    return base, failed, ~failed & (score >= KEEP_AT), score


def _rows(it, model: Trees | None):
    for batch in it:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for at, texts in text_blocks(batch):
            base, failed, kept, score = _verdicts(texts, model)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(texts)), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)],
                names=["doc_id", *_BASE, "base_failed", "kept", "score"])


def _features(it):
    for batch in it:
        for at, texts in text_blocks(batch):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(at, len(texts)) for i in range(3)), pa.array([statistics(t)[1] for t in texts], pa.list_(pa.float64()))], names=["doc_id", "quality", "h", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees | None:
    """Fit on ``rows`` labelled documents at most: of an id one label (the lower) and one text (by its hash) count."""
    some = labelled_sample(labels, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", text_hash().alias("h"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "h", "text").mapInArrow(_features, f"doc_id {kind}, quality int, h long, x array<double>")
    got = made.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("r")).select("r.quality", "r.x").toPandas()
    if not len(got):
        return None
    x, y = np.array(got.x.tolist()), got.quality.to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees however the rows arrived
    return fit(x[order], y[order])


def quality_rules(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document."""
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(
        lambda it: _rows(it, model),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep_documents(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns, in the same pass."""

    def rows(it):
        for batch in it:
            kept = [_verdicts(texts, model)[2] for _, texts in text_blocks(batch)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))


NAME, ORACLE = "op1_quality_rules", None
