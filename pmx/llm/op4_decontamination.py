"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words; all other words share ``OTHER`` hashed terms. Document
frequencies are counted over the whole corpus. TF-IDF rows, of length one, of the benchmark's passages and
of all passages of the corpus are the matrix of a randomised SVD: a random
block of ``RANK + MORE`` columns is multiplied by A'A where the rows lie, made orthonormal and multiplied again (a power step). The
``RANK`` best right singular vectors are those of the Nyström form of A'A that the second product gives, in the space it spans. The two kinds of rows have total weights of
``WEIGHT`` to one, and the rank is at most ``SHARE`` of the passages, so a latent vector is a real reduction.
The words of the corpus are looked up once: each text is written as term numbers, in order for the search and counted by passage for the products.
Documents are then read from there as overlapping windows of 32 and 64 words, whose latent vectors are sums of those of
16-word steps, and compared with every benchmark passage by cosine in blocks.

A candidate is confirmed by the longest common subsequence of the item's words and those around the
window: ``LCS`` of the item or more, or ``LCS_ANSWER`` if also the answer
(the item's last sentence) is there to ``ANSWER``. Words are lower-cased and lose their signs. All of this is read off the term numbers, as
an item's words have numbers of their own, which no other word has.
Against brute force (every window and item by common subsequence) the retrieval finds all leaks of the test tables; see the README.

The benchmark is searched in chunks of whole items with ``TERMS`` distinct words, about, a pass over the documents
each, so what is broadcast has a fixed size; benchmarks of some thousand items are one chunk.

Edge cases: null and empty texts and items match nothing; items under ``SHORT`` words must be
there word for word, and windows with their rarest word are their candidates; repeated rows and items give a row each; null ids are kept
as they are; the rows that ``without_leaks`` drops are told by doc_id and a hash of the text; a very long text is windows like any other, a block of them at a time; equal cosines are tried in order of place; an empty table on either side gives an empty result; other columns
are not read (``without_leaks`` carries them, whatever their names).
"""

from __future__ import annotations

import re
from copy import copy
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, fresh, release, table, text_blocks, text_hash
from .op10_ngram_jaccard import word_hashes

STEP, SMALL, LARGE = 16, 2, 4  # words, and steps in a small and a large window
#: Bits that say which words a step or an item may have.
BITS = 512
#: Items of so many words at most are looked for in small windows.
SMALL_WORDS = 26
RANK, MORE, SHARE, WEIGHT = 128, 16, 0.75, 8.0
OTHER, TERMS = 1024, 32_768
#: Tasks that sum a product over the corpus, at most: each sends a sum of the size of the block of columns.
FIT_TASKS = 32
#: Terms handled at once in a task, about, and passages that are one dense block of a product.
FIT_TERMS, FIT_ROWS = 250_000, 128
#: Words searched at once in a task, about.
SEARCH_WORDS = 80_000
COSINE, LCS, LCS_ANSWER, ANSWER, SHORT = 0.6, 0.75, 0.6, 0.9, 8
_TABLE = bytes(32 if (b < 128 and not chr(b).isalnum()) else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without signs."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def lcs(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence, with a bit for each of the item's n words (or their numbers)."""
    full = (1 << n) - 1
    v, get = full, masks.get
    for w in words:
        m = get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Item:
    def __init__(self, item_id, text: str):
        self.item_id, self.words = item_id, words_of(text)
        last = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(s)]
        self.masks = self.mask(self.words)
        self.counts = {w: m.bit_count() for w, m in self.masks.items()}
        answer = words_of(last[-1]) if len(last) > 1 else []
        self.answer, self.n_answer = self.mask(answer), len(answer)

    @staticmethod
    def mask(words: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def coded(self, terms: Terms) -> Item:
        """The same item with term numbers for words."""
        out, known = copy(self), list(self.masks)
        number = dict(zip(known, terms(known).tolist(), strict=True))
        out.words = [number[w] for w in self.words]
        out.masks, out.counts, out.answer = ({number[w]: x for w, x in of.items()} for of in (self.masks, self.counts, self.answer))
        return out

    def passages(self) -> list[list[bytes]]:
        size = STEP * LARGE
        return [self.words[i : i + size] for i in range(0, max(1, len(self.words) - size // 2), size)]

    def found(self, around: list) -> tuple[float, bool] | None:
        """(share of the item in common, answer there), if that confirms a leak. ``around``: words, of a coded item their numbers."""
        n = len(self.words)
        if n < SHORT:
            first = self.words[0]
            return (1.0, True) if any(w == first and around[i : i + n] == self.words for i, w in enumerate(around)) else None
        # no more than the item's places whose word is there can be in common
        if sum(map(self.counts.__getitem__, self.counts.keys() & set(around))) < LCS_ANSWER * n:
            return None
        share = lcs(self.masks, n, around) / n
        if share < LCS_ANSWER:
            return None
        answer = bool(self.n_answer) and lcs(self.answer, self.n_answer, around) >= ANSWER * self.n_answer
        return (share, answer) if share >= LCS or answer else None


class Terms:
    """Words to term numbers: the benchmark's words first, then shared terms for all others.

    Each process builds its own table, for the hash of a word may differ between them.
    """

    def __init__(self, words):
        self.words = sorted(words)
        self.n, self.size, self.known = len(self.words), len(self.words) + OTHER, None

    def __reduce__(self):
        return Terms, (self.words,)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if self.known is None:
            self.known = {w: i for i, w in enumerate(self.words)}
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        other = np.flatnonzero(out < 0)
        out[other] = self.n + (word_hashes([words[i] for i in other.tolist()]) % np.uint64(OTHER)).astype(np.int32)
        return out


def _steps(ids: np.ndarray, empty: int) -> np.ndarray:
    """Term numbers in rows of STEP, the last filled up with ``empty``."""
    n = -(-len(ids) // STEP)
    out = np.full(n * STEP, empty, np.int32)
    out[: len(ids)] = ids
    return out.reshape(n, STEP)


def _number(size: int):
    """The type of a term number among ``size``."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _binary(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of ``size`` numbers each."""
    ends = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values, and how many each has."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and data.size else np.zeros(0, kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def passage_terms(docs: DataFrame, terms: Terms, *keys: str) -> DataFrame:
    """(terms, counts, sizes, ids) of every document, as numbers in binary values: the distinct terms of its passages one after another, how often each stands there, how many a passage has, and the terms of all its words in order; behind them its columns ``keys``."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(terms)
    d, numbers = docs.select("text", *keys), ["terms", "counts", "sizes", "ids"]

    def rows(it):
        t = shared.value
        for batch in it:
            for row, texts in text_blocks(batch, chars=500_000):
                ids = [t(words) if words else np.zeros(0, np.int32) for words in map(words_of, texts)]
                at, n, sizes, passages = distinct_terms(ids, t.size)
                size = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(passages)])])
                out = [_binary(at.astype(_number(t.size)), size), _binary(n.astype(np.uint8), size), _binary(sizes.astype(np.uint8), passages), _binary(np.concatenate(ids).astype(_number(t.size)), np.array([len(x) for x in ids]))]
                yield pa.RecordBatch.from_arrays([*out, *(batch.column(1 + k).slice(row, len(texts)) for k in range(len(keys)))], names=[*numbers, *keys])

    return d.mapInArrow(rows, StructType([StructField(c, BinaryType()) for c in numbers] + d.schema.fields[1:]))


def distinct_terms(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as term numbers: the distinct terms of all passages one after another, how often each stands there, how many a passage has, and the passages of each text."""
    words = np.array([len(x) for x in ids], np.int64)
    passages = -(-words // (STEP * LARGE))
    place = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    key = (np.repeat(np.cumsum(passages) - passages, words) + place // (STEP * LARGE)) * size + np.concatenate([np.zeros(0, np.int32), *ids])
    key = key.astype(np.int32 if passages.sum() * size < 1 << 31 else np.int64)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    passage, term = np.divmod(key[first], size)
    return term, np.diff(first, append=len(key)), np.bincount(passage, minlength=int(passages.sum())), passages


def _slices(batch: pa.RecordBatch, size: int, most: int | None = None):
    """Rows of a batch with about ``most`` (``FIT_TERMS``) numbers of the first column each."""
    ends = np.concatenate([[0], np.cumsum(_numbers(batch.column(0), _number(size))[1])])
    start = 0
    while start < batch.num_rows:
        stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, ends[start] + (most or FIT_TERMS), side="right")) - 1))
        yield batch.slice(start, stop - start)
        start = stop


def document_frequency(passages: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents."""

    def rows(it):
        df, n = np.zeros(size + 1, np.int64), 0
        for batch in it:
            n += batch.num_rows
            for part in _slices(batch, size):
                at, length = _numbers(part.column(0), _number(size))
                key = np.repeat(np.arange(len(length)) * size, length) + at
                key.sort()
                df[:-1] += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] % size, minlength=size)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])
        release()

    out = np.zeros(size + 1, np.int64)
    for r in passages.select("terms").coalesce(FIT_TASKS).mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def tfidf(terms: Terms, idf: np.ndarray, words: list[bytes]):
    """(terms, weights) of each passage of a text; weights have length one."""
    ids = terms(words) if words else np.zeros(0, np.int32)
    for i in range(0, len(ids), STEP * LARGE):
        t, n = np.unique(ids[i : i + STEP * LARGE], return_counts=True)
        w = n * idf[t]
        yield t, (w / max(float(np.sqrt(w @ w)), 1e-9)).astype(np.float32)


def _add_product(out: np.ndarray, x: np.ndarray, idf: np.ndarray, at: np.ndarray, count: np.ndarray, size: np.ndarray) -> None:
    """Add A'(A x) of some passages to ``out``: blocks of passages are dense matrices over the terms that they have. Passages with a frequent term in common are neighbours, for these have more terms in common."""
    end = np.cumsum(size)
    start = end - size
    w = count * idf[at]
    w = (w / np.repeat(np.maximum(np.sqrt(np.add.reduceat(w * w, start)), 1e-9), size)).astype(np.float32)
    order = np.argsort(np.minimum.reduceat(np.argsort(np.argsort(idf))[at], start), kind="stable")
    part = np.zeros_like(x)
    for i in range(0, len(order), FIT_ROWS):
        which = order[i : i + FIT_ROWS]
        n = size[which]
        place = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        t, here = at[place], np.zeros(len(idf), bool)
        here[t] = True
        terms, column = np.flatnonzero(here), np.cumsum(here) - 1
        a = np.zeros((len(which), len(terms)), np.float32)
        a[np.repeat(np.arange(len(which)), n), column[t]] = w[place]
        part[terms] += a.T @ (a @ x[terms])
    out += part


def gram_product(passages: DataFrame, idf: np.ndarray, m: np.ndarray, step: int = 2048) -> tuple[np.ndarray, int]:
    """A'(A m) over all passages of the corpus, and their number; summed by blocks of terms before it comes to the driver."""
    shared = passages.sparkSession.sparkContext.broadcast((idf, m))

    def rows(it):
        weight, x = shared.value
        out, n = np.zeros(x.shape, np.float64), 0
        for batch in it:
            for part in _slices(batch, len(x)):
                at, count, size = (_numbers(part.column(c), kind)[0].astype(np.int64) for c, kind in enumerate((_number(len(x)), np.uint8, np.uint8)))
                if len(size):
                    _add_product(out, x, weight, at, count, size)
                n += len(size)
        out = out.astype(np.float32)
        parts = [out[i : i + step].tobytes() for i in range(0, len(out), step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary()), pa.array([n] * len(parts), pa.int64())], names=["block", "part", "n"])
        release()

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32) for x in t.column("part"))
        return pa.table({"block": t.column("block").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    kind = "block long, part binary, n long"
    got = sorted(passages.select("terms", "counts", "sizes").coalesce(FIT_TASKS).mapInArrow(rows, kind).groupBy("block").applyInArrow(add, kind).collect(), key=lambda r: r["block"])
    shared.destroy()
    if not got:
        return np.zeros_like(m), 0
    return np.frombuffer(b"".join(r["part"] for r in got), np.float32).reshape(m.shape).copy(), got[0]["n"]


def singular_vectors(product, size: int, rank: int, more: int = MORE) -> np.ndarray:
    """The best right singular vectors of A by a randomised range finder with a power step; ``product`` gives A'A m.

    With y = A'A q of the power step, y (q'y)^-1 y' is A'A but for what y does not span (Nyström), and has its eigenvectors without another product.
    """
    width = min(rank + more, size)
    q = np.random.default_rng(7).standard_normal((size, width)).astype(np.float32)
    q = np.linalg.qr(product(q).astype(np.float64))[0]
    y = product(q.astype(np.float32)).astype(np.float64)
    value, w = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    sure = value > 1e-6 * max(value.max(), 1e-30)
    u, s, _ = np.linalg.svd(y @ (w[:, sure] / np.sqrt(value[sure])), full_matrices=False)
    return u[:, :rank][:, s[:rank] ** 2 > 1e-6 * max(float(s[0]) ** 2 if len(s) else 0.0, 1e-30)].astype(np.float32)


def _bits(steps: np.ndarray) -> np.ndarray:
    """For each row of term numbers the bits of its terms."""
    out, row = np.zeros((len(steps), BITS // 64), np.uint64), np.arange(len(steps))
    for at in steps.T:
        out[row, (at // 64) % (BITS // 64)] |= np.uint64(1) << (at % 64).astype(np.uint64)
    return out


class Latent:
    """The latent space of one chunk of benchmark items, and their passages' vectors in it."""

    def __init__(self, items: list[Item], terms: Terms, idf: np.ndarray, corpus=None, rank: int = RANK):
        """``corpus(m)`` gives (A'A m, rows of A) of the corpus."""
        self.items, self.coded, self.size = items, [it.coded(terms) for it in items], terms.size
        passages = [(i, p) for i, it in enumerate(items) if len(it.words) >= SHORT for p in it.passages()]
        self.owner = np.array([i for i, _ in passages], np.int64)
        rows = [next(tfidf(terms, idf, p)) for _, p in passages]
        b = np.zeros((len(rows), terms.size), np.float32)
        for i, (t, w) in enumerate(rows):
            b[i, t] = w

        def product(m: np.ndarray) -> np.ndarray:
            out = WEIGHT / max(len(b), 1) * (b.T @ (b @ m))
            if corpus:
                part, n = corpus(m)
                out = out + part / max(n, 1)
            return out

        u = singular_vectors(product, terms.size, max(1, min(rank, int(SHARE * len(rows)))))
        v = np.concatenate([idf[:, None] * u, np.zeros((1, u.shape[1]))])  # the last row is the empty place
        self.v = np.ascontiguousarray(v, np.float32)
        z = b @ u
        self.z = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        small = np.array([len(p) <= SMALL_WORDS for _, p in passages], bool)
        self.kinds = [(w, np.flatnonzero(m)) for w, m in ((SMALL, small), (LARGE, ~small)) if m.any()]
        self.sizes = np.array([len(it.words) for it in items], np.int64)
        self.bits = np.array([np.bitwise_or.reduce(_bits(terms(it.words)[:, None]), 0) for it in items], np.uint64)
        #: The rarest term of each item that is too short for a passage.
        self.marks = sorted((int(max(terms(it.words), key=lambda t: (idf[t], t))), i) for i, it in enumerate(items) if len(it.words) < SHORT)

    def candidates(self, parts: list[np.ndarray], cosine: float = COSINE):
        """(document, first step, steps, item, cosine) arrays of windows that are similar to a passage of the item; ``parts`` are the documents' steps."""
        count = np.array([len(p) for p in parts])
        steps = np.concatenate(parts) if len(parts) else np.zeros((0, STEP), np.int32)
        doc = np.repeat(np.arange(len(parts)), count)
        start = np.repeat(np.cumsum(count) - count, count)
        out = []
        for i in range(0, len(steps), 4096):
            lo, hi = i, min(i + 4096 + LARGE, len(steps))
            s = np.empty((hi - lo, self.v.shape[1]), np.float32)
            for j in range(lo, hi, 64):
                s[j - lo : min(j + 64, hi) - lo] = self.v[steps[j : min(j + 64, hi)]].sum(1)
            here = np.arange(lo, min(i + 4096, len(steps)))
            for width, which in self.kinds:
                w = s[: len(here)].copy()
                for k in range(1, width):
                    last = max(0, min(len(here), hi - lo - k))
                    same = doc[here[:last] + k] == doc[here[:last]]
                    w[:last] += s[k : k + last] * same[:, None]
                # whole windows, and the first of a document that is shorter than one
                end = here + width - 1
                at = np.flatnonzero((here == start[here]) | (end < len(steps)) & (doc[np.minimum(end, len(steps) - 1)] == doc[here]))
                w = w[at]
                cos = (w @ self.z[which].T) / np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-9)[:, None]
                r, c = np.nonzero(cos >= cosine)
                if len(r):
                    g = here[at[r]]
                    out.append((doc[g], g - start[g], np.full(len(g), width), self.owner[which[c]], cos[r, c]))
        if self.marks:
            term, item = map(np.array, zip(*self.marks, strict=True))
            g, c = np.nonzero(np.isin(steps, term))
            first, end = np.searchsorted(term, steps[g, c]), np.searchsorted(term, steps[g, c], side="right")
            g, item = np.repeat(g, end - first), np.concatenate([item[i:j] for i, j in zip(first, end, strict=True)]) if len(g) else item[:0]
            out.append((doc[g], g - start[g], np.ones(len(g), np.int64), item, np.zeros(len(g))))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None

    def leaks(self, docs: list[np.ndarray]):
        """(document, item, cosine, share, answer) of the confirmed candidates, one for each pair; ``docs`` are the term numbers of their words."""
        parts = [_steps(x, len(self.v) - 1) for x in docs]
        got = self.candidates(parts)
        if got is None:
            return
        doc, first, width, owner, cos = got
        room = np.maximum(STEP, self.sizes[owner])
        lo, hi = np.maximum(first * STEP - room, 0), (first + width) * STEP + room
        keep = self._may(parts, doc, lo, hi, owner)
        order = np.flatnonzero(keep)[np.lexsort([x[keep] for x in (first, -cos, owner, doc)])]
        done = None
        for d, o, c, i, j in zip(*(x[order].tolist() for x in (doc, owner, cos, lo, hi)), strict=True):
            if (d, o) == done:
                continue
            ok = self.coded[o].found(docs[d][i:j].tolist())
            if ok:
                done = (d, o)
                yield d, o, c, *ok

    def _may(self, parts: list[np.ndarray], doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether the words from lo to hi of a document may have enough of the item: each bit of the item that no step there has is a word or more that is missing."""
        end = np.cumsum([len(p) for p in parts])
        start = end - [len(p) for p in parts]
        bits = _bits(np.concatenate([*parts, np.zeros((1, STEP), np.int32)]))
        i, j = start[doc] + lo // STEP, np.minimum(start[doc] - (-hi // STEP), end[doc])
        have = np.bitwise_or.reduceat(bits, np.stack([i, j], 1).ravel(), axis=0)[::2] if len(doc) else bits[:0]
        n = self.sizes[owner]
        missing = np.bitwise_count(self.bits[owner] & ~have).sum(1, dtype=np.int64)
        return (n < SHORT) | (n - missing >= LCS_ANSWER * n - 1e-6)


def benchmark_chunks(benchmark: DataFrame):
    """(items, their words) of each chunk of the benchmark."""
    items, words = [], set()
    for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        item = Item(r["item_id"], r["text"])
        if not item.words:
            continue
        if items and len(words.union(item.words)) > TERMS:
            yield items, words
            items, words = [], set()
        items.append(item)
        words.update(item.words)
    if items:
        yield items, words


def _fitted(passages: DataFrame, items: list[Item], terms: Terms) -> Latent:
    df, n = document_frequency(passages, terms.size)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    return Latent(items, terms, idf, lambda m: gram_product(passages, idf, m))


def found_leaks(docs: DataFrame, benchmark: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of the document, item_id, cosine, share, answer for every row of ``docs`` and benchmark item that it holds; written, chunk by chunk, as the corpus' term numbers are of one chunk."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    spark, kind = docs.sparkSession, benchmark.schema["item_id"]
    item_type, names = to_arrow_type(kind.dataType), ["item_id", "cosine", "share", "answer"]
    schema = StructType([*docs.select(*keys).schema.fields, StructField("item_id", kind.dataType), StructField("cosine", DoubleType()), StructField("share", DoubleType()), StructField("answer", BooleanType())])
    out = spark.createDataFrame([], schema)
    for items, words in benchmark_chunks(benchmark):
        terms = Terms(words)
        passages = durable(passage_terms(docs, terms, *keys), "passages")
        shared = spark.sparkContext.broadcast(_fitted(passages, items, terms))

        def rows(it, shared=shared):
            m = shared.value
            for batch in it:
                for part in _slices(batch, m.size, SEARCH_WORDS):
                    ids, length = _numbers(part.column(0), _number(m.size))
                    found = list(m.leaks(np.split(ids, np.cumsum(length)[:-1])))
                    if found:
                        row, item, cos, share, answer = zip(*found, strict=True)
                        at = pa.array(row, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(1 + k).take(at) for k in range(len(keys))), pa.array([m.items[i].item_id for i in item], item_type), pa.array(cos), pa.array(share), pa.array(answer)], names=[*keys, *names])
                release()

        out = out.unionByName(durable(passages.select("ids", *keys).mapInArrow(rows, schema), "leaks"))
        discard(passages)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer for every document and benchmark item that it holds (cosine 0: an item under SHORT words)."""
    return found_leaks(docs, benchmark, "doc_id")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all columns; each row is judged by its own text, whatever its id."""
    h, i, j = fresh(docs, "_h", "_i", "_j")
    d = docs.withColumn(h, text_hash())
    gone = found_leaks(d.select("doc_id", "text", h), benchmark, "doc_id", h).select(F.col("doc_id").alias(i), F.col(h).alias(j)).distinct()
    return d.join(gone, d["doc_id"].eqNullSafe(gone[i]) & (d[h] == gone[j]), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NAME, ORACLE = "op4_decontamination", None
