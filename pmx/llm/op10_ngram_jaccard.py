"""N-gram Jaccard join: grouped prefix join over word shingles.

Two documents link when their sets of distinct ``SHINGLE``-word shingles have a Jaccard
similarity of ``PERCENT`` or more. The join is exact (sets are of 64-bit hashes):

1. One pass gives each document's set size and class (copies share a class), and
   the shingles that a block of documents repeats; the most repeated become the end of
   the token order (all others are ordered by hash), so a passage that a third of
   the corpus holds stays out of nearly all prefixes.
2. Documents with the same prefix and size are one group. Prefix tokens are
   dealt by hash as packed blobs; each bucket keeps the tokens that two groups share.
3. Each token has a star: its groups against the one with the most popular tokens. Each group's
   best star, filtered by the overlap bound, is expanded to members and verified, which joins large
   groups of near copies at a cost linear in their size. Members of a group meet one of them.
4. Then all group pairs that share a prefix token and are not connected yet are filtered: by size,
   by the place of the token (one so late that a pair which links must share an earlier one), and by
   parity maps in which only the bits count that all members of a group have in common. A group
   whose members are in several components stands here once for each. The pairs left are expanded to
   members, filtered by the members' own maps, and verified. None of these filters loses a link; that of
   step 3 may, for a star counts only its own tokens, and leave the pair to this step.

A link inside a component changes nothing, so no other pair is expanded. Every text
is tokenised anew where needed; the sets of those in question are written and deleted after use.

Edge cases: null and empty texts have an empty set, link with nothing and are their own
component; with fewer words than a shingle the whole sequence is one; copies and
repeated rows share a class, so ties need no rule; a very long text is one set in one worker, about
100 bytes a word; null ids are members, but never name a component unless
alone; an empty table gives an empty result; other columns are not read. ``without_near_copies`` keeps
of each component the row with the smallest id (null last, then by a hash of the text), so rows
with repeated or null ids are told apart by their text, and equal rows are one.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, components, discard, durable, merged, mix64, one_of_each, settle, table, text_blocks, text_hash
from .pairs import FOUND, PACKED, across, cells, gather, packed, parity_map, stars

SHINGLE, PERCENT = 5, 75
#: A shingle that partitions repeat this often in all is put last in the order; so many of these are broadcast at most.
FREQUENT, MOST_FREQUENT = 8, 250_000
#: Repeats are looked for among hashes under this share of their range, for higher ones are in hardly any prefix.
LOW = 0.4
#: Shingles held for that by a task at most.
HELD = 4_000_000
#: Prefix tokens in a bucket, about.
BUCKET = 250_000
#: Bits of a set's parity map.
PARITY = 1024


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; Python's own where its seed is fixed for all workers, as Spark does."""
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(width, len(h))
    p = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        w = h[j : j + len(p)]
        p = p * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29)))
    return np.unique(mix64(p))


def prefix_size(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def class_key(s: np.ndarray) -> np.uint64:
    """A key of the whole set."""
    with np.errstate(over="ignore"):
        return mix64(np.array([(s * np.uint64(0xC2B2AE3D27D4EB4F) ^ (s >> np.uint64(31))).sum() + np.uint64(len(s))], np.uint64))[0]


def _ordered_prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    size = prefix_size(len(s), percent)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        m = frequent[at] == s
        if m.any():
            s = np.concatenate([s[~m], s[m]])
    return s[:size]


def signatures(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: a document (doc_id, hash h of its text, class a, set size n); of kind 1: a shingle a that n texts of a partition share."""
    d = docs.select("doc_id", text_hash().alias("h"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    low = np.uint64(int(LOW * 2**64))
    names = ["kind", "doc_id", "h", "a", "n"]

    def repeats(parts: list, id_type) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        value, count = value[count > 1], count[count > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(value), np.int32)), pa.nulls(len(value), id_type), pa.nulls(len(value), pa.int64()), pa.array(value.view(np.int64)), pa.array(count)], names=names)

    def rows(it):
        seen, parts, held, id_type = set(), [], 0, None
        for batch in it:
            id_type = batch.column(0).type
            for at, texts in text_blocks(batch):
                sets = [shingles(t) for t in texts]
                keys = np.array([class_key(s) if len(s) else np.uint64(0) for s in sets], np.uint64)
                for k, s in zip(keys.tolist(), sets, strict=True):
                    if k not in seen:
                        seen.add(k)
                        parts.append(s[: np.searchsorted(s, low)])
                        held += len(parts[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(texts), np.int32)), batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(keys.view(np.int64)), pa.array(np.array([len(s) for s in sets], np.int64))], names=names)
                if held > HELD:
                    yield repeats(parts, id_type)
                    seen, parts, held = set(), [], 0
        if parts:
            yield repeats(parts, id_type)

    return d.mapInArrow(rows, f"kind int, doc_id {kind}, h long, a long, n long")


def _deal(docs: DataFrame, frequent: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """Prefix tokens with group and place in its prefix, and the members (class, group, parity map, size), packed by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(it):
        for batch in it:
            for _, texts in text_blocks(batch):
                tok, grp, place, member = [], [], [], {}
                seen = set()
                for t in texts:
                    s = shingles(t)
                    if not len(s):
                        continue
                    p = _ordered_prefix(s, shared.value, percent)
                    g = class_key(np.append(p, np.uint64(len(s))))
                    member[class_key(s)] = (g, len(s), parity_map(s, PARITY))
                    if g not in seen:
                        seen.add(g)
                        tok.append(p)
                        grp.append(np.full(len(p), g, np.uint64))
                        place.append(np.arange(len(p), dtype=np.int32))
                if not tok:
                    continue
                x, y, z = map(np.concatenate, (tok, grp, place))
                yield packed((x % np.uint64(buckets)).astype(np.int64), x, y, z)
                x = np.array(list(member), np.uint64)  # members have buckets of their own
                y = np.stack([np.concatenate([[g], m]) for g, _, m in member.values()]).astype(np.uint64)
                yield packed(buckets + (x % np.uint64(buckets)).astype(np.int64), x, y, np.array([n for _, n, _ in member.values()], np.int32))

    return docs.select("doc_id", "text").mapInArrow(rows, PACKED)


def _may_link(n1, n2, shared, percent: int):
    """Whether the overlap can reach the threshold: a set whose prefix ends first has no
    token of its prefix in the other but the shared ones."""
    rest = lambda n: n - (n - F.ceil(F.lit(percent) * n / 100) + 1)
    bound = F.greatest(rest(n1), rest(n2)) + shared
    bound = F.least(bound, n1, n2)
    return bound * (100 + percent) >= (n1 + n2) * percent


def _wide_map(s: np.ndarray) -> np.ndarray:
    """A parity map with four bits or more for each element of the set."""
    return parity_map(s, 1 << max(10, int(4 * len(s) - 1).bit_length()))


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two parity maps differ at least; slots are numbers modulo the width, so the wider map folds onto the other."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, written.

    A pass over the documents writes the sets of those in question, found by a bounded filter, with parity maps that grow with
    the set. The maps alone rule out nearly all pairs that do not link, so only sets of the others move.
    """
    spark = docs.sparkSession
    need = durable(pairs.select(F.explode(F.array("a", "b")).alias("ck")).distinct().join(classes, "ck").select("ck", F.xxhash64("first.doc_id", "first.h").alias("h")), "need")
    asked = spark.sparkContext.broadcast(Filter(need, "h"))

    def sets(it):
        seen = set()
        for batch in it:
            for _, ts in text_blocks(batch.filter(pa.array(asked.value(batch.column(0).to_numpy())))):
                made = {class_key(s): s for s in map(shingles, ts) if len(s)}
                new = [k for k in made if k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(new, np.uint64).view(np.int64)), pa.array([len(made[k]) for k in new], pa.int64()),
                     pa.array([_wide_map(made[k]).tobytes() for k in new], pa.binary()), pa.array([made[k].tobytes() for k in new], pa.binary())], names=["ck", "n", "map", "set"])

    # a false alarm of the filter makes a set that nothing asks for, a repeated row in two tasks a link twice
    made = durable(docs.select(F.xxhash64("doc_id", text_hash()).alias("h"), "text").mapInArrow(sets, "ck long, n long, map binary, set binary"), "sets")

    def near(it):
        for batch in it:
            a, b, n, m, x, y = (batch.column(i) for i in range(6))
            n, m = n.to_numpy(), m.to_numpy()
            need = -(-percent * (n + m) // (100 + percent))
            ok = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(need <= np.minimum(n, m)):
                ok[i] = 2 * need[i] + _apart(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) <= n[i] + m[i]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    side = lambda c, n, s: made.select(F.col("ck").alias(c), F.col("n").alias(n), F.col("map").alias(s))
    close = pairs.select("a", "b").join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    close = durable(close.mapInArrow(near, "a long, b long").distinct(), "close")
    settle(spark)
    wanted = spark.sparkContext.broadcast(Filter(close.select(F.explode(F.array("a", "b")).alias("ck")).distinct(), "ck"))

    def moving(it):
        for batch in it:
            yield batch.filter(pa.array(wanted.value(batch.column(0).to_numpy())))

    def check(it):
        for batch in it:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                m = np.concatenate([p, q])
                m.sort()
                both = int((m[1:] == m[:-1]).sum())
                ok[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    moved = made.select("ck", "set").mapInArrow(moving, "ck long, set binary")
    side = lambda c, s: moved.select(F.col("ck").alias(c), F.col("set").alias(s))
    links = durable(close.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    asked.destroy()
    wanted.destroy()
    discard(need, made, close)
    settle(spark)
    return links


def _agreed(units: DataFrame) -> DataFrame:
    """uk, s: a unit's parity map, and the bits in which all its members agree behind it."""
    words = PARITY // 64
    ones = F.unhex(F.lit("FF" * (PARITY // 8)))
    part = lambda i: F.conv(F.hex(F.substring("s", 8 * i + 1, 8)), 16, -10).cast("long")
    sums = [f(part(i)).alias(f"{name}{i}") for i in range(words) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    whole = lambda c: F.concat(*[F.unhex(F.lpad(F.hex(c(i)), 16, "0")) for i in range(words)])
    many = units.filter("members > 1").groupBy("uk").agg(*sums)
    both = F.concat(whole(lambda i: F.col(f"all{i}")), whole(lambda i: F.col(f"all{i}").bitwiseOR(F.bitwise_not(F.col(f"any{i}")))))
    return units.filter("members = 1").select("uk", F.concat("s", ones).alias("s")).unionByName(many.select("uk", both.alias("s")))


def _near(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that their parity maps (ck, n, s) do not rule out."""

    def rows(it):
        for batch in it:
            a, b, n, m, x, y = (batch.column(i) for i in range(6))
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(z.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for z in (x, y))
            n, m = n.to_numpy(), m.to_numpy()
            ok = pa.array(2 * -(-percent * (n + m) // (100 + percent)) + np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= n + m)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    side = lambda c, n, s: maps.select(F.col("ck").alias(c), F.col("n").alias(n), F.col("s").alias(s))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(rows, "a long, b long")


def _expanded(units: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of member classes of the unit pairs ``found`` that their own parity maps do not rule out."""
    side = lambda u, c: units.select(F.col("uk").alias(u), F.col("ck").alias(c))
    met = found.select("u", "v").join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _near(met, units, percent)


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, ck) of every document, and (ck, first) of every class with a set: the first row of its component."""
    spark = docs.sparkSession
    sig = durable(signatures(docs), "signatures")
    rows = sig.filter("kind = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("a").alias("ck"))
    hot = sig.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "a").limit(MOST_FREQUENT).select("a").collect()
    frequent = np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    classes = durable(rows.filter("n_shingles > 0").groupBy("ck", "n_shingles").agg(first), "classes")
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(16, total * (100 - percent) // 100 // BUCKET)
    dealt = _deal(docs, frequent, buckets, percent).repartition("bucket").sortWithinPartitions("bucket")
    found = durable(dealt.mapInArrow(gather(buckets), FOUND), "prefixes")
    settle(spark)
    members = found.filter("kind = 2").select(F.col("a").alias("gk"), F.col("b").alias("ck"), "n", "s")
    groups = members.groupBy("gk").agg(F.min("ck").alias("rep"), F.first("n").alias("n"), F.count("*").alias("size"))

    posted = found.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("n").alias("at"), "m")
    weight = durable(posted.groupBy("node").agg(F.sum("m").alias("pop"), F.count("*").alias("most")), "weights")
    settle(spark)
    g = lambda c, s: groups.select(F.col("gk").alias(c), F.col("rep").alias(f"rep{s}"), F.col("n").alias(f"n{s}"))
    arms = (stars(posted, weight).join(g("a", 1), "a").join(g("b", 2), "b")
            .filter(_may_link(F.col("n1"), F.col("n2"), F.col("shared"), percent)).select(F.col("rep1").alias("a"), F.col("rep2").alias("b")))
    inner = members.join(groups.filter("size > 1").select("gk", "rep"), "gk").filter("ck != rep").select(F.col("rep").alias("a"), F.col("ck").alias("b"))
    plain = classes.select("ck", "first")
    pairs = durable(arms.union(inner).distinct(), "pairs")
    settle(spark)
    links = _verify(docs, plain, pairs, percent)
    comp = components(links)
    discard(pairs)

    # group pairs that share a prefix token across components; a unit is what a group has in one component
    units = members.join(comp.withColumnRenamed("node", "ck"), "ck", "left").withColumn("comp", F.coalesce("component", "ck")).withColumn("uk", F.xxhash64("gk", "comp"))
    sizes = units.groupBy("gk", "uk", "comp").agg(F.first("n").alias("n"), F.count("*").alias("members"))
    units = units.join(sizes.select("uk", "members"), "uk").select("uk", "ck", "n", "s", "members")
    most = weight.select(F.col("node").alias("gk"), "most")  # what a group can share with another at most
    parts = durable(sizes.join(most, "gk", "left").join(_agreed(units), "uk").select("gk", "uk", "n", "comp", F.coalesce("most", F.lit(0)).alias("most"), "s"), "units")
    where = parts.select("gk", F.col("uk").alias("node"), "n", "comp", "most", "s")
    met = cells(posted.withColumnRenamed("node", "gk").join(where, "gk").select("token", "node", "n", "comp", "most", "at", "s", "m"))
    # the units of a group meet by a token of its own, before all others in place
    split = where.join(sizes.groupBy("gk").agg(F.count("*").alias("m")).filter("m > 1"), "gk")
    own = cells(split.select(F.xxhash64("gk", F.lit("group")).alias("token"), "node", "n", "comp", F.lit(1 << 40).alias("most"), F.lit(-(1 << 40)).alias("at"), "s", "m"))
    met = met.unionByName(own).select("token", "node", "n", "comp", "most", "at", "side", "s").repartition("token").sortWithinPartitions("token")
    # the tokens that a pair was found by are not all it shares, so their number rules nothing out
    near = durable(met.mapInArrow(across(percent, True), "u long, v long, n long").select("u", "v").distinct(), "group-pairs")
    settle(spark)
    rest = durable(_expanded(units, near, percent), "pairs")
    settle(spark)
    more = _verify(docs, plain, rest, percent)
    discard(found, weight, parts, near, rest)
    comp = merged(comp, more)
    discard(links, more)
    label = classes.join(comp.withColumnRenamed("node", "ck"), "ck", "left").select("ck", "first", F.coalesce("component", "ck").alias("comp"))
    names = label.groupBy("comp").agg(F.min("first").alias("first"))
    return rows, label.select("ck", "comp").join(names, "comp").select("ck", "first")


def ngram_jaccard(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows, named = _components(docs, percent)
    named = named.select("ck", F.col("first.doc_id").alias("component_id"))
    return rows.join(named, "ck", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, of each component the first; documents without a word stay."""
    rows, named = _components(docs, percent)
    same = F.struct("doc_id", "h").eqNullSafe(F.struct("first.doc_id", "first.h"))
    marks = rows.join(named, "ck").groupBy("doc_id", "h").agg(F.bool_or(same).alias("stays"), F.count("*").alias("n"))
    return one_of_each(docs, durable(marks.filter("not stays or n > 1"), "copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


NAME = "op10_ngram_jaccard"
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id"""
