"""Edge cases that every operator defines: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, ck long, node long, x string, bucket long, item_id string, kept boolean"
RNG = random.Random(3)
WORDS = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


ROWS = [
    (1, prose(60, 1)), (2, prose(60, 1)), (2, prose(60, 1)), (3, None), (4, ""), (5, "   \n \t "), (6, "one"), (7, "ÀÉ ünïcode ⚡ 你好   x"),
    (8, "\n".join(["a line that is said again and again in this text"] * 30)), (9, prose(60_000, 9)), (None, prose(50, 10)), (None, None),
    (10, prose(60, 1) + " tail"), (11, "!!! ### | | |"), (12, "\x00 \x0b odd \x1c signs \x85 here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, 2, 3, "x", 4, "b", True) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL = sorted((i is None, i or 0) for i, _ in ROWS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality_rules(spark, docs, empty):
    from pmx.llm.op1_quality_rules import quality_rules, train

    out = quality_rules(docs, None).collect()
    assert ids(out) == ALL
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[8]["n_dup_lines"] == 29 and by[8]["n_repeat_words"] == by[8]["n_words"] and by[8]["base_failed"]
    assert by[11]["n_symbols"] == 6
    assert by[9]["n_words"] == 60_000
    assert quality_rules(empty, None).count() == 0
    assert train(docs, labels(spark)) is None
    assert train(docs, labels(spark, [(1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 0)])) is None


def test_repeat_words_against_windows():
    from pmx.llm.op1_quality_rules import statistics

    for seed in range(60):
        r = random.Random(seed)
        words = r.choices("ab" if seed % 2 else "abc", k=r.randint(0, 60))
        w = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i in range(len(w)) if w.count(w[i]) > 1 for k in range(8)}
        assert statistics(" ".join(words))[0][4] == len(hit)


def test_monotone_trees():
    from pmx.llm import op1_quality_rules as o

    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = (x[:, 0] + 0.3 * r.standard_normal(800) < 0.5).astype(float)
    t = o.fit(x, y, [-1, 0, 0])
    grid = np.linspace(0, 1, 50)
    for other in (0.1, 0.5, 0.9):
        p = t.probability(np.column_stack([grid, np.full(50, other), np.full(50, 1 - other)]))
        assert (np.diff(p) <= 1e-12).all()
    assert ((t.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8


def test_quality_knn(spark, docs, empty):
    from pmx.llm.op2_quality_knn import knn_quality, train

    assert {r["score"] for r in knn_quality(docs, None).collect()} == {0.5}
    model = train(docs, labels(spark, [(1, 1, 0), (8, 0, 0), (9, 1, 0)]))
    out = knn_quality(docs, model).collect()
    assert ids(out) == ALL and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[8]["predicted"] == 0 and by[1]["predicted"] == 1
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert knn_quality(empty, model).count() == 0


def test_knn_scores_are_exact():
    from pmx.llm.op2_quality_knn import SHARP, Neighbours

    r = np.random.default_rng(1)
    x, y = r.integers(0, 5, (60, 40)).astype(np.float32), r.integers(0, 2, 60)
    m = Neighbours(x, y, 10)
    q = m.unit(m.weigh(x[:7]) @ m.v)
    for row, got in zip(q, m.score(x[:7], 5), strict=True):
        cos = m.z @ row
        near = np.argsort(-cos)[:5]
        w = np.exp(SHARP * (cos[near] - cos[near].max()))
        assert abs((w * y[near]).sum() / w.sum() - got) < 1e-5


def test_language(spark, docs, empty):
    from pmx.llm.op7_language_id import language_id, train

    out = language_id(docs, train(docs)).collect()
    assert ids(out) == ALL
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[11]["lang_pred"] == "und" and by[1]["lang_pred"] == "en"
    assert language_id(empty, train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id(docs, train(empty)).collect()} == {"und"}


def test_secrets(spark, docs, empty):
    from pmx.llm.op6_secret_scan import secret_scan

    rows = [(1, 'x token:token:abcdefgh'), (2, "é PassWord = 'hunter22' AKIA" + "A" * 16), (3, "f" * 24 + "x" + "e" * 23),
            (4, "key q8Zr5Lx2Vn7Kw3Ty9Bm4c end"), (5, "a 123e4567-e89b-12d3-a456-426614174000 b"), (6, "abc" * 20), (7, None)]
    got = {r["doc_id"]: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    span = lambda i, k: [(x["s"], x["e"]) for x in got[i][k]]
    assert span(1, "assign") == [] and span(2, "assign") == [(2, 22)] and span(2, "access") == [(24, 44)]
    assert span(3, "hex") == [(0, 24)] and span(4, "entropy") == [(4, 25)]
    assert span(5, "entropy") == [] and span(6, "entropy") == [] and not got[7]["hex"]
    assert secret_scan(docs).count() == len(ROWS) and secret_scan(empty).count() == 0


def test_window_entropy_against_brute_force(spark):
    import math
    from collections import Counter

    from pmx.llm.op6_secret_scan import ALPHABET, window_entropy

    r = random.Random(5)
    texts = ["".join(r.choices(ALPHABET[: r.randint(2, 60)], k=r.randint(20, 70))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, h in df.select("t", window_entropy(df["t"]).alias("h")).collect():
        want = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(t[i : i + 20]).values()) for i in range(len(t) - 19))
        assert abs(h - want) < 1e-9


def test_window_entropy_over_parts(spark):
    """Windows that reach over the border of a part count."""
    from pmx.llm.op6_secret_scan import ALPHABET, window_entropy, window_over

    r = random.Random(6)
    texts = ["".join(r.choices(ALPHABET[: r.randint(2, 60)], k=r.randint(1, 70))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = df["t"]
    for whole, parts, over in df.select(window_entropy(t), window_entropy(t, part=19), window_over(t, window_entropy(t) - 1e-9, part=23)).collect():
        assert abs(whole - parts) < 1e-9 and over == (whole > 0)


def test_secrets_of_letters_and_beside_allowed_words(spark):
    import string

    from pmx.llm.op6_secret_scan import secret_scan

    r = random.Random(8)
    letters = ["".join(r.choices(string.ascii_letters, k=40)) for _ in range(60)]
    mixed = ["".join(r.choices(string.ascii_letters + string.digits, k=40)) for _ in range(60)]
    clean = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "/en/articles/2024-01-01/the-thing-that-is-here", "20240101-123456-0000000001",
             "x/123e4567-e89b-12d3-a456-426614174000/example", "Donaudampfschifffahrtsgesellschaft"]
    rows = [f"see https://x.io/example/{m} now" for m in mixed] + [f"key {m} end" for m in letters] + clean
    got = {x["doc_id"]: [(y["s"], y["e"]) for y in x["entropy"]] for x in secret_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(60)) >= 58 and sum(got[i] == [(4, 44)] for i in range(60, 120)) >= 58
    assert [rows[i] for i in got if i >= 120 and got[i]] == []


def test_secret_runs_cost_in_proportion(spark):
    """One run of any length, with a secret in it or not."""
    import time

    from pmx.llm.op6_secret_scan import ALPHABET, secret_scan, window_entropy

    r = random.Random(9)
    for signs in (ALPHABET[:64], "abcd"):
        took = []
        for n in (2000, 20_000, 40_000, 80_000):
            df = spark.createDataFrame([(1, "".join(r.choices(signs, k=n)))], "doc_id long, text string")
            start = time.perf_counter()
            found = secret_scan(df).collect()[0]
            df.select(window_entropy(df["text"])).collect()
            took.append(time.perf_counter() - start)
            assert [(x["s"], x["e"]) for x in found["entropy"]] == ([(0, n)] if len(signs) > 4 else [])
        assert all(b < 2.5 * a + 0.5 for a, b in zip(took[1:], took[2:]))


def test_html_edges(spark):
    from pmx.llm.op3_html_text import extract, main_text

    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == main_text("<script>x") == ""
    assert main_text("<p>a&amp;b  c<br>d<p>e&eacute;") == "a&b c d eé"
    assert "comment" not in main_text("<article><p>Some long article text here.</p><p>More of it.</p></article><div id=comments><p>comment text</p></div>")
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    page = "<html><body><header>Top</header><ul class=menu><li><a href=a>m</a></ul><div><p>First part of it.</p><p>Second <i>part</i>.</p></div><form>f<input></form><footer>end</footer>"
    df = spark.createDataFrame([(1, "u", page, "clash"), (1, "u", page, "clash"), (2, None, None, "z")], "page_id long, url string, html string, text string")
    out = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract(df).collect())
    assert out == [(1, "u", "First part of it. Second part.", 30)] * 2 + [(2, None, "", 0)]
    assert extract(df.limit(0)).count() == 0


def test_token_files(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pmx.llm.common import shared_path
    from pmx.llm.op5_token_files import SequenceReader, VOCABULARY, read_files, write_files

    path = public_tokenizers.path(VOCABULARY)
    manifest = write_files(docs, shared_path(spark, "t"), path, 64)
    out = read_files(manifest).collect()
    assert ids(out) == ALL
    t = Tokenizer.from_file(path)
    want = {}
    for i, x in ROWS:
        a = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(a), zlib.crc32(a.tobytes())))
    got = {}
    for r in sorted(out, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    first = manifest.orderBy("base").first()
    reader = SequenceReader(first["file"])
    flat = np.concatenate([i for i, _ in reader.batches()])
    assert len(flat) == 64 * len(reader)
    for k in (0, 1, len(reader) // 2, len(reader) - 1):
        ids_, mask = reader.sequence(k)
        assert (ids_ == flat[64 * k : 64 * k + 64]).all() and len(mask) == 64
    assert {b.num_rows for b in map(reader.file.get_batch, range(reader.file.num_record_batches - 1))} <= {reader.batch}
    same = spark.createDataFrame([(7, f"text {i % 3}") for i in range(300)] + [(None, "x")] * 200 + [(6, "y"), (8, "z")], docs.select("doc_id", "text").schema)
    back = sorted(read_files(write_files(same, shared_path(spark, "t"), path, 64)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == [None] * 200 + [6] + [7] * 300 + [8]
    assert all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(back, back[1:]))
    assert sum(int(np.sum(m.to_numpy(zero_copy_only=False))) for _, m in reader.batches()) == first["n_tokens"]
    assert read_files(write_files(empty, shared_path(spark, "t"), path)).count() == 0


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_ids_are_those_of_whole_texts(name, spaced):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pmx.llm.tokens import Words

    w = Words(public_tokenizers.path(name), spaced)
    r = random.Random(2)
    signs = ["a", "b", " ", " ", "\n", "\t", "\x85", "\xa0", "'s", "Σ", "é", "é", "́", "1", "23", "!!", "<|endoftext|>", "　", "\x1c", "\0", "İ", "ß", "À", "Œ", ",", "'", "&"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(4000)] + [
        " ".join("".join(r.choices("abeÀéñß", k=r.randint(0, 6))) + "".join(r.choices(".,#$%'-_", k=r.randint(0, 3))) for _ in range(6)) for _ in range(2000)]
    assert w.encode(texts) == w.raw(texts)
    # the names of special tokens are their ids, as the library has it; or text, where that is asked for
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    some = [t for t in texts if "<|" in t][:300] + ["<|ENDOFTEXT|>", "a<|endoftext|><|endoftext|>b c", "<|endoftext|", "x <|startoftext|> y"]
    ids = lambda b: list(np.frombuffer(b, np.uint16))
    assert list(map(ids, w.encode(some))) == [plain.encode(t, add_special_tokens=False).ids for t in some]
    text = Words(public_tokenizers.path(name), spaced, special=False)
    end = plain.token_to_id("<|endoftext|>")
    assert text.encode(some) == text.raw(some) and end in ids(w.encode(some)[-3]) and not any(end in ids(x) for x in text.encode(some))


def test_packing(spark, docs, empty):
    from pmx.llm.op8_packing import CAPACITY, best_fit, lower_bound, pack_documents

    out = pack_documents(docs).toPandas()
    assert sorted(ALL) == sorted((i != i, 0 if i != i else int(i)) for i in out[out.piece == 0].doc_id)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= CAPACITY and (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all()
    assert (out.length == CAPACITY)[out.doc_id == 9].sum() > 10
    assert out.sequence_id.nunique() == lower_bound(out.length.to_numpy())
    assert pack_documents(empty).count() == 0
    r = np.random.default_rng(0)
    for _ in range(30):
        size = r.integers(1, 50, r.integers(1, 12))
        _, _, n = best_fit(size, 50)
        assert _least_bins(size.tolist(), 50) >= lower_bound(size, 50) and n >= lower_bound(size, 50)


def _least_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes.sort(reverse=True)
    go(0, [])
    return best[0]


def test_packing_exchange_saves_bins(spark):
    from pmx.llm.op8_packing import best_fit_packing, lower_bound

    r = np.random.default_rng(4)
    size = r.integers(30, 90, 400)
    df = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(size)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = best_fit_packing(df, 100, 20, 4).toPandas()
    assert len(out) == 400 and out.groupby("sequence_id").length.sum().max() <= 100
    alone = best_fit_packing(df, 100, 20, 4, rounds=0).toPandas().sequence_id.nunique()
    assert lower_bound(size, 100) <= out.sequence_id.nunique() <= alone


def test_ngram_jaccard(spark, docs, empty):
    from pmx.llm.op10_ngram_jaccard import ngram_jaccard

    out = ngram_jaccard(docs).collect()
    assert ids(out) == ALL
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == by[10]["component_id"] == 1
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[4]["component_id"] == 4
    assert by[6]["n_shingles"] == 1
    assert ngram_jaccard(empty).count() == 0


def test_ngram_jaccard_against_brute_force(spark):
    from pmx.llm.op10_ngram_jaccard import ngram_jaccard

    r = random.Random(8)
    passage = prose(55, 77).split()
    rows = []
    for i in range(260):
        kind = i % 4
        base = prose(r.randint(6, 60), 1000 + i // 8).split()
        if kind == 1:  # near copies
            for _ in range(r.randint(1, 3)):
                base[r.randrange(len(base))] = r.choice(WORDS)
        if kind == 2:  # a passage that many hold
            base = prose(r.randint(5, 30), i).split() + passage
        if kind == 3:
            base = prose(r.randint(0, 7), i // 40).split()
        rows.append((i, " ".join(base)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_jaccard_links_of_the_second_pass(spark):
    """Chains of short texts, each a word away from the one before, so that most links are not along a star."""
    from pmx.llm.op10_ngram_jaccard import ngram_jaccard

    r = random.Random(12)
    rows = []
    for size in (24, 44, 104):
        for _ in range(30):
            words = [f"{len(rows)}x{k}" for k in range(size)]
            for k in range(8):
                rows.append((len(rows), " ".join(words)))
                for j in range(max(1, size // 44)):
                    words[r.randrange(size)] = f"{len(rows)}y{k}z{j}"
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a // 8 * 8, a):  # families share no word
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {x["doc_id"]: x["component_id"] for x in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_line_dedup(spark, docs, empty):
    from pmx.llm.op9_line_dedup import line_dedup, line_verdicts

    out = line_dedup(docs)
    assert out.columns == docs.columns
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    # the row without an id comes first in order, 1 keeps the line its copies lose
    assert by[1] == [prose(60, 1)] and 2 not in by and 10 not in by
    assert by[3] == [None] and by[4] == [""] and by[8] == ["a line that is said again and again in this text"]
    assert line_verdicts(empty).count() == 0 and line_dedup(empty).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    from pmx.llm import op9_line_dedup as o

    r = random.Random(6)
    rows = []
    for i in range(120):
        lines = []
        for k in range(4):
            w = prose(30, i // 3 * 10 + k).split()
            if r.random() < 0.5:
                w[r.randrange(30)] = r.choice(WORDS)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    items = [(i, k, {x[j : j + 8] for j in range(len(x) - 7)}) for i, t in rows for k, x in enumerate(o._line_list(t)) if len(x) >= 8]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            s, t = items[a][2], items[b][2]
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {items[j][:2] for j in range(len(items)) if find(j) != j}
    got = {(x["doc_id"], x["line"]) for x in o.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter("removed").collect()}
    assert len(want ^ got) <= 0.02 * len(want)


def test_short_lines(spark):
    """Equal lines of any length are one; from SHINGLE characters up, similar ones too."""
    from pmx.llm import op9_line_dedup as o

    r = random.Random(9)
    pool = ["".join(r.choices("abcdefghijklmnop ", k=r.randint(1, 23))).strip() or "x" for _ in range(150)] + ["你好", "Read more", "aaaaaaaa", "aaaaaaaaa", "你好世界，这是一行文字没有空格", "你好世界，这是一行文字没有空格。"]
    pool += [x + r.choice("qrs") for x in pool if len(x) > 10]
    rows = [(i, "\n".join(r.choices(pool, k=6))) for i in range(60)] + [(100, "\n\n")]
    items = [(i, k, x) for i, t in rows for k, x in enumerate(o._line_list(t)) if x]
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for _, _, x in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if items[a][2] == items[b][2] or s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {items[j][:2] for j in range(len(items)) if find(j) != j}
    equal = {x[:2] for j, x in enumerate(items) if any(x[2] == y[2] for y in items[:j])}
    out = o.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {(x["doc_id"], x["line"]) for x in out.filter("removed").collect()}
    assert equal <= got and len(want ^ got) <= 0.05 * len(want)
    d = o.line_dedup(spark.createDataFrame([(1, "Read more\n\nb"), (2, "Read more\n\nc"), (3, "b")], "doc_id long, text string"))
    assert sorted(map(tuple, d.collect())) == [(1, "Read more\n\nb"), (2, "\nc")]
    assert (o.signature(["abcdefgh", "abcdefghi"]) != o._NONE).all()


def test_decontamination(spark, docs, empty):
    from pmx.llm.op4_decontamination import decontaminate

    item = prose(40, 500) + ". " + prose(12, 501) + "."
    near = item.split()
    for k in (3, 11, 20, 29):
        near[k] = "changed"
    rows = [(1, prose(300, 600)), (2, prose(100, 601) + " " + item.upper() + " " + prose(90, 602)), (3, prose(40, 603) + " " + " ".join(near) + " " + prose(200, 604)), (4, None), (5, "short item"), (5, "short item")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item"), (5, prose(45, 700))], "item_id long, text string")
    out = decontaminate(d, bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(2, 1), (3, 1), (5, 4), (5, 4)]
    assert decontaminate(empty, bench).count() == 0 and decontaminate(d, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench).count() == 0


def test_short_and_long_items_and_repeated_ids(spark):
    from pmx.llm.op4_decontamination import decontaminate, without_leaks

    long = prose(200, 810)
    rows = [(1, prose(300, 811) + " tri quux zap " + prose(300, 812)), (1, prose(200, 813)), (None, prose(90, 814) + " " + long + " " + prose(20, 815)), (None, prose(100, 816)), (2, "tri zap quux")]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, item_id int, h string").repartition(2)
    bench = spark.createDataFrame([(1, "Tri, quux zap!"), (2, long), (3, prose(30, 817))], "item_id long, text string")
    assert sorted(((r["doc_id"] or 0, r["item_id"]) for r in decontaminate(d, bench).collect())) == [(0, 2), (1, 1)]
    out = without_leaks(d, bench)
    assert out.columns == d.columns and sorted(r["text"] for r in out.collect()) == sorted([rows[1][1], rows[3][1], rows[4][1]])
    assert without_leaks(d.limit(0), bench).count() == 0 and without_leaks(d, bench.limit(0)).count() == 5


def test_latent_retrieval_recall_against_brute_force(spark):
    """Paraphrased items in prose: all that the common subsequence confirms anywhere are found by the latent search."""
    from pmx.llm import op4_decontamination as o

    r = random.Random(41)
    items = [prose(r.randint(14, 60), 2000 + i) for i in range(60)]
    rows = []
    for i in range(240):
        w = items[i % 60].split()
        for k in range(len(w)):
            x = r.random()
            w[k] = r.choice(WORDS) if x < 0.08 else "" if x < 0.12 else w[k] + " " + r.choice(WORDS) if x < 0.16 else w[k]
        rows.append((i, prose(r.randint(0, 150), 3000 + i) + " " + " ".join(w) + " " + prose(r.randint(0, 150), 4000 + i)))
    rows += [(1000 + i, prose(200, 5000 + i)) for i in range(100)]
    made = [o.Item(i, t) for i, t in enumerate(items)]
    want = set()
    for i, t in rows:
        words = o.words_of(t)
        for it in made:
            room, width = max(o.STEP, len(it.words)), o.STEP * (o.SMALL if len(it.words) <= o.SMALL_WORDS else o.LARGE)
            if any(it.found(words[max(0, s - room) : s + width + room]) for s in range(0, len(words), o.STEP)):
                want.add((i, it.item_id))
    out = o.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in out.collect()}
    assert len(want) > 200 and got <= want and len(got) >= 0.9 * len(want)


def test_singular_vectors_are_those_of_the_matrix():
    from pmx.llm.op4_decontamination import singular_vectors

    r = np.random.default_rng(3)
    a = (r.standard_normal((80, 60)) * 0.8 ** np.arange(60)).astype(np.float32)
    v = singular_vectors(lambda m: a.T @ (a @ m), 60, 8)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-4)
    assert np.linalg.norm(a @ v) ** 2 >= 0.999 * (s[:8] ** 2).sum()


def test_secret_matches_cost_in_proportion(spark):
    """Spans of many matches, over several parts, are those of a plain scan."""
    import re

    from pmx.llm.op6_secret_scan import HEX, PART, secret_scan

    r = random.Random(4)
    texts = [" ".join("é" * r.randint(0, 3) + "".join(r.choices("0123456789abcdef", k=r.randint(20, 30))) for _ in range(n)) for n in (1, PART - 1, PART, PART + 1, 5 * PART + 3)]
    got = {x["doc_id"]: [(y["s"], y["e"]) for y in x["hex"]] for x in secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: [m.span() for m in re.finditer(HEX, t)] for i, t in enumerate(texts)}


def test_markup_is_read_once():
    """Tags whose quotes never close cost no second reading of the page; parts of an article stay whatever they are called."""
    import time

    from pmx.llm.op3_html_text import main_text

    for piece in ('<a title="q ', '<a ">" ', "<a title='q\" >", '<a ">\' ', "<p>x<div>", "<!-- ", "<script ", "< a"):
        took = []
        for n in (2000, 32_000):
            start = time.process_time()
            main_text(piece * n)
            took.append(time.process_time() - start)
        assert took[1] < 16 * 3 * max(took[0], 0.005), piece
    text = "<article><h1>T</h1><p>First paragraph, long enough.</p><div class=legal><p>The court held it.</p></div><section id=discussion><p>We discuss it here.</p></section></article>"
    assert main_text(f"<body><nav><a href=x>menu</a></nav>{text}<div class=legal>all rights</div></body>") == "T First paragraph, long enough. The court held it. We discuss it here."


LONG = "The court held that the whole of the matter was open to review, and it said so at some length in its reasons. "


@pytest.mark.parametrize("part", [
    f'<div class="share-price"><p>{LONG}</p></div>', f'<section id="comment-on-law"><p>{LONG}</p></section>', f'<p class="social-policy">{LONG}</p>', f'<div class="cookie-recipes">{LONG}</div>',
    "<p>See <a href=a>the first long report</a>, <a href=b>the second long report</a> and <a href=c>the third long report</a>.</p>",
    "<ul><li><a href=a>First source of it</a></li><li><a href=b>Second source of it</a></li><li><a href=c>Third source of it</a></li></ul>", f"<label>{LONG}</label>", f"<menu><li>{LONG}</li></menu>"])
def test_article_keeps_its_parts(part):
    """Names of which one word points elsewhere, and links, cost an article nothing; with or without an ``article`` tag, between its paragraphs."""
    import re

    from pmx.llm.op3_html_text import main_text

    words = " ".join(re.sub("<[^>]*>", " ", part).split()).replace(" ,", ",").replace(" .", ".")
    for tag in ("article", "div"):
        page = f"<body><nav><a href=x>menu</a></nav><{tag}><p>{LONG}</p>{part}<p>{LONG}</p></{tag}><footer>end</footer></body>"
        assert main_text(page) == f"{LONG}{words} {LONG}".strip(), tag


def test_parts_that_are_elsewhere():
    from pmx.llm.op3_html_text import main_text

    assert main_text(f'<body><div class="cookie-recipes">{LONG}</div></body>') == LONG.strip()
    for name in ("comments", "comment-list", "post-comments", "share-buttons", "main-nav", "site-footer", "newsletter-signup", "cookie-notice", "alert", "relatedPosts", "ad-slot-3"):
        assert main_text(f'<body><article><p>{LONG}</p><div class="{name}"><p>{LONG}elsewhere</p></div></article></body>') == LONG.strip(), name
    links = "".join(f"<li><a href={k}>Some other page {k}</a></li>" for k in range(6))
    assert main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul></div></body>") == (LONG * 2).strip()


def test_quotes_hide_ends_of_tags_where_they_close():
    """Against a plain reader: a quote hides what stands before the next of its kind; if no end is left then, quotes count for nothing in that tag."""
    from pmx.llm.op3_html_text import tokens

    def plain_end(html, at):
        quote = None
        for k in range(at, len(html)):
            if quote:
                quote = None if html[k] == quote else quote
            elif html[k] in "\"'":
                quote = html[k]
            elif html[k] == ">":
                return k + 1
        return html.find(">", at) + 1

    for seed in range(3000):
        r = random.Random(seed)
        html = "".join(r.choices(["<a ", "<b", "x", '"', "'", ">", " ", "</p"], k=r.randint(1, 40)))
        at, want = 0, []
        while (i := html.find("<", at)) >= 0 and ">" in html[i:]:
            k = i + len("</p") if html.startswith("</p", i) else i + 2
            while k < len(html) and html[k] not in " />":
                k += 1
            at = plain_end(html, k)
            if not at:
                break
            want.append((i, at))
        assert [(a, b) for a, b, *_ in tokens(html)] == want, html


def test_density_finds_the_article_without_names():
    """Pages whose parts are named for nothing: blocks of the article are kept, those of menus and link lists are not."""
    from pmx.llm.op3_html_text import main_text

    hit = kept = total = 0
    for i in range(60):
        r = random.Random(900 + i)
        blocks = [prose(r.randint(25, 90), 9000 + 20 * i + k) for k in range(r.randint(3, 9))]
        links = lambda n: "".join(f"<li><a href=/{k}>{r.choice(WORDS)}MENU</a></li>" for k in range(n))  # noqa: B023, E731
        page = f"<html><body><div class=a1><ul>{links(8)}</ul></div><div class=a2><div>{''.join(f'<p>{b}</p>' for b in blocks)}</div></div><div class=a3><ul>{links(r.randint(5, 20))}</ul></div></body></html>"
        got = main_text(page)
        hit += sum(b in got for b in blocks)
        total += len(blocks)
        kept += got.count("MENU")
    assert hit >= 0.98 * total and kept <= 0.02 * total


def test_held_out_accuracy(spark):
    """Rules, classifier and languages on rows that they did not learn from."""
    from pyspark.sql import functions as F

    from pmx.llm import op1_quality_rules, op2_quality_knn, op7_language_id
    from pmx.llm.common import split_residue, table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality").dropna()
    rules = op1_quality_rules.train(docs, labels.withColumn("toxic", F.lit(0)).filter(split_residue(3) != 1))
    got = op1_quality_rules.quality_rules(docs, rules).join(labels.filter(split_residue(3) == 1), "doc_id").toPandas()
    assert len(got) > 50 and ((got.score >= 0.5) == (got.quality == 1)).mean() >= 0.95
    got = op2_quality_knn.query(spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() >= 0.97
    got = op7_language_id.query(spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred != 'und'").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() >= 0.97


def test_fits_are_bounded_when_ids_repeat(spark):
    from pmx.llm.common import bounded_rows, labelled_sample
    from pmx.llm.op2_quality_knn import train

    docs = spark.createDataFrame([(1, prose(30, k % 7)) for k in range(300)] + [(2, "x ! ! !")] * 300, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1)] * 50, "doc_id long, quality int")
    assert labelled_sample(labels, 60).count() <= 2 and len(train(docs, labels).z) == 2
    assert bounded_rows(docs, 5).count() <= 5


def test_trees_as_arrays_against_a_walk():
    from pmx.llm import op1_quality_rules as o

    r = np.random.default_rng(2)
    x = r.random((600, 4))
    t = o.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), [0, 0, 0, 0])
    for row in x[:40]:
        margin = t.start
        for k in range(len(t.feature)):
            node = 0
            for _ in range(o.DEPTH):
                node = 2 * node + (2 if row[t.feature[k, node]] > t.threshold[k, node] else 1)
            margin += t.leaf[k, node - (2**o.DEPTH - 1)]
        assert abs(margin - t.margin(row[None, :])[0]) < 1e-9


def test_spans_digest(spark):
    from pmx.llm.op6_secret_scan import query

    assert hashlib.sha256(b"").hexdigest() in {r["base_sha256"] for r in query(spark, "/root/testdata/sf0.001").collect()}


IDENTITY = [(1, "A word here and there"), (2, "A word here and there"), (2, "B another thing entirely"), (3, "C once more of it"), (3, "C once more of it"),
            (None, "D without an id at all"), (None, "D without an id at all"), (9, "D without an id at all"), (None, None), (None, None), (4, "")]


def test_rows_that_share_an_id_are_told_apart(spark):
    """Near copies: one row of each text stays, whatever its id; line dedup: a unique line stays, whoever shares its id."""
    from pmx.llm.op10_ngram_jaccard import without_near_copies
    from pmx.llm.op9_line_dedup import line_dedup

    df = spark.createDataFrame([(i, t, 1, 2, 3, "s") for i, t in IDENTITY], "doc_id long, text string, _h int, _gone int, _doc int, h string").repartition(3)
    out = without_near_copies(df)
    assert out.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(1, IDENTITY[0][1]), (2, IDENTITY[2][1]), (3, IDENTITY[3][1]), (4, ""), (9, IDENTITY[7][1]), (None, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == want
    want = [(1, IDENTITY[0][1]), (2, IDENTITY[2][1]), (3, IDENTITY[3][1]), (4, ""), (None, None), (None, None), (None, IDENTITY[5][1])]
    out = line_dedup(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == want
    two = spark.createDataFrame([(1, "A line of it"), (2, "A line of it\nC quite different"), (2, "B thing unlike all\nD last words")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup(two).collect()) == ["A line of it", "B thing unlike all\nD last words", "C quite different"]
    assert without_near_copies(df.limit(0)).count() == 0 and line_dedup(df.limit(0)).count() == 0
