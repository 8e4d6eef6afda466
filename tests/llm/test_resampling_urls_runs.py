"""Importance resampling, URL filters and periodic runs: against plain Python, and the cases that they define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, h long, place string, part int, w int, n int, url string, page_id long"
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdefgäé9Z-", k=RNG.randint(1, 8))) for _ in range(120)] + ["x" * 70, "你好"]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(n))


TEXTS = [
    (1, prose(60, 1)), (2, prose(60, 1)), (2, prose(60, 1)), (2, prose(50, 2)), (3, None), (4, ""), (5, " \n\t \v\f\r"), (6, "one"), (7, "-- ## --"), (None, prose(50, 10)), (None, None),
    (8, prose(30_000, 9)), (9, "z" * 200_000 + " end"), (10, "a b " * 400), (11, "same " * 3000), *[(20 + i, prose(15 + i, 100 + i)) for i in range(60)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "u", 5) for i, t in TEXTS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def feature_list(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in feature_list(t)[1])
    t = Counter(bucket(f) for x in target for f in feature_list(x)[1])
    s_all, t_all, out = sum(s.values()), sum(t.values()), []
    for i, x in rows:
        n, fs = feature_list(x)
        g = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in map(bucket, fs)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * 25 // 100]
    return out, drawn


def test_resampling_against_plain_python(spark, docs):
    from pmx.llm.op11_importance_resampling import drawn_documents, resample

    target = [prose(40, 1), prose(200, 104), None, ""]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, table).collect()
    want, drawn = plain_resample(TEXTS, target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(((r[0], *r[2:]) for r in want), key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) > 10
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]
    chosen = drawn_documents(docs, table)
    assert chosen.columns == docs.columns
    assert {r["doc_id"] for r in chosen.collect()} == {r[0] for r in drawn}


def test_resampling_without_rows_or_target(spark, docs, empty):
    from pmx.llm.op11_importance_resampling import resample

    none = spark.createDataFrame([], "text string")
    assert resample(empty, none).count() == 0
    assert resample(empty, docs).count() == 0
    assert resample(docs, none).filter("rank is not null").count() == sum(feature_list(t)[0] >= 20 for _, t in TEXTS) * 25 // 100
    few = docs.filter("doc_id in (3, 4, 5, 6)")
    assert [r["rank"] for r in resample(few, docs).collect()] == [None] * 4


def test_features_of_slices():
    import pyarrow as pa

    from pmx.llm.op11_importance_resampling import features

    texts = [t or "" for _, t in TEXTS] + ["", "é", "a", "b"]
    doc, bucket, words = features(pa.array(["cut off", *texts])[1:])
    for k, t in enumerate(texts):
        n, fs = feature_list(t)
        assert words[k] == n
        assert sorted(bucket[doc == k].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in fs)
    assert features(pa.array([], pa.string()))[1].size == 0 and features(pa.array(["", ""]))[2].tolist() == [0, 0]


URLS = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme.net/x": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
    "HTTP://WWW.Foo.NET/a?b#c": ("www.foo.net", "/a", "net/", "block"), "http://net/": ("net", "/", "net/", "block"), "http://planet/": ("planet", "/", None, "allow"),
    "http://foo.net": ("foo.net", "", None, "allow"), "http://foo.net:80/": ("foo.net:80", "/", None, "allow"),
    "https://a.example.net/en/1?x=http://porn.com": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
    "https://badexample.net/en/1": ("badexample.net", "/en/1", "net/", "block"), "https://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/", "block"),
    "https://xxx.org/fr/": ("xxx.org", "/fr/", "org/fr/", "allow"), "https://xxx.org/en/": ("xxx.org", "/en/", None, "block"), "https://a.com/p%6Frn": ("a.com", "/p%6Frn", None, "block"),
    "https://a.com/pornography": ("a.com", "/pornography", None, "allow"), "https://a.com/éporn": ("a.com", "/éporn", None, "allow"), "https://a.com/7porn_": ("a.com", "/7porn_", None, "block"),
    "https://free.com/free/free": ("free.com", "/free/free", None, "allow"), "https://free.com/a-casino": ("free.com", "/a-casino", None, "block"), "https://a.com/?q=porn#porn": ("a.com", "/", None, "allow"),
    "https://essex.com/unicorn%FF%": ("essex.com", "/unicorn%FF%", None, "allow"), "s://Ä.com/Ä": ("Ä.com", "/Ä", None, "allow"), "a://b://c": ("b:", "//c", None, "allow"),
    "https://" + "a." * 200_000 + "net/": ("a." * 200_000 + "net", "/", "net/", "block"), "https://.net/": (".net", "/", "net/", "block"),
    "https://a.com/" + "free/" * 50_000: ("a.com", "/" + "free/" * 50_000, None, "allow"),
}


def test_urls(spark, empty):
    from pmx.llm.op12_url_filters import kept_pages, url_verdicts

    pages = spark.createDataFrame([(i, u, "host", "rule", 3) for i, u in enumerate(URLS)] + [(None, None, "h", "r", 1)], "page_id long, url string, host string, rule string, verdict int")
    got = {r["page_id"]: r for r in url_verdicts(pages).collect()}
    for i, (url, want) in enumerate(URLS.items()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want, url
    assert got[None]["verdict"] == "allow"
    assert url_verdicts(empty).count() == 0
    kept = kept_pages(pages)
    assert kept.columns == pages.columns and kept.count() == 1 + sum(v[3] == "allow" for v in URLS.values())
    assert url_verdicts(pages, rules=[], weights={}).filter("verdict = 'block' or rule is not null").count() == 0


def test_rules_against_plain_search():
    from pmx.llm.op12_url_filters import Rules

    for seed in range(200):
        r = random.Random(seed)
        name = lambda n: ".".join(r.choices(["a", "b", "ab"], k=n))  # noqa: B023, E731
        rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((name(r.randint(1, 3)), "/" + "x" * r.randint(0, 3)) for _ in range(6))}.values())
        find = Rules(rules).find
        for _ in range(20):
            host, path = name(r.randint(1, 4)), "/" + "x" * r.randint(0, 3)
            fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert find(host, path) == (max(fits)[2:] if fits else None)


def test_terms_against_plain_search():
    from pmx.llm.op12_url_filters import Terms, vocabulary

    terms = [*vocabulary()][:12] + ["ab", "b", "a", "aba"]
    find = Terms(dict.fromkeys(terms, 1)).find
    for seed in range(300):
        r = random.Random(seed)
        text = "".join(r.choice([*terms, "-", "/", "7", "é", "s"]) for _ in range(r.randint(0, 12)))
        assert find(text) == {t for t in terms if re.search(rf"(?<![^\W\d_]){t}(?![^\W\d_])", text)}, text


def plain_runs(w):
    """Every maximal run of at least four periods and six words, from the definition."""
    n, out = len(w), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            k = i
            while k < n - p and w[k] == w[k + p]:
                k += 1
            if k + p - i >= max(6, 4 * p) and not any(all(w[j] == w[j + q] for j in range(i, k + p - q)) for q in range(1, p)):
                out.add((i, k + p - i, p))
            i = k
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_cases():
    for seed in range(500):
        r = random.Random(seed)
        kind = seed % 5
        if kind == 0:
            yield r.choices("ab", k=r.randint(0, 90))
        elif kind == 1:
            yield r.choices("abcd", k=r.randint(0, 40)) * r.randint(1, 6) + r.choices("ab", k=r.randint(0, 9))
        elif kind == 2:
            yield (r.choices("ab", k=r.randint(1, 3)) * r.randint(3, 7) + r.choices("abc", k=r.randint(0, 3))) * r.randint(3, 6)
        elif kind == 3:
            yield [x for _ in range(6) for x in r.choices("ab", k=r.randint(1, 9)) * r.randint(1, 8)]
        else:
            w = ["a"] * r.randint(0, 80)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w) + 1) : 0] = ["b"]
            yield w


def test_runs_against_the_definition():
    from pmx.llm.op13_periodic_runs import block_runs

    cases = list(word_cases())
    found = block_runs([" ".join(w).encode() for w in cases])  # one block: no run goes over the end of a text
    assert sum(len(r) for r, _ in found) > 300
    for w, (runs, left) in zip(cases, found, strict=True):
        assert runs == plain_runs(w), w
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert left.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_long_runs_cost_in_proportion():
    import time

    from pmx.llm.op13_periodic_runs import runs_of

    for make in (lambda n: np.zeros(n, np.int32), lambda n: np.tile(np.arange(25) < 24, n // 25).astype(np.int32), lambda n: np.random.default_rng(1).integers(0, 2, n).astype(np.int32)):
        took = []
        for n in (50_000, 200_000):
            w, start = make(n), time.perf_counter()
            runs_of(w)
            took.append(time.perf_counter() - start)
        assert took[1] < 8 * took[0] + 0.5


def test_words_are_split_in_parts(monkeypatch):
    from pmx.llm import op13_periodic_runs as o

    texts = [(t or "").encode() for _, t in TEXTS]
    whole = o.block_runs(texts)
    monkeypatch.setattr(o, "SPLIT_BYTES", 7)
    assert o.block_runs(texts) == whole
    assert [x for part in o._words("a\u2003b \x1c c\x85".encode()) for x in part] == ["a\u2003b".encode(), b"\x1c", "c\x85".encode()]


def plain_query(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_query_against_plain_python(spark, docs, empty, tmp_path):
    from pmx.llm.op13_periodic_runs import periodic_runs, query

    rows = [(i, t) for i, t in TEXTS if len(t or "") < 10_000] + [(1000 + i, prose(120, i)) for i in range(120)] + [(1121, "end " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_query(i, t)) for i, t in rows)
    assert sum(r["n_runs"] for r in got.collect()) > 10
    assert periodic_runs(empty).count() == 0
    assert periodic_runs(docs).count() == len(TEXTS)
