"""The fit of the decontamination: its product over the corpus in blocks, and two products a fit."""

import numpy as np


def test_fit_takes_two_products():
    from pmx.llm.op4_decontamination import singular_vectors

    r = np.random.default_rng(3)
    a = (r.standard_normal((300, 200)) * 0.95 ** np.arange(200)).astype(np.float32)
    calls = []
    v = singular_vectors(lambda m: calls.append(1) or a.T @ (a @ m), 200, 40)
    s = np.linalg.svd(a, compute_uv=False)
    assert len(calls) == 2
    assert np.allclose(v.T @ v, np.eye(40), atol=1e-4)
    assert np.linalg.norm(a @ v) ** 2 >= 0.995 * (s[:40] ** 2).sum()


def test_singular_vectors_of_few_directions():
    from pmx.llm.op4_decontamination import singular_vectors

    a = np.zeros((6, 5), np.float32)
    assert singular_vectors(lambda m: a.T @ (a @ m), 5, 3).shape == (5, 0)
    a[0, 1] = 2.0
    assert np.allclose(np.abs(singular_vectors(lambda m: a.T @ (a @ m), 5, 3)), np.eye(5)[:, 1:2], atol=1e-5)


def test_distinct_terms_and_product_by_slices(spark, monkeypatch):
    """Many small slices of a batch and blocks of passages give the product of the whole, texts without a word among them."""
    from pmx.llm import op4_decontamination as o

    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 90, n)) for n in [0, 1, 64, 65, 200, 0, 3000, *r.integers(0, 150, 400).tolist()]]
    terms = o.Terms({f"w{i}".encode() for i in range(90)})  # of others the number depends on the process
    at, n, sizes, passages = o.distinct_terms([terms(o.words_of(t)) if t else np.zeros(0, np.int32) for t in texts], terms.size)
    want = [np.unique(terms(w[i : i + 64]), return_counts=True) for w in map(o.words_of, texts) for i in range(0, len(w), 64)]
    assert at.tolist() == np.concatenate([x for x, _ in want]).tolist() and n.tolist() == np.concatenate([x for _, x in want]).tolist()
    assert sizes.tolist() == [len(x) for x, _ in want] and passages.tolist() == [-(-len(t.split()) // 64) for t in texts]
    assert all(len(x) == 0 for x in o.distinct_terms([], terms.size))

    monkeypatch.setattr(o, "FIT_TERMS", 300)
    monkeypatch.setattr(o, "FIT_ROWS", 7)
    found = o.passage_terms(spark.createDataFrame([(t,) for t in texts], "text string"), terms)
    df, docs = o.document_frequency(found, terms.size)
    assert docs == len(texts) and df.tolist() == sum(np.bincount(np.unique(terms(o.words_of(t))), minlength=terms.size) for t in texts if t).tolist()
    idf = np.log((1 + docs) / (1 + df)).astype(np.float32) + np.float32(0.05)
    a = np.zeros((len(want), terms.size))
    for i, (t, k) in enumerate(want):
        a[i, t] = k * idf[t] / np.linalg.norm(k * idf[t])
    m = r.standard_normal((terms.size, 9)).astype(np.float32)
    out, rows = o.gram_product(found, idf, m)
    assert rows == len(want) and np.abs(out - a.T @ (a @ m)).max() < 1e-4 * np.abs(out).max()


def test_places_bound_keeps_every_confirmed_item():
    """What the bound by words turns down, the common subsequence turns down too."""
    import random

    from pmx.llm.op4_decontamination import LCS, LCS_ANSWER, Item, lcs, words_of

    r, kept = random.Random(2), 0
    for _ in range(2000):
        words = [f"w{i}" for i in range(r.choice([5, 30]))]
        item = Item(1, " ".join(r.choices(words, k=r.randint(8, 40))) + ". " + " ".join(r.choices(words, k=4)) + ".")
        around = words_of(" ".join(r.choices([*words, "other"], k=r.randint(0, 90))))
        share = lcs(item.masks, len(item.words), around) / len(item.words)
        answer = lcs(item.answer, item.n_answer, around) >= 0.9 * item.n_answer
        want = (share, answer) if share >= LCS or share >= LCS_ANSWER and answer else None
        kept += want is not None
        assert item.found(around) == want
    assert kept > 100
