"""The latent space of the decontamination is fitted over every passage of the corpus."""

import random

import numpy as np


def test_fit_sees_every_passage(spark, monkeypatch):
    from pmx.llm import op4_decontamination as o

    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=r.choice([5, 40, 150]))) for _ in range(2100)] + ["", None]
    items = [" ".join(r.choices(words, k=30)) + ". " + " ".join(r.choices(words, k=6)) + "." for _ in range(3)]
    items.append(" ".join(words))  # every word has its own term
    texts[7] = "w1 " + items[0]
    seen, whole = [], o.gram_product

    def spy(passages, idf, m):
        out, n = whole(passages, idf, m)
        seen.append((idf, m, out, n))
        return out, n

    monkeypatch.setattr(o, "gram_product", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = o.decontaminate(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert (7, 0) in {(x["doc_id"], x["item_id"]) for x in got.collect()}
    terms = o.Terms({w for t in items for w in o.words_of(t)})
    rows = [p for t in texts if t for p in o.tfidf(terms, seen[0][0], o.words_of(t))]
    a = np.zeros((len(rows), terms.size))
    for i, (t, w) in enumerate(rows):
        a[i, t] = w
    assert len(rows) > 2100
    for _, m, out, n in seen:
        assert n == len(rows)
        assert np.abs(out - a.T @ (a @ m)).max() < 1e-4 * np.abs(out).max()
