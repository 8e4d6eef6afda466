"""The decontamination looks the words of the corpus up once, and reads term numbers from then on."""

import random

import numpy as np


def test_the_search_reads_no_texts(spark, monkeypatch):
    """The query's plan, and that of the pipeline's stage but for the rows it keeps, have no text in them any more."""
    from pmx.llm import op4_decontamination as o

    taken, whole = [], o.passage_terms
    monkeypatch.setattr(o, "passage_terms", lambda docs, terms, *keys: taken.append(keys) or whole(docs, terms, *keys))
    item = "one two three four five six seven eight nine ten eleven twelve. The answer is forty two."
    rows = [(1, "some words before " + item + " and some behind", 7), (1, "no such thing in here", 8), (None, item, 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h long").repartition(2)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    out = o.decontaminate(docs, bench)
    assert sorted((x["doc_id"] or 0, x["item_id"]) for x in out.collect()) == [(0, 5), (1, 5)]
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    kept = o.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(x["_h"] for x in kept.collect()) == [8, 10]
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert len(taken) == 2  # once a run, with one chunk


def test_term_numbers_confirm_what_words_do():
    from pmx.llm.op4_decontamination import Item, Terms, words_of

    r, kept = random.Random(8), 0
    items = [Item(i, " ".join(f"w{x}" for x in r.choices(range(30), k=r.choice([1, 3, 7, 8, 20, 40]))) + (". w1 w2 w3." if i % 2 else "")) for i in range(200)]
    terms = Terms({w for it in items for w in it.words})
    for it in items:
        around = words_of(" ".join(f"w{x}" for x in r.choices(range(36), k=r.randint(0, 60))))
        if r.random() < 0.5:
            at = r.randint(0, len(around))
            around[at:at] = it.words
        want = it.found(around)
        if len(it.words) < 8:
            assert (want is not None) == (b" " + b" ".join(it.words) + b" " in b" " + b" ".join(around) + b" ")
        assert it.coded(terms).found(terms(around).tolist() if around else np.zeros(0, np.int32).tolist()) == want
        kept += want is not None
    assert 50 < kept < 200
