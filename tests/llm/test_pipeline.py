"""The pipeline stage by stage, each against plain Python over its own input."""

import zlib

import numpy as np

import corpus_pipeline
from pmx.llm.common import durable, table


def test_stages(spark, sf):
    docs, kept = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = durable(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == table(spark, sf, "documents").columns
        kept[name] = (before.toPandas(), docs.toPandas())

    from pmx.llm.op1_quality_rules import statistics

    a, b = kept["quality_rules"]
    stay = set(b.doc_id)
    for i, t in zip(a.doc_id, a.text, strict=True):
        n, _, _, _, rep = statistics(t or "")[0]
        if n < 20 or 100 * rep > 30 * n:
            assert i not in stay
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").quality
    clean = [i for i, t in zip(a.doc_id, a.text, strict=True) if labels.get(i) == 1 and len(t.split()) >= 30]
    assert np.mean([i in stay for i in clean]) > 0.95

    from pmx.llm.op9_line_dedup import SHINGLE, _line_list

    _, b = kept["line_dedup"]
    lines = [{x[k : k + SHINGLE] for k in range(len(x) - SHINGLE + 1)} for t in b.text for x in _line_list(t) if len(x) >= SHINGLE]
    for i, s in enumerate(lines):
        for t in lines[:i]:
            if 100 * min(len(s), len(t)) >= 75 * max(len(s), len(t)):
                assert 100 * len(s & t) < 75 * len(s | t)

    _, b = kept["ngram_jaccard"]
    sets = []
    for t in b.text:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    for i, s in enumerate(sets):
        for t in sets[:i]:
            assert not s or 100 * len(s & t) < 75 * len(s | t)

    from pmx.llm.op4_decontamination import words_of

    a, b = kept["decontamination"]
    items = [b" " + b" ".join(words_of(t)) + b" " for t in table(spark, sf, "benchmark").toPandas().text]
    holds = [any(x in b" " + b" ".join(words_of(t)) + b" " for x in items) for t in a.text]
    assert set(b.doc_id) == {i for i, h in zip(a.doc_id, holds, strict=True) if not h}

    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = kept["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, x in zip(a.doc_id, a.text, strict=True):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {tuple(r) for r in b[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == want
    for _, g in b.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all()


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


MESSY = [(1, "A first line that says one thing and then some more of it, at length, as lines do.\nAnd a second line with quite other words in it, so that the text is long enough to stay."), (1, None), (2, ""), (None, None),
         (None, "A text without an id, which has words enough of its own to be kept by the base rule, since it holds more than twenty of them in all."), (3, "!!! ###"), (4, "word " * 3000)]


def test_stages_on_empty_and_messy_tables(spark, sf):
    """Empty tables, null and repeated ids, equal rows, and columns named like those that stages make."""
    import corpus_pipeline
    from pmx.llm.common import durable

    schema = "doc_id long, text string, lang string, source string, n_chars int, stays boolean, n long, _h long, h string, quality int, kept boolean, score double"
    row = lambda i, t: (i, t, "en", "s", None, True, 7, 8, "h", 1, False, 0.5)
    for rows in ([], [row(i, t) for i, t in MESSY] * 2):
        docs = spark.createDataFrame(rows, schema)
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = durable(stage(spark, docs, sf), f"messy-{name}")
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= before, name
                docs, before = out, out.count()
        packed = out.select("doc_id", "length").collect()
        assert len(packed) == before  # a piece a document, as all are short
        if rows:
            kept = {(r["doc_id"], r["text"]) for r in docs.collect()}
            assert (None, MESSY[4][1]) in kept and len(kept) == before  # equal rows are one, the text without an id stays
            assert not any(t in (None, "", "!!! ###") for _, t in kept)
            assert {(r["stays"], r["n"], r["_h"], r["h"], r["quality"]) for r in docs.collect()} == {(True, 7, 8, "h", 1)}
