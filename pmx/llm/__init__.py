"""Operators of a training-data pipeline; each module has one, with its query and, where SQL can say it, its oracle."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["op1_quality_rules", "op2_quality_knn", "op3_html_text", "op4_decontamination", "op5_token_files", "op6_secret_scan", "op7_language_id", "op8_packing", "op9_line_dedup", "op10_ngram_jaccard",
            "op11_importance_resampling", "op12_url_filters", "op13_periodic_runs"]


def _all():
    return [import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict:
    import corpus_pipeline

    from pmx.deploy import shipped

    return {m.NAME: shipped(m.query) for m in _all()} | {"pipeline": shipped(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {m.NAME: m.ORACLE for m in _all()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
