"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next; all but the last return the columns of ``documents``, whatever
their names. Ids may be null or repeat; very long texts and ties are handled as the operators say; empty tables
give empty tables, and without labels the base rule alone rejects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pmx.deploy import ship
from pmx.llm.common import durable, table
from pmx.llm.op1_quality_rules import keep_documents, train
from pmx.llm.op4_decontamination import without_leaks
from pmx.llm.op8_packing import pack_documents
from pmx.llm.op9_line_dedup import line_dedup
from pmx.llm.op10_ngram_jaccard import without_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are rejected, each row is judged by its own text."""
    return keep_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents that lose their last line with a word go, texts without a word stay.

    Rows that share an id are documents of their own; of equal rows (doc_id and text) one stays.
    """
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, the one with the smallest doc_id stays (null last, then by text); texts without a word stay.

    Rows that share an id are documents of their own; of equal rows (doc_id and text) one stays.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is judged by its own text."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, as the pieces of documents in them; null and empty texts are the end id, every row is packed."""
    return pack_documents(docs)


#: Bytes that a Python worker gets at a time, at most about: the JVM holds batches outside its heap, beside what it holds there.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(_BATCH).lower()).groups()
    if not 0 < int(number) << " kmgt".index(unit or " ") * 10 <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _sent(stage):
    """The stage, with the package sent to the executors first, and batches of bounded size."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        _small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("quality_rules", _sent(quality_rules)), ("line_dedup", _sent(dedup_lines)), ("ngram_jaccard", _sent(near_duplicates)),
          ("decontamination", _sent(decontamination)), ("packing", _sent(packing))]
#: Trees, MinHash, latent vectors and tokenizers have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    ship(spark)
    _small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
