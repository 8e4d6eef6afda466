"""Ordered pattern tables: the first pattern, in the table's order, that a text contains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
#: Patterns that go along with the tasks, at most.
MOST_PATTERNS = 100_000


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """A table of patterns (place, pattern, grp, category, subcategory) from a CSV file with those columns; it is data, so that long lists are no code."""
    return spark.read.csv(path, header=True, schema="place long, pattern string, grp string, category string, subcategory string")


class FirstMatch:
    """All patterns in one automaton, so a text is read once, whatever their number; of the hits the lowest place counts."""

    def __init__(self, patterns: list[tuple[int, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for place, pattern in sorted(patterns, reverse=True):  # of equal patterns the lowest place stays
            self.automaton.add_word(pattern, place)
        if patterns:
            self.automaton.make_automaton()
        self.some = bool(patterns)

    def __call__(self, text: str | None) -> int | None:
        return min((place for _, place in self.automaton.iter(text)), default=None) if self.some and text else None


def first_match(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``df`` with the columns of ``table`` (place, pattern, ...) of the first pattern in upper case that ``column`` contains in upper case; null where none does.

    Distinct values are matched once each, by an automaton in every task, and joined back. A table over ``MOST_PATTERNS`` rows is an error.
    """
    rows = table.select("place", F.upper("pattern").alias("pattern")).filter("pattern <> ''").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    patterns = [(r["place"], r["pattern"]) for r in rows]

    def match(it):
        first = FirstMatch(patterns)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([first(x) for x in batch.column(0).to_pylist()], pa.int64())], names=["_value", "place"])

    values = df.select(F.upper(column).alias("_value")).filter("_value IS NOT NULL").distinct()
    found = values.mapInArrow(match, "_value string, place long").filter("place IS NOT NULL").join(table, "place").drop("pattern")
    return df.withColumn("_value", F.upper(column)).join(found, "_value", "left").drop("_value")
