"""How rows are dealt to tasks: as many tasks as the rows need, and hot keys told from the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
#: Rows that a task gets, about; a key with more rows than ``HOT_ROWS`` is hot.
TASK_ROWS, HOT_ROWS = 1_000_000, 1_000_000
_BUCKETS = 65_536


def dealt(df: DataFrame, rows: int, *keys: str, always: bool = False) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to one task for each ``TASK_ROWS``, so that a task's memory does not grow with the table.

    Where the session's own number of partitions is enough, Spark deals as it likes, or by ``keys`` if ``always``.
    What is dealt by some of a group's, window's or join's keys is not shuffled again for it.
    """
    tasks = rows // TASK_ROWS + 1
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, *keys)
    return df.repartition(*keys) if always else df


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """(key) of those with more than ``HOT_ROWS`` rows, None if there are none. Rows are counted by a hash first, and one by one only where that says so."""
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS))
    full = [r["b"] for r in df.groupBy(bucket.alias("b")).count().filter(C("count") > HOT_ROWS).collect()]  # _BUCKETS at most
    if not full:
        return None
    few = df.sparkSession.createDataFrame([(b,) for b in full], "b long")
    hot = df.join(F.broadcast(few), bucket == C("b"), "left_semi").groupBy(key).count().filter(C("count") > HOT_ROWS).select(key)
    found = [tuple(r) for r in hot.collect()]  # a row for each HOT_ROWS rows at most
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def by_heat(df: DataFrame, hot: DataFrame | None, key: str, cold_way, hot_way) -> DataFrame:
    """``cold_way`` of the rows whose key is not ``hot`` and ``hot_way`` of the others, as one result. Both must work within keys."""
    if hot is None:
        return cold_way(df)
    return cold_way(df.join(F.broadcast(hot), key, "left_anti")).unionByName(hot_way(df.join(F.broadcast(hot), key, "left_semi")))
