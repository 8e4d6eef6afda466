"""Windows over ranges of a number for hot keys: a key is shared among buckets of the number, each with the rows just outside that its windows need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col


def range_sums(df: DataFrame, keys: list[str], value: str, before: int, after: int, aggregates: dict, size: int = 4096) -> DataFrame:
    """Each row of ``df`` with aggregates over the rows of its keys whose ``value`` (long) is from ``value + before`` to ``value + after``.

    ``df`` has one row for keys and value, so a window holds no more rows than it is wide, whatever the key. A row goes to its own bucket of ``size`` values
    and to those whose windows reach it, so a key of any number of rows is many tasks' work.
    """
    own = F.floor(C(value) / size)
    reach = F.sequence(F.floor((C(value) - after) / size), F.floor((C(value) - before) / size))
    seen = df.withColumn("_bucket", F.explode(F.array_union(reach, F.array(own))))
    w = W.partitionBy(*keys, "_bucket").orderBy(value).rangeBetween(before, after)
    return seen.select("*", *[f.over(w).alias(name) for name, f in aggregates.items()]).filter(C("_bucket") == own).drop("_bucket")
