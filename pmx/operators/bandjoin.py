"""Band joins: equality on some keys and closeness on a number, without a full pairing of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def band_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, width: int, condition: Column) -> DataFrame:
    """Rows of ``left`` and ``right`` (as l_* and r_*) that agree on ``keys`` and whose ``value``s differ by ``width`` at most.

    Values fall into buckets of that width; a left row goes to its own bucket and both neighbours, so
    the join is an equi-join on (keys, bucket), which a hot key shares among its buckets, and
    the residual condition keeps the exact band.
    """
    bucket = lambda p: F.floor(C(f"{p}{value}") / F.lit(width))
    a = left.select(*[C(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[C(c).alias(f"r_{c}") for c in right.columns])
    a = a.withColumn("_bucket", F.explode(F.array(*[bucket("l_") + i for i in (-1, 0, 1)])))
    b = b.withColumn("_b", bucket("r_"))
    on = (C("_bucket") == C("_b")) & (F.abs(C(f"l_{value}") - C(f"r_{value}")) <= width) & condition
    for k in keys:
        on = on & (C(f"l_{k}") == C(f"r_{k}"))
    return a.join(b, on).drop("_bucket", "_b")
