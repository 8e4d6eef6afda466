"""Running totals over a global order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col


def running_total(df: DataFrame, bucket: Column, order: list[str], value: str) -> DataFrame:
    """Adds cum (sum up to the row), peak (largest cum up to the row) and drawdown (cum - peak).

    ``bucket`` must follow the order (say, the day of the time that comes first in it). Sums and peaks inside a
    bucket are windows of that bucket; only one row a bucket meets in an ordered window, whose
    results are joined back as offsets.
    """
    x = df.withColumn("_b", bucket)
    w = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum(value).over(w))
    x = x.withColumn("_top", F.max("_in").over(w))
    b = x.groupBy("_b").agg(F.sum(value).alias("_s"), F.max("_in").alias("_m"))
    past = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_offset", F.coalesce(F.sum("_s").over(past), F.lit(0.0)))
    b = b.withColumn("_before", F.max(C("_offset") + C("_m")).over(past)).select("_b", "_offset", "_before")
    cum = C("_offset") + C("_in")
    peak = F.greatest(C("_offset") + C("_top"), F.coalesce("_before", C("_offset") + C("_top")))
    return x.join(b, "_b").select(*df.columns, cum.alias("cum"), peak.alias("peak"), (cum - peak).alias("drawdown"))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums of each key in order, for keys that a task can sort: one shuffle, none if ``df`` is dealt by ``keys``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.sum(c).over(w).alias(k) for k, c in sums.items()])


def segmented(df: DataFrame, keys: list[str], segment: Column, order: list[str], sums: dict[str, Column] | None = None, count: str | None = None,
              lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums, a running count, values of the row before and of the row after, of each key in order, for keys of any number of rows.

    ``segment`` must follow the order (say, its day). Windows stay inside (keys, segment), which is how rows are dealt, so a hot key is many tasks' work; one row a
    segment, with its sums, its first and its last values, meets those of the same key in a second window, and is joined back.
    """
    sums, lags, leads = sums or {}, lags or {}, leads or {}
    x = df.withColumn("_s", segment)
    w = W.partitionBy(*keys, "_s").orderBy(*order)
    up = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.select("*", F.row_number().over(w).cast("long").alias("_n"), F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"), *[F.sum(c).over(up).alias(f"_sum_{k}") for k, c in sums.items()],
                 *[F.lag(c).over(w).alias(f"_lag_{k}") for k, c in lags.items()], *[F.lead(c).over(w).alias(f"_lead_{k}") for k, c in leads.items()])
    place = F.struct(*order)
    part = x.groupBy(*keys, "_s").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()],
                                      *[F.max_by(c, place).alias(f"_last_{k}") for k, c in lags.items()], *[F.min_by(c, place).alias(f"_first_{k}") for k, c in leads.items()])
    by = W.partitionBy(*keys).orderBy("_s")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    part = part.select(*keys, "_s", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_before"), *[F.sum(f"_t_{k}").over(past).alias(f"_off_{k}") for k in sums],
                       *[F.lag(f"_last_{k}").over(by).alias(f"_prev_{k}") for k in lags], *[F.lead(f"_first_{k}").over(by).alias(f"_next_{k}") for k in leads])
    j = x.join(part, [*keys, "_s"])
    total = lambda k: F.when(C(f"_sum_{k}").isNull(), C(f"_off_{k}")).when(C(f"_off_{k}").isNull(), C(f"_sum_{k}")).otherwise(C(f"_off_{k}") + C(f"_sum_{k}"))
    return j.select(*df.columns, *[total(k).alias(k) for k in sums], *([(C("_before") + C("_n")).alias(count)] if count else []),
                    *[F.when(C("_n") == 1, C(f"_prev_{k}")).otherwise(C(f"_lag_{k}")).alias(k) for k in lags], *[F.when(C("_n") == C("_all"), C(f"_next_{k}")).otherwise(C(f"_lead_{k}")).alias(k) for k in leads])
