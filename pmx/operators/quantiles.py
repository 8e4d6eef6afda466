"""Exact quantiles of any number of rows, without one task that holds a group's values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
#: Rows that a pass sends to the driver, about; groups that can be asked for at once.
HISTOGRAM_ROWS, MOST_GROUPS = 65_536, 4_096


def exact_quantiles(df: DataFrame, column: str, qs: list[float], by: str | None = None) -> dict:
    """The ``qs`` quantiles of ``column`` (interpolated between neighbours), as {group: list}; without ``by`` the group is None.

    Rank selection: a histogram of the values between the bounds known so far says which bin holds each wanted rank, and the bin's least and
    largest value are the next bounds, until they are one. A pass is one aggregate with partial sums; a few passes do, whatever the
    number of rows. Nulls and NaN do not count; a group without values is not in the result. ``df`` is read in every pass, so it should be a table.
    """
    v = df.select((C(by) if by else F.lit(None).cast("string")).alias("g"), C(column).cast("double").alias("v")).filter(C("v").isNotNull() & ~F.isnan("v"))
    rows = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    size = {r["g"]: r["n"] for r in rows}
    places = {g: [(n - 1) * q for q in qs] for g, n in size.items()}
    found: dict[tuple, float] = {}
    # (group, least, largest, values before) -> ranks in it
    open_ = {(r["g"], r["lo"], r["hi"], 0): sorted({k for p in places[r["g"]] for k in (math.floor(p), math.ceil(p))}) for r in rows}
    while open_:
        for (g, lo, hi, _), ranks in list(open_.items()):
            if lo == hi:
                found.update({(g, k): lo for k in ranks})
        open_ = {i: ranks for i, ranks in open_.items() if i[1] < i[2]}
        if not open_:
            break
        ids, bins = list(open_), max(16, HISTOGRAM_ROWS // len(open_))
        bounds = df.sparkSession.createDataFrame([(k, *i[:3]) for k, i in enumerate(ids)], f"i int, g {v.schema['g'].dataType.simpleString()}, lo double, hi double")
        inside = v.join(F.broadcast(bounds).withColumnRenamed("g", "of"), C("g").eqNullSafe(C("of")) & (C("v") >= C("lo")) & (C("v") <= C("hi")))  # some rows a group, MOST_GROUPS at most
        # halves keep the difference of large values finite
        share = (C("v") / 2 - C("lo") / 2) / (C("hi") / 2 - C("lo") / 2)
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")
        parts: dict[int, list] = {}
        for r in inside.groupBy("i", bin_).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            parts.setdefault(r["i"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        new: dict[tuple, list] = {}
        for k, i in enumerate(ids):
            before = i[3]
            for _, n, lo, hi in sorted(parts[k]):
                ranks = [x for x in open_[i] if before <= x < before + n]
                if ranks:
                    # the least and largest value of a bin are known themselves
                    for x, value in ((before, lo), (before + n - 1, hi)):
                        if x in ranks:
                            found[i[0], x] = value
                            ranks = [y for y in ranks if y != x]
                    if ranks:
                        new[i[0], lo, hi, before] = ranks
                before += n
        open_ = new
    return {g: [found[g, math.floor(p)] + (found[g, math.ceil(p)] - found[g, math.floor(p)]) * (p - math.floor(p)) for p in ps] for g, ps in places.items()}
