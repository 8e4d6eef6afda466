"""Column builders of the engine's domain: prices, outcomes, buckets, categories, fees and payoffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def taker_price() -> Column:
    return F.when(C("taker_side") == "yes", C("yes_price")).otherwise(C("no_price"))


def maker_price() -> Column:
    return F.when(C("taker_side") == "yes", C("no_price")).otherwise(C("yes_price"))


def taker_won() -> Column:
    return F.when(C("taker_side") == C("result"), 1).otherwise(0)


def maker_won() -> Column:
    return F.when(C("taker_side") != C("result"), 1).otherwise(0)


def opposite(side: Column) -> Column:
    return F.when(side == "yes", "no").otherwise("yes")


def d(x) -> Column:
    """As a double (bare decimal literals would make decimals)."""
    return (C(x) if isinstance(x, str) else x).cast("double")


def rnd(x: Column, digits: int = 6) -> Column:
    """Rounded, so that the order of a float sum does not show; never a negative zero."""
    return F.round(d(x), digits) + F.lit(0.0)


def excess(won: Column, price: Column) -> Column:
    return d(won) - d(price) / F.lit(100.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return d(a) / F.nullif(d(b), F.lit(0.0))


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def breakpoints(x: Column, upper: Sequence[tuple[object, str]], last: str, inclusive: bool = True) -> Column:
    """The label of the first upper bound that x is within; null and larger values get ``last``."""
    out = None
    for bound, label in upper:
        test = x <= F.lit(bound) if inclusive else x < F.lit(bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


#: Labels and bounds of the buckets.
SIZE_BUCKETS = [(1, "1"), (10, "2-10"), (100, "11-100"), (1000, "101-1K")]
TTE_BUCKETS = [(3600, "<1h"), (21600, "1-6h"), (86400, "6-24h"), (604800, "1-7d")]
TTE_HOURS = [(1, "<=1h"), (6, "1-6h"), (24, "6-24h"), (72, "1-3d"), (168, "3-7d")]
LIFE_STAGES = [(0.05, "0-5%"), (0.1, "5-10%"), (0.2, "10-20%"), (0.4, "20-40%"), (0.6, "40-60%"), (0.8, "60-80%"), (0.95, "80-95%")]


def size_bucket(n: Column) -> Column:
    return breakpoints(n, SIZE_BUCKETS, "1K+")


def tte_bucket(seconds: Column) -> Column:
    return breakpoints(seconds, TTE_BUCKETS, "7d+", inclusive=False)


def life_share(t: Column, opened: Column, closed: Column) -> Column:
    """Where t lies between opening and close, held to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), seconds_between(t, opened) / F.nullif(seconds_between(closed, opened), F.lit(0.0))))


def life_stage(share: Column) -> Column:
    return breakpoints(share, LIFE_STAGES, "95-100%", inclusive=False)


def price_decile(price: Column) -> Column:
    """1-10, 11-20 ... 91-99, as 1..10."""
    return F.least(F.greatest(F.floor((price - 1) / F.lit(10.0)) + 1, F.lit(1)), F.lit(10)).cast("int")


def price_zone(price: Column) -> Column:
    return F.when(price < 15, "longshot").when(price > 85, "favourite").otherwise("mid")


def cent_bucket(price: Column, width: int = 5) -> Column:
    return (F.floor(price / F.lit(float(width))) * width).cast("int")


def log_bin(x: Column) -> Column:
    """Bins of a quarter decade, by their lower edge."""
    return F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(d(x), F.lit(0.01))) * 4) / F.lit(4.0))


def category(ticker: Column) -> Column:
    """Leading capitals and digits; 'independent' for null, empty or other beginnings."""
    found = F.regexp_extract(F.coalesce(ticker, F.lit("")), "^([A-Z0-9]+)", 1)
    return F.when(found == "", "independent").otherwise(found)


def keyword_group(x: Column, table: Sequence[tuple[str, str]], other: str = "Other") -> Column:
    """The group of the first pattern that x contains, in the table's order.

    The table is a parameter: long pattern lists come as data, not as code.
    """
    out = None
    for pattern, group in table:
        test = F.contains(F.upper(x), F.lit(pattern.upper()))
        out = F.when(test, group) if out is None else out.when(test, group)
    return out.otherwise(other) if out is not None else F.lit(other)


def fee(price: Column, rate: float = 0.07, cap: float = 3.0) -> Column:
    """Cents: the rate on the smaller distance to 0 or 100, capped."""
    p = d(price)
    return F.least(F.least(p, F.lit(100.0) - p) * F.lit(rate), F.lit(cap))


def signed_count() -> Column:
    return F.when(C("taker_side") == "yes", C("count")).otherwise(-C("count"))
