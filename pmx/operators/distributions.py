"""Student-t fit, Kolmogorov-Smirnov distance and Shapiro-Wilk test of a column of any length.

Rows are counted by value first; fit and distance then run over the table of values.
"""

from __future__ import annotations

from math import erf, exp, lgamma, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmx.operators.graph import checkpointed
from pmx.operators.prefix import running_total
from pmx.stats import beta_fraction

C = F.col
#: Rows of the Shapiro-Wilk test at most, as its approximation holds that far; picked by a hash.
SHAPIRO_ROWS = 5000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, n): how often each value is there; nulls and NaN do not count."""
    x = df.select(C(column).cast("double").alias("v")).filter(C("v").isNotNull() & ~F.isnan("v"))
    return checkpointed(x.groupBy("v").agg(F.count("*").alias("n")))


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out, x = out - 1 / x, x + 1
    r = 1 / (x * x)
    return out + log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out, x = out + 1 / (x * x), x + 1
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def fit_student(counts: DataFrame, rounds: int = 200, close: float = 1e-10) -> dict | None:
    """df, loc and scale of greatest likelihood over (v, n), by Fisher scoring; None for fewer than two values.

    A round is one aggregate: the likelihood and its slopes at the present estimate. A step that does not gain is halved. Rounds end when a step is
    smaller than ``close`` in each of loc/scale, log scale and log df.
    """
    n, m, sd, values = counts.agg(F.sum("n"), F.sum(C("v") * C("n")) / F.sum("n"), F.sqrt(F.sum(C("v") * C("v") * C("n")) / F.sum("n") - F.pow(F.sum(C("v") * C("n")) / F.sum("n"), 2)), F.count("*")).first()
    if values < 2:
        return None
    at, best, step, slope = np.array([m, log(max(sd, 1e-12)), log(5.0)]), -np.inf, np.zeros(3), None
    for _ in range(rounds):
        trial = at + step
        mu, scale, df = trial[0], exp(trial[1]), exp(trial[2])
        z = (C("v") - F.lit(float(mu))) / F.lit(scale)
        w = F.lit(df + 1) / (F.lit(df) + z * z)
        ln = F.log1p(z * z / F.lit(df))
        a, b, c = counts.agg(F.sum(w * z * C("n")), F.sum(w * z * z * C("n")), F.sum(ln * C("n"))).first()
        a, b, c = a / n, b / n, c / n
        like = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi) - trial[1] - (df + 1) / 2 * c
        if like < best - 1e-13:
            step = step / 2
        else:
            at, best = trial, like
            slope = np.array([a / scale, b - 1, df * 0.5 * (digamma((df + 1) / 2) - digamma(df / 2) - 1 / df - c + b / df)])
            cross = -2 / ((df + 1) * (df + 3)) * df
            own = (0.25 * (trigamma(df / 2) - trigamma((df + 1) / 2)) - (df + 5) / (2 * df * (df + 1) * (df + 3))) * df * df
            info = np.array([[(df + 1) / ((df + 3) * scale * scale), 0, 0], [0, 2 * df / (df + 3), cross], [0, cross, own]])
            step = np.linalg.solve(info, slope)
            step[2] = np.clip(step[2], -1, 1)
        if abs(step[0]) / scale < close and (np.abs(step[1:]) < close).all() or at[2] > log(1e6):  # as good as normal
            break
    return {"df": float(exp(at[2])), "loc": float(at[0]), "scale": float(exp(at[1])), "log_likelihood": best * n}


def student_cdf(df: float, loc: float, scale: float):
    """The distribution function as a column function over batches of values."""

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        z = (v.to_numpy() - loc) / scale
        tail = np.array([0.5 * beta_fraction(df / 2, 0.5, df / (df + x * x)) for x in z])
        return pd.Series(np.where(z > 0, 1 - tail, tail))

    return cdf


def kolmogorov(counts: DataFrame, cdf, bucket: Column | None = None) -> tuple[float, float]:
    """The largest distance between the share of values up to a point and ``cdf`` there, with its asymptotic p.

    ``bucket`` follows the order of the values (their whole part, unless given), so running shares are sums within buckets and one row a bucket.
    """
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return 0.0, 1.0
    x = running_total(counts.withColumn("n", C("n").cast("double")), F.floor("v") if bucket is None else bucket, ["v"], "n")
    p = cdf(C("v"))
    gap = F.greatest(F.abs(C("cum") / total - C("p")), F.abs((C("cum") - C("n")) / total - C("p")))
    d = float(x.select("n", "cum", p.alias("p")).agg(F.max(gap)).first()[0])
    t = (sqrt(total) + 0.12 + 0.11 / sqrt(total)) * d
    tail = 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * t * t) for k in range(1, 101)) if t > 0.2 else 1.0
    return d, float(min(max(tail, 0.0), 1.0))


def _poly(c: list[float], x: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and its p by Royston's approximation, for 3 to 5,000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    # fixed values: coefficients of the approximation, lowest power first
    c1, c2 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    small_mean, small_sd = [0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322]
    large_mean, large_sd, edge = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302], [-2.273, 0.459]
    mm, u = float(m @ m), 1 / sqrt(n)
    a = m / sqrt(mm)
    if n == 3:
        a = np.array([-sqrt(0.5), 0.0, sqrt(0.5)])
    else:
        last = a[-1] + _poly(c1, u)
        if n > 5:
            second = a[-2] + _poly(c2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / sqrt(phi)
            a[[0, 1, -2, -1]] = -last, -second, second, last
        else:
            a = m / sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a[[0, -1]] = -last, last
    w = min(float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        return w, max(0.0, 6 / pi * (np.arcsin(sqrt(w)) - np.arcsin(sqrt(0.75))))
    y = log(max(1 - w, 1e-300))
    if n < 12:
        g = _poly(edge, n)
        if y >= g:
            return w, 1e-99
        y, mean, sd = -log(g - y), _poly(small_mean, n), exp(_poly(small_sd, n))
    else:
        mean, sd = _poly(large_mean, log(n)), exp(_poly(large_sd, log(n)))
    return w, 0.5 * (1 - erf((y - mean) / sd / sqrt(2)))


def shapiro_sample(df: DataFrame, column: str, key: str, rows: int = SHAPIRO_ROWS) -> tuple[float, float]:
    """The test over all rows, or ``rows`` of them where there are more."""
    h = F.xxhash64(F.col(key), F.lit(42))
    some = df.filter(C(column).isNotNull()).select(C(column).cast("double").alias("v"), h.alias("h")).orderBy("h", "v").limit(rows)
    return shapiro_wilk(some.toPandas()["v"].to_numpy())
