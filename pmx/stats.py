"""Distribution tails, as column expressions, and small numerical routines in numpy."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail, by a rational approximation of erfc with errors under 1.2e-7."""
    x = F.abs(z) / F.lit(sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * F.lit(0.5))
    # fixed values: coefficients of the approximation, lowest power first
    k = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(k[-1])
    for c in reversed(k[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student tail for many degrees of freedom: the t is turned into a normal one."""
    g = (df * 8 + 1) / (df * 8 + 3)
    return normal_two_sided(g * F.sqrt(df * F.log1p(t * t / df)))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    f, c, dd = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        dd = 1 / (1 + num * dd or tiny)
        c = 1 + num / c or tiny
        f *= c * dd
        if abs(1 - c * dd) < 1e-12:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def isotonic_falling(y: np.ndarray) -> np.ndarray:
    """The closest non-increasing sequence (pools adjacent violators)."""
    blocks: list[list[float]] = []
    for v in y:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, n in blocks]) if blocks else np.zeros(0)


def nelder_mead(f, x0: np.ndarray, steps: int = 200) -> np.ndarray:
    """Minimiser without derivatives."""
    n = len(x0)
    pts = [np.asarray(x0, float)] + [x0 + np.eye(n)[i] * (0.1 * abs(x0[i]) or 0.05) for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        centre = np.mean(pts[:-1], axis=0)
        trial = lambda k: (p := centre + k * (pts[-1] - centre), f(p))  # noqa: E731, B023
        p, v = trial(-1.0)
        if v < val[0]:
            p2, v2 = trial(-2.0)
            p, v = (p2, v2) if v2 < v else (p, v)
        elif v >= val[-2]:
            p2, v2 = trial(-0.5 if v < val[-1] else 0.5)
            if v2 < min(v, val[-1]):
                p, v = p2, v2
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (q - pts[0]) for q in pts[1:]]
                val = [val[0]] + [f(q) for q in pts[1:]]
                continue
        pts[-1], val[-1] = p, v
    return pts[int(np.argmin(val))]


def normal_survival(x: np.ndarray) -> np.ndarray:
    from math import erfc

    return np.array([0.5 * erfc(v / sqrt(2.0)) for v in np.atleast_1d(x)])


def fit_survival(x: np.ndarray, s: np.ndarray, kind: str = "normal") -> dict | None:
    """Normal or lognormal survival curve closest to (x, s): mu, sigma and the largest gap."""
    if kind == "lognormal":
        keep = x > 0
        x, s = np.log(x[keep]), s[keep]
    if len(x) < 3:
        return None
    start = np.array([float(np.interp(-0.5, -s, x)) if len(s) else 0.0, log(max(float(np.std(x)), 1e-6))])
    best = nelder_mead(lambda p: float(((normal_survival((x - p[0]) / exp(min(max(p[1], -20), 20))) - s) ** 2).sum()), start)
    fit = normal_survival((x - best[0]) / exp(min(max(best[1], -20), 20)))
    return {"mu": float(best[0]), "sigma": exp(min(max(best[1], -20), 20)), "ks": float(np.abs(fit - s).max())}


def granger(a: np.ndarray, b: np.ndarray, max_lag: int = 12) -> tuple[float, int]:
    """(least p, its lag) of the F test that lags of ``a`` help to predict ``b``."""
    best = (1.0, 0)
    for lag in range(1, max_lag + 1):
        n = len(b) - lag
        if n <= 3 * lag + 1:
            break
        y = b[lag:]
        own = np.column_stack([np.ones(n)] + [b[lag - k : -k] for k in range(1, lag + 1)])
        full = np.column_stack([own] + [a[lag - k : -k] for k in range(1, lag + 1)])
        rss = [float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()) for m in (own, full)]
        df2 = n - full.shape[1]
        if rss[1] <= 0 or df2 <= 0:
            continue
        p = f_tail((rss[0] - rss[1]) / lag / (rss[1] / df2), lag, df2)
        best = min(best, (p, lag))
    return best


def cross_correlation_peak(a: np.ndarray, b: np.ndarray, max_lag: int = 12, fixed: bool = False) -> tuple[int, float]:
    """(lag, correlation) of the largest absolute cross-correlation.

    By the parity sign, B following A by k gives lag -k; ``fixed`` turns it.
    """
    x, y = a - a.mean(), b - b.mean()
    norm = sqrt(float((x * x).sum() * (y * y).sum()))
    if not norm:
        return 0, 0.0
    best = (0, 0.0)
    for lag in range(-max_lag, max_lag + 1):
        if abs(lag) >= len(x):
            continue
        c = float((x[lag:] * y[: len(y) - lag]).sum() if lag >= 0 else (x[:lag] * y[-lag:]).sum()) / norm
        if abs(c) > abs(best[1]) + 1e-12:
            best = (lag, c)
    return (-best[0], best[1]) if fixed else best
