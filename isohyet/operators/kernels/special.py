"""Special functions that numpy lacks."""

from __future__ import annotations

import math

import numpy as np


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """Probability of a Student t at least this far from 0."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    return betainc(df / 2, 0.5, df / (df + t * t))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal."""
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    return np.array([inv(float(x)) for x in np.ravel(p)]).reshape(np.shape(p))


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def student_cdf(t: np.ndarray, df: float) -> np.ndarray:
    """Distribution function of Student's t, element by element: the incomplete beta function's continued fraction on arrays."""
    t = np.asarray(t, float)
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    turn = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    inside = (z > 0) & (z < 1)
    y = np.where(inside, z, 0.5)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    f, c, d = np.ones_like(y), np.ones_like(y), np.zeros_like(y)
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) if i % 2 == 0 else -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 / np.where((v := 1 + n * d) == 0, 1e-300, v)
        c = np.where((v := 1 + n / c) == 0, 1e-300, v)
        f = f * c * d
        if (np.abs(1 - c * d) < 1e-14).all():
            break
    beta = np.where(inside, front * (f - 1), (z >= 1).astype(float))
    tail = np.where(turn, 1 - beta, beta) / 2
    return np.where(t > 0, 1 - tail, tail)
