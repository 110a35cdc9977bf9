"""Loess-based decomposition, the dynamic linear model, and its early-warning companions, of one series each."""

from __future__ import annotations

import math

import numpy as np

from .special import betainc


def loess(y: np.ndarray, span: int, degree: int = 1, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear (or constant) fits with tricube weights over the `span` nearest of x = 0 .. n-1, at those or other places."""
    n = len(y)
    x, at = np.arange(n, dtype=float), np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    weights = np.ones(n) if weights is None else weights
    k = min(span, n)
    left = np.clip(np.floor(at - (k - 1) / 2 + 0.5).astype(int), 0, n - k)
    idx = left[:, None] + np.arange(k)
    d = np.abs(x[idx] - at[:, None])
    h = d.max(axis=1) + (max(0, span - n) / 2)
    h = np.where(h > 0, h, 1.0)
    w = np.where(d <= 0.999 * h[:, None], (1 - np.minimum(d / h[:, None], 1) ** 3) ** 3, 0.0)
    w = np.where(d <= 0.001 * h[:, None], 1.0, w) * weights[idx]
    total = w.sum(axis=1)
    w = w / np.where(total > 0, total, 1.0)[:, None]
    mean_x = (w * x[idx]).sum(1)
    value = (w * y[idx]).sum(1)
    if degree:
        dev = x[idx] - mean_x[:, None]
        var = (w * dev * dev).sum(1)
        slope = np.where(np.sqrt(var) > 0.001 * (n - 1), (w * dev * y[idx]).sum(1) / np.where(var > 0, var, 1.0), 0.0)
        value = value + slope * (at - mean_x)
    return np.where(total > 0, value, y[np.clip(np.round(at).astype(int), 0, n - 1)])


def _odd(x: float) -> int:
    n = int(x)
    return n if n % 2 else n + 1


def stl(y: np.ndarray, period: int, seasonal: int = 13, trend: int | None = None, low_pass: int | None = None, robust: bool = False, inner: int | None = None, outer: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by seasonal-trend loess; they add up to y. Spans as in the published procedure."""
    y = np.asarray(y, float)
    n = len(y)
    trend = _odd(1.5 * period / (1 - 1.5 / seasonal) + 1) if trend is None else trend
    low_pass = _odd(period + (period % 2 == 0)) if low_pass is None else low_pass
    inner, outer = (2 if robust else 5) if inner is None else inner, (15 if robust else 0) if outer is None else outer
    t, s, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(outer + 1):
        for _ in range(inner):
            d = y - t
            c = np.empty(n + 2 * period)
            for j in range(period):
                sub, w = d[j::period], rho[j::period]
                c[j::period] = loess(sub, seasonal, 1, w, np.arange(-1, len(sub) + 1))[: len(c[j::period])]
            low = c
            for m in (period, period, 3):
                low = np.convolve(low, np.ones(m) / m, "valid")
            low = loess(low, low_pass)
            s = c[period : period + n] - low
            t = loess(y - s, trend, 1, rho)
        if k < outer:
            r = np.abs(y - t - s)
            h = 6 * np.median(r)
            u = r / h if h > 0 else np.zeros(n)
            rho = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - np.minimum(u, 1) ** 2) ** 2))
    return t, s, y - t - s


def interpolated(y: np.ndarray, most: float = 0.05) -> np.ndarray | None:
    """Linear interpolation over missing values; None if their share is above `most`."""
    ok = np.isfinite(y)
    if not ok.any() or (~ok).mean() > most:
        return None
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok])


def student_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * math.log1p(x * x / df)) / math.sqrt(df * math.pi)


def student_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection of its distribution."""
    if p == 0.5:
        return 0.0
    q = 2 * min(p, 1 - p)
    a, b = 0.0, 1.0
    tail = lambda t: betainc(df / 2, 0.5, df / (df + t * t))
    while tail(b) > q and b < 1e9:
        b *= 2
    for _ in range(80):
        m = (a + b) / 2
        a, b = (m, b) if tail(m) > q else (a, m)
    return math.copysign((a + b) / 2, p - 0.5)


def forward_filter(y: np.ndarray, x: np.ndarray, harmonics: tuple[int, ...] = (1, 2), discount: float = 0.98, period: float = 365.25 / 16) -> dict[str, np.ndarray]:
    """Forward filter of a dynamic linear model with local trend, regression on x and harmonics.

    Returns m [T+1, k], C [T+1, k, k], nu and likelihood [T+1]; row 0 is nought. A missing y leaves the prior and gives
    its forecast to the next step's first regressor, which is the lagged series.
    """
    x, trend, regression = np.array(x, float).reshape(len(y), -1), 2, np.atleast_2d(x).shape[-1] if np.ndim(x) > 1 else 1
    k = trend + regression + 2 * len(harmonics)
    g, f = np.eye(k), np.zeros(k)
    g[0, 1] = f[0] = 1
    for j, h in enumerate(harmonics):
        c, s, at = math.cos(2 * math.pi * h / period), math.sin(2 * math.pi * h / period), trend + regression + 2 * j
        g[at : at + 2, at : at + 2] = [[c, s], [-s, c]]
        f[at] = 1
    block = np.ones((k, k))
    for a, b in ((0, trend), (trend, trend + regression), (trend + regression, k)):
        block[a:b, a:b] = discount
    m, cov, scale, nu = np.zeros(k), np.eye(k), 0.2**2, float(trend + regression + len(harmonics))
    out = {"m": np.zeros((len(y) + 1, k)), "C": np.zeros((len(y) + 1, k, k)), "nu": np.zeros(len(y) + 1), "likelihood": np.zeros(len(y) + 1)}
    for t, now in enumerate(y):
        prior, r = g @ m, g @ cov @ g.T / block
        nu *= discount
        f[trend : trend + regression] = x[t]
        gain = r @ f
        q = float(f @ gain) + scale
        gain, forecast = gain / q, float(f @ prior)
        if np.isfinite(now):
            e = now - forecast
            ratio = (nu + e * e / q) / (nu + 1)
            likelihood = student_pdf(e / math.sqrt(q), nu) / math.sqrt(q)
            m, cov = prior + gain * e, ratio * (r - np.outer(gain, gain) * q)
            nu, scale = nu + 1, ratio * scale
        else:
            m, cov, likelihood = prior, r, math.nan
            if t + 1 < len(y):
                x[t + 1, 0] = forecast
        out["m"][t + 1], out["C"][t + 1], out["nu"][t + 1], out["likelihood"][t + 1] = m, cov, nu, likelihood
    return out


def drift(series: np.ndarray, window: int) -> np.ndarray:
    """1 + slope of the conditional median increment on the state, in windows of the series; 0 where it cannot be fitted."""
    low, high = np.nanmin(series), np.nanmax(series)
    span = high - low
    grid = np.arange(low - 0.1 * abs(low), high + 0.1 * abs(high), span / 20) if span else np.array([low])
    out = np.zeros(max(0, len(series) - window - 1))
    for i in range(len(out)):
        part = series[i : i + window]
        step, state = np.diff(part), part[:-1]
        near = np.abs(state - grid[:, None]) < span / 10
        first = np.array([np.nanmedian(step[m]) if m.any() and np.isfinite(step[m]).any() else np.nan for m in near])
        second = np.array([np.nanmedian(step[m] ** 2) if m.any() and np.isfinite(step[m]).any() else np.nan for m in near])
        use = np.isfinite(first) & (second < span / 20)
        if use.sum() > 1:
            out[i] = 1 + np.polyfit(grid[use], first[use], 1)[0]
    return out


def low_steps(y: np.ndarray, first_ordinal: int, percentile: float, step: int = 16) -> np.ndarray:
    """Steps whose value is below the mean of their day of the year minus z deviations, of the series interpolated to days."""
    from datetime import date
    from statistics import NormalDist

    at = first_ordinal + step * np.arange(len(y))
    ok = np.isfinite(y)
    if ok.sum() < 2:
        return np.zeros(0, int)
    days = np.arange(at[ok][0], at[ok][-1])
    daily = np.interp(days, at[ok], y[ok])
    doy = np.array([min(date.fromordinal(int(d)).timetuple().tm_yday, 365) for d in days])
    z = NormalDist().inv_cdf(1 - (1 - percentile) / 2)
    n = np.bincount(doy, minlength=366)
    mean = np.bincount(doy, daily, 366) / np.maximum(n, 1)
    sd = np.sqrt(np.maximum(np.bincount(doy, daily**2, 366) / np.maximum(n, 1) - mean**2, 0))
    own = np.array([min(date.fromordinal(int(d)).timetuple().tm_yday, 365) for d in at])
    return np.flatnonzero(ok & (y < mean[own] - z * sd[own]))
