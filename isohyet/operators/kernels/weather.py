"""Daily weather of one station on 365-day years: occurrence, amounts, temperatures, cycles; and rank shuffling over stations."""

from __future__ import annotations

import math

import numpy as np

from .special import gammainc, normal_ppf

#: Month lengths of a 365-day year; the wet-day threshold; the highest relative humidity.
MONTHS, WET, HUMID = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 0.1, 0.95
_MONTH_OF = np.repeat(np.arange(12), MONTHS)


def occurrence(rain: np.ndarray, threshold: float = WET) -> tuple[np.ndarray, np.ndarray]:
    """States [years, 365] (1 wet) and p00, p01, p10, p11 for each day, from 26 periods of 14 days and the last repeated."""
    wet = np.where(rain > threshold, 1.0, 0.0)
    wet[~np.isfinite(rain) | (rain < 0)] = np.nan
    before = np.concatenate([[0.0], wet.ravel()[:-1]]).reshape(wet.shape)
    n01, n10, n11 = (np.nansum((before == a) & (wet == b), axis=0) for a, b in ((0, 1), (1, 0), (1, 1)))
    n00 = len(rain) - n01 - n10 - n11 - np.isnan(wet * before).sum(0)
    a = np.stack([n00, n01, n10, n11]).astype(float)[:, : 26 * 14].reshape(4, 26, 14).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        p00, p10 = a[0] / (a[0] + a[1]), a[2] / (a[2] + a[3])
    p00, p10 = np.nan_to_num(p00, nan=1.0), np.nan_to_num(p10, nan=1.0)
    p = np.repeat(np.stack([p00, 1 - p00, p10, 1 - p10]), 14, axis=1)
    return wet, np.concatenate([p, p[:, -1:]], axis=1)


def harmonics(y: np.ndarray, level: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares fit of a mean and `level` harmonics over the year: fitted values, (mean, amplitudes), phases."""
    n = len(y)
    t = (np.arange(n) + 1) * 2 * np.pi / n
    x = np.column_stack([np.ones(n), *[f((j + 1) * t) for j in range(level) for f in (np.sin, np.cos)]])
    c = np.linalg.lstsq(x, y, rcond=None)[0]
    amplitude, phase = [c[0]], []
    for j in range(level):
        s, k = c[2 * j + 1], c[2 * j + 2]
        d = math.atan(k / s) if s else math.copysign(math.pi / 2, k)
        phase.append(d)
        amplitude.append(s / math.cos(d) if s else abs(k))
    return x @ c, np.array(amplitude), np.array(phase)


def state_statistics(x: np.ndarray, wet: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Residuals [years * 365], and the harmonic mean and deviation (ddof 1) of each day for wet and dry ones."""
    out, resid = {}, np.zeros(x.shape)
    for name, value in (("wet", 1), ("dry", 0)):
        y = np.where(wet == value, x, np.nan)
        n = np.isfinite(y).sum(0)
        mean = np.where(n > 0, np.nansum(y, 0) / np.maximum(n, 1), 0.0)
        sd = np.where(n > 1, np.sqrt(np.nansum((y - mean) ** 2, 0) / np.maximum(n - 1, 1)), 0.0)
        out[f"mean_{name}"], out[f"sd_{name}"] = harmonics(mean)[0], harmonics(sd)[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (y - out[f"mean_{name}"]) / out[f"sd_{name}"]
        resid += np.where(np.isfinite(r), r, 0.0)
    return resid.ravel(), out


def temperature_matrices(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B of the first-order model of two residual series: A = M1 M0^-1, B a root of M0 - M1 M0^-1 M1'."""

    def cov(a, b, lag):
        return (a * b).sum() / max(1, len(a) - ((a == 0) & (b == 0)).sum() - lag - 1)

    c0 = cov(high, low, 0)
    m0 = np.array([[1, c0], [c0, 1]])
    pair = (high, low)
    m1 = np.array([[cov(pair[j][1:], pair[i][:-1], 1) for j in (0, 1)] for i in (0, 1)])
    inverse = np.linalg.pinv(m0)
    d, v = np.linalg.eigh(m0 - m1 @ inverse @ m1.T)
    d = np.where(d < 0, 1e-6, d)
    return m1 @ inverse, v @ np.diag(np.sqrt(d)) @ v.T


def correct(daily: np.ndarray, target: np.ndarray, how: str, corrector: str) -> np.ndarray:
    """Days of whole years moved to meet targets [years * 12]; a factor that is no number is 0."""
    years = len(daily) // 365
    month = np.tile(_MONTH_OF, years) + 12 * np.repeat(np.arange(years), 365)
    n, total = np.bincount(month, minlength=12 * years), np.bincount(month, daily, 12 * years)
    agg = total if how == "sum" else total / n
    with np.errstate(divide="ignore", invalid="ignore"):
        a = target - agg if corrector == "translation" else target / agg
    a = np.where(np.isfinite(a), a, 0.0)[month]
    return daily + a if corrector == "translation" else daily * a


# Families: (fit of positive data, draws). Parameters are arrays, so that they can be stored.
def _moments(x):
    return x.mean(), max(x.std(), 1e-9)


def _fit_gamma(x):
    s = max(math.log(x.mean()) - np.log(x).mean(), 1e-9)
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    return k, x.mean() / k


def _fit_weibull(x):
    k, lx = 1.0, np.log(x)
    for _ in range(60):
        w = x**k
        f = (w * lx).sum() / w.sum() - 1 / k - lx.mean()
        df = (w * lx * lx).sum() / w.sum() - ((w * lx).sum() / w.sum()) ** 2 + 1 / k**2
        k = min(max(k - f / df, 0.05), 50.0)
    return k, ((x**k).mean()) ** (1 / k)


def _fit_gumbel(x):
    b = max(x.std() * math.sqrt(6) / math.pi, 1e-9)
    for _ in range(60):
        w = np.exp(-(x - x.min()) / b)
        b = max(0.5 * b + 0.5 * (x.mean() - (x * w).sum() / w.sum()), 1e-9)
    return x.min() - b * math.log(np.exp(-(x - x.min()) / b).mean()), b


def _l_moments(x):
    x = np.sort(x)
    n = len(x)
    i = np.arange(n)
    b0, b1 = x.mean(), (i * x).sum() / (n * max(1, n - 1))
    b2 = (i * (i - 1) * x).sum() / (n * max(1, n - 1) * max(1, n - 2))
    l2 = max(2 * b1 - b0, 1e-12)
    return b0, l2, (6 * b2 - 6 * b1 + b0) / l2


def _fit_gev(x):
    l1, l2, t3 = _l_moments(x)
    c = 2 / (3 + t3) - math.log(2) / math.log(3)
    k = 7.8590 * c + 2.9554 * c * c
    k = k if abs(k) > 1e-6 else 1e-6
    k = max(k, -0.95)
    g = math.gamma(1 + k)
    a = max(l2 * k / ((1 - 2**-k) * g), 1e-12)
    return k, l1 - a * (1 - g) / k, a


def _fit_pareto(x):
    l1, l2, _ = _l_moments(x - min(0.0, x.min()))
    k = max(min(l1 / l2 - 2, 5.0), -0.45)
    return k, (1 + k) * l1


def _fit_pearson(x):
    m, s = _moments(x)
    g = ((x - m) ** 3).mean() / s**3
    g = g if abs(g) > 1e-3 else 1e-3
    return m, s, g


_EULER_PI = math.log(2 * math.pi)


def _gamma_log(x, k, b):
    return (k - 1) * np.log(x) - x / b - math.lgamma(k) - k * math.log(b)


def _inf(v, ok):
    return np.where(ok, v, -np.inf)


with np.errstate(all="ignore"):
    FAMILIES = {
        "norm": (_moments, lambda x, m, s: -0.5 * ((x - m) / s) ** 2 - math.log(s) - 0.5 * _EULER_PI, lambda r, n, m, s: r.normal(m, s, n)),
        "expon": (lambda x: (x.mean(),), lambda x, b: -x / b - math.log(b), lambda r, n, b: r.exponential(b, n)),
        "gamma": (_fit_gamma, _gamma_log, lambda r, n, k, b: r.gamma(k, b, n)),
        "lognorm": (lambda x: _moments(np.log(x)), lambda x, m, s: -0.5 * ((np.log(x) - m) / s) ** 2 - np.log(x * s) - 0.5 * _EULER_PI, lambda r, n, m, s: r.lognormal(m, s, n)),
        "weibull_min": (_fit_weibull, lambda x, k, b: math.log(k / b) + (k - 1) * np.log(x / b) - (x / b) ** k, lambda r, n, k, b: b * r.weibull(k, n)),
        "genextreme": (_fit_gev, lambda x, k, m, a: _inf(-math.log(a) + (1 / k - 1) * np.log(np.maximum(1 - k * (x - m) / a, 1e-300)) - np.maximum(1 - k * (x - m) / a, 1e-300) ** (1 / k), 1 - k * (x - m) / a > 0), lambda r, n, k, m, a: m + a * (1 - (-np.log(r.random(n))) ** k) / k),
        "genpareto": (_fit_pareto, lambda x, k, a: _inf(-math.log(a) + ((1 / k - 1) * np.log(np.maximum(1 - k * x / a, 1e-300)) if abs(k) > 1e-9 else -x / a), 1 - k * x / a > 0), lambda r, n, k, a: a * (1 - r.random(n) ** k) / k if abs(k) > 1e-9 else r.exponential(a, n)),
        "gumbel_r": (_fit_gumbel, lambda x, m, b: -(x - m) / b - np.exp(-(x - m) / b) - math.log(b), lambda r, n, m, b: r.gumbel(m, b, n)),
        "pearson3": (_fit_pearson, lambda x, m, s, g: _inf(_gamma_log(np.maximum((x - m) * np.sign(g) / s * 2 / abs(g) + 4 / g**2, 1e-300), 4 / g**2, 1.0) + math.log(2 / (abs(g) * s)), (x - m) * np.sign(g) / s * 2 / abs(g) + 4 / g**2 > 0), lambda r, n, m, s, g: m + np.sign(g) * s * (r.gamma(4 / g**2, 1.0, n) - 4 / g**2) * abs(g) / 2),
    }


def best_distribution(x: np.ndarray) -> tuple[str, list[float]]:
    """The family of least AIC for positive data; a deterministic choice. Fewer than three values: exponential."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x) & (x > 0)]
    if len(x) < 3 or np.ptp(x) == 0:
        return "expon", [float(x.mean()) if len(x) else 1e-6]
    best = (math.inf, "expon", [float(x.mean())])
    for name, (fit, log, _) in FAMILIES.items():
        try:
            with np.errstate(all="ignore"):
                p = [float(v) for v in fit(x)]
                aic = 2 * len(p) - 2 * float(np.sum(log(x, *p)))
        except (ValueError, OverflowError, ZeroDivisionError):
            continue
        if math.isfinite(aic) and aic < best[0]:
            best = (aic, name, p)
    return best[1], best[2]


def positive_draws(rng, name: str, p: list[float], n: int) -> np.ndarray:
    """Draws above 0: others are drawn again, and after many tries stand at the smallest number above 0."""
    draw = FAMILIES[name][2]
    out = draw(rng, n, *p)
    for _ in range(200):
        bad = ~(out > 0)
        if not bad.any():
            return out
        out[bad] = draw(rng, int(bad.sum()), *p)
    return np.maximum(out, 1e-6)


def monthly_distributions(x: np.ndarray) -> dict[int, tuple[str, list[float]]]:
    """Best family of each month's positive values in a matrix [years, 365]."""
    return {m: best_distribution(x[:, _MONTH_OF == m]) for m in range(12)}


def fit(obs: dict[str, np.ndarray]) -> dict:
    """Parameters from daily matrices [years, 365] of PRE, MAXTEM, MINTEM, RHU, RS, WIN (those present)."""
    wet, p = occurrence(obs["PRE"])
    amounts = np.where(obs["PRE"] > WET, obs["PRE"] - WET, 0.0)
    out = {"occurrence": p, "rain": monthly_distributions(amounts)}
    if "MAXTEM" in obs and "MINTEM" in obs:
        r1, s1 = state_statistics(obs["MAXTEM"], wet)
        r2, s2 = state_statistics(obs["MINTEM"], wet)
        a, b = temperature_matrices(r1, r2)
        out["temperature"] = {"a": a, "b": b, "high": s1, "low": s2}
    out["cycles"] = {v: state_statistics(obs[v], wet)[1] for v in ("RHU", "RS") if v in obs}
    out["draws"] = {v: {s: monthly_distributions(np.where(wet == s, obs[v], 0.0)) for s in (0, 1)} for v in ("WIN",) if v in obs}
    return out


def generate(model: dict, targets: dict[str, np.ndarray], years: int, rules: dict[str, tuple[str, str]], seed: int | tuple) -> dict[str, np.ndarray]:
    """Daily series of whole years; targets hold monthly values [years * 12], rules (aggregate, corrector) of each variable."""
    rng, n = np.random.default_rng(seed), 365 * years
    p, u = model["occurrence"], rng.random(365 * years)
    states, now = np.zeros(n, int), 0
    for i in range(n):
        now = int(u[i] >= p[2 * now, i % 365])
        states[i] = now
    month = np.tile(_MONTH_OF, years)

    def moved(x, v):
        return correct(x, targets[v], *rules[v]) if v in targets else x

    rain = np.zeros(n)
    for m in range(12):
        at = (states == 1) & (month == m)
        rain[at] = positive_draws(rng, *model["rain"][m], int(at.sum()))
    rain = moved(rain, "PRE")
    rain[rain < WET] = 0
    out = {"PRE": rain}

    def by_state(s, what):
        return np.where(states == 1, np.tile(s[f"{what}_wet"], years), np.tile(s[f"{what}_dry"], years))

    if t := model.get("temperature"):
        high, low = moved(by_state(t["high"], "mean"), "MAXTEM"), moved(by_state(t["low"], "mean"), "MINTEM")
        sh, sl = np.abs(by_state(t["high"], "sd")), np.abs(by_state(t["low"], "sd"))
        eps, k, r = rng.standard_normal((n, 2)), np.zeros((n, 2)), np.zeros(2)
        for i in range(n):
            r = t["a"] @ r + t["b"] @ eps[i]
            k[i] = r
        spread = np.sqrt(np.abs(sh**2 - sl**2))
        base = sh > sl  # the steadier of the two is drawn first
        tmin = np.where(base, low + sl * k[:, 1], 0.0)
        tmax = np.where(base, tmin + high - low + spread * k[:, 0], high + sh * k[:, 0])
        tmin = np.where(base, tmin, tmax + low - high - spread * k[:, 1])
        out |= {"MAXTEM": tmax, "MINTEM": np.where(tmax <= tmin, tmax - 0.2 * np.abs(tmax), tmin)}
    for v, s in model["cycles"].items():
        y = moved(by_state(s, "mean"), v) + np.abs(by_state(s, "sd")) * rng.standard_normal(n)
        out[v] = np.clip(y, 0.0, HUMID) if v == "RHU" else np.maximum(y, 0.0)
    for v, d in model["draws"].items():
        y = np.zeros(n)
        for s in (0, 1):
            for m in range(12):
                at = (states == s) & (month == m)
                y[at] = positive_draws(rng, *d[s][m], int(at.sum()))
        out[v] = moved(y, v)
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ordinal ranks from 1 in each column."""
    return np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0) + 1


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape)
    for j in range(x.shape[1]):
        _, inv, n = np.unique(x[:, j], return_inverse=True, return_counts=True)
        out[:, j] = (np.cumsum(n) - (n - 1) / 2)[inv]
    return out


def spearman(x: np.ndarray) -> np.ndarray:
    return np.atleast_2d(np.corrcoef(_mean_ranks(x), rowvar=False))


def repaired(c: np.ndarray) -> np.ndarray:
    """A positive definite correlation matrix: eigenvalues of at most 0 become 1e-10, the diagonal 1 again."""
    d, v = np.linalg.eigh((c + c.T) / 2)
    if (d > 0).all():
        return c
    m = v @ np.diag(np.where(d <= 0, 1e-10, d)) @ v.T
    s = np.sqrt(np.diag(m))
    return m / np.outer(s, s) + 1e-9 * np.eye(len(m))


def iman_conover(target: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x with each column's values in an order that gives the columns the target rank correlation."""
    scores = normal_ppf(_ranks(x) / (len(x) + 1))
    own = np.linalg.cholesky(repaired(spearman(scores)))
    turn = np.linalg.cholesky(repaired(np.asarray(target, float))) @ np.linalg.inv(own)
    ranks = _ranks(scores @ turn.T) - 1
    return np.take_along_axis(np.sort(x, axis=0), ranks, axis=0)


def fill_trace(x: np.ndarray, threshold: float, rate: float, rng) -> np.ndarray:
    """x times rate, the dry cells of each column filled with a random order of traces below the threshold."""
    out = np.asarray(x, float) * rate
    for j in range(out.shape[1]):
        dry = out[:, j] < rate * threshold
        d = int(dry.sum())
        if d:
            out[dry, j] = rng.permutation(d) * (rate * threshold - 1) / d
    return out


def shuffle_to(target: np.ndarray, gen: np.ndarray, fill: bool, threshold: float, rate: float, rng) -> np.ndarray:
    if not fill:
        return iman_conover(target, gen)
    out = iman_conover(target, fill_trace(gen, threshold, rate, rng))
    out[out < threshold * rate] = 0
    return out / rate


def multi_site(obs: np.ndarray, gen: np.ndarray, fill: bool = False, threshold: float = 0.1, rate: float = 1e3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """gen shuffled to the observed rank correlation, and again to the target adjusted by the first result; and that target."""
    rng = np.random.default_rng(seed)
    obs = fill_trace(obs, threshold, rate, rng) if fill else np.asarray(obs, float)
    rank = spearman(obs)
    once = shuffle_to(rank, gen, fill, threshold, rate, rng)
    once = fill_trace(once, threshold, rate, rng) if fill else once
    x, y = np.corrcoef(once, rowvar=False).ravel(), rank.ravel()
    slope, intercept = np.polyfit(x, y, 1)
    target = (slope * np.corrcoef(obs, rowvar=False) + intercept).reshape(rank.shape)
    return shuffle_to(target, gen, fill, threshold, rate, rng), target


def ks_gamma(x: np.ndarray, k: float, b: float) -> float:
    """Kolmogorov-Smirnov distance of data from a gamma distribution."""
    x = np.sort(x)
    c = np.array([gammainc(k, v / b) for v in x])
    i = np.arange(1, len(x) + 1) / len(x)
    return float(max((i - c).max(), (c - i + 1 / len(x)).max()))
