"""Linear models of an ensemble: least variance, ridge, and Bayesian model averaging by enumeration or Metropolis steps."""

from __future__ import annotations

import itertools
import math

import numpy as np

from .special import student_cdf


def least_variance(errors: np.ndarray) -> np.ndarray:
    """Weights, summing to 1, of the least error variance: A^-1 1 / (1' A^-1 1) for the errors' covariance A."""
    centred = errors - errors.mean(axis=0)
    a = centred.T @ centred / max(1, len(errors) - 1)
    w = np.linalg.pinv(a) @ np.ones(a.shape[0])
    return w / w.sum()


def ridge_cv(x: np.ndarray, y: np.ndarray, penalties: np.ndarray | None = None, folds: int = 10) -> tuple[float, np.ndarray]:
    """Intercept and coefficients at the penalty of the least mean of the folds' mean squared errors; folds are contiguous.

    Columns are centred and divided by their norm in each fit, which the penalties refer to; coefficients are those of the columns as given.
    """
    penalties = np.logspace(-5, 2, 200) if penalties is None else penalties

    def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ma, mb = a.mean(0), b.mean()
        norm = np.sqrt(((a - ma) ** 2).sum(0))
        norm = np.where(norm > 0, norm, 1.0)
        u, s, vt = np.linalg.svd((a - ma) / norm, full_matrices=False)
        coef = vt.T @ ((s / (s**2 + penalties[:, None])).T * (u.T @ (b - mb))[:, None])
        return coef / norm[:, None], ma, mb

    loss = np.zeros(len(penalties))
    for test in np.array_split(np.arange(len(y)), min(folds, len(y))):
        train = np.setdiff1d(np.arange(len(y)), test)
        if len(train) < 2:
            continue
        coef, ma, mb = solve(x[train], y[train])
        loss += (((x[test] - ma) @ coef + mb - y[test][:, None]) ** 2).mean(0)
    coef, ma, mb = solve(x, y)
    c = coef[:, int(loss.argmin())]
    return float(mb - ma @ c), c


def log_likelihood(x: np.ndarray, y: np.ndarray, chosen: tuple[int, ...], g: float, standard: bool = False) -> float:
    """Log marginal likelihood, but for a constant, of the model with an intercept and the chosen columns under a g-prior.

    The first term has the model's own residual sum; standard takes the total sum there, as the usual g-prior does.
    """
    n, k = len(y), sum(chosen)
    total = ((y - y.mean()) ** 2).sum()
    if k:
        a = np.column_stack([np.ones(n), x[:, np.flatnonzero(chosen)]])
        rest = ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
    else:
        rest = total
    rest, total = max(rest, 1e-300), max(total, 1e-300)
    first = total if standard else rest
    return -0.5 * math.log(n) - (n - 1) / 2 * math.log(first) + (n - k - 1) / 2 * math.log(1 + g) - (n - 1) / 2 * math.log(1 + g * rest / total)


def log_prior(chosen: tuple[int, ...], inclusion: float) -> float:
    k = sum(chosen)
    return k * math.log(inclusion) + (len(chosen) - k) * math.log(1 - inclusion)


def enumerate_models(x: np.ndarray, y: np.ndarray, inclusion: float = 1 / 3, g: float | None = None, standard: bool = False) -> dict[tuple[int, ...], float]:
    """Posterior of every subset of the columns (for some dozen at most)."""
    k = x.shape[1]
    g = max(len(y), k * k) if g is None else g
    models = list(itertools.product((0, 1), repeat=k))
    logs = np.array([log_likelihood(x, y, m, g, standard) + log_prior(m, inclusion) for m in models])
    p = np.exp(logs - logs.max())
    return dict(zip(models, p / p.sum(), strict=True))


def mc3(x: np.ndarray, y: np.ndarray, iterations: int = 10_000, inclusion: float = 1 / 3, g: float | None = None, proposal: str = "random", seed: int = 0, standard: bool = False) -> tuple[dict, list]:
    """Metropolis walk over inclusion vectors: shares of visits after burn-in, and the walk.

    random proposes to flip one column; prior draws a column anew from the prior.
    """
    k, rng = x.shape[1], np.random.default_rng(seed)
    g = max(len(y), k * k) if g is None else g
    cache: dict[tuple, float] = {}

    def value(m: tuple) -> float:
        if m not in cache:
            cache[m] = log_likelihood(x, y, m, g, standard)
        return cache[m]

    now = tuple(int(v) for v in rng.random(k) < inclusion)
    walk = []
    for _ in range(iterations):
        i = rng.integers(k)
        new = list(now)
        new[i] = 1 - new[i] if proposal == "random" else int(rng.random() < inclusion)
        new = tuple(new)
        ratio = value(new) - value(now) + (log_prior(new, inclusion) - log_prior(now, inclusion) if proposal == "random" else 0.0)
        if math.log(rng.random() or 1e-300) < ratio:
            now = new
        walk.append(now)
    tau = max(integrated_time(np.array([sum(m) for m in walk], float)), 1.0)
    kept = walk[min(len(walk) // 2, int(20 * tau)) :]
    visits: dict[tuple, float] = {}
    for m in kept:
        visits[m] = visits.get(m, 0) + 1 / len(kept)
    return visits, walk


def averaged_coefficients(x: np.ndarray, y: np.ndarray, inclusion: float = 1 / 3, exact_up_to: int = 12, seed: int = 0, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients averaged over the posterior: enumerated for few columns, else by the walk."""
    k = x.shape[1]
    post = enumerate_models(x, y, inclusion) if k <= exact_up_to else mc3(x, y, inclusion=inclusion, seed=seed)[0]
    g = max(len(y), k * k)
    intercept, out = 0.0, np.zeros(k)
    for m, p in post.items():
        at = np.flatnonzero(m)
        a = np.column_stack([np.ones(len(y)), x[:, at]])
        c = ConjugateRegression(1 / g).fit(a, y).mean
        intercept += p * c[0]
        out[at] += p * c[1:]
    return float(intercept), out


class ConjugateRegression:
    """Normal-gamma posterior of a linear model; penalty times X'X is the prior precision."""

    def __init__(self, penalty: float):
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> ConjugateRegression:
        xx = x.T @ x
        self.precision = (1 + self.penalty) * xx
        self.cov = np.linalg.pinv(self.precision)
        self.mean = self.cov @ (x.T @ y)
        self.shape = len(y) / 2
        self.rate = max(0.5 * (y @ y - self.mean @ self.precision @ self.mean), 1e-300)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.mean

    def coefficients(self, n: int, rng) -> np.ndarray:
        """Draws of the coefficients, a row each: normal given the precision, which is gamma."""
        tau = rng.gamma(self.shape, 1 / self.rate, n)
        root = np.linalg.cholesky(self.cov + 1e-12 * np.eye(len(self.mean)))
        return self.mean + (rng.standard_normal((n, len(self.mean))) @ root.T) / np.sqrt(tau)[:, None]

    def residuals(self, n: int, rng) -> np.ndarray:
        """Draws of the residual deviation."""
        return 1 / np.sqrt(rng.gamma(self.shape, 1 / self.rate, n))

    def predictive(self, x: np.ndarray, n: int, rng) -> np.ndarray:
        """Draws at each row of x: Student around the mean."""
        df, scale = 2 * self.shape, self.rate / self.shape
        width = np.sqrt(scale * (1 + np.einsum("ij,jk,ik->i", x, self.cov, x)))
        return self.predict(x)[:, None] + width[:, None] * draw_student(df, (len(x), n), rng)


def draw_student(df: float, size, rng) -> np.ndarray:
    return rng.standard_normal(size) / np.sqrt(rng.chisquare(df, size) / df)


def draw_normal_gamma(mean: np.ndarray, cov: np.ndarray, shape: float, rate: float, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    tau = rng.gamma(shape, 1 / rate, n)
    root = np.linalg.cholesky(np.asarray(cov))
    return mean + rng.standard_normal((n, len(mean))) @ root.T / np.sqrt(tau)[:, None], tau


def prediction_interval(density, centre: float, mass: float, reach: float) -> tuple[float, float]:
    """The symmetric interval around centre that holds `mass` of a density, by Simpson sums and bisection."""

    def held(w: float) -> float:
        t = np.linspace(centre - w, centre + w, 2001)
        v = np.array([density(x) for x in t])
        h = t[1] - t[0]
        return h / 3 * (v[0] + v[-1] + 4 * v[1:-1:2].sum() + 2 * v[2:-1:2].sum())

    a, b = 0.0, reach
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if held(m) < mass else (a, m)
    return centre - b, centre + b


def predictive_draws(x: np.ndarray, y: np.ndarray, new: np.ndarray, n: int, inclusion: float = 1 / 3, seed: int = 0) -> np.ndarray:
    """Draws of the averaged prediction at new rows: models by a multinomial draw, then each one's predictive draws."""
    rng = np.random.default_rng(seed)
    post = enumerate_models(x, y, inclusion)
    g = max(len(y), x.shape[1] ** 2)
    counts = rng.multinomial(n, list(post.values()))
    out = []
    for m, c in zip(post, counts, strict=True):
        if c:
            at = np.flatnonzero(m)
            wide = lambda a: np.column_stack([np.ones(len(a)), a[:, at]])  # noqa: E731, B023
            out.append(ConjugateRegression(1 / g).fit(wide(x), y).predictive(wide(new), int(c), rng))
    return np.concatenate(out, axis=1)


def posterior_of(x: np.ndarray, y: np.ndarray, inclusion: float = 1 / 3, exact_up_to: int = 12, seed: int = 0) -> dict[tuple[int, ...], float]:
    """Enumerated for few columns, else by the walk."""
    return enumerate_models(x, y, inclusion) if x.shape[1] <= exact_up_to else mc3(x, y, inclusion=inclusion, seed=seed)[0]


def predictive_mixture(x: np.ndarray, y: np.ndarray, new: np.ndarray, inclusion: float = 1 / 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The averaged prediction at new rows as a mixture of Students: weights (m,), centres and widths (m, rows), degrees of freedom."""
    post, g = posterior_of(x, y, inclusion), max(len(y), x.shape[1] ** 2)
    centres, widths = [], []
    for m in post:
        at = np.flatnonzero(m)
        wide = lambda a: np.column_stack([np.ones(len(a)), a[:, at]])  # noqa: E731, B023
        fit, n = ConjugateRegression(1 / g).fit(wide(x), y), wide(new)
        centres.append(fit.predict(n))
        widths.append(np.sqrt(fit.rate / fit.shape * (1 + np.einsum("ij,jk,ik->i", n, fit.cov, n))))
    return np.array(list(post.values())), np.array(centres), np.array(widths), float(len(y))


def mixture_quantile(weights: np.ndarray, centres: np.ndarray, widths: np.ndarray, df: float, p: float) -> np.ndarray:
    """Where a mixture's distribution function reaches p, row by row: bisection, no draws."""
    below = lambda q: weights @ student_cdf((q - centres) / widths, df)
    far = widths.max(axis=0)
    low, high = centres.min(axis=0) - far, centres.max(axis=0) + far
    while (out := below(low) > p).any():
        low = np.where(out, low - (far := 2 * far), low)
    while (out := below(high) < p).any():
        high = np.where(out, high + (far := 2 * far), high)
    for _ in range(80):
        middle = (low + high) / 2
        short = below(middle) < p
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return (low + high) / 2


def autocorrelation(x: np.ndarray, lags: int | None = None) -> np.ndarray:
    """Autocorrelation up to n / 100 lags by default."""
    lags = max(1, len(x) // 100) if lags is None else lags
    c = x - x.mean()
    v = (c * c).mean() or 1.0
    return np.array([(c[: len(c) - k] * c[k:]).mean() / v for k in range(lags + 1)])


def integrated_time(x: np.ndarray, window: float = 6.0) -> float:
    """Integrated autocorrelation time, summed up to the first lag above `window` times itself."""
    a, tau = autocorrelation(x, min(len(x) - 1, 2000)), 0.5
    for k in range(1, len(a)):
        tau += a[k]
        if k >= window * tau:
            break
    return float(max(tau, 0.5))


def exponential_time(x: np.ndarray) -> float:
    """Largest -k / log|acf(k)| over the estimated lags."""
    a = np.abs(autocorrelation(x))[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -np.arange(1, len(a) + 1) / np.log(a)
    t = t[np.isfinite(t)]
    return float(t.max()) if len(t) else 0.0


def binary_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b of two 0/1 series."""
    n11, n00 = ((x == 1) & (y == 1)).sum(), ((x == 0) & (y == 0)).sum()
    n10, n01 = ((x == 1) & (y == 0)).sum(), ((x == 0) & (y == 1)).sum()
    d = math.sqrt(float((n11 + n10) * (n00 + n01)) * float((n11 + n01) * (n00 + n10)))
    return float((n11 * n00 - n10 * n01) / d) if d else 0.0


def binary_acf(x: np.ndarray, lags: int | None = None) -> np.ndarray:
    lags = max(1, len(x) // 100) if lags is None else lags
    return np.array([1.0] + [binary_tau(x[:-k], x[k:]) for k in range(1, lags + 1)])


def diagnose(walk: list, k: int) -> dict:
    """Effective sample size and standard error of each column's inclusion in a walk."""
    m = np.array(walk, float).reshape(-1, k)
    tau = np.array([integrated_time(m[:, i]) if m[:, i].std() else 0.5 for i in range(k)])
    ess = len(m) / (2 * tau)
    return {"tau": tau, "ess": ess, "stderr": m.std(0) / np.sqrt(ess)}
