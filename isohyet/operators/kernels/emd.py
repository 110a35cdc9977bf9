"""Empirical mode decomposition of one series, its ensembles, significance of modes, and instantaneous frequency."""

from __future__ import annotations

import math

import numpy as np

#: Thresholds of the stopping rules.
SVAR, STD, ENERGY, RANGE, TOTAL_POWER, MAX_SIFT = 0.001, 0.2, 0.2, 0.001, 0.005, 1000


def natural_extrema(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of maxima, minima and zero crossings; a plateau's extremum is its middle."""
    d = np.sign(np.diff(s))
    at = np.flatnonzero(d)
    turn = np.flatnonzero(d[at[1:]] != d[at[:-1]]) if len(at) > 1 else np.zeros(0, int)
    place = (at[turn] + 1 + at[turn + 1]) // 2 if len(turn) else np.zeros(0, int)
    up = d[at[turn]] > 0 if len(turn) else np.zeros(0, bool)
    zero = np.flatnonzero(s[:-1] * s[1:] < 0)
    exact = np.flatnonzero(s == 0)
    if len(exact):
        runs = np.split(exact, np.flatnonzero(np.diff(exact) > 1) + 1)
        zero = np.sort(np.r_[zero, [(r[0] + r[-1]) // 2 for r in runs]])
    return place[up], place[~up], zero


def parabolic(t: np.ndarray, s: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the parabolas through each extremum and its neighbours."""
    if not len(places):
        return t[places], s[places]
    a, b, c = t[places - 1], t[places], t[places + 1]
    fa, fb, fc = s[places - 1], s[places], s[places + 1]
    left, right = (fb - fa) / (b - a), (fc - fb) / (c - b)
    curve = (right - left) / (c - a)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (a + b) / 2 - left / (2 * curve)
        y = fa + left * (x - a) + curve * (x - a) * (x - b)
    ok = np.isfinite(x) & np.isfinite(y) & (x > a) & (x < c)
    return np.where(ok, x, b), np.where(ok, y, fb)


def mirrored(t: np.ndarray, s: np.ndarray, tx: np.ndarray, x: np.ndarray, tn: np.ndarray, n: np.ndarray, count: int = 2):
    """Maxima and minima continued beyond both ends by `count` mirrored ones.

    The mirror stands at the end's first extremum, or at the end itself when the end value lies beyond that extremum's
    opposite neighbour, in which case the end counts as an extremum of that kind.
    """

    def one_end(first, tx, x, tn, n, edge_t, edge_s):
        # Everything as seen from a left end; the right one is passed in reversed.
        if abs(tx[0] - first) < abs(tn[0] - first):
            if edge_s > n[0]:
                mx, mn, pivot = (tx[1 : count + 1], x[1 : count + 1]), (tn[:count], n[:count]), tx[0]
            else:
                mx, mn, pivot = (tx[:count], x[:count]), (np.r_[edge_t, tn[: count - 1]], np.r_[edge_s, n[: count - 1]]), edge_t
        elif edge_s < x[0]:
            mx, mn, pivot = (tx[:count], x[:count]), (tn[1 : count + 1], n[1 : count + 1]), tn[0]
        else:
            mx, mn, pivot = (np.r_[edge_t, tx[: count - 1]], np.r_[edge_s, x[: count - 1]]), (tn[:count], n[:count]), edge_t
        out = [(2 * pivot - m[0], m[1]) for m in (mx, mn)]
        # A mirror inside the series would leave its end uncovered: then it stands at the end.
        if any(((first - m[0]) * sign < 0).all() for m in out):
            out = [(2 * edge_t - a[:count], b[:count]) for a, b in ((tx, x), (tn, n))]
        return out

    sign = 1
    left = one_end(t[0], tx, x, tn, n, t[0], s[0])
    sign = -1
    right = one_end(t[-1], tx[::-1], x[::-1], tn[::-1], n[::-1], t[-1], s[-1])
    join = lambda l, a, b, r: tuple(_sorted_unique(np.r_[l[0], a, r[0]], np.r_[l[1], b, r[1]]))
    return join(left[0], tx, x, right[0]), join(left[1], tn, n, right[1])


def _sorted_unique(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, first = np.unique(t, return_index=True)
    return t, v[first]


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline, not-a-knot; the parabola through three points, the line through two."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, b, c, r = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    a[1:-1], b[1:-1], c[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    r[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    b[0], c[0] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * c[0]) * h[1] * d[0] + h[0] ** 2 * d[1]) / c[0]
    b[-1], a[-1] = h[-2], h[-1] + h[-2]
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * a[-1] + h[-1]) * h[-2] * d[-1]) / a[-1]
    m = solve_tridiagonal(a, b, c, r)
    return _hermite(x, y, m, at)


def solve_tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x of the tridiagonal system with lower a, diagonal b, upper c."""
    b, r = b.astype(float).tolist(), r.astype(float).tolist()
    a, c, n = a.tolist(), c.tolist(), len(b)
    for i in range(1, n):
        w = a[i] / b[i - 1]
        b[i] -= w * c[i - 1]
        r[i] -= w * r[i - 1]
    out = [0.0] * n
    out[-1] = r[-1] / b[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (r[i] - c[i] * out[i + 1]) / b[i]
    return np.array(out)


def _hermite(x, y, m, at):
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    u = (at - x[i]) / h
    return y[i] * (1 + 2 * u) * (1 - u) ** 2 + m[i] * h * u * (1 - u) ** 2 + y[i + 1] * u * u * (3 - 2 * u) + m[i + 1] * h * u * u * (u - 1)


def akima(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Akima's spline."""
    if len(x) < 3:
        return np.interp(at, x, y)
    d = np.diff(y) / np.diff(x)
    e = np.r_[3 * d[0] - 2 * d[1], 2 * d[0] - d[1], d, 2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]
    w = np.abs(np.diff(e))
    left, right = w[2:], w[:-2]
    total = left + right
    with np.errstate(invalid="ignore", divide="ignore"):
        m = np.where(total > 1e-9 * w.max(initial=0), (left * e[1:-2] + right * e[2:-1]) / total, (e[1:-2] + e[2:-1]) / 2)
    return _hermite(x, y, m, at)


ENVELOPES = {"cubic": cubic, "akima": akima, "linear": lambda x, y, at: np.interp(at, x, y), "slinear": lambda x, y, at: np.interp(at, x, y)}


def envelopes(t: np.ndarray, s: np.ndarray, kind: str = "cubic", extrema: str = "simple", count: int = 2):
    """Upper and lower envelope with their knots; None when there are too few extrema."""
    hi, lo, _ = natural_extrema(s)
    if len(hi) + len(lo) < 3 or not len(hi) or not len(lo):
        return None
    tx, x = parabolic(t, s, hi) if extrema == "parabol" else (t[hi], s[hi])
    tn, n = parabolic(t, s, lo) if extrema == "parabol" else (t[lo], s[lo])
    (tx, x), (tn, n) = mirrored(t, s, tx, x, tn, n, count)
    return ENVELOPES[kind](tx, x, t), ENVELOPES[kind](tn, n, t), x, n


def _is_imf(new: np.ndarray, old: np.ndarray, tops: np.ndarray, bottoms: np.ndarray) -> bool:
    if (tops < 0).any() or (bottoms > 0).any():
        return False
    if (new**2).sum() < 1e-10:
        return False
    power = (old**2).sum()
    diff = new - old
    span = old.max() - old.min()
    svar = (diff**2).sum() / span if span else np.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        std = ((diff / new) ** 2).sum()
    return svar < SVAR or std < STD or (diff**2).sum() / power < ENERGY


def _finished(rest: np.ndarray) -> bool:
    return rest.max() - rest.min() < RANGE or np.abs(rest).sum() < TOTAL_POWER


def emd(s: np.ndarray, t: np.ndarray | None = None, max_imf: int = -1, kind: str = "cubic", extrema: str = "simple", fixe: int = 0, fixe_h: int = 0, stop: str = "default", count: int = 2) -> np.ndarray:
    """Modes as rows, the residue last if it is not nought; their sum is s.

    fixe sifts so many times; fixe_h goes on until the counts of extrema and zeros have differed by at most one so many
    times running; stop="rilling" ends by the amplitude rule (0.05, 0.5, 0.05). Without `extrema` parabol, t is 0, 1, ...
    """
    s = np.asarray(s, float)
    t = np.arange(len(s), dtype=float) if t is None or extrema == "simple" else (np.asarray(t, float) - t[0]) / np.diff(t).min()
    rest, modes = s.copy(), []
    while len(s) > 3 and (max_imf < 0 or len(modes) < max_imf):
        mode, steady, done = rest.copy(), 0, False
        for n in range(1, MAX_SIFT + 1):
            env = envelopes(t, mode, kind, extrema, count)
            if env is None:
                done = n == 1
                break
            top, bottom, tops, bottoms = env
            mean, old = (top + bottom) / 2, mode
            if stop == "rilling":
                amplitude = np.abs(top - bottom) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = np.abs(mean) / amplitude
                hi, lo, zero = natural_extrema(mode)
                if (f > 0.05).mean() <= 0.05 and not (f > 0.5).any() and abs(len(hi) + len(lo) - len(zero)) <= 1:
                    break
                mode = mode - mean
                continue
            mode = mode - mean
            hi, lo, zero = natural_extrema(mode)
            near = abs(len(hi) + len(lo) - len(zero)) < 2
            if fixe:
                if n >= fixe:
                    break
            elif fixe_h:
                steady = steady + 1 if near and n > 1 else 0
                if steady >= fixe_h:
                    break
            else:
                env = envelopes(t, mode, kind, extrema, count)
                if env is None or (near and _is_imf(mode, old, env[2], env[3])):
                    break
        if done:
            break
        modes.append(mode)
        rest = rest - mode
        if _finished(rest):
            break
    if not modes:
        return s[None, :]
    residue = s - np.sum(modes, axis=0)
    return np.array(modes + ([residue] if not np.allclose(residue, 0) else []))


def with_residue(modes: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(modes, residue): the residue is what the modes lack of s, or their last row (the trend) if they lack nothing."""
    rest = s - modes.sum(0)
    return (modes, rest) if not np.allclose(rest, 0) else (modes[:-1], modes[-1])


def noise(kind: str, scale: float, size: int, rng) -> np.ndarray:
    return rng.normal(0, scale, size) if kind == "normal" else rng.uniform(-scale, scale, size)


def trial(s: np.ndarray, number: int, seed: int, width: float = 0.05, distribution: str = "normal", max_imf: int = -1, **options) -> np.ndarray:
    """Modes of s with the noise of one trial; the noise depends on (seed, number) alone."""
    rng = np.random.default_rng((seed, number))
    return emd(s + noise(distribution, width * (s.max() - s.min()), len(s), rng), max_imf=max_imf, **options)


def ceemdan(s: np.ndarray, trials: int = 100, seed: int = 0, epsilon: float = 0.005, max_imf: int = -1, range_thr: float = 0.01, power_thr: float = 0.05, **options) -> np.ndarray:
    """Modes by complete ensemble EMD with adaptive noise; their sum is s.

    All modes of a trial's noise are divided by the deviation of its first. The first mode is the mean of the trials' first
    modes; each later one is what is left minus the mean of the trials' local means, so that the noise averages out.
    """
    scale = s.std() or 1.0
    x = s / scale
    noises = []
    for k in range(trials):
        parts = emd(np.random.default_rng((seed, k)).normal(0, 1, len(x)), **options)
        noises.append(parts / (parts[0].std() or 1.0))
    modes = [np.mean([emd(x + epsilon * n[0], max_imf=1, **options)[0] for n in noises], axis=0)]
    before = x - modes[0]
    while max_imf < 0 or len(modes) < max_imf:
        rest = x - np.sum(modes, axis=0)
        if np.ptp(rest) < range_thr or np.abs(rest).sum() < power_thr or len(emd(rest, max_imf=1, **options)) == 1:
            break
        beta, k = epsilon * before.std(), len(modes)
        local = np.mean([emd(before + beta * n[k] if len(n) > k else before, max_imf=1, **options)[-1] for n in noises], axis=0)
        modes.append(before - local)
        before = local
    return np.array([*modes, x - np.sum(modes, axis=0)]) * scale


def mean_period(mode: np.ndarray) -> float:
    """Length by the number of peaks that are not below nought; the whole length without any."""
    hi = natural_extrema(mode)[0]
    return len(mode) / max(1, int((mode[hi] >= 0).sum()))


def white_noise_check(modes: np.ndarray, test: str = "aposteriori", rescaling: int = 1, alpha: float = 0.95) -> dict[int, int]:
    """1 for each mode whose energy is not that of white noise of its period, else 0.

    apriori: the energy lies outside the two-sided spread. aposteriori: energies are moved so that the mode `rescaling`
    lies on its upper limit, which has half the spread there, and are above the upper limit after that.
    """
    from statistics import NormalDist

    n = modes.shape[1]
    log_t = np.log([mean_period(m) for m in modes])
    energy = np.log(np.maximum((modes**2).sum(axis=1) / n, 1e-300))
    unit = abs(NormalDist().inv_cdf((1 - alpha) / 2)) * math.sqrt(2 / n)
    spread = unit * np.exp(log_t / 2)
    if test == "apriori":
        out = np.abs(energy + log_t) > spread
    else:
        k = rescaling - 1
        limit = -log_t[k] + unit * math.exp(log_t[k]) / 2
        out = energy + (limit - energy[k]) > spread - log_t
    return {i + 1: int(v) for i, v in enumerate(out)}


def phase(mode: np.ndarray) -> np.ndarray:
    """Unwrapped phase of the analytic signal."""
    n = len(mode)
    f = np.fft.fft(mode)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.unwrap(np.angle(np.fft.ifft(f * h)))


def instantaneous_frequency(mode: np.ndarray, t: np.ndarray, order: bool = False, alpha: float | None = None) -> np.ndarray:
    """Derivative of the phase over 2 pi: differences (one fewer value), or sixth-order compact ones if order; alpha filters the phase."""
    p = phase(mode)
    if alpha is not None:
        p = filter6(p, alpha)
    step = t[1] - t[0]
    return pade6(p, step) / (2 * np.pi) if order else np.diff(p) / (2 * np.pi * step)


def pade6(v: np.ndarray, step: float) -> np.ndarray:
    """First derivative by the compact scheme of sixth order, of third and fourth at the ends."""
    n = len(v)
    a, b, c, r = np.full(n, 1 / 3), np.ones(n), np.full(n, 1 / 3), np.zeros(n)
    r[2:-2] = 14 / 9 * (v[3:-1] - v[1:-3]) / (2 * step) + 1 / 9 * (v[4:] - v[:-4]) / (4 * step)
    for i in (1, n - 2):
        a[i] = c[i] = 1 / 4
        r[i] = 3 / 2 * (v[i + 1] - v[i - 1]) / (2 * step)
    c[0], a[-1] = 2.0, 2.0
    r[0] = (-5 * v[0] + 4 * v[1] + v[2]) / (2 * step)
    r[-1] = (5 * v[-1] - 4 * v[-2] - v[-3]) / (2 * step)
    return solve_tridiagonal(a, b, c, r)


def filter6(v: np.ndarray, alpha: float) -> np.ndarray:
    """Compact low-pass filter of sixth order, -0.5 < alpha <= 0.5; the three values at each end stay."""
    n = len(v)
    a, b, c, r = np.full(n, alpha), np.ones(n), np.full(n, alpha), v.astype(float).copy()
    k = [11 / 16 + 5 * alpha / 8, 15 / 32 + 17 * alpha / 16, -3 / 16 + 3 * alpha / 8, 1 / 32 - alpha / 16]
    r[3:-3] = k[0] * v[3:-3] + sum(k[j] / 2 * (v[3 + j : n - 3 + j] + v[3 - j : n - 3 - j]) for j in (1, 2, 3))
    a[:3] = c[:3] = a[-3:] = c[-3:] = 0
    return solve_tridiagonal(a, b, c, r)


def emd2d(image: np.ndarray, max_imf: int = -1, mse: float = 0.01, mean: float = 0.01, passes: int = 20, radial: bool = False) -> np.ndarray:
    """Two-dimensional modes, the residue last. Envelopes are smooth surfaces through local extrema of the image tiled by mirrors 3 x 3.

    The surfaces are thin-plate splines on all extrema of all tiles (cubic radial functions if radial).
    """
    low, span = image.min(), (image.max() - image.min()) or 1.0
    rest, modes = (image - low) / span, []
    while max_imf < 0 or len(modes) < max_imf:
        mode, first = rest.copy(), True
        for _ in range(passes):
            found = _surface_extrema(mode)
            if any(len(p) < 4 for p in found):
                break
            top, bottom = (_surface(mode, p, radial) for p in found)
            middle = (top + bottom) / 2
            new = mode - middle
            stop = ((new - mode) ** 2).mean() < mse or abs(middle).mean() < mean
            mode, first = new, False
            if stop:
                break
        if first:
            break
        modes.append(mode)
        rest = rest - mode
        if rest.max() - rest.min() < 0.001:
            break
    out = [m * span for m in modes]
    return np.array([*out, image - (np.sum(out, axis=0) if out else 0)])


def _surface_extrema(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places higher, and lower, than all eight neighbours, on an image mirrored at its edges."""
    p = np.pad(z, 1, mode="reflect") if min(z.shape) > 1 else np.pad(z, 1, mode="edge")
    around = np.stack([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    return np.argwhere(z > around.max(0)), np.argwhere(z < around.min(0))


#: Knots up to which a surface is one dense system; above, it is solved by iterations that hold no matrix.
MAX_DENSE = 9000
#: Knots up to which that system is solved by least squares.
SMALL = 400
#: Kernels up to which a surface's values are summed one by one; above, they are one convolution of the image.
MAX_SUMMED = 50_000_000
#: Values of kernels held at a time, knots of a local solve, residual (relative) and steps at which the iterations end.
_HELD, _LOCAL, _RESIDUAL, _STEPS = 4_000_000, 60, 1e-8, 400


def _kernel(r: np.ndarray, radial: bool) -> np.ndarray:
    if radial:
        return r**3
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(r > 0, r * r * np.log(r), 0.0)


def _product(at: np.ndarray, c: np.ndarray, w: np.ndarray, radial: bool) -> np.ndarray:
    """Kernels between `at` and c times w, a block of rows at a time."""
    out, step = np.empty(len(at)), max(1, _HELD // len(c))
    for a in range(0, len(at), step):
        b = at[a : a + step]
        out[a : a + step] = _kernel(np.hypot(b[:, :1] - c[:, 0], b[:, 1:] - c[:, 1]), radial) @ w
    return out


def _smooth(n: int) -> int:
    """The least number from n on without prime factors above 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def _convolved(h: int, w: int, y: np.ndarray, x: np.ndarray, weights: np.ndarray, scale: float, radial: bool) -> np.ndarray:
    """Kernels between the places of an h x w image and knots at places of its 3 x 3 tiles times weights, by Fourier transforms.

    The knots' rows are taken in three bands of h, so that no array has more than some eight times the image's places.
    """
    tall, wide = _smooth(2 * h - 1), _smooth(4 * w - 3)
    j = np.arange(wide)
    dx = np.where(j < 2 * w - 1, j, j - wide) / scale
    total, step = np.zeros((tall, wide // 2 + 1), complex), max(1, _HELD // wide)
    for low in (1 - h, 1, h + 1):
        at = (y >= low) & (y < low + h)
        if not at.any():
            continue
        laid = np.zeros((tall, wide))
        np.add.at(laid, (y[at] - low, x[at] % wide), weights[at])
        band = np.fft.rfft2(laid)
        for a in range(0, tall, step):
            i = np.arange(a, min(a + step, tall))
            dy = (np.where(i < h, i, i - tall) - low) / scale
            laid[a : a + step] = _kernel(np.hypot(dy[:, None], dx), radial)
        band *= np.fft.rfft2(laid)
        total += band
    return np.fft.irfft2(total, (tall, wide))[:h, :w]


def _surface(z: np.ndarray, points: np.ndarray, radial: bool) -> np.ndarray:
    """The surface through every point of the image and of its eight mirrors."""
    h, w = z.shape
    tiles = [(points[:, 0] * a + b, points[:, 1] * c + d) for a, b in ((1, 0), (-1, 0), (-1, 2 * h - 2)) for c, d in ((1, 0), (-1, 0), (-1, 2 * w - 2))]
    y, x = np.concatenate([t[0] for t in tiles]), np.concatenate([t[1] for t in tiles])
    at = np.unique(np.stack([y, x], 1), axis=0, return_index=True)[1]
    scale = max(h, w)
    c, v = np.stack([y[at], x[at]], 1) / scale, np.tile(z[points[:, 0], points[:, 1]], 9)[at]
    gy, gx = np.mgrid[0:h, 0:w]
    if len(c) > SMALL and (plane := _plane(c, v)) is not None:
        return plane[0] + gy * (plane[1] / scale) + gx * (plane[2] / scale)
    weights, plane = (_dense if len(c) <= MAX_DENSE else _iterated)(c, v, radial)
    if h * w * len(c) > MAX_SUMMED:
        return _convolved(h, w, y[at], x[at], weights, scale, radial) + plane[0] + gy * (plane[1] / scale) + gx * (plane[2] / scale)
    g = np.stack([gy.ravel(), gx.ravel()], 1) / scale
    return (_product(g, c, weights, radial) + plane[0] + g @ plane[1:]).reshape(h, w)


def _plane(c: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """The plane through all knots, if their values are on one but for rounding: no weights then, whatever their number."""
    a = np.c_[np.ones(len(c)), c]
    plane = np.linalg.lstsq(a, v, rcond=None)[0]
    return plane if abs(a @ plane - v).max() <= 1e-12 * abs(v).max() else None


def _dense(c: np.ndarray, v: np.ndarray, radial: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the knots c and the plane beneath, by one dense system."""
    n = len(c)
    a = np.zeros((n + 3, n + 3))
    for b in range(0, n, step := max(1, _HELD // n)):
        a[b : min(b + step, n), :n] = _kernel(np.hypot(c[b : b + step, :1] - c[:, 0], c[b : b + step, 1:] - c[:, 1]), radial)
    a[:n, n], a[:n, n + 1 :] = 1, c
    a[n:, :n] = a[:n, n:].T
    a[np.arange(n + 3), np.arange(n + 3)] += 1e-10
    rhs = np.r_[v, np.zeros(3)]
    if n <= SMALL or np.linalg.matrix_rank(a[:n, n:]) < 3:  # knots on a line leave the plane open
        coef = np.linalg.lstsq(a, rhs, rcond=None)[0]
    else:
        coef = np.linalg.solve(a, rhs)
    return coef[:n], coef[n:]


def _iterated(c: np.ndarray, v: np.ndarray, radial: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same by restarted GMRES on the weights orthogonal to planes, with local cardinal functions to precondition."""
    n = len(c)
    q = np.linalg.qr(np.c_[np.ones(n), c])[0]
    free = lambda x: x - q @ (q.T @ x)
    near = _nearest(c, min(_LOCAL, n))
    cardinal = np.empty(near.shape)
    e = np.zeros(near.shape[1] + 3)
    e[0] = 1
    for i in range(n):
        m = c[near[i]]
        k = len(m)
        a = np.zeros((k + 3, k + 3))
        a[:k, :k], a[:k, k], a[:k, k + 1 :] = _kernel(np.hypot(m[:, :1] - m[:, 0], m[:, 1:] - m[:, 1]), radial), 1, m - m[0]
        a[k:, :k] = a[:k, k:].T
        cardinal[i] = np.linalg.lstsq(a, e, rcond=None)[0][:k]

    def ready(r: np.ndarray) -> np.ndarray:
        return free(np.bincount(near.ravel(), weights=(cardinal * r[:, None]).ravel(), minlength=n))

    x, goal, used = np.zeros(n), _RESIDUAL * (np.linalg.norm(free(v)) or 1.0), 0
    while True:
        r = free(v - _product(c, c, x, radial))
        beta = np.linalg.norm(r)
        if beta <= goal:
            break
        if used >= _STEPS:
            raise ArithmeticError(f"a surface through {n} extrema has residual {beta:g} after {used} steps")
        basis, solved, upper = [r / beta], [], np.zeros((41, 40))
        for k in range(40):
            solved.append(ready(basis[k]))
            w = free(_product(c, c, solved[k], radial))
            for _ in range(2):
                for j, b in enumerate(basis):
                    upper[j, k] += (d := b @ w)
                    w = w - d * b
            upper[k + 1, k] = np.linalg.norm(w)
            used += 1
            rhs = np.r_[beta, np.zeros(k + 1)]
            y = np.linalg.lstsq(upper[: k + 2, : k + 1], rhs, rcond=None)[0]
            if np.linalg.norm(upper[: k + 2, : k + 1] @ y - rhs) <= goal / 2 or upper[k + 1, k] == 0 or used >= _STEPS:
                break
            basis.append(w / upper[k + 1, k])
        x = x + np.array(solved).T @ y
    return x, np.linalg.lstsq(np.c_[np.ones(n), c], v - _product(c, c, x, radial), rcond=None)[0]


def _nearest(c: np.ndarray, k: int) -> np.ndarray:
    """Each knot's k nearest, itself first."""
    out, step = np.empty((len(c), k), np.int64), max(1, _HELD // len(c))
    for a in range(0, len(c), step):
        d = np.hypot(c[a : a + step, :1] - c[:, 0], c[a : a + step, 1:] - c[:, 1])
        d[np.arange(len(d)), np.arange(a, a + len(d))] = -1
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + step] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1), 1)
    return out
