"""Statistics of all pairs of a series in O(n log^2 n), numpy only: counts of rising and falling pairs, and the k-th slope.

Pairs are counted while a merge sort joins blocks: each value of a right block finds its place in the sorted left block.
A pair's slope is below t where the line x - t * place falls from its earlier to its later step, so slopes below t are
counted as falling pairs, and the slopes between two bounds are the pairs whose order the two lines have turned round.
The k-th slope is bracketed by random slopes until few are left, which are then listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Slopes that are listed at once; slopes drawn in each round; most rounds, after which all that are left are listed.
_LISTED, _DRAWN, _ROUNDS = 1 << 17, 1 << 15, 64


def ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks from 0; equal values share one."""
    return np.unique(x, return_inverse=True)[1].ravel().astype(np.int64)


def merges(r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level of a merge sort of ranks: places in left blocks, sorted; places in right blocks; and for each of the
    latter where in the former its block begins, its equals begin, and its equals end."""
    n = len(r)
    size = 1 << max(0, n - 1).bit_length()
    padded = np.full(size, r.max(initial=0) + 1)
    padded[:n] = r
    span, order, w = int(r.max(initial=0)) + 2, np.arange(size), 1
    while w < size:
        both = order.reshape(-1, 2, w)
        base = np.arange(len(both))[:, None] * span
        left, right = both[:, 0].ravel(), both[:, 1].ravel()
        keys, wanted = (padded[both[:, 0]] + base).ravel(), (padded[both[:, 1]] + base).ravel()
        real = right < n
        wanted, right = wanted[real], right[real]
        begin = np.repeat(np.arange(len(both)) * w, w)[real]
        yield left, right, begin, np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        order = order[np.argsort(padded[order] + np.repeat(np.arange(len(both)) * span, 2 * w), kind="stable")]
        w *= 2


def earlier(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many earlier ranks are below it, and how many above."""
    below, above = np.zeros(len(r), np.int64), np.arange(len(r), dtype=np.int64)
    for _, right, begin, low, high in merges(r):
        below[right] += low - begin
        above[right] -= high - begin
    return below, above


def _falling(r: np.ndarray) -> int:
    return int(earlier(r)[1].sum())


def trend_sum(x: np.ndarray) -> int:
    """Sum of the signs of later minus earlier values."""
    below, above = earlier(ranks(x))
    return int(below.sum() - above.sum())


def trend_variance(x: np.ndarray) -> float:
    """Variance of trend_sum without a trend, with its correction for ties."""
    n, ties = len(x), np.unique(x, return_counts=True)[1].astype(object)
    return float(n * (n - 1) * (2 * n + 5) - sum(ties * (ties - 1) * (2 * ties + 5))) / 18


def _turned(x: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the line at low, and in that order the ranks at high: slopes between are its falling pairs."""
    t = np.arange(len(x))
    order = np.argsort(x - low * t, kind="stable")
    return order, ranks(x - high * t)[order]


def slopes_between(x: np.ndarray, low: float, high: float, drawn: tuple[int, np.random.Generator] | None = None) -> np.ndarray:
    """All slopes of pairs between two bounds, or so many drawn from them."""
    order, r = _turned(x, low, high)
    levels = [(left, right, end, begin + (1 << k) - end) for k, (left, right, begin, _, end) in enumerate(merges(r))]
    if drawn:
        sums = [np.cumsum(k) for *_, k in levels]
        total = np.cumsum([s[-1] if len(s) else 0 for s in sums])
        picks = np.sort(drawn[1].integers(0, total[-1], drawn[0])) if total[-1] else np.zeros(0, np.int64)
    a, b = [], []
    for k, (left, right, start, count) in enumerate(levels):
        if drawn:
            mine = picks[(picks >= (total[k - 1] if k else 0)) & (picks < total[k])] - (total[k - 1] if k else 0)
            at = np.searchsorted(sums[k], mine, "right")
            within = mine - np.concatenate([[0], sums[k]])[at]
        else:
            at = np.repeat(np.arange(len(right)), count)
            within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        a.append(order[left[start[at] + within]])
        b.append(order[right[at]])
    i, j = np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)
    return (x[j] - x[i]) / (j - i)


def slopes_below(x: np.ndarray, t: float) -> int:
    return _falling(ranks(x - t * np.arange(len(x))))


def all_slopes(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(x), 1)
    return (x[j] - x[i]) / (j - i)


def kth_slope(x: np.ndarray, k: int, seed: int = 7) -> float:
    """The k-th smallest slope (from 0) of all pairs, to about 1e-15 of the values' range."""
    x = x - x.mean()
    n, rng = len(x), np.random.default_rng(seed)
    inside = n * (n - 1) // 2
    if inside <= _LISTED:
        return float(np.partition(all_slopes(x), k)[k])
    high, limit = 1.001 * np.ptp(x), max(_LISTED, 16 * n)  # no slope is steeper
    if not high:
        return 0.0
    low, below, whole = -high, 0, inside
    for _ in range(_ROUNDS):
        if inside <= limit:
            break
        if inside < whole:
            seen = slopes_between(x, low, high, (_DRAWN, rng))
        else:
            i, j = rng.integers(0, n, _DRAWN), rng.integers(0, n - 1, _DRAWN)
            j += j >= i
            seen = (x[j] - x[i]) / (j - i)
        seen.sort()
        at, band = (k - below) / inside * len(seen), 1 + 2 * np.sqrt(len(seen))
        a, b = seen[int(max(0, at - band))], seen[int(min(len(seen) - 1, at + band))]
        # Bounds lie between slopes: beside the drawn ones by far less than slopes differ, unless they are equal.
        steep = max(abs(a), abs(b))
        beside = max(1e-12 * steep, 8 * np.finfo(float).eps * (np.ptp(x) + steep * n))
        a, b = max(low, a - beside), min(high, b + beside)
        under, over = slopes_below(x, a), slopes_below(x, b)
        if k < under:
            high, inside = a, under - below
        elif k >= over:
            low, inside, below = b, below + inside - over, over
        else:
            low, high, inside, below = a, b, over - under, under
            if b - a <= 4 * beside:
                return float((a + b) / 2)
    found = slopes_between(x, low, high)
    at = min(max(k - below, 0), len(found) - 1)
    return float(np.partition(found, at)[at])


def sen_slope(x: np.ndarray) -> float:
    """Median of the slopes of all pairs, by place; NaN for fewer than two values."""
    n = len(x) * (len(x) - 1) // 2
    if not n:
        return float("nan")
    if n <= _LISTED:
        return float(np.median(all_slopes(x)))
    one = kth_slope(x, (n - 1) // 2)
    return one if n % 2 else (one + kth_slope(x, n // 2)) / 2


def prewhitened(x: np.ndarray) -> np.ndarray:
    """Trend-free pre-whitening: from the second value on. What is left of an exact line has no correlation."""
    trend = sen_slope(x) * np.arange(len(x))
    flat = x - trend
    c = flat - flat.mean()
    r = (c[1:] @ c[:-1]) / whole if (whole := c @ c) > 0 else 0.0
    return flat[1:] - r * flat[:-1] + trend[1:]


def forward(x: np.ndarray, textbook: bool = False) -> np.ndarray:
    """UF of the sequential Mann-Kendall test."""
    k = np.arange(1, len(x) + 1, dtype=np.float64)
    expected = k * (k - 1) / 4 if textbook else k * (k + 1) / 4
    s = np.cumsum(earlier(ranks(x))[0])
    spread = np.sqrt(k * (k - 1) * (2 * k + 5) / 72)
    return np.where(k == 1, 0.0, (s - expected) / np.where(k == 1, 1.0, spread))


def sequential(x: np.ndarray, textbook: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UF, and UB: minus that of the reversed series, reversed."""
    return forward(x, textbook), -forward(x[::-1], textbook)[::-1]


def crossings(uf: np.ndarray, ub: np.ndarray) -> np.ndarray:
    """Places at which UF - UB has changed its sign since the place before."""
    d = uf - ub
    return np.flatnonzero(d[1:] * d[:-1] < 0) + 1
