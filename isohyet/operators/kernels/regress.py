"""Regressions of statistical downscaling: forward selection with least squares, a multilayer perceptron, boosted trees with Shapley values."""

from __future__ import annotations

import math

import numpy as np


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept first, a column for each column of y."""
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def cv_error(x: np.ndarray, y: np.ndarray, folds: int = 5) -> float:
    """Mean squared error over contiguous folds."""
    loss, parts = 0.0, np.array_split(np.arange(len(x)), min(folds, len(x)))
    for test in parts:
        train = np.ones(len(x), bool)
        train[test] = False
        if train.sum() < 2:
            continue
        c = least_squares(x[train], y[train])
        loss += ((np.column_stack([np.ones(len(test)), x[test]]) @ c - y[test]) ** 2).mean() / len(parts)
    return float(loss)


def forward_selection(x: np.ndarray, y: np.ndarray, most: int, folds: int = 5) -> list[int]:
    """Columns in the order that lowers the error most, up to `most`; it stops where none lowers it."""
    chosen: list[int] = []
    best = math.inf
    while len(chosen) < min(most, x.shape[1]):
        scores = {j: cv_error(x[:, [*chosen, j]], y, folds) for j in range(x.shape[1]) if j not in chosen}
        j = min(scores, key=scores.get)
        if scores[j] >= best:
            break
        best = scores[j]
        chosen.append(j)
    return chosen


class Perceptron:
    """Rectified layers trained by Adam on squared error, stopping when the loss has not fallen by tol for `patience` epochs."""

    def __init__(self, layers: tuple[int, ...] = (500, 500, 250), epochs: int = 200, rate: float = 0.001, batch: int = 200, tol: float = 1e-4, patience: int = 10, seed: int = 0):
        self.layers, self.epochs, self.rate, self.batch, self.tol, self.patience, self.seed = layers, epochs, rate, batch, tol, patience, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Perceptron:
        y = y.reshape(len(y), -1)
        rng, sizes = np.random.default_rng(self.seed), [x.shape[1], *self.layers, y.shape[1]]
        self.w = [rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        params = [*self.w, *self.b]
        m, v, t, best, calm = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, math.inf, 0
        for _ in range(self.epochs):
            order, loss = rng.permutation(len(x)), 0.0
            for s in range(0, len(x), self.batch):
                at = order[s : s + self.batch]
                acts = [x[at]]
                for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
                    z = acts[-1] @ w + b
                    acts.append(np.maximum(z, 0) if i < len(self.w) - 1 else z)
                d = (acts[-1] - y[at]) / len(at)
                loss += ((acts[-1] - y[at]) ** 2).sum() / 2
                gw, gb = [None] * len(self.w), [None] * len(self.w)
                for i in range(len(self.w) - 1, -1, -1):
                    gw[i], gb[i] = acts[i].T @ d + 1e-4 * self.w[i] / len(at), d.sum(0)
                    d = (d @ self.w[i].T) * (acts[i] > 0)
                t += 1
                for k, g in enumerate([*gw, *gb]):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            loss /= len(x)
            calm = 0 if loss < best - self.tol else calm + 1
            best = min(best, loss)
            if calm >= self.patience:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0)
        return x


class BoostedTrees:
    """Gradient boosting of shallow squared-error trees, with Shapley values by the paths through each tree."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.1, least: int = 5):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base, self.forest = float(y.mean()), []
        now = np.full(len(y), self.base)
        for _ in range(self.trees):
            tree = self._grow(x, y - now, self.depth)
            self.forest.append(tree)
            now = now + self.rate * _tree_values(tree, x)
        return self

    def _grow(self, x, r, depth):
        leaf = {"value": float(r.mean()), "n": len(r)}
        if depth == 0 or len(r) < 2 * self.least:
            return leaf
        best = (1e-12, None, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, c = x[order, j], np.cumsum(r[order])
            n = np.arange(1, len(r))
            gain = c[:-1] ** 2 / n + (c[-1] - c[:-1]) ** 2 / (len(r) - n) - c[-1] ** 2 / len(r)
            gain[(v[1:] == v[:-1]) | (n < self.least) | (len(r) - n < self.least)] = -1
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (gain[k], j, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return leaf | {"feature": best[1], "cut": best[2], "left": self._grow(x[left], r[left], depth - 1), "right": self._grow(x[~left], r[~left], depth - 1)}

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(_tree_values(t, x) for t in self.forest)

    def shap(self, x: np.ndarray) -> np.ndarray:
        """Shapley values [rows, columns]; with the base they add up to the prediction but for the trees' mean values."""
        out = np.zeros(x.shape)
        for tree in self.forest:
            used = sorted(_features(tree))
            for i in range(len(used)):
                for mask in range(1 << len(used)):
                    if mask >> i & 1:
                        continue
                    known = {f for k, f in enumerate(used) if mask >> k & 1}
                    s, p = len(known), len(used)
                    weight = math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p)
                    out[:, used[i]] += self.rate * weight * (_expected(tree, x, known | {used[i]}) - _expected(tree, x, known))
        return out


def _tree_values(t: dict, x: np.ndarray) -> np.ndarray:
    return _expected(t, x, None)


def _features(t: dict) -> set[int]:
    return {t["feature"], *_features(t["left"]), *_features(t["right"])} if "feature" in t else set()


def _expected(t: dict, x: np.ndarray, known: set[int] | None) -> np.ndarray:
    """Mean of the tree at rows of which only the known columns count; all if known is None."""
    if "feature" not in t:
        return np.full(len(x), t["value"])
    left, right = _expected(t["left"], x, known), _expected(t["right"], x, known)
    if known is None or t["feature"] in known:
        return np.where(x[:, t["feature"]] <= t["cut"], left, right)
    return (left * t["left"]["n"] + right * t["right"]["n"]) / t["n"]
