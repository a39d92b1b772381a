"""Boosted trees for two classes, fitted on rows wherever they are and small enough to send along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BINS = 32
#: ``grow`` adds up whole numbers of 1 / UNIT, so that the order of the rows does not matter.
UNIT = 2.0**20


@dataclass(frozen=True)
class Trees:
    """Complete trees of equal depth: node k has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def grow(
    summed: Callable, cuts: list[np.ndarray], trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0
) -> Trees:
    """Newton boosting of the logistic loss over histograms of quantile bins, on weighted rows that
    need not be in one place.

    ``summed(work)`` adds up what ``work(code, y, weight)`` returns for the parts of the rows, where
    ``code`` is ``codes(x, cuts)``.  It is called once, and once for each level of a tree.
    """
    width, inner = len(cuts), 2**depth - 1
    total, up = summed(lambda code, y, weight: np.array([weight.sum(), (weight * y).sum()]))
    share = min(max(up / total, 1e-4), 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    all_feature, all_cut, all_leaf = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    for _ in range(trees):
        before = Trees(base, all_feature, all_cut, all_leaf)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros((inner + 1, 2))
        for level in range(depth):
            first = 2**level - 1

            def sums(
                code: np.ndarray, y: np.ndarray, weight: np.ndarray, before: Trees = before, level: int = level,
                first: int = first, feature: np.ndarray = feature.copy(), cut: np.ndarray = cut.copy(),
            ) -> np.ndarray:
                p = 1 / (1 + np.exp(-before.margin(code)))
                node, rows = np.zeros(len(code), np.int64), np.arange(len(code))
                for _ in range(level):
                    node = 2 * node + 1 + (code[rows, feature[node]] > cut[node])
                at = (((node - first)[:, None] * width + np.arange(width)) * BINS + code).ravel()
                gh = (np.rint(weight * v * UNIT) for v in (p - y, np.maximum(p * (1 - p), 1e-6)))
                size = 2**level * width * BINS
                return np.stack([np.bincount(at, np.repeat(v, width), size) for v in gh]).reshape(2, 2**level, width, BINS)

            for n, (g, h) in enumerate(summed(sums).swapaxes(0, 1) / UNIT):
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g[0].sum(), h[0].sum()
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                left = (gt, ht)
                if gain[f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + n], cut[first + n] = f, b
                    left = (gl[f, b], hl[f, b])
                if level == depth - 1:
                    leaf[2 * n], leaf[2 * n + 1] = left, (gt - left[0], ht - left[1])
        all_feature, all_cut = np.vstack([all_feature, feature]), np.vstack([all_cut, cut])
        all_leaf = np.vstack([all_leaf, -rate * leaf[:, 0] / (leaf[:, 1] + ridge)])
    # From numbers of bins to values.
    for k, c in enumerate(cuts):
        mine = (all_feature == k) & np.isfinite(all_cut)
        all_cut[mine] = c[all_cut[mine].astype(np.int64)] if len(c) else np.inf
    return Trees(base, all_feature, all_cut, all_leaf)


def codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of the bin of each value."""
    return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1).astype(np.uint8)


def quantiles(values: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """As ``np.quantile`` of ``values`` that rise, each repeated as ``counts`` say."""
    ends = np.cumsum(counts)
    at = np.asarray(shares) * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, f(at), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression by accelerated descent."""
    n = max(len(x), 1)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    size = np.linalg.norm(x @ v) ** 2 / n / 4 + ridge
    w = z = np.zeros(x.shape[1], x.dtype)
    keep = np.append(np.full(x.shape[1] - 1, ridge), 1e-6).astype(x.dtype)
    y = y.astype(x.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - (x.T @ (p - y) / n + keep * z) / size
        z = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_line(s: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept that turn a score into calibrated log-odds (Platt's targets)."""
    s, y = np.asarray(s, float), np.asarray(y, float)
    n = np.ones(len(y)) if weight is None else weight
    up, down = (n * y).sum(), n.sum() - (n * y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    centre, scale = (s.mean(), s.std() or 1.0) if len(s) else (0.0, 1.0)
    if weight is not None and len(s):
        centre = np.average(s, weights=n)
        scale = np.sqrt(np.average((s - centre) ** 2, weights=n)) or 1.0
    x = np.stack([(s - centre) / scale, np.ones(len(s))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (n * (p - t)) + 1e-3 * w)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)
