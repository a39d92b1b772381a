"""Single-machine answers to compare with."""

from __future__ import annotations

import numpy as np


def newton(x, y, w=None):
    """Logistic fit with a constant: coefficients, standard errors, log-likelihood."""
    w = np.ones(len(y)) if w is None else w
    x = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (w * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(h, x.T @ (w * (y - p)))
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    p = 1 / (1 + np.exp(-x @ b))
    ll = float((w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return b, np.sqrt(np.diag(np.linalg.inv(h))), ll


def auc(yes, score):
    """Mann-Whitney statistic with middle ranks."""
    ranks = score.rank()
    n1, n0 = (yes == 1).sum(), (yes == 0).sum()
    return (ranks[yes == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
