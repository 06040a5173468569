"""Linear support vector machines by dual coordinate descent, for small training sets in numpy."""

from __future__ import annotations

import numpy as np


def hinge_dual(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_features: int, c: float = 1.0, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + c * sum of hinge losses. ``rows`` hold (features, values); a feature is at most once in a row. ``y`` is -1 or 1."""
    w = np.zeros(n_features)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if not square[i]:
                continue
            at, x = rows[i]
            g = y[i] * float(w[at] @ x) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= c else g
            if abs(projected) < 1e-12:
                continue
            worst = max(worst, abs(projected))
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            w[at] += (new - alpha[i]) * y[i] * x
            alpha[i] = new
        if worst < tolerance:
            break
    return w
