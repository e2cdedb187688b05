"""A generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Each feature has a lookup table over its bins, and so has each chosen pair of features. Boosting
goes round the features again and again; each visit fits a tree of at most four leaves to the
gradient and adds a small step of it to the feature's table. When the features are done, the
pairs with the largest remaining gain get tables the same way. A score is a sum of lookups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 12
STEP, RIDGE, LEAF = 0.15, 2.0, 10


@dataclass
class Gam:
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row."""
        total = np.full(len(x), self.bias)
        for k, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cut, x[:, k], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut between bins; the place is 0 if there is none."""
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    left, right = slice(None, -1), slice(None, -1)
    gain = cg[left] ** 2 / (ch[left] + RIDGE) + (cg[-1] - cg[right]) ** 2 / (ch[-1] - ch[right] + RIDGE) - cg[-1] ** 2 / (ch[-1] + RIDGE)
    gain = np.where((cn[left] >= LEAF) & (cn[-1] - cn[right] >= LEAF), gain, -1.0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin."""
    _, cut = _best_cut(g, h, n) if depth and len(g) > 1 else (0.0, 0)
    if not cut:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each cell of a pair, by cuts along either feature."""
    rows, columns = (_best_cut(g.sum(k), h.sum(k), n.sum(k)) for k in (1, 0))
    out = np.full(g.shape, _leaf(g.sum(), h.sum()))
    if not depth or max(rows[0], columns[0]) <= 0:
        return out
    if rows[0] >= columns[0]:
        parts = (np.s_[:rows[1], :], np.s_[rows[1]:, :])
    else:
        parts = (np.s_[:, :columns[1]], np.s_[:, columns[1]:])
    for p in parts:
        out[p] = _pair_tree(g[p], h[p], n[p], depth - 1)
    return out


def _pair_gain(g: np.ndarray, h: np.ndarray) -> float:
    """What the cells explain beyond the two features by themselves."""
    return float((g**2 / (h + RIDGE)).sum() - max((g.sum(k) ** 2 / (h.sum(k) + RIDGE)).sum() for k in (0, 1)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit to rows ``x`` and labels 0 or 1; with no rows the score is one half."""
    width = x.shape[1]
    cuts = [_quantiles(x[:, k], BINS) if len(x) else np.zeros(0) for k in range(width)]
    coarse = [_quantiles(x[:, k], COARSE) if len(x) else np.zeros(0) for k in range(width)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(cuts, coarse, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    if not len(x):
        return model
    fine = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    total = np.full(len(x), model.bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = gradient()
            size = len(cuts[k]) + 1
            step = STEP * _tree(*(np.bincount(fine[k], w, size) for w in (g, h, np.ones(len(x)))))
            model.tables[k] += step
            total += step[fine[k]]
    g, h = gradient()
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            shape = len(coarse[a]) + 1, len(coarse[b]) + 1
            cell = rough[a] * shape[1] + rough[b]
            gains.append((_pair_gain(*(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h))), (a, b), cell, shape))
    gains.sort(key=lambda r: (-r[0], r[1]))
    chosen = gains[:PAIRS]
    model.pairs = [pair for _, pair, _, _ in chosen]
    model.pair_tables = [np.zeros(shape) for _, _, _, shape in chosen]
    for _ in range(PAIR_ROUNDS):
        for k, (_, _, cell, shape) in enumerate(chosen):
            g, h = gradient()
            step = STEP * _pair_tree(*(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(x)))))
            model.pair_tables[k] += step
            total += step.reshape(-1)[cell]
    return model
