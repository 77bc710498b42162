"""An isolation forest small enough to be fitted anew for every source."""

from __future__ import annotations

import numpy as np

_EULER = 0.5772156649


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which a random search tree over ``n`` points separates one of them."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    out = 2 * (np.log(big - 1) + _EULER) - 2 * (big - 1) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random trees, each over its own points: ``points`` is (trees, points of a tree, features).

    All trees grow together, a level at a time. A split takes a feature with a chance in
    proportion to its extent in the node, and a uniform threshold within it. Every node
    keeps the box of its points, so that a row outside it is isolated there with the
    chance that a cut of the box, stretched to the row, would fall between the two; path
    lengths are expectations over such cuts. Hence a score grows with the distance from
    the points, also beyond the farthest of them.
    """

    def __init__(self, points: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.trees, psi, width = points.shape
        self.depth = max(1, int(np.ceil(np.log2(max(psi, 2)))))
        self.norm = max(float(mean_path(np.array(psi))), 1.0)
        expected = mean_path(np.arange(psi + 1)).astype(np.float32)
        flat = np.ascontiguousarray(points.reshape(-1, width), dtype=np.float32)
        cell = np.repeat(np.arange(self.trees), psi)
        at_point = np.arange(len(flat))
        self.levels = []
        for level in range(self.depth + 1):
            cells = self.trees << level
            size = np.bincount(cell, minlength=cells)
            order = np.argsort(cell.astype(np.uint16) if cells <= 1 << 16 else cell, kind="stable")
            filled = np.flatnonzero(size)
            begin = np.cumsum(size[filled]) - size[filled]
            sorted_points = flat[order]
            low, high = np.zeros((2, cells, width), dtype=np.float32)
            low[filled] = np.minimum.reduceat(sorted_points, begin, axis=0)
            high[filled] = np.maximum.reduceat(sorted_points, begin, axis=0)
            extent = high - low
            upto = np.cumsum(extent, axis=1)
            total = upto[:, -1]
            draw = rng.random((2, cells), dtype=np.float32)
            feature = np.minimum((upto <= (draw[0] * total)[:, None]).sum(axis=1), width - 1)
            every = np.arange(cells)
            cut = low[every, feature] + draw[1] * extent[every, feature]
            cut = np.minimum(cut, np.nextafter(high[every, feature], np.float32(-np.inf)))
            cut = np.where(total > 0, cut, np.float32(np.inf))
            self.levels.append((low, high, total, feature, cut, level + expected[size], total <= 0))
            cell = 2 * cell + (flat[at_point, feature[cell]] > cut[cell])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, in (0, 1); about 0.5 for rows among the points, more the earlier they are isolated."""
        n, width = x.shape
        rows = np.tile(np.ascontiguousarray(x, dtype=np.float32), (self.trees, 1))
        flat, at = rows.ravel(), np.arange(len(rows)) * width
        cell = np.repeat(np.arange(self.trees), n)
        left = np.ones(len(rows), dtype=np.float32)  # chance of not being isolated so far
        path = np.zeros(len(rows), dtype=np.float32)
        for level, (low, high, total, feature, cut, leaf, single) in enumerate(self.levels):
            beyond = (np.maximum(low[cell] - rows, 0) + np.maximum(rows - high[cell], 0)).sum(axis=1)
            chance = np.divide(beyond, beyond + total[cell], out=np.zeros_like(beyond), where=beyond > 0)
            path += left * chance * (level + 1)
            left *= 1 - chance
            ends = single[cell] if level < self.depth else True
            path += np.where(ends, left * leaf[cell], 0)
            left = np.where(ends, 0, left)
            cell = 2 * cell + (flat[at + feature[cell]] > cut[cell])
        return np.exp2(-path.reshape(self.trees, n).mean(axis=0) / self.norm)
