"""Regression trees on binned columns: boosted with early stopping, or averaged as a forest (NumPy, for training sets that
fit a task). Splits are searched in histograms of at most BINS bins, all nodes of one depth together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

BINS = 64
#: Numbers that tasks which grow a tree together exchange at a time.
CELLS = 32_768

#: Adds up an array over the tasks that each hold a part of the rows, the same in each.
Add = Callable[[np.ndarray], np.ndarray]


@dataclass
class Tree:
    """Node arrays: split column (-1: a leaf), threshold (values at most go left), children, value."""

    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            c = self.column[at]
            inner = c >= 0
            if not inner.any():
                return self.value[at]
            v = x[rows, np.maximum(c, 0)]
            at = np.where(inner, np.where(v > self.threshold[at], self.right[at], self.left[at]), at)


@dataclass
class Trees:
    trees: list[Tree]
    start: float
    rate: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Inner edges of each column's bins: its distinct values if few, else quantiles."""
    out = []
    for c in x.T:
        u = np.unique(c[np.isfinite(c)])
        out.append((u[:-1] + u[1:]) / 2 if len(u) <= BINS else np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])))
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1) if x.size else np.zeros(x.shape, int)


def _alone(sums: np.ndarray) -> np.ndarray:
    return sums


def _histograms(bins: np.ndarray, columns: np.ndarray, local: np.ndarray, live: np.ndarray, slope: np.ndarray, weight: np.ndarray, nodes: int, n_bins: int, add: Add) -> Iterator[tuple[int, np.ndarray]]:
    """(column, (2, nodes, n_bins)): slopes and weights of every node's bins, added up for about CELLS numbers at a time."""
    step = max(1, CELLS // (2 * nodes * n_bins))
    for k in range(0, len(columns), step):
        keys = [local[live] * n_bins + bins[live, c] for c in columns[k : k + step]]
        sums = add(np.stack([[np.bincount(key, v[live], nodes * n_bins) for v in (slope, weight)] for key in keys]))
        yield from zip(columns[k : k + step], sums.reshape(len(keys), 2, nodes, n_bins))


def _tree(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, max_depth: int, columns: np.ndarray, reg_lambda: float, reg_alpha: float, min_weight: float, pick=None, add: Add = _alone) -> Tree:
    """One tree that lowers the squared error: slope is the weighted residual of each row, weight its weight. `add` adds up an
    array over the tasks that each hold a part of the rows."""
    shrink = lambda g: np.sign(g) * np.maximum(np.abs(g) - reg_alpha, 0)
    gain = lambda g, w: shrink(g) ** 2 / (w + reg_lambda + 1e-12)
    column, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
    node = np.zeros(len(bins), np.int64)
    level = [0]
    n_bins = max((len(e) for e in edges), default=0) + 1
    for depth in range(max_depth + 1):
        place = np.full(len(column), -1)
        place[level] = np.arange(len(level))
        local = place[node]
        live = (local >= 0) & (weight > 0)
        g, w = add(np.stack([np.bincount(local[live], v[live], len(level)) for v in (slope, weight)]))
        for k, name in enumerate(level):
            value[name] = float(shrink(g[k]) / (w[k] + reg_lambda + 1e-12))
        if depth == max_depth or n_bins < 2:
            break
        best = np.full(len(level), 1e-10)
        where = np.full((len(level), 2), -1)
        for c, (slopes, weights) in _histograms(bins, columns, local, live, slope, weight, len(level), n_bins, add):
            gl, wl = np.cumsum(slopes, 1)[:, :-1], np.cumsum(weights, 1)[:, :-1]
            gr, wr = g[:, None] - gl, w[:, None] - wl
            rise = np.where((wl >= min_weight) & (wr >= min_weight), gain(gl, wl) + gain(gr, wr) - gain(g, w)[:, None], -np.inf)
            if pick is not None:
                rise[~pick(len(level), c)] = -np.inf
            at = rise.argmax(1)
            top = rise[np.arange(len(level)), at]
            better = top > best
            best[better] = top[better]
            where[better] = np.stack([np.full(better.sum(), c), at[better]], 1)
        grown = []
        for k, name in enumerate(level):
            c, b = where[k]
            if c < 0:
                continue
            column[name], threshold[name] = int(c), float(edges[c][b]) if b < len(edges[c]) else math.inf
            left[name], right[name] = len(column), len(column) + 1
            grown += [len(column), len(column) + 1]
            for part in (column, threshold, left, right, value):
                part += [-1 if part is column else 0, -1 if part is column else 0]
        if not grown:
            break
        split = local >= 0
        split[split] = where[local[split], 0] >= 0
        c, b = where[local[split]].T
        names = np.array(level)[local[split]]
        node[split] = np.where(bins[split, c] > b, np.array(right)[names], np.array(left)[names])
        level = grown
    return Tree(np.array(column), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float))


def grow(x: np.ndarray, z: np.ndarray, trees: int, max_depth: int = 6, learning_rate: float = 0.1, min_child_weight: float = 1.0, subsample: float = 0.8, colsample: float = 0.8, reg_lambda: float = 1.0, reg_alpha: float = 0.0, seed: int = 0, watch: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 100) -> Trees:
    """Boosted trees for the squared error; with `watch`, growing stops after `patience` trees without a smaller error there,
    and the trees up to the smallest are kept."""
    rng = np.random.default_rng([seed, 5])
    k = max(1, round(colsample * x.shape[1]))
    draws = lambda _: ((rng.random(len(z)) < subsample).astype(float), np.sort(rng.choice(x.shape[1], k, replace=False)))
    return _boosted(x, z, bin_edges(x), float(z.mean()) if len(z) else 0.0, draws, trees, max_depth, learning_rate, min_child_weight, reg_lambda, reg_alpha, watch, patience, _alone)


def grow_together(x: np.ndarray, z: np.ndarray, ids: np.ndarray, edges: list[np.ndarray], add: Add, trees: int, max_depth: int = 6, learning_rate: float = 0.1, min_child_weight: float = 1.0, subsample: float = 0.8, colsample: float = 0.8, reg_lambda: float = 1.0, reg_alpha: float = 0.0, seed: int = 0, watch: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 100) -> Trees:
    """As `grow`, by tasks that each call it with their own part of the rows (and of `watch`) and add up histograms: every task
    gets the same trees. edges are those of all rows; a row's part in a tree is drawn from its id, wherever it lies."""
    rng = np.random.default_rng([seed, 5])
    k = max(1, round(colsample * x.shape[1]))
    total, n = add(np.array([z.sum(), len(z)]))
    draws = lambda tree: ((_uniform(ids, seed, tree) < subsample).astype(float), np.sort(rng.choice(x.shape[1], k, replace=False)))
    return _boosted(x, z, edges, float(total / max(n, 1)), draws, trees, max_depth, learning_rate, min_child_weight, reg_lambda, reg_alpha, watch, patience, add)


def _uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + (tree + 1) * 0x8CB92BA72F3D8DD7) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).astype(float) / 2.0**64


def _boosted(x: np.ndarray, z: np.ndarray, edges: list[np.ndarray], start: float, draws: Callable, trees: int, max_depth: int, learning_rate: float, min_child_weight: float, reg_lambda: float, reg_alpha: float, watch: tuple[np.ndarray, np.ndarray] | None, patience: int, add: Add) -> Trees:
    bins = _binned(x, edges)
    now, out = np.full(len(z), start), []
    seen = None if watch is None else np.full(len(watch[1]), start)
    best, kept = math.inf, 0
    for t in range(trees):
        weight, columns = draws(t)
        tree = _tree(bins, edges, weight * (z - now), weight, max_depth, columns, reg_lambda, reg_alpha, min_child_weight, add=add)
        out.append(tree)
        now = now + learning_rate * tree.predict(x)
        if watch is not None:
            seen = seen + learning_rate * tree.predict(watch[0])
            squares, n = add(np.array([((seen - watch[1]) ** 2).sum(), len(seen)]))
            error = float(squares / n)
            if error < best:
                best, kept = error, len(out)
            elif len(out) - kept >= patience:
                break
    return Trees(out if watch is None else out[: max(1, kept)], start, learning_rate)


def forest(x: np.ndarray, z: np.ndarray, trees: int = 200, max_features: float | str = 1.0, min_leaf: int = 1, max_depth: int = 16, seed: int = 0) -> Trees:
    """The mean of trees on bootstrap samples; each node may split a random part of the columns."""
    rng = np.random.default_rng([seed, 6])
    edges = bin_edges(x)
    bins = _binned(x, edges)
    d = x.shape[1]
    share = (math.isqrt(d) / d) if max_features == "sqrt" else float(max_features)
    start = float(z.mean()) if len(z) else 0.0
    out = []
    for _ in range(trees):
        weight = np.bincount(rng.integers(0, len(z), len(z)), minlength=len(z)).astype(float)
        pick = None if share >= 1 else lambda nodes, c: rng.random(nodes) < share
        out.append(_tree(bins, edges, weight * (z - start), weight, max_depth, np.arange(d), 0.0, 0.0, float(min_leaf), pick))
    return Trees(out, start, 1 / max(1, trees))
