"""Recipes whose fit needs only sums over the training rows: mean, least squares and ridge on scaled, reduced columns, for
training sets of any size. Two passes of sums fit all folds; the driver solves systems of as many columns as there are features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What these fits know; the rest needs its training rows in one place.
MODELS, SCALINGS, REDUCTIONS = ("mean", "linear", "ridge"), ("standard", "none"), ("pca", "pls")

_FORWARD = {"standard": lambda c: c, "sqrt": F.sqrt, "log1p": F.log1p}


def knows(recipe) -> bool:
    return recipe.model in MODELS and recipe.scaling in SCALINGS and recipe.target in _FORWARD and (recipe.reduction is None or recipe.reduction[0] in REDUCTIONS)


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names], 1) if batch.num_rows else np.zeros((0, len(names)))


def _first_moments(rows: DataFrame, features: list[str], y: str, targets: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By fold: (count, means, population variances) of the features and each transformed target."""
    cells = {c: F.col(c) for c in features} | {f"_{t}": _FORWARD[t](F.col(y)) for t in targets}
    found = rows.groupBy("fold").agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{k}") for k, c in enumerate(cells.values())], *[F.var_pop(c).alias(f"_v{k}") for k, c in enumerate(cells.values())]).collect()
    values = lambda r, name: np.array([r[f"{name}{k}"] for k in range(len(cells))], float)
    return {r.fold: (float(r._n), values(r, "_m"), values(r, "_v")) for r in found}


def fit_folds(rows: DataFrame, recipes: dict, features: list[str], y: str) -> dict[tuple[str, int], object]:
    """{(name, fold): pipelines.Fitted} on all rows of the other folds. rows: fold, features and y as doubles, no nulls;
    recipes: {name: (recipe, candidates)}."""
    from tessera.operators.pipelines import TARGETS, Fitted, _spread

    targets = sorted({r.target for r, _ in recipes.values()})
    kinds = sorted({(r.scaling, r.target) for r, _ in recipes.values()})
    moments = _first_moments(rows, features, y, targets)
    folds, d = sorted(moments), len(features)
    start: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for f in folds:
        others = [moments[g] for g in folds if g != f]
        if not others:
            raise ValueError("there is only one fold")
        n = sum(o[0] for o in others)
        mean = sum(o[0] * o[1] for o in others) / n
        start[f] = mean, np.sqrt(sum(o[0] * (o[2] + (o[1] - mean) ** 2) for o in others) / n)

    def scaler(kind: tuple[str, str], f: int):
        mean, spread = start[f][0][:d], _spread(start[f][1][:d])
        return (lambda v: np.clip((v - mean) / spread, -10, 10)) if kind[0] == "standard" else (lambda v: v - mean)

    def target(kind: tuple[str, str], f: int) -> tuple[float, float]:
        k = d + targets.index(kind[1])
        return float(start[f][0][k]), float(_spread(start[f][1][k]))

    prefixes = {(k, f): scaler(kind, f) for k, kind in enumerate(kinds) for f in folds}
    scales = {(k, f): target(kind, f) for k, kind in enumerate(kinds) for f in folds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros((d + 2, d + 2)) for key in prefixes}
        for batch in batches:
            x, t, fold = matrix(batch, features), batch.column(y).to_numpy(), batch.column("fold").to_numpy()
            for (k, f), scale in prefixes.items():
                own = fold != f
                centre, spread = scales[k, f]
                z = (TARGETS[kinds[k][1]][0](t[own]) - centre) / spread
                a = np.column_stack([np.ones(own.sum()), scale(x[own]), z])
                sums[k, f] += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array([key[0] for key in sums], pa.int32()), pa.array([key[1] for key in sums], pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["k", "f", "s"])

    parts = rows.select("fold", *features, y).mapInArrow(run, "k int, f int, s array<double>")
    cells = parts.select("k", "f", F.posexplode("s").alias("at", "v")).groupBy("k", "f", "at").agg(F.sum("v").alias("v"))
    sums = {key: np.zeros((d + 2) ** 2) for key in prefixes}
    for r in cells.collect():
        sums[r.k, r.f][r.at] = r.v
    out = {}
    for name, (recipe, grid) in recipes.items():
        k = kinds.index((recipe.scaling, recipe.target))
        candidates = [dict(recipe.settings) | c for c in (grid or [{}])]
        for f in folds:
            out[name, f] = Fitted(recipe, candidates, prefixes[k, f], _solved(sums[k, f].reshape(d + 2, d + 2), recipe, candidates), *scales[k, f])
    return out


def _solved(s: np.ndarray, recipe, candidates: list[dict]):
    """The model on scaled columns from the sums of products of (1, columns, target)."""
    from tessera.operators.pipelines import _spread

    n, mean, m = s[0, 0], s[0, 1:-1] / s[0, 0], s[0, -1] / s[0, 0]
    xx, xy = s[1:-1, 1:-1] - n * np.outer(mean, mean), s[1:-1, -1] - n * mean * m
    turn = np.eye(len(mean)) if recipe.reduction is None else _turn(n, xx, xy, *recipe.reduction)
    if recipe.reduction is not None:
        turn = turn / _spread(np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, xx, turn), 0) / n))
    l, v = np.linalg.eigh(turn.T @ xx @ turn)
    l, b = np.maximum(l, 0), v.T @ (turn.T @ xy)
    weights = []
    for c in candidates:
        alpha = {"linear": 0.0, "mean": None}.get(recipe.model, c.get("alpha", 1.0))
        keep = np.zeros(len(l), bool) if alpha is None else l > l.max(initial=0) * 1e-13 if alpha == 0 else l + alpha > 0
        weights.append(turn @ v @ np.divide(b, l + (alpha or 0.0), out=np.zeros(len(l)), where=keep))
    w = np.array(weights).T
    return lambda x: m + (x - mean) @ w


def _turn(n: float, xx: np.ndarray, xy: np.ndarray, name: str, k: int) -> np.ndarray:
    """Columns to reduced columns, as pipelines.REDUCERS does it from rows."""
    if name == "pca":
        return np.linalg.eigh(xx)[1][:, ::-1][:, :k]
    xx, xy = xx.copy(), xy.copy()
    weights, loads = [], []
    for _ in range(min(k, len(xx), int(n) - 1)):
        size = np.linalg.norm(xy)
        if size < 1e-12:
            break
        w = xy / size
        tt = w @ xx @ w
        load, share = xx @ w / tt, xy @ w / tt
        xx, xy = xx - tt * np.outer(load, load), xy - tt * share * load
        weights.append(w)
        loads.append(load)
    if not weights:
        return np.zeros((len(xx), 1))
    w, p = np.array(weights).T, np.array(loads).T
    return w @ np.linalg.inv(p.T @ w)


def out_of_fold(rows: DataFrame, fitted: dict, features: list[str], y: str) -> DataFrame:
    """(recipe, candidate, id, fold, pred, y) of every validated row, a narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, f, at, pred in _predicted(batch, fitted, features):
                part = batch.take(pa.array(at))
                for c in range(pred.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), c, np.int32)), part.column("id"), part.column("fold"), pa.array(pred[:, c]), part.column(y)], ["recipe", "candidate", "id", "fold", "pred", "y"])

    return rows.mapInArrow(run, "recipe string, candidate int, id bigint, fold int, pred double, y double")


def _predicted(batch: pa.RecordBatch, fitted: dict, features: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(recipe, fold, rows, predictions) of a batch's validated rows."""
    x, fold = matrix(batch, features), batch.column("fold").to_numpy()
    for f in np.unique(fold[fold >= 0]):
        at = np.flatnonzero(fold == f)
        for name in dict.fromkeys(key[0] for key in fitted):
            yield name, int(f), at, fitted[name, f].predict(x[at])


def errors_by_fold(rows: DataFrame, fitted: dict, features: list[str], y: str) -> DataFrame:
    """(recipe, candidate, fold, n, a, s): count, absolute and squared errors, added up within the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            t = batch.column(y).to_numpy()
            for name, f, at, pred in _predicted(batch, fitted, features):
                e = pred - t[at][:, None]
                n, a, s = sums.get((name, f), (0, 0.0, 0.0))
                sums[name, f] = n + len(at), a + np.abs(e).sum(0), s + (e * e).sum(0)
        out = [(name, c, f, n, float(a[c]), float(s[c])) for (name, f), (n, a, s) in sums.items() for c in range(len(a))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], ["recipe", "candidate", "fold", "n", "a", "s"])

    parts = rows.mapInArrow(run, "recipe string, candidate int, fold int, n bigint, a double, s double")
    return parts.groupBy("recipe", "candidate", "fold").agg(*[F.sum(c).alias(c) for c in "nas"])


def permuted_errors(rows: DataFrame, fitted: dict, features: list[str], y: str, repeats: int, seed: int) -> DataFrame:
    """(feature, fold, repeat, rise) of permutation_importance_cv: within a fold, the k-th row in one hashed order gets the
    value of the k-th row in another; the features share the two orders of a repeat."""
    from tessera.operators.splits import draw, hashed_rank

    moved = [f"_p{k}" for k in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            x, p, t = matrix(batch, features), matrix(batch, moved), batch.column(y).to_numpy()
            fold, repeat = batch.column("fold").to_numpy(), batch.column("repeat").to_numpy()
            for f, r in {*zip(fold.tolist(), repeat.tolist())}:
                at = np.flatnonzero((fold == f) & (repeat == r))
                error = lambda v, f=f, at=at: np.abs(fitted["own", f].predict(v)[:, 0] - t[at])
                base, rises = error(x[at]), np.zeros(len(features))
                for j in range(len(features)):
                    v = x[at].copy()
                    v[:, j] = p[at, j]
                    rises[j] = (error(v) - base).sum()
                n, s = sums.get((f, r), (0, 0.0))
                sums[f, r] = n + len(at), s + rises
        out = [(features[j], f, r, n, float(s[j])) for (f, r), (n, s) in sums.items() for j in range(len(features))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()))], ["feature", "fold", "repeat", "n", "s"])

    both = None
    for r in range(repeats):
        left = hashed_rank(rows, draw(f"{seed}:{r}:a", "id"), "_k", ["fold"])
        right = hashed_rank(rows.select("id", "fold", *[F.col(c).alias(p) for c, p in zip(features, moved)]), draw(f"{seed}:{r}:b", "id"), "_k", ["fold"]).drop("id")
        part = left.join(right, ["fold", "_k"]).select("fold", F.lit(r).alias("repeat"), *features, *moved, y)
        both = part if both is None else both.unionByName(part)
    parts = both.mapInArrow(run, "feature string, fold int, repeat int, n bigint, s double")
    return parts.groupBy("feature", "fold", "repeat").agg((F.sum("s") / F.sum("n")).alias("rise"))
