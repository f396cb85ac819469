"""Linear algebra over tables too large for one task: reductions and ridge from one pass of sums; kernels in grouped tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: list[str], y: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, matrix of products) of the columns and y: each task adds up its batches, the driver adds one matrix a task.

    Rows with a null or NaN take no part.
    """
    names = [*columns, y]
    d = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.zeros((0, d))
            x = x[np.isfinite(x).all(1)]
            n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([m.ravel().tolist()])], ["n", "s", "m"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "n double, s array<double>, m array<double>")
    # one array a task, added position by position on the cluster
    flat = parts.select(F.posexplode(F.concat(F.array("n"), "s", "m")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    cells = np.zeros(1 + d + d * d)
    for r in flat.collect():
        cells[r.k] = r.v
    return int(cells[0]), cells[1 : 1 + d], cells[1 + d :].reshape(d, d)


def _centred(n: int, s: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = s / max(n, 1)
    return mean, m - n * np.outer(mean, mean)


def fit_ridge(df: DataFrame, columns: list[str], y: str, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of min |y - Xw - b|^2 + alpha |w|^2, the intercept free; alpha 0 is least squares."""
    mean, c = _centred(*gram(df, columns, y))
    a = c[:-1, :-1] + alpha * np.eye(len(columns))
    w = np.linalg.lstsq(a, c[:-1, -1], rcond=None)[0] if alpha == 0 else np.linalg.solve(a, c[:-1, -1])
    return w, float(mean[-1] - mean[:-1] @ w)


def ridge_path(df: DataFrame, columns: list[str], y: str, alphas: list[float]) -> list[tuple[float, np.ndarray, float, float]]:
    """(alpha, coefficients, intercept, effective degrees of freedom) for every penalty from one eigendecomposition."""
    mean, c = _centred(*gram(df, columns, y))
    l, v = np.linalg.eigh(c[:-1, :-1])
    l = np.maximum(l, 0)
    b = v.T @ c[:-1, -1]
    out = []
    for alpha in alphas:
        w = v @ (b / np.maximum(l + alpha, 1e-300))
        out.append((alpha, w, float(mean[-1] - mean[:-1] @ w), float(1 + (l / np.maximum(l + alpha, 1e-300)).sum())))
    return out


def linear(columns: list[str], w: np.ndarray, b: float) -> Column:
    out = F.lit(float(b))
    for c, v in zip(columns, w):
        out = out + F.col(c) * F.lit(float(v))
    return out


def pca(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, components (d, k), population variances); each component's largest weight is positive."""
    first = columns[0]
    n, s, m = gram(df.withColumn("_y", F.col(first)), columns, "_y")
    mean, c = _centred(n, s, m)
    l, v = np.linalg.eigh(c[:-1, :-1] / max(n, 1))
    order = np.argsort(-l)[:k]
    v = v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return mean[:-1], v, l[order]


def pls(df: DataFrame, columns: list[str], y: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, rotation (d, k)) of partial least squares scores, from the products alone: weights follow the covariance with
    y, each found direction is deflated from both."""
    n, s, m = gram(df, columns, y)
    mean, c = _centred(n, s, m)
    xx, xy = c[:-1, :-1].copy(), c[:-1, -1].copy()
    k = min(k, len(columns), max(n - 1, 1))
    weights, loadings = [], []
    for _ in range(k):
        size = np.linalg.norm(xy)
        if size < 1e-12:
            break
        w = xy / size
        tt = w @ xx @ w
        p = xx @ w / tt
        q = xy @ w / tt
        xx = xx - tt * np.outer(p, p)
        xy = xy - tt * q * p
        weights.append(w)
        loadings.append(p)
    w, p = np.array(weights).T, np.array(loadings).T
    return mean[:-1], w @ np.linalg.inv(p.T @ w)


def project(df: DataFrame, columns: list[str], means: np.ndarray, rotation: np.ndarray, prefix: str = "z") -> DataFrame:
    """Scores as new columns; a narrow projection."""
    out = {}
    for j in range(rotation.shape[1]):
        out[f"{prefix}{j}"] = linear(columns, rotation[:, j], float(-means @ rotation[:, j]))
    return df.withColumns(out)


# kernel ridge on training sets that fit a task (the sizes of an experiment, not of the table)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(square, 0))


def kernel_ridge(k: np.ndarray, y: np.ndarray, alphas: list[float]) -> np.ndarray:
    """Dual coefficients (alphas, n) for a centred target from one eigendecomposition."""
    l, v = np.linalg.eigh((k + k.T) / 2)
    b = v.T @ y
    return np.stack([v @ (b / (l + a)) for a in alphas])


def rbf_grid(d: int) -> list[float]:
    """Eleven widths around 1/d."""
    return (np.logspace(-3, 2, 11) / d).tolist()


# Penalties of ridge and kernel ridge.
RIDGE_ALPHAS = [float(a) for a in np.logspace(-4, 3, 15)]
KRR_ALPHAS = [float(a) for a in np.logspace(-6, 1, 8)]


def one_standard_error(curve: DataFrame, k: str, mean: str, se: str) -> DataFrame:
    """The row with the smallest k whose mean is at most the smallest mean plus its standard error."""
    best = curve.where(F.col(mean).isNotNull()).orderBy(mean, k).limit(1).select((F.col(mean) + F.col(se)).alias("_bar"))
    return curve.join(F.broadcast(best)).where(F.col(mean) <= F.col("_bar")).orderBy(k).limit(1).drop("_bar")


def permutation_importance(df: DataFrame, features: list[str], w: np.ndarray, b: float, y: str, repeats: int = 3, seed: int = 0) -> DataFrame:
    """(feature, rise): rise of the mean absolute error of a linear model when a feature's values change places.

    Values change places by rank: the k-th row in one hashed order gets the value of the k-th row in another, so each
    repeat is a one-to-one shuffle. All features share the two orders of a repeat.
    """
    from tessera.operators.splits import draw, hashed_rank

    base = F.abs(linear(features, w, b) - F.col(y))
    out = None
    for r in range(repeats):
        left = hashed_rank(df.select("id", *features, y), draw(f"{seed}:{r}:a", "id"), "_n")
        right = hashed_rank(df.select("id", *[F.col(f).alias(f"_{f}") for f in features]), draw(f"{seed}:{r}:b", "id"), "_n").drop("id")
        both = left.join(right, "_n")
        cells = [F.avg(F.abs(linear(features, w, b) + float(w[k]) * (F.col(f"_{f}") - F.col(f)) - F.col(y)) - base).alias(f) for k, f in enumerate(features)]
        part = both.agg(*cells)
        out = part if out is None else out.unionByName(part)
    long = out.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("rise")) for f in features])).alias("e")).select("e.*")
    return long.groupBy("feature").agg(F.avg("rise").alias("rise"))
