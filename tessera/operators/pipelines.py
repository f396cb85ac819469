"""Pipelines of scaling, reduction and model with a transformed target, as recipes that job tables fit.

A recipe is data: names and settings. Everything that is fitted sees the training rows of its fold only. Training sets are of
stated size: they are counted, and refused beyond MAX_ROWS, before they are sent to the tasks once; a job table (recipe, fold)
is then one plan, however many recipes, folds and candidates there are. Prediction on tables of any size is a narrow stage.
"""

from __future__ import annotations

import itertools
import json
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import boosting, summed
from tessera.operators.linear import KRR_ALPHAS, RIDGE_ALPHAS, rbf_grid
from tessera.operators.quantum import default_qubits, gamma_grid
from tessera.operators.statistics import mutual_information
from tessera.plans.lineage import cut

#: Rows, and numbers, that a training set may have.
MAX_ROWS, MAX_CELLS = 200_000, 50_000_000
#: Bytes of fitted models that are sent to the rows at a time.
SENT = 1 << 26

Apply = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Recipe:
    """scaling: a name of SCALERS; reduction: (a name of REDUCERS, k) or None; model: a name of MODELS; target: a name of TARGETS."""

    model: str
    scaling: str = "standard"
    reduction: tuple[str, int] | None = None
    target: str = "standard"
    settings: tuple[tuple[str, object], ...] = ()

    def with_settings(self, **more) -> Recipe:
        return replace(self, settings=tuple(sorted({**dict(self.settings), **more}.items())))

    def describe(self) -> dict:
        return asdict(self) | {"settings": dict(self.settings)}


# scalings: training columns to a function of columns


def _spread(s: np.ndarray) -> np.ndarray:
    return np.where(s > 1e-300, s, 1.0)


def _clipped(centre: np.ndarray, spread: np.ndarray, before: Apply = lambda v: v) -> Apply:
    return lambda v: np.clip((before(v) - centre) / spread, -10, 10)


def _standard(x: np.ndarray) -> Apply:
    return _clipped(x.mean(0), _spread(x.std(0)))


def _robust(x: np.ndarray) -> Apply:
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    return _clipped(middle, _spread(high - low))


def _log_standard(x: np.ndarray) -> Apply:
    c = x - x.mean(0)
    skew = np.abs((c**3).mean(0) / _spread(x.std(0)) ** 3) > 1.0
    bend = lambda v: np.where(skew, np.sign(v) * np.log1p(np.abs(v)), v)
    return _clipped(bend(x).mean(0), _spread(bend(x).std(0)), bend)


#: Scalings by name, clipped at +-10.
SCALERS: dict[str, Callable[[np.ndarray], Apply]] = {"standard": _standard, "robust": _robust, "log_standard": _log_standard, "none": lambda x: lambda v: v}


# reductions: scaled training columns and target to a function of columns


def _pca(x: np.ndarray, z: np.ndarray, k: int) -> Apply:
    mean = x.mean(0)
    _, _, rows = np.linalg.svd(x - mean, full_matrices=False)
    return lambda v: (v - mean) @ rows[:k].T


def _pls(x: np.ndarray, z: np.ndarray, k: int) -> Apply:
    mean, rest, left = x.mean(0), x - x.mean(0), z - z.mean()
    weights, loads = [], []
    for _ in range(min(k, x.shape[1], len(x) - 1)):
        w = rest.T @ left
        if np.linalg.norm(w) < 1e-12:
            break
        w = w / np.linalg.norm(w)
        t = rest @ w
        load = rest.T @ t / (t @ t)
        left = left - t * (left @ t) / (t @ t)
        rest = rest - np.outer(t, load)
        weights.append(w)
        loads.append(load)
    if not weights:
        return lambda v: np.zeros((len(v), 1))
    w, p = np.array(weights).T, np.array(loads).T
    turn = w @ np.linalg.inv(p.T @ w)
    return lambda v: (v - mean) @ turn


def _kbest(x: np.ndarray, z: np.ndarray, k: int) -> Apply:
    """The k columns with the largest mutual information with the target, in their own order; equal ones: the earlier."""
    told = np.array([mutual_information(c, z) for c in x.T])
    chosen = np.sort(np.argsort(-told, kind="stable")[:k])
    return lambda v: v[:, chosen]


REDUCERS: dict[str, Callable[[np.ndarray, np.ndarray, int], Apply]] = {"pca": _pca, "pls": _pls, "kbest": _kbest}

#: Target transforms: forward and inverse.
TARGETS: dict[str, tuple[Apply, Apply]] = {
    "standard": (lambda y: y, lambda z: z),
    "sqrt": (np.sqrt, lambda z: np.maximum(z, 0) ** 2),
    "log1p": (np.log1p, np.expm1),
}


def fit_prefix(recipe: Recipe, x: np.ndarray, z: np.ndarray) -> Apply:
    """Scaling, and reduction to inputs that are standardized again: what every kind of model of the recipe sees."""
    if recipe.scaling not in SCALERS or (recipe.reduction and recipe.reduction[0] not in REDUCERS):
        raise KeyError(f"unknown scaling or reduction in {recipe}")
    scale = SCALERS[recipe.scaling](x)
    if recipe.reduction is None:
        return scale
    reduce = REDUCERS[recipe.reduction[0]](scale(x), z, recipe.reduction[1])
    inside = reduce(scale(x))
    centre, spread = inside.mean(0), _spread(inside.std(0))
    return lambda v: (reduce(scale(v)) - centre) / spread


# models: training inputs and target, and all candidate settings, to a function that gives one column a candidate


def _ridge(x: np.ndarray, z: np.ndarray, candidates: list[dict], penalty: float | None = None) -> Apply:
    mean, m = x.mean(0), z.mean()
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    b = u.T @ (z - m)
    keep = s > s.max(initial=0) * 1e-10
    weights = []
    for c in candidates:
        alpha = penalty if penalty is not None else c.get("alpha", 1.0)
        weights.append(vt.T @ np.divide(s * b, s * s + alpha, out=np.zeros(len(s)), where=keep if alpha == 0 else s * s + alpha > 0))
    return lambda v: m + (v - mean) @ np.array(weights).T


def _kernel(x: np.ndarray, z: np.ndarray, candidates: list[dict], kernel) -> Apply:
    """Kernel ridge on a centred target; candidates that share an embedding or a kernel share its work."""
    m, duals = z.mean(), []
    shared: dict[str, tuple] = {}
    for c in candidates:
        key = json.dumps({k: v for k, v in c.items() if k != "alpha"}, sort_keys=True)
        if key not in shared:
            own = kernel.embed(x, c)
            shared[key] = own, np.linalg.eigh(_even(kernel.gram(own, own, c)))
        own, (l, v) = shared[key]
        duals.append((c, own, v @ ((v.T @ (z - m)) / np.maximum(l + c.get("alpha", 1.0), 1e-12))))

    def apply(v: np.ndarray) -> np.ndarray:
        seen: dict[str, np.ndarray] = {}
        out = []
        for c, own, dual in duals:
            key = json.dumps({k: w for k, w in c.items() if k != "alpha"}, sort_keys=True)
            if key not in seen:
                seen[key] = kernel.gram(kernel.embed(v, c), own, c)
            out.append(m + seen[key] @ dual)
        return np.stack(out, 1)

    return apply


def _even(k: np.ndarray) -> np.ndarray:
    return (k + k.T) / 2


def _by_kernel(name: str):
    def fit(x: np.ndarray, z: np.ndarray, candidates: list[dict]) -> Apply:
        from tessera.operators.quantum_models import KERNELS

        return _kernel(x, z, candidates, KERNELS[name])

    return fit


def _z_readout(x: np.ndarray, z: np.ndarray, candidates: list[dict]) -> Apply:
    """Ridge on circuit expectations; the inputs are standardized once more, as the encoder expects."""
    from tessera.operators.quantum_models import z_features

    scale = _standard(x)
    groups: dict[str, list[int]] = {}
    for k, c in enumerate(candidates):
        groups.setdefault(json.dumps({a: b for a, b in c.items() if a != "alpha"}, sort_keys=True), []).append(k)
    fitted = [(json.loads(key), at, _ridge(z_features(scale(x), **json.loads(key)), z, [candidates[k] for k in at])) for key, at in groups.items()]

    def apply(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), len(candidates)))
        for settings, at, ridge in fitted:
            out[:, at] = ridge(z_features(scale(v), **settings))
        return out

    return apply


def _boosted(x: np.ndarray, z: np.ndarray, candidates: list[dict]) -> Apply:
    grown = [boosting.grow(x, z, **{"trees": 200, **c}) for c in candidates]
    return lambda v: np.stack([g.predict(v) for g in grown], 1)


def _forest(x: np.ndarray, z: np.ndarray, candidates: list[dict]) -> Apply:
    grown = [boosting.forest(x, z, **c) for c in candidates]
    return lambda v: np.stack([g.predict(v) for g in grown], 1)


MODELS: dict[str, Callable[[np.ndarray, np.ndarray, list[dict]], Apply]] = {
    "mean": lambda x, z, c: lambda v: np.full((len(v), len(c)), z.mean()),
    "linear": lambda x, z, c: _ridge(x, z, c, penalty=0.0),
    "ridge": _ridge,
    "rbf_krr": _by_kernel("rbf"),
    "fidelity": _by_kernel("fidelity"),
    "projected": _by_kernel("projected"),
    "z_readout": _z_readout,
    "rf": _forest,
    "gbt": _boosted,
}

# Grids of each model that do not depend on the number of inputs.
GRIDS: dict[str, dict[str, list]] = {
    "mean": {},
    "linear": {},
    "ridge": {"alpha": RIDGE_ALPHAS},
    "rf": {"max_features": [1.0, 0.5, "sqrt"], "min_leaf": [1, 3, 5]},
    "gbt": {"max_depth": [3, 5, 7], "learning_rate": [0.03, 0.1], "min_child_weight": [1, 5]},
}


def grid_of(recipe: Recipe, n_features: int) -> list[dict]:
    """All candidates of a recipe's model, in nested order (the last name varies fastest)."""
    d = recipe.reduction[1] if recipe.reduction else n_features
    grid = {
        "rbf_krr": {"alpha": KRR_ALPHAS, "gamma": rbf_grid(d)},
        "fidelity": {"alpha": KRR_ALPHAS, "gamma": gamma_grid(d)},
        "projected": {"alpha": KRR_ALPHAS, "gamma": gamma_grid(d), "gamma_p": [0.25, 1.0, 4.0]},
        "z_readout": {"alpha": RIDGE_ALPHAS, "gamma": gamma_grid(d)},
    }.get(recipe.model) or GRIDS[recipe.model]
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def build(model: str, n_features: int, scaling: str = "standard", reduction: tuple[str, int] | None = None, target: str = "standard", **settings) -> tuple[Recipe, list[dict]]:
    """(recipe, its grid); unknown names raise KeyError."""
    if model not in MODELS or target not in TARGETS:
        raise KeyError(f"unknown model {model!r} or target {target!r}")
    recipe = Recipe(model, scaling, reduction, target).with_settings(**settings)
    return recipe, grid_of(recipe, n_features)


def roster(n_features: int, models: tuple[str, ...] = ("mean", "linear", "ridge", "rbf_krr"), **options) -> dict[str, tuple[Recipe, list[dict]]]:
    """{model: (recipe, grid)} with the same scaling, reduction and target."""
    return {m: build(m, n_features, **options) for m in models}


def quantum_ridge(n_features: int, scaling: str, reduction: tuple[str, int] | None, target: str, encoding: str = "zz", reps: int = 2, qubits: int | None = None) -> tuple[Recipe, list[dict]]:
    """The readout ridge on circuit expectations with its 15 penalties x 11 angle scales."""
    d = reduction[1] if reduction else n_features
    return build("z_readout", n_features, scaling, reduction, target, encoding=encoding, reps=reps, qubits=qubits or default_qubits(encoding, d))


# one fit


@dataclass
class Fitted:
    """predict gives the target's own scale, never negative; columns are candidates."""

    recipe: Recipe
    candidates: list[dict]
    prefix: Apply = field(repr=False)
    model: Apply = field(repr=False)
    centre: float = 0.0
    scale: float = 1.0

    def back(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(TARGETS[self.recipe.target][1](z * self.scale + self.centre), 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.back(self.model(self.prefix(x))) if len(x) else np.zeros((0, len(self.candidates)))


def fit(recipe: Recipe, x: np.ndarray, y: np.ndarray, candidates: list[dict] | None = None) -> Fitted:
    """All candidates of a recipe on one training set; scaling and reduction are fitted once for them, on the transformed target."""
    candidates = [dict(recipe.settings) | c for c in (candidates or [{}])]
    z = TARGETS[recipe.target][0](np.asarray(y, float))
    centre, scale = float(z.mean()), float(_spread(z.std()))
    z = (z - centre) / scale
    prefix = fit_prefix(recipe, x, z)
    return Fitted(recipe, candidates, prefix, MODELS[recipe.model](prefix(x), z, candidates), centre, scale)


# job tables


def clean_rows(rows: DataFrame, features: list[str], y: str, *more: str) -> DataFrame:
    """(id, features, y, more...) without null or NaN rows, numbers as doubles."""
    return rows.select("id", *[F.col(c).cast("double").alias(c) for c in [*features, y]], *more).dropna()


def _too_many(n: int, features: list[str]) -> bool:
    return n > MAX_ROWS or n * len(features) > MAX_CELLS


def training_arrays(rows: DataFrame, features: list[str], y: str, *more: str) -> tuple[np.ndarray, ...]:
    """(ids, x, y, more...) in order of id, null or NaN rows left out; refused beyond MAX_ROWS rows or MAX_CELLS numbers."""
    clean = clean_rows(rows, features, y, *more)
    n = clean.count()
    if _too_many(n, features):
        raise ValueError(f"a training set of {n} rows x {len(features)} columns is larger than one task holds")
    table = clean.toArrow().sort_by("id")
    columns = lambda names: np.stack([table.column(c).to_numpy() for c in names], 1) if len(table) else np.zeros((0, len(names)))
    return (table.column("id").to_numpy(), columns(features), table.column(y).to_numpy(), *[table.column(c).to_numpy() for c in more])


def run_jobs(spark: SparkSession, jobs: list[dict], work: Callable[[dict], Iterator[tuple]], shared: tuple, schema: str) -> DataFrame:
    """One row set per job, jobs side by side; `shared` reaches the tasks once."""
    sent = spark.sparkContext.broadcast(shared)
    table = spark.createDataFrame([(k, json.dumps(j)) for k, j in enumerate(jobs)], "k int, job string") if jobs else spark.createDataFrame([], "k int, job string")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job in pdf["job"]:
                out = list(work(json.loads(job), *sent.value))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return table.repartition(max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)), "k").mapInPandas(run, schema)


@dataclass
class CVResult:
    """candidates: (recipe, candidate, mae, rmse, fold_sd, n_eval); oof: (recipe, candidate, id, fold, pred)."""

    oof: DataFrame
    candidates: DataFrame
    grids: dict[str, list[dict]]

    def best(self) -> DataFrame:
        """The candidate of least error of every recipe, ties to the earlier, with its settings as JSON."""
        from tessera.operators.relational import argmin_rows

        text = F.create_map(*[F.lit(v) for name, grid in self.grids.items() for k, c in enumerate(grid) for v in (f"{name}:{k}", json.dumps(c, sort_keys=True))])
        sizes = F.create_map(*[F.lit(v) for name, grid in self.grids.items() for v in (name, len(grid))])
        found = argmin_rows(self.candidates, ["recipe"], "mae", "candidate")
        return found.withColumn("hyperparams", text[F.concat_ws(":", "recipe", "candidate")]).withColumn("n_candidates", sizes[F.col("recipe")])

    def best_oof(self) -> DataFrame:
        """(recipe, id, fold, pred) of each recipe's best candidate."""
        return self.oof.join(self.best().select("recipe", "candidate"), ["recipe", "candidate"]).select("recipe", "id", "fold", "pred")


def _pooled(oof: DataFrame) -> DataFrame:
    """Errors of every candidate over all its out-of-fold predictions, each row predicted once."""
    e = F.col("pred") - F.col("y")
    return _over_folds(oof.groupBy("recipe", "candidate", "fold").agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("s")))


def _over_folds(by_fold: DataFrame) -> DataFrame:
    return by_fold.groupBy("recipe", "candidate").agg(
        (F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"), F.stddev_samp(F.col("a") / F.col("n")).alias("fold_sd"), F.sum("n").alias("n_eval")
    )


def tune(rows: DataFrame, recipes: dict[str, tuple[Recipe, list[dict]]], features: list[str], y: str) -> CVResult:
    """Cross-validation of every candidate of every recipe on the same folds.

    rows: id, fold, y and features; a row with fold -1 is always trained on (a holdout is folds 0 and -1). Each id must be
    there once. One job per (recipe, fold) fits its scaling and reduction once for all candidates. Beyond what one task holds,
    recipes that `summed` knows are fitted from sums over the table; others are refused there.
    """
    clean = cut(clean_rows(rows, features, y, "fold"))
    if _too_many(clean.count(), features) and all(summed.knows(recipe) for recipe, _ in recipes.values()):
        if not clean.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("a row is validated more than once")
        fitted = summed.fit_folds(clean, recipes, features, y)
        oof = summed.out_of_fold(clean, fitted, features, y).select("recipe", "candidate", "id", "fold", "pred")
        return CVResult(oof, _over_folds(summed.errors_by_fold(clean, fitted, features, y)), {name: grid or [{}] for name, (_, grid) in recipes.items()})
    ids, x, t, fold = training_arrays(clean, features, y, "fold")
    if len(np.unique(ids)) != len(ids):
        raise ValueError("a row is validated more than once")
    grids = {name: grid or [{}] for name, (_, grid) in recipes.items()}
    plans = {name: recipe for name, (recipe, _) in recipes.items()}
    jobs = [{"recipe": name, "fold": int(f)} for name in recipes for f in np.unique(fold[fold >= 0])]

    def work(job: dict, ids, x, t, fold) -> Iterator[tuple]:
        held = fold == job["fold"]
        name = job["recipe"]
        pred = fit(plans[name], x[~held], t[~held], grids[name]).predict(x[held])
        for c in range(len(grids[name])):
            yield from zip([name] * held.sum(), [c] * held.sum(), ids[held].tolist(), [job["fold"]] * held.sum(), pred[:, c].tolist(), t[held].tolist())

    oof = run_jobs(rows.sparkSession, jobs, work, (ids, x, t, fold), "recipe string, candidate int, id bigint, fold int, pred double, y double")
    return CVResult(oof.select("recipe", "candidate", "id", "fold", "pred"), _pooled(oof), grids)


SpecFactory = Callable[[int, str], dict[str, tuple[Recipe, list[dict]]]]


def learning_curve(table: DataFrame, train_sets: DataFrame, feature_sets: dict[str, list[str]], y: str, make_specs: SpecFactory, folds: int = 5, by: str | None = None, eval_set: str = "cv") -> CVResult:
    """Cross-validation over many training sets as one job table; the result's recipe is "seed:n_train:model:feature set".

    train_sets: (seed, n_train, id). All models and feature sets of one training set share its folds: a hashed partition, or
    whole groups of the column `by`. make_specs(seed, feature set) gives {model: (recipe, grid)}.
    """
    spark = table.sparkSession
    features = list(dict.fromkeys(f for names in feature_sets.values() for f in names))
    members = train_sets.select("seed", "n_train", "id").distinct()
    rows = table.join(members.select("id").distinct(), "id", "left_semi")
    ids, x, t = training_arrays(rows, features, y)
    text = F.concat_ws(":", F.lit("cv"), "seed", "n_train")
    if by:
        found = members.join(table.select("id", F.col(by).alias("_by")), "id").withColumn("fold", F.pmod(F.xxhash64(text, "_by"), F.lit(folds)).cast("int"))
    else:  # a set is at most MAX_ROWS rows
        order = F.row_number().over(Window.partitionBy("seed", "n_train").orderBy(F.md5(F.concat_ws(":", text, "id")), "id"))
        found = members.withColumn("fold", ((order - 1) % folds).cast("int"))
    sets = found.select("seed", "n_train", "id", "fold").toArrow().to_pandas()
    sets = sets[np.isin(sets["id"], ids)].sort_values(["seed", "n_train", "id"])
    jobs, plans, grids, parts = [], {}, {}, {}
    for (seed, n), part in sets.groupby(["seed", "n_train"]):
        parts[f"{seed}:{n}"] = np.searchsorted(ids, part["id"].to_numpy()), part["fold"].to_numpy()
        for fname in feature_sets:
            for model, (recipe, grid) in make_specs(int(seed), fname).items():
                name = f"{seed}:{n}:{model}:{fname}"
                plans[name], grids[name] = recipe, grid or [{}]
                jobs += [{"recipe": name, "set": f"{seed}:{n}", "features": fname, "fold": int(f)} for f in np.unique(part["fold"])]
    columns = {name: [features.index(f) for f in names] for name, names in feature_sets.items()}

    def work(job: dict, ids, x, t, parts) -> Iterator[tuple]:
        at, fold = parts[job["set"]]
        v, held, name = x[at][:, columns[job["features"]]], fold == job["fold"], job["recipe"]
        pred = fit(plans[name], v[~held], t[at][~held], grids[name]).predict(v[held])
        for c in range(len(grids[name])):
            yield from zip([name] * held.sum(), [c] * held.sum(), ids[at][held].tolist(), [job["fold"]] * held.sum(), pred[:, c].tolist(), t[at][held].tolist())

    oof = run_jobs(spark, jobs, work, (ids, x, t, parts), "recipe string, candidate int, id bigint, fold int, pred double, y double")
    return CVResult(oof.select("recipe", "candidate", "id", "fold", "pred"), _pooled(oof).withColumn("eval_set", F.lit(eval_set)), grids)


def curve_table(result: CVResult) -> DataFrame:
    """(seed, n_train, model, features, mae, rmse, fold_sd, n_eval, n_candidates, hyperparams) of a learning curve."""
    part = lambda k: F.split_part("recipe", F.lit(":"), F.lit(k))
    best = result.best()
    return best.select(part(1).cast("int").alias("seed"), part(2).cast("int").alias("n_train"), part(3).alias("model"), part(4).alias("features"), "eval_set", "mae", "rmse", "fold_sd", "n_eval", "n_candidates", "hyperparams")


def development_curve(table: DataFrame, train_sets: DataFrame, eval_sets: dict[str, DataFrame], features: list[str], y: str, recipes: dict[str, Recipe], cache: str | None = None, tail: float = 9.0) -> DataFrame:
    """(seed, n_train, model, eval_set, mae, rmse, rmse_below_tail, r2, bias, n_eval): every recipe fitted on every training
    set and scored on every evaluation set. The fits are one job table; evaluation rows stay where they are and may be any number.

    train_sets: (seed, n_train, id); eval_sets: (id) by name. A row that a fit trains on must not be in an evaluation set
    (ValueError). With `cache`, results lie as Parquet under the hash of (seed, size, recipe, features, target, evaluation
    sets) and jobs that are there are read instead of run.
    """
    from tessera.operators.provenance import config_hash

    spark = table.sparkSession
    clean = cut(clean_rows(table, features, y))
    members = train_sets.select("seed", "n_train", "id").distinct()
    train = clean.join(members.select("id").distinct(), "id", "left_semi")
    ids, x, t = training_arrays(train, features, y)
    frame = members.toArrow().to_pandas()
    sets = {f"{seed}:{n}": np.flatnonzero(np.isin(ids, part["id"].to_numpy())) for (seed, n), part in frame.groupby(["seed", "n_train"])}
    held = spark.createDataFrame([], "id bigint, eval_set string")
    for name, rows in eval_sets.items():
        held = held.unionByName(rows.select("id", F.lit(name).alias("eval_set")).distinct())
    if not train.join(held, "id", "left_semi").isEmpty():
        raise ValueError("a training row is in an evaluation set")
    jobs = [{"set": s, "model": m, "key": config_hash({"set": s, "recipe": r.describe(), "features": features, "y": y, "sets": sorted(eval_sets)})} for s in sets for m, r in recipes.items()]
    schema = "key string, seed int, n_train int, model string, eval_set string, mae double, rmse double, rmse_below_tail double, r2 double, bias double, n_eval bigint"
    stored = spark.read.schema(schema).parquet(cache) if cache and _there(spark, cache) else spark.createDataFrame([], schema)
    known = {r.key for r in stored.select("key").distinct().collect()}

    def work(job: dict, ids, x, t, sets) -> Iterator[tuple]:
        at = sets[job["set"]]
        yield job["key"], cloudpickle.dumps(fit(recipes[job["model"]], x[at], t[at]))

    todo = [j for j in jobs if j["key"] not in known]
    scores = _held_out_errors(run_jobs(spark, todo, work, (ids, x, t, sets), "key string, fitted binary"), clean.join(held, "id"), features, y, tail)
    cells = [(j["key"], *map(int, j["set"].split(":")), j["model"], name) for j in todo for name in eval_sets]
    nan = F.lit(math.nan)
    fresh = spark.createDataFrame(cells, "key string, seed int, n_train int, model string, eval_set string").join(scores, ["key", "eval_set"], "left").select(
        "key", "seed", "n_train", "model", "eval_set", *[F.coalesce(c, nan).alias(c) for c in ("mae", "rmse", "rmse_below_tail", "r2", "bias")], F.coalesce("n_eval", F.lit(0)).cast("bigint").alias("n_eval")
    )
    if cache:
        fresh.write.mode("append").parquet(cache)
        stored = spark.read.schema(schema).parquet(cache)
        fresh = spark.createDataFrame([], schema)
    mine = spark.createDataFrame([(j["key"],) for j in jobs], "key string")
    return stored.unionByName(fresh).dropDuplicates(["key", "eval_set"]).join(F.broadcast(mine), "key", "left_semi").drop("key")


def _held_out_errors(models: DataFrame, rows: DataFrame, features: list[str], y: str, tail: float) -> DataFrame:
    """(key, eval_set, mae, rmse, rmse_below_tail, r2, bias, n_eval) of models (key, fitted) on rows (features, y, eval_set) of
    any number: the models are sent to the rows, as many at a time as SENT bytes hold, and one at least."""
    models = cut(models)
    batches: list[list[str]] = []
    room = 0
    for r in models.select("key", F.length("fitted").alias("n")).orderBy("key").collect():
        if r.n > room or not batches:
            batches.append([])
            room = SENT
        batches[-1].append(r.key)
        room -= r.n
    out = None
    for keys in batches or [[]]:
        sent = rows.sparkSession.sparkContext.broadcast({r.key: bytes(r.fitted) for r in models.where(F.col("key").isin(keys)).collect()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            fitted = {key: cloudpickle.loads(value) for key, value in sent.value.items()}
            for batch in batches:
                v, t = summed.matrix(batch, features), batch.column(y).to_numpy()
                for key, model in fitted.items():
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(t), pa.string()), batch.column("eval_set"), pa.array(model.predict(v)[:, 0] - t), pa.array(t)], ["key", "eval_set", "e", "v"])

        part = rows.select(*features, y, "eval_set").mapInArrow(run, "key string, eval_set string, e double, v double")
        out = part if out is None else out.unionByName(part)
    e, spread = F.col("e"), F.var_pop("v") * F.count("*")
    return out.groupBy("key", "eval_set").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(F.when(F.col("v") < tail, e * e))).alias("rmse_below_tail"),
        F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.avg(e).alias("bias"), F.count("*").alias("n_eval"),
    )


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def pca_cv_curve(rows: DataFrame, features: list[str], y: str, ks: list[int], model: str = "ridge", **options) -> DataFrame:
    """(k, pca, mae, rmse, hyperparams): error on the first k components of the scaled features, and without reduction."""
    recipes = {f"{k}:1": build(model, len(features), reduction=("pca", k), **options) for k in ks}
    recipes[f"{len(features)}:0"] = build(model, len(features), **options)
    best = tune(rows, recipes, features, y).best()
    return best.select(F.split_part("recipe", F.lit(":"), F.lit(1)).cast("int").alias("k"), (F.split_part("recipe", F.lit(":"), F.lit(2)) == "1").alias("pca"), "mae", "rmse", "hyperparams")


def permutation_importance_cv(rows: DataFrame, recipe: Recipe, features: list[str], y: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """(feature, rise): mean rise of the validation error when a feature's values change places, over folds and repeats.

    rows: id, fold, y and features. One job per (fold, feature); the order of values depends on (seed, fold, feature, repeat).
    Beyond what one task holds, a recipe that `summed` knows is fitted from sums and values change places by hashed orders.
    """
    clean = cut(clean_rows(rows, features, y, "fold"))
    if _too_many(clean.count(), features) and summed.knows(recipe):
        fitted = summed.fit_folds(clean, {"own": (recipe, [{}])}, features, y)
        rises = summed.permuted_errors(clean, fitted, features, y, repeats, seed)
        return rises.groupBy("feature").agg(F.avg("rise").alias("rise"))
    shared = training_arrays(clean, features, y, "fold")
    jobs = [{"fold": int(f), "feature": j} for f in np.unique(shared[3]) for j in range(len(features))]

    def work(job: dict, ids, x, t, fold) -> Iterator[tuple]:
        held = fold == job["fold"]
        fitted = fit(recipe, x[~held], t[~held])
        error = lambda v: np.abs(fitted.predict(v)[:, 0] - t[held]).mean()
        base = error(x[held])
        for r in range(repeats):
            v = x[held].copy()
            v[:, job["feature"]] = np.random.default_rng([seed, job["fold"], job["feature"], r]).permutation(v[:, job["feature"]])
            yield features[job["feature"]], job["fold"], r, float(error(v) - base)

    rises = run_jobs(rows.sparkSession, jobs, work, shared, "feature string, fold int, repeat int, rise double")
    return rises.groupBy("feature").agg(F.avg("rise").alias("rise"))


def make_folds(rows: DataFrame, seed: int, n: int = 5, by: str | None = None) -> DataFrame:
    """rows with fold: a partition by hashed order, or whole groups of `by`."""
    from tessera.operators.splits import group_kfold, kfold

    return group_kfold(rows, by, n, f"cv:{seed}") if by else kfold(rows, "id", n, f"cv:{seed}")


def _tuning_rows(rows: DataFrame, n: int, seed: int, cv_max_n: int, validation: float, most: int) -> tuple[DataFrame, str]:
    from tessera.operators.splits import hashed_rank, draw

    if n <= cv_max_n:
        return make_folds(rows, seed), "5-fold CV"
    size = min(most, max(10, round(validation * n)))
    ranked = hashed_rank(rows, draw(f"holdout:{seed}", "id"), "_n")
    return ranked.withColumn("fold", F.when(F.col("_n") <= size, 0).otherwise(-1)).drop("_n"), "holdout"


@dataclass
class TabularFitter:
    """Chooses a recipe's candidate by cross-validation up to cv_max_n rows, on one held-out part beyond, and fits it on all rows."""

    recipe: Recipe
    grid: list[dict]
    features: list[str]
    y: str
    seed: int = 0
    cv_max_n: int = 1000
    validation: float = 0.1
    most_validation: int = 5000
    label: str = ""

    @property
    def config(self) -> dict:
        return {"kind": "tabular", **asdict(self), "recipe": self.recipe.describe()}

    def fit(self, rows: DataFrame) -> TabularFitter:
        ids, x, t = training_arrays(rows, self.features, self.y)
        self.chosen, self.tuning, self.tuning_mae = (self.grid or [{}])[0], "none", None
        if len(self.grid) > 1:
            parts, self.tuning = _tuning_rows(rows, len(ids), self.seed, self.cv_max_n, self.validation, self.most_validation)
            best = tune(parts, {"own": (self.recipe, self.grid)}, self.features, self.y).best().first()
            self.chosen, self.tuning_mae = self.grid[best.candidate], best.mae
        self.fitted = fit(self.recipe, x, t, [self.chosen])
        self.train = (x, t)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, pred), a narrow stage; rows with a null get a null. The model is refitted once in each worker."""
        sent = rows.sparkSession.sparkContext.broadcast((self.recipe, *self.train, self.chosen))
        names = self.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            recipe, x, t, chosen = sent.value
            fitted = fit(recipe, x, t, [chosen])
            for pdf in batches:
                v = pdf[names].to_numpy(float)
                good = np.isfinite(v).all(1)
                pred = np.full(len(v), np.nan)
                pred[good] = fitted.predict(v[good])[:, 0]
                yield pd.DataFrame({"id": pdf["id"], "pred": pred})

        found = rows.select("id", *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, "id bigint, pred double")
        return found.select("id", F.nanvl("pred", F.lit(None).cast("double")).alias("pred"))

    def describe(self) -> dict:
        return {"params": self.chosen, "tuning": self.tuning} | ({"tuning_mae": self.tuning_mae} if self.tuning_mae is not None else {})


@dataclass
class MeanFitter:
    """Predicts the mean of the training rows."""

    y: str

    @property
    def config(self) -> dict:
        return {"kind": "mean", "y": self.y}

    def fit(self, rows: DataFrame) -> MeanFitter:
        self.mean = rows.agg(F.avg(self.y)).first()[0]
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.lit(self.mean).cast("double").alias("pred"))

    def describe(self) -> dict:
        return {"mean": self.mean}


def kernel_ridge(kind: str, features: list[str], y: str, scaling: str = "standard", reduction: tuple[str, int] | None = None, target: str = "standard", alphas: list[float] | None = None, **options) -> TabularFitter:
    """A fitter of kernel ridge with a kernel of quantum_models.KERNELS, over all its settings and penalties."""
    from tessera.operators.quantum_models import KERNELS, kernel_candidates

    model = {"rbf": "rbf_krr"}.get(kind, kind)
    d = reduction[1] if reduction else len(features)
    return TabularFitter(Recipe(model, scaling, reduction, target), kernel_candidates(KERNELS[kind], d, alphas or KRR_ALPHAS), features, y, **options)


# The space of the random search for boosted trees, (name, kind, low, high).
BOOSTED_SPACE = (
    ("max_depth", "int", 3, 10),
    ("learning_rate", "log", 0.01, 0.2),
    ("min_child_weight", "log", 1.0, 50.0),
    ("subsample", "uniform", 0.5, 1.0),
    ("colsample", "uniform", 0.3, 1.0),
    ("reg_lambda", "log", 1e-2, 100.0),
    ("reg_alpha", "log", 1e-3, 10.0),
)


def sample_params(space: tuple, rng: np.random.Generator) -> dict:
    """One draw of every setting: whole numbers with both ends, uniform, or uniform in the logarithm."""
    draws = {
        "int": lambda a, b: int(rng.integers(a, b, endpoint=True)),
        "log": lambda a, b: float(a * (b / a) ** rng.random()),
        "uniform": lambda a, b: float(a + (b - a) * rng.random()),
    }
    return {name: draws[kind](low, high) for name, kind, low, high in space}


def _table_edges(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """boosting.bin_edges of a table's columns: distinct values are counted, quantiles exact."""
    from tessera.operators.statistics import ordered_counts, quantiles_of, unpivot

    ordered = cut(ordered_counts(unpivot(rows, features), ["column"], "value"))
    few = ordered.groupBy("column").agg(F.count("*").alias("n")).where(F.col("n") <= boosting.BINS).select("column")
    values = {r.column: np.array(sorted(r.v)) for r in ordered.join(few, "column").groupBy("column").agg(F.collect_list("value").alias("v")).collect()}
    shares = np.linspace(0, 1, boosting.BINS + 1)[1:-1].tolist()
    cuts = {r.column: np.unique(np.array(r.q)) for r in quantiles_of(ordered.join(few, "column", "left_anti"), ["column"], "value", shares).collect()}
    return [(values[c][:-1] + values[c][1:]) / 2 if c in values else cuts[c] for c in features]


def _together(spread: DataFrame, features: list[str], y: str, work: Callable, schema: str) -> DataFrame:
    """The rows that work(ids, x, t, fold, add) yields in the first task; all tasks run it side by side, each on its part."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    kinds = {name: types[kind] for name, kind in (part.split() for part in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        first, tasks = context.partitionId() == 0, len(context.getTaskInfos())
        # the barrier's own exchange takes a second a call: it only tells where the first task listens
        key = os.urandom(16)
        listener = Listener(("0.0.0.0", 0), backlog=tasks, authkey=key) if first else None
        told = context.allGather(f"{listener.address[1]}:{key.hex()}" if first else "")[0].split(":")
        if first:
            peers = dict((c.recv(), c) for c in [listener.accept() for _ in range(tasks - 1)])
        else:
            upward = Client((context.getTaskInfos()[0].address.rsplit(":", 1)[0], int(told[0])), authkey=bytes.fromhex(told[1]))
            upward.send(context.partitionId())

        def add(sums: np.ndarray) -> np.ndarray:
            own = np.ascontiguousarray(sums, float)
            if not first:
                upward.send_bytes(own.tobytes())
                return np.frombuffer(upward.recv_bytes(), float).reshape(own.shape)
            for k in sorted(peers):
                own = own + np.frombuffer(peers[k].recv_bytes(), float).reshape(own.shape)
            for peer in peers.values():
                peer.send_bytes(own.tobytes())
            return own

        parts = [(b.column("id").to_numpy(), summed.matrix(b, features), b.column(y).to_numpy(), b.column("fold").to_numpy()) for b in batches]
        parts = parts or [(np.zeros(0, np.int64), np.zeros((0, len(features))), np.zeros(0), np.zeros(0, np.int32))]
        out = list(work(*map(np.concatenate, zip(*parts)), add))
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(kinds, zip(*out))], list(kinds))

    return spread.mapInArrow(run, schema, barrier=True)


@dataclass
class BoostedFitter:
    """Random search with early stopping inside the training set; the winner grows as many trees as it needed on average,
    scaled from the inner training size to the whole. One job per (trial, fold)."""

    features: list[str]
    y: str
    seed: int = 0
    trials: int = 20
    target: str = "standard"
    cv_max_n: int = 1000
    validation: float = 0.1
    most_validation: int = 5000
    most_trees: int = 4000
    patience: int = 100
    space: tuple = BOOSTED_SPACE

    @property
    def config(self) -> dict:
        return {"kind": "boosted", **asdict(self)}

    def fit(self, rows: DataFrame) -> BoostedFitter:
        rng = np.random.default_rng(self.seed)
        drawn = [sample_params(self.space, rng) for _ in range(self.trials)]
        n = rows.count()
        parts, self.tuning = _tuning_rows(rows, n, self.seed, self.cv_max_n, self.validation, self.most_validation)
        clean = cut(clean_rows(parts, self.features, self.y, "fold"))
        if _too_many(n_clean := clean.count(), self.features):
            return self._fit_together(clean, n_clean, drawn)
        shared = training_arrays(clean, self.features, self.y, "fold")
        folds = np.unique(shared[3][shared[3] >= 0])
        forward, inverse = TARGETS[self.target]
        seed, most, patience = self.seed, self.most_trees, self.patience

        def work(job: dict, ids, x, t, fold) -> Iterator[tuple]:
            held = fold == job["fold"]
            z = forward(t[~held])
            m, s = z.mean(), float(_spread(z.std()))
            g = boosting.grow(x[~held], (z - m) / s, trees=most, seed=seed, watch=(x[held], (forward(t[held]) - m) / s), patience=patience, **drawn[job["trial"]])
            pred = np.maximum(inverse(g.predict(x[held]) * s + m), 0)
            yield job["trial"], job["fold"], int(held.sum()), float(np.abs(pred - t[held]).sum()), len(g.trees), int((~held).sum())

        jobs = [{"trial": k, "fold": int(f)} for k in range(self.trials) for f in folds]
        cells = run_jobs(rows.sparkSession, jobs, work, shared, "trial int, fold int, n bigint, a double, trees int, inner bigint")
        _, x, t, _ = shared
        self._choose(cells, drawn, len(t))
        z = forward(t)
        self.centre, self.scale = float(z.mean()), float(_spread(z.std()))
        self.model = boosting.grow(x, (z - self.centre) / self.scale, trees=self.n_trees, seed=self.seed, **self.params)
        return self

    def _choose(self, cells: DataFrame, drawn: list[dict], n: int) -> None:
        self.table = cells.groupBy("trial").agg((F.sum("a") / F.sum("n")).alias("mae"), F.avg("trees").alias("trees"), F.avg("inner").alias("inner")).orderBy("mae", "trial").collect()
        best = self.table[0]
        self.params, self.tuning_mae = drawn[best.trial], best.mae
        self.n_trees = max(1, math.ceil(best.trees * n / best.inner))

    def _fit_together(self, clean: DataFrame, n: int, drawn: list[dict]) -> BoostedFitter:
        """The same search on rows that no task holds alone: each task of a barrier stage keeps a part, and all grow every tree
        together from histograms that they add up."""
        forward, inverse = TARGETS[self.target]
        seed, most, patience = self.seed, self.most_trees, self.patience
        folds = sorted(r.fold for r in clean.select("fold").where("fold >= 0").distinct().collect())
        edges = {f: _table_edges(clean.where(F.col("fold") != f), self.features) for f in folds}
        spread = cut(clean.repartition(clean.sparkSession.sparkContext.defaultParallelism))

        def standard(z: np.ndarray, add: boosting.Add) -> tuple[float, float]:
            total, k = add(np.array([z.sum(), len(z)]))
            return float(total / k), float(_spread(np.sqrt(add(np.array([((z - total / k) ** 2).sum()]))[0] / k)))

        def search(ids, x, t, fold, add) -> Iterator[tuple]:
            for trial, params in enumerate(drawn):
                for f in folds:
                    held = fold == f
                    z = forward(t[~held])
                    m, s = standard(z, add)
                    g = boosting.grow_together(x[~held], (z - m) / s, ids[~held], edges[f], add, trees=most, seed=seed, watch=(x[held], (forward(t[held]) - m) / s), patience=patience, **params)
                    a, k, inner = add(np.array([np.abs(np.maximum(inverse(g.predict(x[held]) * s + m), 0) - t[held]).sum(), held.sum(), (~held).sum()]))
                    yield trial, f, int(k), float(a), len(g.trees), int(inner)

        cells = cut(_together(spread, self.features, self.y, search, "trial int, fold int, n bigint, a double, trees int, inner bigint"))
        self._choose(cells, drawn, n)
        whole, params, trees = _table_edges(clean, self.features), self.params, self.n_trees

        def last(ids, x, t, fold, add) -> Iterator[tuple]:
            z = forward(t)
            m, s = standard(z, add)
            yield (cloudpickle.dumps((m, s, boosting.grow_together(x, (z - m) / s, ids, whole, add, trees=trees, seed=seed, **params))),)

        found = _together(spread, self.features, self.y, last, "model binary").collect()
        self.centre, self.scale, self.model = cloudpickle.loads(bytes(found[0].model))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, pred), a narrow stage; NaN goes the way of small values in every split, null too."""
        model, m, s, names, inverse = self.model, self.centre, self.scale, self.features, TARGETS[self.target][1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "pred": np.maximum(inverse(model.predict(pdf[names].to_numpy(float)) * s + m), 0)})

        return rows.select("id", *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, "id bigint, pred double")

    def describe(self) -> dict:
        return {"params": self.params, "n_trees": self.n_trees, "tuning": self.tuning, "tuning_mae": self.tuning_mae, "n_trials": self.trials}
