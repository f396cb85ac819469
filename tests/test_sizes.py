"""Queries whose stored or collected tables must not grow beyond their input, and models beyond one task's training rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def stored(monkeypatch):
    """Columns of every table that a query stores on its way."""
    from tessera.plans import lineage

    seen: list[list[str]] = []
    real = lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: (seen.append(df.columns), real(df))[1])
    return seen


def test_latent_charge_stores_no_atoms(spark, stored):
    from tessera.plans.q_tables import q57_latent_charge
    from tessera.plans.views import molecules

    known = molecules(spark, SMALL, "r", "mu").where("mu is not null and size(r) = 3 * size(z)")
    assert q57_latent_charge(spark, SMALL).count() == known.count()
    assert stored and not {"x", "features", "pos", "edges"} & {c for columns in stored for c in columns}


def test_atom_subset_stores_elements_only(spark, stored):
    from tessera.plans.q_tables import q86_atom_subset

    rows = sorted(q86_atom_subset(spark, SMALL).collect(), key=lambda r: -r.id)
    assert [r.first for r in rows] == np.cumsum([0, *[r.n for r in rows]])[:-1].tolist()
    assert stored and not {"x", "features", "edges"} & {c for columns in stored for c in columns}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 4)) * [1, 10, 0.1, 3] + [0, 100, 5, 0]
    x[7, 1], x[:, 3] = 1e4, x[:, 0] * 2 + 0.1 * x[:, 3]
    y = np.maximum(3 + x[:, 0] + 0.05 * x[:, 1] + rng.standard_normal(600) * 0.3, 0)
    return spark.createDataFrame([(k, int(k % 5) - (k % 5 == 4) * 5, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))], "id bigint, fold int, a double, b double, c double, d double, y double")


NAMES = ["a", "b", "c", "d"]


def test_tuning_beyond_one_task_is_the_same(rows, monkeypatch):
    from tessera.operators import pipelines as pl

    recipes = {"mean": pl.build("mean", 4), "linear": pl.build("linear", 4), "ridge": pl.build("ridge", 4, target="sqrt"), "pca": pl.build("ridge", 4, reduction=("pca", 2)), "pls": pl.build("ridge", 4, reduction=("pls", 2), target="log1p"), "none": pl.build("ridge", 4, "none")}
    wanted = pl.tune(rows, recipes, NAMES, "y")
    monkeypatch.setattr(pl, "MAX_ROWS", 100)
    found = pl.tune(rows, recipes, NAMES, "y")
    key = lambda r: (r.recipe, r.candidate)
    for a, b in zip(sorted(wanted.candidates.collect(), key=key), sorted(found.candidates.collect(), key=key), strict=True):
        assert key(a) == key(b) and a.n_eval == b.n_eval == 480 and (a.mae, a.rmse, a.fold_sd) == pytest.approx((b.mae, b.rmse, b.fold_sd), rel=1e-7)
    assert found.best_oof().where("recipe = 'pca'").count() == 480
    with pytest.raises(ValueError, match="more than once"):
        pl.tune(rows.union(rows), recipes, NAMES, "y")
    with pytest.raises(ValueError, match="larger than one task"):
        pl.tune(rows, {"rf": pl.build("rf", 4)}, NAMES, "y")


def test_pca_curve_beyond_one_task(rows, monkeypatch):
    from tessera.operators import pipelines as pl

    curve = lambda: {(r.k, r.pca): (r.mae, r.hyperparams) for r in pl.pca_cv_curve(rows, NAMES, "y", [1, 2, 4]).collect()}
    wanted = curve()
    monkeypatch.setattr(pl, "MAX_ROWS", 100)
    found = curve()
    assert set(found) == set(wanted) and all(found[k][0] == pytest.approx(wanted[k][0], rel=1e-7) and found[k][1] == wanted[k][1] for k in wanted)


def test_importance_beyond_one_task(rows, monkeypatch):
    from tessera.operators import pipelines as pl

    recipe, rows = pl.Recipe("ridge").with_settings(alpha=1.0), rows.withColumn("fold", (F.col("id") % 5).cast("int"))
    wanted = {r.feature: r.rise for r in pl.permutation_importance_cv(rows, recipe, NAMES, "y", 3).collect()}
    monkeypatch.setattr(pl, "MAX_ROWS", 100)
    found = {r.feature: r.rise for r in pl.permutation_importance_cv(rows, recipe, NAMES, "y", 3).collect()}
    assert set(found) == set(NAMES) and all(found[k] == pytest.approx(wanted[k], rel=0.2, abs=0.02) for k in NAMES)


def test_development_curve_scores_any_number_of_rows(rows, monkeypatch):
    from tessera.operators import pipelines as pl

    sets = rows.where("id < 80").select(F.lit(0).alias("seed"), F.lit(80).alias("n_train"), "id")
    held = {"rest": rows.where("id >= 80").select("id"), "none": rows.where("id < 0").select("id"), "few": rows.where("id >= 590").select("id")}
    recipes = {"mean": pl.Recipe("mean"), "rbf": pl.Recipe("rbf_krr").with_settings(alpha=0.1, gamma=0.2)}
    monkeypatch.setattr(pl, "MAX_ROWS", 100)
    monkeypatch.setattr(pl, "SENT", 10)
    found = {(r.model, r.eval_set): r for r in pl.development_curve(rows, sets, held, NAMES, "y", recipes).collect()}
    _, x, t = (np.array(v) for v in zip(*[(r.id, [r[c] for c in NAMES], r.y) for r in rows.orderBy("id").collect()]))
    e = pl.fit(recipes["rbf"], x[:80], t[:80], [{}]).predict(x[80:])[:, 0] - t[80:]
    r = found["rbf", "rest"]
    assert (r.mae, r.rmse, r.bias, r.r2, r.n_eval) == pytest.approx((np.abs(e).mean(), np.sqrt((e**2).mean()), e.mean(), 1 - (e**2).sum() / ((t[80:] - t[80:].mean()) ** 2).sum(), 520))
    assert len(found) == 6 and found["mean", "none"].n_eval == 0 and np.isnan(found["mean", "none"].mae) and found["mean", "few"].n_eval == 10


def test_boosted_trees_grow_together(rows, monkeypatch):
    from tessera.operators import boosting
    from tessera.operators import pipelines as pl

    one = lambda: pl.BoostedFitter(NAMES, "y", trials=2, most_trees=30, patience=5, cv_max_n=50, space=(("max_depth", "int", 3, 4), ("subsample", "uniform", 1.0, 1.0), ("colsample", "uniform", 1.0, 1.0))).fit(rows.drop("fold"))
    wanted = one()
    monkeypatch.setattr(pl, "MAX_ROWS", 100)
    monkeypatch.setattr(boosting, "CELLS", 100)
    found = one()
    assert found.params == wanted.params and found.n_trees == wanted.n_trees and found.tuning_mae == pytest.approx(wanted.tuning_mae)
    both = found.predict(rows).toDF("id", "p").join(wanted.predict(rows), "id").collect()
    assert len(both) == 600 and all(r.p == pytest.approx(r.pred) for r in both)
