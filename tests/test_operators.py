"""Operators against hand-computed and brute-force results on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions.composition import key_of_formula, key_of_numbers
from tessera.operators import molecule_kernels as mk
from tessera.operators import quantum as qu
from tessera.operators import relational as rel
from tessera.operators import splits as sp
from tessera.operators import statistics as st

A = 1.09 / math.sqrt(3)
METHANE = (np.array([6, 1, 1, 1, 1]), np.array([[0, 0, 0], [A, A, A], [-A, -A, A], [-A, A, -A], [A, -A, -A]]))


def test_group_variance_by_hand(spark):
    rows = spark.createDataFrame([(1.0, "A"), (3.0, "A"), (5.0, "B"), (7.0, "B"), (100.0, "C"), (None, "A"), (1.0, None)], "y double, g string")
    r = st.group_variance(rows, "y", "g", 2).first()
    assert (r.n, r.k) == (4, 2)
    assert r.eta2 == pytest.approx(0.8) and r.within_std == pytest.approx(math.sqrt(2)) and r.within_mae == pytest.approx(1)
    assert st.group_variance(rows.where("false"), "y", "g").first().n == 0


def test_error_by_group_and_slope(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 2.0, "a"), (3.0, 1.0, "b"), (4.0, 4.0, "b")], "y double, p double, g string")
    got = {r.g: r for r in st.error_by_group(rows, "y", "p", "g").collect()}
    assert got["a"].mae == 0.5 and got["a"].bias == 0.5 and got["b"].rmse == pytest.approx(math.sqrt(2))
    curve = spark.createDataFrame([(float(n), 3 * n**-0.5) for n in (10, 100, 1000)], "n double, err double")
    assert st.loglog_slope(curve, "n", "err").first().slope == pytest.approx(-0.5)


def test_average_rank_with_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, None, 3.0, 1.0]
    got = st.average_rank(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v", buckets=4).orderBy("i").collect()
    assert [r["rank"] for r in got] == [5.0, 1.5, 5.0, 3.0, None, 5.0, 1.5]


def test_redundant_and_constant_columns(spark):
    rng = random.Random(0)
    rows = [(x := rng.random(), x**3, rng.random(), 1.0) for _ in range(80)]
    df = spark.createDataFrame(rows, "a double, cubed double, b double, c double")
    assert [r.column for r in st.zero_variance(df, df.columns).collect()] == ["c"]
    assert [r["dropped"] for r in st.redundant_columns(df, ["a", "cubed", "b"], 0.99)] == ["cubed"]
    # mostly zero columns agree overall; u and v do not where they are alive, twice u does
    sparse = [(u := (k + 1.0) * (k < 40), (k * 17 % 41 + 1.0) * (k < 40), 2 * u) for k in range(2000)]
    found = st.redundant_columns(spark.createDataFrame(sparse, "u double, v double, twice double"), ["u", "v", "twice"], 0.9)
    assert [(r["dropped"], r["kept"], r["rho_active"]) for r in found] == [("twice", "u", pytest.approx(1))]


def test_small_matrices():
    assert st.participation_ratio([1, 1, 1]) == pytest.approx(3)
    assert st.components_for_share([5, 3, 2], 0.8) == 2
    assert st.condition_number([1, 0]) == math.inf
    assert st.variance_inflation(np.array([[1, 1], [1, 1.0]])).max() > 1e6
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400)
    assert st.mutual_information(x, x + 0.1 * rng.standard_normal(400)) > 1 > 0.1 > st.mutual_information(x, rng.standard_normal(400))


def test_rank_features_uses_every_row(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 3)).round(3)
    x[:400] = x[400:800]
    x[800:1000] = x[800]
    y = 0.8 * x[:, 0] + 0.6 * x[:, 1]
    few = np.floor(3 * x[:, 1]) // 2
    for v in (x[:, 0], x[:, 2], few):
        brute = np.concatenate([np.partition(np.maximum(np.abs(v[s, None] - v), np.abs(y[s, None] - y)), 3, axis=1)[:, 3] for s in np.split(np.arange(3000), 6)])
        assert (st._neighbour_radius(v, y, 3) == brute).all()
    rows = [(*map(float, r), float(f), 1.0, float(v)) for r, f, v in zip(x, few, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, few double, one double, y double")
    got = {r.feature: r for r in st.rank_features(df, ["a", "b", "c", "few", "one"], "y").collect()}
    # rows in one order, since rounding decides whether a rounded value lies on the edge of a radius
    want = {n: st.mutual_information(v[o], y[o]) for n, v in (("a", x[:, 0]), ("b", x[:, 1]), ("c", x[:, 2]), ("few", few)) for o in [np.lexsort((y, v))]}
    assert {n: r.mi for n, r in got.items()} == pytest.approx(want, abs=1e-9)
    assert [r.feature for r in sorted(got.values(), key=lambda r: r.mi_rank)] == sorted(want, key=lambda n: -want[n])
    assert st.rank_features(df.where("false"), ["a"], "y").count() == 0


def test_exclusions_and_duplicates(spark):
    table = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    rules = spark.createDataFrame([(1, "a", 0), (1, "a", 9), (2, "b", 0), (2, "b", 1)], "ord int, rule string, id bigint")
    got = {r.rule: (r.listed, r.newly_removed) for r in rel.exclusion_report(table, rules).collect()}
    assert got == {"a": (2, 1), "b": (2, 1)}
    assert rel.kept_rows(table, rules).count() == 3
    spectra = spark.createDataFrame([(10, "x"), (11, "x"), (12, "y"), (13, None), (14, None)], "id bigint, k string")
    assert {r.id: r.label for r in rel.duplicate_groups(spectra, ["k"]).collect()} == {10: 10, 11: 10, 13: 13, 14: 13}
    with pytest.raises(rel.MissingKeys):
        rel.ordered_lookup(spark.createDataFrame([(0, 99)], "pos int, id bigint"), table, "id")


@pytest.mark.parametrize("text,counts", [("C6H4N2O", (6, 4, 2, 1, 0)), ("c6 h4-n2_o", (6, 4, 2, 1, 0)), ("CH3C5HN2O", (6, 4, 2, 1, 0)), ("C₆H₄N₂O", (6, 4, 2, 1, 0)), ("C_6H_{4}N_2O", (6, 4, 2, 1, 0)), ("", None), ("Xe", None), (None, None)])
def test_formula_spellings(spark, text, counts):
    z = None if counts is None else [n for n, c in zip((6, 1, 7, 8, 9), counts) for _ in range(c)]
    r = spark.createDataFrame([(text, z)], "f string, z array<int>").select(key_of_formula(F.col("f")).alias("a"), key_of_numbers(F.col("z")).alias("b")).first()
    assert r.a == r.b and (r.a is None) == (counts is None)


def test_descriptors_are_invariant_and_the_control_is_not():
    rng = np.random.default_rng(0)
    for name, (function, names) in mk.DESCRIPTORS.items():
        base = function(*METHANE)
        assert len(base) == len(names)
        change = max(np.abs(function(*move(*METHANE, rng)) - base).max() for move in mk.TRANSFORMS.values())
        assert (change <= 1e-8) == (name != "coordinates")


def test_native_kernels_agree_with_numpy(spark):
    z, r = METHANE
    df = spark.createDataFrame([(z.tolist(), r.ravel().tolist()), ([], []), (None, None)], "z array<int>, r array<double>")
    z_, r_ = F.col("z"), F.col("r")
    row = df.select(F.size(ar.bonds(z_, r_)).alias("b"), ar.radius_of_gyration(r_).alias("g"), ar.electronegativity_dipole(z_, r_).alias("d"), ar.coulomb_matrix(z_, r_).alias("m")).collect()
    assert row[0].b == 4 and row[0].g == pytest.approx(mk.geometry(r)[0]) and row[0].d == pytest.approx(0, abs=1e-9)
    assert np.linalg.eigvalsh(np.array(row[0].m)).sum() == pytest.approx(mk.coulomb_spectrum(z, r).sum())
    assert row[1].b == 0 and row[2].g is None


def test_ring_sizes():
    for n in (3, 4, 5, 6, 7):
        turn = np.arange(n) * 2 * np.pi / n
        radius = 1.5 / (2 * np.sin(np.pi / n))
        ring = np.stack([radius * np.cos(turn), radius * np.sin(turn), 0 * turn], 1)
        bonds = mk.bond_matrix(np.full(n, 6), ring)
        assert (mk.smallest_rings(bonds, np.full(n, True)) == n).all() and mk.ring_count(bonds) == 1


def test_equilibrated_charges_are_neutral():
    from tessera.operators.surroundings import one

    q = one(*METHANE).q
    assert q.sum() == pytest.approx(0, abs=1e-12) and q[0] < 0 and np.ptp(q[1:]) < 1e-9


def test_batched_descriptors_equal_single_ones():
    from tessera.operators.surroundings import described

    rng = np.random.default_rng(5)
    mols = [METHANE, (np.array([6]), np.zeros((1, 3))), (np.array([8, 1, 1]), np.array([[0, 0, 0], [0.96, 0, 0], [-0.24, 0.93, 0]]))]
    mols += [(rng.choice([1, 6, 7, 8, 9], n), rng.uniform(-2, 2, (n, 3))) for n in (2, 5, 12, 12, 29)]
    for name, (function, names) in mk.DESCRIPTORS.items():
        assert np.allclose(described(name, mols), np.stack([function(*m) for m in mols]), atol=1e-8), name
        assert described(name, mols).shape[1] == len(names)


def test_surroundings_by_hand_and_one_by_one(spark):
    from tessera.operators import features as ft
    from tessera.operators.surroundings import one, surroundings

    x = one(*METHANE).x
    at = {n: k for k, n in enumerate(mk.ATOM_FEATURES)}
    assert x[0, at["degree"]] == 4 and x[0, at["bonded_H"]] == 4 and (x[1:, at["shell2_H"]] == 3).all()
    assert x[0, at["angle_cos_mean"]] == pytest.approx(-1 / 3) and x[0, at["bond_vector_asymmetry"]] == pytest.approx(0, abs=1e-12)
    assert x[0, at["radial_H_1.44"]] == pytest.approx(4 * (math.cos(math.pi * 1.09 / 5) + 1) / 2 * math.exp(-((1.09 - mk.RADIAL_CENTRES[1]) ** 2) / 0.32))
    assert x[0, at["nuclear_potential"]] == pytest.approx(4 / 1.09)
    water = (np.array([8, 1, 1]), np.array([[0, 0, 0], [0.96, 0, 0], [-0.24, 0.93, 0]]))
    alone = (np.array([6]), np.zeros((1, 3)))
    mols = [METHANE, alone, water, METHANE]
    whole = surroundings(np.concatenate([m[0] for m in mols]), np.concatenate([m[1] for m in mols]), np.r_[0, np.cumsum([len(m[0]) for m in mols])])
    each = [one(*m) for m in mols]
    assert np.allclose(whole.x, np.concatenate([s.x for s in each])) and np.allclose(whole.rdf, np.concatenate([s.rdf for s in each]))
    assert (whole.groups == np.concatenate([s.groups for s in each])).all() and whole.qeq[1].tolist() == [0, 0, 0]
    rows = [(k, m[0].tolist(), m[1].ravel().tolist()) for k, m in enumerate(mols)] + [(9, None, None), (10, [6], [0.0]), (11, [2], [0.0] * 3)]
    got = {r.id: r for r in ft.environments(spark.createDataFrame(rows, "id bigint, z array<int>, r array<double>")).collect()}
    assert len(got[0].edges) == 8 and len(got[1].features) == 1 and got[9].features is None and got[10].edges is None and got[11].groups is None
    assert np.allclose(got[2].features, each[2].x) and [e.i for e in got[2].edges] == [0, 0, 1, 2]


def test_closed_form_equals_simulation():
    x = np.random.default_rng(0).uniform(-1, 1, (5, 4))
    z = qu.pauli_expectations(qu.statevectors(qu.encoding_circuit(4, 4), 4, x), 4)[:, 2]
    pair = np.cos(2 * (np.pi - x[:, :-1]) * (np.pi - x[:, 1:]))
    want = np.cos(2 * x)
    want[:, :-1] *= pair
    want[:, 1:] *= pair
    assert np.abs(z - want).max() < 1e-12
    k = qu.fidelity(s := qu.statevectors(qu.encoding_circuit(4, 2, "ry_rz"), 2, x), s)
    assert np.allclose(np.diag(k), 1) and np.allclose(k, k.T)


def test_folds_and_samples(spark):
    rows = spark.range(103).withColumn("g", (F.col("id") % 7).cast("string"))
    sizes = [r["count"] for r in sp.kfold(rows, "id", 5, "s").groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    folds = sp.group_kfold(rows, "g", 3, "s").groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in folds)
    taken = sp.sample_keeping_one(rows, "id", "g", 90, "s").groupBy("g").count().collect()
    whole = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    assert all(r["count"] < whole[r.g] for r in taken) and sum(r["count"] for r in taken) == 90
    with pytest.raises(ValueError):
        sp.sample_keeping_one(rows, "id", "g", 100, "s")


def test_raw_record(spark):
    from tessera.sources.records import parse_records

    text = "1\ngdb 7\t" + "\t".join(["1.5*^-6"] * 15) + "\nC\t0\t0\t1*^1\t-0.5\n100.0\t200.0\nC\tC\nI\tI\n"
    bad = [text.replace("gdb 7\t1.5", "gdb 7\tx"), text.replace("C\t0", "Xe\t0"), "", None, text.replace("\t-0.5", "")]
    got = parse_records(spark.createDataFrame([(text,), *[(b,) for b in bad]], "text string")).collect()
    assert got[0].error is None and got[0].id == 7 and got[0].mu == pytest.approx(1.5e-6) and list(got[0].r) == [0, 0, 10]
    assert [r.error for r in got[1:]] == ["bad property line", "unknown element", "short record", "short record", "bad atom line"]


def test_yeo_johnson_round(spark):
    from tessera.operators.scaling import fit_scaling

    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).lognormal(size=300)], "x double")
    scaled = fit_scaling(df, ["x"], "yeo_johnson").apply(df).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.skewness("x").alias("k")).first()
    assert abs(scaled.m) < 1e-9 and scaled.s == pytest.approx(1) and abs(scaled.k) < 0.3


def test_exact_quantiles_and_normal_scores(spark):
    from statistics import NormalDist

    from tessera.operators.scaling import fit_powers, normal_quantile

    rng = np.random.default_rng(3)
    values = np.r_[rng.standard_normal(500), np.zeros(300), rng.standard_normal(40) * 1e6]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", None), (None, 2.0)], "g string, v double")
    got = {r.g: r.q for r in st.quantiles_of(st.ordered_counts(df, ["g"], "v", bins=8), ["g"], "v", [0, 0.01, 0.25, 0.5, 0.999, 1]).collect()}
    assert got["a"] == pytest.approx(np.quantile(values, [0, 0.01, 0.25, 0.5, 0.999, 1]).tolist()) and got["b"] == [1.0] * 6
    p = [1e-7, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-6]
    z = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("z")).orderBy("p").collect()]
    assert z == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-8)
    sample = spark.createDataFrame([(float(v),) for v in rng.lognormal(size=400)], "x double")
    power = fit_powers(sample, ["x"])[0]
    x = np.array([r.x for r in sample.collect()])

    def likelihood(q):
        return -0.5 * np.log(np.var(((x + 1) ** q - 1) / q)) + (q - 1) * np.log1p(x).mean()

    assert all(likelihood(power) >= likelihood(power + step) - 1e-9 for step in (-0.01, -1e-3, 1e-3, 0.01))


def test_ridge_and_pls(spark):
    from tessera.operators.linear import fit_ridge, pls

    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.01 * rng.standard_normal(200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    w, b = fit_ridge(df, ["a", "b", "c"], "y", 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)) and b == pytest.approx(y.mean() - x.mean(0) @ w)
    means, rotation = pls(df, ["a", "b", "c"], "y", 2)
    scores = (x - means) @ rotation
    assert abs(scores[:, 0] @ scores[:, 1]) < 1e-8


def _charge_rows(rng, sizes=(3, 4)):
    edges = np.array([(0, 1, 1.0, 0.0, 0.0), (1, 0, -1.0, 0.0, 0.0), (1, 2, 0.0, 0.6, 0.8), (2, 1, 0.0, -0.6, -0.8)])
    return [(rng.standard_normal((n, 3)), (p := rng.standard_normal((n, 3))) - p.mean(0), rng.integers(0, 5, n), edges) for n in sizes]


@pytest.mark.parametrize("loss", ["mse", "mae", "huber"])
def test_latent_charge_gradients(loss):
    from tessera.operators.latent_charge import LatentCharge, Molecules

    rng = np.random.default_rng(1)
    model, g, y = LatentCharge(hidden=(4, 3), rounds=2, loss=loss), Molecules.of(_charge_rows(rng)), np.array([0.01, 0.2])
    weights = {k: v + 0.1 * rng.standard_normal(v.shape) for k, v in model.start(3).items()}
    _, found = model.gradient(weights, g, y)
    assert set(found) == set(weights)
    for name, slope in found.items():
        flat = weights[name].reshape(-1)
        for k in range(0, flat.size, 3):
            old = flat[k]
            sides = []
            for step in (1e-6, -1e-6):
                flat[k] = old + step
                sides.append(model.gradient(weights, g, y)[0])
            flat[k] = old
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(slope.reshape(-1)[k], rel=1e-4, abs=1e-6)


def test_latent_charge_symmetry_and_learning():
    from tessera.operators.latent_charge import ChargeEnsemble, LatentCharge

    rng = np.random.default_rng(2)
    rows = _charge_rows(rng, [4] * 60)
    true = np.array([0.7, -0.3, 0.2])
    y = np.array([np.linalg.norm((x @ true) @ pos) * 4.8032 for x, pos, _, _ in rows])
    model = LatentCharge(hidden=(), dipoles=False, least_steps=600, epochs=5, patience=500, rate_patience=500, rate=0.02).fit(rows, y)
    assert np.abs(model.predict(rows) - y).mean() < 0.2 * y.mean()
    turn = mk.rotation(rng)
    moved = [(x, pos @ turn.T, e, np.c_[edge[:, :2], edge[:, 2:] @ turn.T]) for x, pos, e, edge in rows]
    both = LatentCharge(hidden=(5,), rounds=1, least_steps=10, epochs=1, patience=1).fit(rows, y)
    assert np.abs(both.predict(moved) - both.predict(rows)).max() < 1e-9
    assert np.abs(both.dipole_vectors(moved) - both.dipole_vectors(rows) @ turn.T).max() < 1e-9
    assert max(abs(q.sum()) for q in both.charges(rows)) < 1e-9
    pair = ChargeEnsemble(LatentCharge(hidden=(), least_steps=10, epochs=1), 2).fit(rows, y)
    assert np.allclose(pair.predict(rows), (pair.members[0].predict(rows) + pair.members[1].predict(rows)) / 2)
    assert model.predict([]).shape == (0,) and model.charges([]) == []


def test_degrees_of_freedom_equal_the_trace():
    from tessera.operators.complexity import smoother_df
    from tessera.operators.linear import rbf

    x = np.random.default_rng(0).standard_normal((30, 4))
    x[:, 3] = x[:, 0] + x[:, 1]
    mean = np.full((30, 30), 1 / 30)
    k = rbf(x, x, 0.3)
    smooth = k @ np.linalg.inv(k + 0.1 * np.eye(30)) @ (np.eye(30) - mean) + mean
    assert smoother_df("rbf", x, 0.1, gamma=0.3) == pytest.approx(np.trace(smooth))
    c = x - x.mean(0)
    assert smoother_df("ridge", x, 2.0) == pytest.approx(1 + np.trace(c @ np.linalg.inv(c.T @ c + 2 * np.eye(4)) @ c.T))
    assert smoother_df("linear", x) == pytest.approx(4) and smoother_df("mean", x) == 1 and smoother_df("forest", x) is None


def test_catalog_is_consistent():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
