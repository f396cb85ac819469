"""Labelled-table operators, feature stores and atom subsets against brute force and awkward input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features as ft
from tessera.operators import molecule_kernels as mk
from tessera.operators import relational as rel
from tessera.operators import splits as sp
from tessera.sources import records, results

A = float(1.09 / np.sqrt(3))
METHANE = ([6, 1, 1, 1, 1], [0.0, 0.0, 0.0, A, A, A, -A, -A, A, -A, A, -A, A, -A, -A])
WATER = ([8, 1, 1], [0.0, 0.0, 0.0, 0.96, 0.0, 0.0, -0.24, 0.93, 0.0])


@pytest.fixture(scope="module")
def table(spark):
    rows = [(5, *METHANE), (2, *WATER), (9, [6], [0.0, 0.0, 0.0]), (7, None, None)]
    return spark.createDataFrame(rows, "id bigint, z array<int>, r array<double>")


def test_columns_bands_and_medians(spark):
    rows = [(k, float(k % 17), "ab"[k % 2]) for k in range(200)] + [(900, None, "a"), (901, 3.0, None)]
    df = spark.createDataFrame(rows, "id bigint, v double, g string")
    assert rel.select_named(df, ["g", "id"]).columns == ["g", "id"]
    with pytest.raises(ValueError, match="nope"):
        rel.select_named(df, ["nope"])
    v = np.array([r[1] for r in rows if r[1] is not None])
    low, high = np.quantile(v, [0.1, 0.9])
    assert rel.quantile_band(df, "v", 0.1, 0.9).count() == ((v >= low) & (v <= high)).sum()
    got = {r.id: r.m for r in rel.with_group_median(df, ["g"], "v", "m").collect()}
    assert got[0] == np.median([r[1] for r in rows if r[2] == "a" and r[1] is not None]) and got[901] is None and len(got) == 202
    assert [r.id for r in rel.in_groups_of(df, "g", 101).limit(1).collect()] and rel.in_groups_of(df, "g", 500).count() == 0


def test_orders_texts_and_sides(spark):
    df = spark.createDataFrame([("b", -3.0, "pls10"), ("a", 2.0, "pca"), (None, None, None), ("z", 1.0, "plsx")], "k string, v double, t string")
    assert [r.v for r in rel.by_size(df.dropna(), "v").collect()] == [-3.0, 2.0, 1.0]
    assert {r.k: r.o for r in df.select("k", rel.ordinal(F.col("k"), ["z", "b"]).alias("o")).collect()} == {"z": 1, "b": 2, "a": 3, None: 3}
    assert [r.n for r in df.select(rel.number_after(F.col("t"), "pls").alias("n")).collect()] == [10, None, None, None]
    text = [r.t for r in df.select(rel.plus_minus(F.col("v"), F.when(F.col("v") > 1, F.lit(0.25)), 2).alias("t")).collect()]
    assert text == ["-3.00", "2.00 ± 0.25", None, "1.00"]
    both = rel.concat_columns([df.select("k", "v"), spark.createDataFrame([("a", 1), ("q", 2)], "k string, w int")], "k")
    assert both.count() == 5 and rel.cross_section(df, "k", "a").columns == ["v", "t"]


def test_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (3, float("inf"))], "id int, v double")
    assert rel.finite_check(df, ["v"], "id").first().asDict() == {"column": "v", "rows": 4, "nulls": 1, "not_finite": 2, "keys": 3}
    got = {r.rule: (r.checked, r.violations) for r in rel.sampled_rules(df, ["id"], {"pos": F.col("v") > 0, "id": F.col("id") > 0}, 100, "s").collect()}
    assert got["id"] == (4, 0) and got["pos"][1] == 1
    assert rel.leaf_order([[1, 0.1, 0.9], [0.1, 1, 0.2], [0.9, 0.2, 1]]) == [0, 2, 1] and rel.leaf_order(np.zeros((0, 0))) == []
    running = rel.running_total(spark.range(50).withColumn("n", F.col("id") % 4), "id", "n", "t", width=8)
    assert {r.id: r.t for r in running.collect()} == {k: sum(j % 4 for j in range(k)) for k in range(50)}


def test_legal_features_and_frames(spark, table):
    ids = spark.createDataFrame([(5,), (2,)], "id bigint")
    names = ["max_distance", "n_H", "qeq_dipole_D", "cm_0"]
    got = {r.id: r for r in ft.legal_features(table, ids, names).collect()}
    z, r = np.array(WATER[0]), np.array(WATER[1]).reshape(-1, 3)
    assert got[2].n_H == 2 and got[2].max_distance == float(np.float32(mk.geometry(r)[4])) and got[2].cm_0 == float(np.float32(mk.coulomb_spectrum(z, r)[0]))
    with pytest.raises(KeyError):
        ft.legal_features(table, ids, ["nothing"])
    with pytest.raises(rel.MissingKeys):
        ft.legal_features(table, spark.createDataFrame([(1,)], "id bigint"), names)
    stored = spark.createDataFrame([(5, 1.5, 4.0, 0.0, 1.0)], "id bigint, max_distance double, n_H double, qeq_dipole_D double, cm_0 double")
    frame = {r.id: r.max_distance for r in ft.evaluation_frame(stored, table, ids, names).collect()}
    assert frame[5] == 1.5 and set(frame) == {5, 2}


def test_atoms_are_renumbered(spark, table):
    described = ft.load_atoms(table, spark.createDataFrame([(5,), (2,), (9,)], "id bigint"), ["centroid_distance", "degree", "unknown"])
    assert {len(x) for r in described.collect() for x in r.features} == {2}
    atoms, edges = ft.subset_atoms(described, spark.createDataFrame([(0, 2), (1, 9), (2, 5)], "pos bigint, id bigint"))
    assert [(r.row, r.id, r.element) for r in atoms.orderBy("row").collect()] == [(0, 2, 3), (1, 2, 1), (2, 2, 1), (3, 9, 0), (4, 5, 0), *[(k, 5, 1) for k in range(5, 9)]]
    assert {(r.i, r.j) for r in edges.collect()} == {(0, 1), (1, 0), (0, 2), (2, 0), *[(4, k) for k in range(5, 9)], *[(k, 4) for k in range(5, 9)]}
    with pytest.raises(rel.MissingKeys):
        ft.subset_atoms(described, spark.createDataFrame([(0, 77)], "pos bigint, id bigint"))


def test_stores_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1, [1.0, 2.0]), (1, 0.2, [3.0, 4.0])], "id bigint, v double, x array<double>")
    records.write_features(df.drop("x"), str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).orderBy("id").collect()
    assert [(r.id, r.v) for r in back] == [(1, float(np.float32(0.2))), (2, float(np.float32(0.1)))]
    records.write_npz(df, tmp_path / "a.npz", ["id"])
    loaded = np.load(tmp_path / "a.npz")
    assert loaded["id"].tolist() == [1, 2] and loaded["x"].tolist() == [[3, 4], [1, 2]]


def test_dictionary_and_sets(spark):
    assert records.data_dictionary(spark).count() == len(records.COLUMNS) and records.natural_role("n_c") == records.natural_role("a") == "structure" and records.natural_role("gap") == "computed"
    rows = [("n_C", "composition", "molecule", True, 0), ("rg", "engineered", "molecule", True, 5), ("x", "engineered", "molecule", False, 2), ("cm_0", "cm", None, True, 1), ("gap", "dft_property", "molecule", True, 3), ("degree", "atom", "atom", True, 1), ("is_C", "atom", "atom", True, 9)]
    catalog = spark.createDataFrame(rows, "feature string, block string, level string, kept boolean, ord int")
    got = {r.name: list(r.features) for r in results.feature_sets(catalog).collect()}
    assert got == {"composition": ["n_C"], "cm": ["cm_0"], "structure": ["n_C", "rg"], "structure+": ["n_C", "rg"], "all_legal": ["n_C", "rg", "cm_0"], "structure+dft": ["n_C", "rg", "gap"]}
    assert results.atom_feature_names(catalog) == ["is_C", "degree"]


def test_sets_of_ids(spark):
    rows = [("pool", 3), ("dev", 1), ("dev_unseen", 2), ("test_unseen", 9), ("pool", 3)] + [("test_unseen_q", k) for k in range(30)]
    members = spark.createDataFrame(rows, "set_name string, id bigint")
    assert [r.id for r in sp.development_ids(members).collect()] == [1, 2, 3]
    some = sp.select_test_molecules(members, ["test_unseen_q", "test_unseen"], 4, "s")
    assert [r["count"] for r in some.groupBy("subset").count().orderBy("subset").collect()] == [1, 4]
    assert some.exceptAll(sp.select_test_molecules(members.repartition(5), ["test_unseen_q", "test_unseen"], 4, "s")).count() == 0
