"""Queries of splits, scalings, models, quantum features and costs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.operators import linear as ln
from tessera.operators import quantum as qu
from tessera.operators import scaling as sc
from tessera.operators import splits as sp
from tessera.plans.views import M, molecules, rounded, table

S, D = SparkSession, str
FEATURES = ["n_c", "n_h", "n_n", "n_o", "n_f", "alpha", "zpve", "cv"]


def _frame(spark: S, d: D) -> DataFrame:
    """Regression frame (id, FEATURES, mu) of the molecules without nulls."""
    from tessera.functions.composition import ELEMENTS

    m = molecules(spark, d, "mu", "alpha", "zpve", "cv")
    count = lambda k: F.size(F.filter("z", lambda v: v == k)).cast("double")
    return m.select("id", *[count(k).alias(f"n_{s.lower()}") for s, k in ELEMENTS], "alpha", "zpve", "cv", "mu").dropna()


# splits


def q34_stratified_holdout(spark: S, d: D) -> DataFrame:
    return sp.choose_groups(molecules(spark, d, "n_heavy"), "f", "n_heavy", 0.15, "7:unseen")


def q35_keep_one_sample(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d).select("id", "f").where("f is not null")
    return sp.sample_keeping_one(m, "id", "f", 200, "7:familiar").select("id")


def q36_kfold(spark: S, d: D) -> DataFrame:
    return sp.kfold(molecules(spark, d).select("id"), "id", 5, "cv").select("id", "fold")


def q37_group_kfold(spark: S, d: D) -> DataFrame:
    return sp.group_kfold(molecules(spark, d).select("id", "f"), "f", 5, "cv").select("id", "fold")


def q38_nested_sets(spark: S, d: D) -> DataFrame:
    """Sizes of the stored training sets of every build, revision and seed, at the build's own sizes."""
    from tessera.operators.relational import latest

    order = table(spark, d, "train_order").where("build_id is not null and pos is not null and id is not null").select("build_id", "revision", "seed", "pos", "id").distinct()
    sizes = latest(table(spark, d, "split_build").where("build_id is not null").select("build_id", "train_sizes", "written_at"), ["build_id"], ["written_at"]).select("build_id", "train_sizes")
    sets = order.join(sizes, "build_id").withColumn("n_train", F.explode(F.filter("train_sizes", lambda n: F.col("pos") < n)))
    return sets.groupBy("build_id", "revision", "seed", "n_train").agg(F.count("*").alias("n"))


def q39_stored_overlaps(spark: S, d: D) -> DataFrame:
    """Ids that a build stores in several main sets, and small sets' ids that are not in their parent: counts per build."""
    rows = table(spark, d, "split_set").select("build_id", "set_name", "id").distinct()
    main = rows.where(F.col("set_name").isin(sp.MAIN)).groupBy("build_id", "id").agg(F.count("*").alias("k"))
    shared = main.groupBy("build_id").agg(F.count_if(F.col("k") > 1).alias("shared"))
    out = shared
    for small in ("test_unseen", "test_familiar"):
        parent = rows.where(F.col("set_name") == small).select("build_id", "id")
        lost = rows.where(F.col("set_name") == f"{small}_q").join(parent, ["build_id", "id"], "left_anti").groupBy("build_id").agg(F.count("*").alias(f"outside_{small}"))
        out = out.join(lost, "build_id", "left")
    return out.na.fill(0)


def q39_split_checks(spark: S, d: D) -> DataFrame:
    """Splits built from all molecules and checked: all counts are 0."""
    m = molecules(spark, d, "n_heavy").where("f is not null").select("id", F.col("f").alias("formula"), "n_heavy")
    config = sp.SplitConfig(dev_size=20, train_sizes=[20, 50, 100], track_b_sizes=[20], n_familiar_formulas=5)
    none = m.where("false").select("id")
    return sp.check_splits(sp.build_splits(m, config), m, none)


def q40_fill_order(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d).select("id", "f").where("f is not null")
    anchored = m.groupBy("f").agg(F.count("*").alias("n")).where("n >= 20").select("f")
    return sp.fill_order(m, "id", "f", anchored, "7:0")


def q40_holdout(spark: S, d: D) -> DataFrame:
    return sp.holdout(molecules(spark, d).select("id"), "id", "hold").select("id", "validation")


# scalings


def q41_standardize_clip(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(sc.fit_scaling(rows, ["l_extendedprice", "l_quantity"], "standard").apply(rows))


def q41_robust(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(sc.fit_scaling(rows, ["l_extendedprice", "l_quantity"], "robust").apply(rows))


def q42_skewed_log(spark: S, d: D) -> DataFrame:
    rows = molecules(spark, d, "mu", "r2").select("id", "mu", "r2")
    return rounded(sc.fit_scaling(rows, ["mu", "r2"], "log_standard", 0.5).apply(rows))


def q42_yeo_johnson(spark: S, d: D) -> DataFrame:
    rows = molecules(spark, d, "mu", "r2").select("id", "mu", "r2")
    return sc.fit_scaling(rows, ["mu", "r2"], "yeo_johnson").apply(rows)


def q42_quantile_normal(spark: S, d: D) -> DataFrame:
    rows = molecules(spark, d, "mu").select("id", "mu")
    return sc.fit_scaling(rows, ["mu"], "quantile_normal").apply(rows)


def q43_targets(spark: S, d: D) -> DataFrame:
    """Standardized transformed targets, and predictions brought back: 0.5 standard deviations above each mean, clipped at 0."""
    m = molecules(spark, d, "mu").where("mu >= 0")
    out = [F.col("id")]
    for name in ("standard", "sqrt", "log1p"):
        centre, scale = sc.fit_target(m, "mu", name)
        z = (sc.target_forward(name, F.col("mu")) - centre) / scale
        out += [z.alias(name), sc.clip_predictions(sc.target_inverse(name, (z - 1) * scale + centre)).alias(f"{name}_back")]
    return rounded(m.select(*out))


# models


def q52_least_squares(spark: S, d: D) -> DataFrame:
    w, b = ln.fit_ridge(_frame(spark, d), ["alpha"], "mu", 0.0)
    return rounded(spark.createDataFrame([("alpha", float(w[0])), ("intercept", b)], "term string, value double"))


def q53_pca(spark: S, d: D) -> DataFrame:
    """Squared length of each row's scores on all components, which is its squared distance from the mean."""
    rows = _frame(spark, d)
    means, rotation, _ = ln.pca(rows, FEATURES, len(FEATURES))
    scores = ln.project(rows, FEATURES, means, rotation)
    return rounded(scores.select("id", sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(len(FEATURES))), F.lit(0.0)).alias("squares")), 4)


def _training_sets(spark: S, d: D, n: int) -> DataFrame:
    order = sp.hashed_rank(_frame(spark, d).select("id"), sp.draw("train:0", "id"), "n").select("id", (F.col("n") - 1).alias("pos"))
    return sp.nested_sets(order, [n]).select(F.lit(0).alias("seed"), "n_train", "id")


def q57_tune(spark: S, d: D) -> DataFrame:
    """A learning curve of the model roster on nested training sets: least pooled error of each model's grid."""
    from tessera.operators import pipelines as pl

    specs = lambda seed, name: pl.roster(len(FEATURES), target="sqrt")
    sets = _training_sets(spark, d, 50).unionByName(_training_sets(spark, d, 100))
    return pl.curve_table(pl.learning_curve(_frame(spark, d), sets, {"all": FEATURES}, "mu", specs))


def q57_dev_curve(spark: S, d: D) -> DataFrame:
    from tessera.operators import evaluation as ev

    rows = _frame(spark, d)
    sets = _training_sets(spark, d, 200)
    held = rows.join(sets, "id", "left_anti").select("id")
    return ev.dev_curve(rows, sets, {"rest": held}, FEATURES, "mu", {"mean": ev.mean_fitter, "ridge": ev.ridge_fitter(1.0), "forest": ev.tree_fitter(trees=5, depth=4)})


def q57_permutation_importance(spark: S, d: D) -> DataFrame:
    rows = _frame(spark, d)
    w, b = ln.fit_ridge(rows, FEATURES, "mu", 1.0)
    return ln.permutation_importance(rows, FEATURES, w, b, "mu", repeats=2)


def q57_rank_features(spark: S, d: D) -> DataFrame:
    from tessera.operators.statistics import rank_features

    return rank_features(_frame(spark, d), FEATURES, "mu")


def q57_spectrum(spark: S, d: D) -> DataFrame:
    """Effective dimension of the features: participation ratio, components for 95 %, condition number, largest inflation."""
    import numpy as np

    from tessera.operators import statistics as st

    _, _, cov = st.moments_matrix(_frame(spark, d), ["alpha", "zpve", "cv"])
    l = np.linalg.eigvalsh(cov)
    row = (round(st.participation_ratio(l), 6), st.components_for_share(l, 0.95), round(st.condition_number(l), 3), round(float(st.variance_inflation(cov).max()), 6))
    return spark.createDataFrame([row], "participation double, components int, condition double, inflation double")


# quantum features


def _angles(scale: float, k: int = 4) -> list:
    return [F.get("embedding", F.lit(i)).cast("double") * scale for i in range(k)]


def q20_zz_readout(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rounded(rows.select("vec_id", *[c.alias(f"z{k}") for k, c in enumerate(qu.zz_readout(_angles(2.0)))]))


def q20_zz_simulated(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.array(*_angles(1.0)).alias("x"))
    found = qu.transform(rows, "vec_id", "x", 4, 4, 2.0)
    return rounded(found.select("vec_id", *[F.get("features", F.lit(k)).alias(f"z{k}") for k in range(4)]))


def q20_ry_rz(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.array(*_angles(1.0)).alias("x"))
    return qu.transform(rows, "vec_id", "x", 4, qu.default_qubits("ry_rz", 4), 2.0, "ry_rz", paulis="xyz")


def _queries(spark: S, d: D) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "embedding")


def q31_rbf_gram(spark: S, d: D) -> DataFrame:
    """The query vectors (ids divisible by 100) against all vectors."""
    every = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(qu.rbf_pairs(_queries(spark, d), every, "embedding", 0.5))


def q32_target_alignment(spark: S, d: D) -> DataFrame:
    """Centred alignment of the query vectors' kernel rows, against all vectors, with the products of a target."""
    every = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    gram = qu.rbf_pairs(_queries(spark, d), every, "embedding", 0.5)
    y = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("y"))
    return rounded(qu.target_alignment(gram, y))


def q33_offdiagonal(spark: S, d: D) -> DataFrame:
    """Of the query vectors' kernel values with all other vectors."""
    every = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(qu.offdiagonal_stats(qu.rbf_pairs(_queries(spark, d), every, "embedding", 0.5)))


def q50_cost_model(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(F.lit("fidelity"), F.lit("projected"), F.lit("z_readout")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("model"), F.col("p_size").cast("bigint").alias("n"))
    train, new = qu.circuits_needed(F.col("model"), F.col("n"), F.col("n") * 2)
    return rounded(rows.select("p_partkey", train.alias("train"), new.alias("new"), qu.qpu_seconds(train, F.lit(1000), F.lit(5e-6)).alias("seconds")))


def q51_mitigation(spark: S, d: D) -> DataFrame:
    x = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return rounded(table(spark, d, "embeddings").select("vec_id", qu.depolarizing_mitigation(x, 1 - x, 3).alias("overlap")))


def q56_shots(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.cos(F.get("embedding", F.lit(0)).cast("double")).alias("z"))
    return qu.shot_estimates(rows, ["vec_id"], "z", 1000, 7)


def q56_model_names(spark: S, d: D) -> DataFrame:
    name = F.concat_ws("@", F.col("event_type"), (F.col("user_id") % 5).cast("string"))
    base, shots = qu.split_model_name(name)
    return table(spark, d, "events").groupBy(base.alias("base"), shots.alias("shots")).agg(F.count("*").alias("n"))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q") and callable(f) and name[1].isdigit()}


def _scaled(columns: dict[str, str], source: str, keys: str) -> str:
    cells = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN round(greatest(least({e}, 10), -10), 6) + 0.0 END AS {c}" for c, e in columns.items())
    return f"SELECT {keys}, {cells} FROM {source}"


_A = [f"embedding[{k + 1}]::DOUBLE * 2" for k in range(4)]
_PAIR = [f"cos(2 * (pi() - {a}) * (pi() - {b}))" for a, b in zip(_A, _A[1:])]
_Z = [" * ".join([f"cos(2 * {a})", *([_PAIR[k - 1]] if k else []), *([_PAIR[k]] if k < 3 else [])]) for k, a in enumerate(_A)]
_ZZ = "SELECT vec_id, " + ", ".join(f"round({z}, 6) + 0.0 AS z{k}" for k, z in enumerate(_Z)) + " FROM embeddings"
_GRAM = "SELECT a.vec_id AS i, b.vec_id AS j, exp(-0.5 * list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS k FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
_SKEW = "CASE WHEN abs((SELECT avg((v - m) ** 3) / pow(avg((v - m) ** 2), 1.5) FROM (SELECT {c} AS v, avg({c}) OVER () AS m FROM b WHERE {c} IS NOT NULL))) > 0.5 THEN sign({c}) * ln(1 + abs({c})) ELSE {c} END"

SQL = {
    "q34_stratified_holdout": f"WITH {M}, g AS (SELECT f, min(n_heavy) AS n_heavy FROM m WHERE f IS NOT NULL GROUP BY f), r AS (SELECT *, row_number() OVER (PARTITION BY n_heavy ORDER BY md5('7:unseen:' || f)) AS n, count(*) OVER (PARTITION BY n_heavy) AS c FROM g) SELECT f FROM r WHERE n <= floor(c * 0.15 + 0.5)",
    "q35_keep_one_sample": f"WITH {M}, r AS (SELECT id, md5('7:familiar:' || id) AS h, row_number() OVER (PARTITION BY f ORDER BY md5('7:familiar:' || id)) AS n, count(*) OVER (PARTITION BY f) AS c FROM m WHERE f IS NOT NULL) SELECT id FROM r WHERE n < c ORDER BY h LIMIT 200",
    "q36_kfold": f"WITH {M} SELECT id, ((row_number() OVER (ORDER BY md5('cv:' || id)) - 1) % 5)::INT AS fold FROM m",
    "q37_group_kfold": f"WITH {M} SELECT id, (('0x' || substr(md5('cv:' || f), 1, 8))::BIGINT % 5)::INT AS fold FROM m",
    "q38_nested_sets": """WITH o AS (SELECT DISTINCT build_id, revision, seed, pos, id FROM train_order WHERE build_id IS NOT NULL AND pos IS NOT NULL AND id IS NOT NULL), b AS (SELECT build_id, unnest(train_sizes) AS n_train FROM (SELECT * FROM split_build WHERE build_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY written_at) = 1))
 SELECT build_id, revision, seed, n_train, count(*) AS n FROM o JOIN b USING (build_id) WHERE pos < n_train GROUP BY ALL""",
    "q39_stored_overlaps": """WITH r AS (SELECT DISTINCT build_id, set_name, id FROM split_set), k AS (SELECT build_id, id, count(*) AS k FROM r WHERE set_name IN ('pool','test_unseen','test_familiar','dev','dev_unseen') GROUP BY 1, 2)
 SELECT build_id, count(*) FILTER (k > 1) AS shared,
 (SELECT count(*) FROM r q WHERE q.build_id = k.build_id AND q.set_name = 'test_unseen_q' AND q.id NOT IN (SELECT id FROM r p WHERE p.build_id = q.build_id AND p.set_name = 'test_unseen')) AS outside_test_unseen,
 (SELECT count(*) FROM r q WHERE q.build_id = k.build_id AND q.set_name = 'test_familiar_q' AND q.id NOT IN (SELECT id FROM r p WHERE p.build_id = q.build_id AND p.set_name = 'test_familiar')) AS outside_test_familiar
 FROM k GROUP BY build_id""",
    "q40_fill_order": f"""WITH {M}, p AS (SELECT id, f FROM m WHERE f IS NOT NULL), g AS (SELECT f FROM p GROUP BY f HAVING count(*) >= 20),
 a AS (SELECT id FROM p JOIN g USING (f) QUALIFY row_number() OVER (PARTITION BY f ORDER BY md5('7:0:anchor:' || id)) = 1), n AS (SELECT count(*) AS n FROM a)
 SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, true AS is_anchor FROM a UNION ALL SELECT row_number() OVER (ORDER BY md5('7:0:' || id)) - 1 + n, id, false FROM p, n WHERE id NOT IN (SELECT id FROM a)""",
    "q40_holdout": f"WITH {M} SELECT id, row_number() OVER (ORDER BY md5('hold:' || id)) <= least(5000, greatest(10, round_even(0.1 * (SELECT count(*) FROM m), 0))) AS validation FROM m",
    "q41_standardize_clip": _scaled({c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in ("l_extendedprice", "l_quantity")}, "lineitem", "l_orderkey, l_linenumber"),
    "q41_robust": "WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_b, quantile_cont({c}, 0.75) AS {c}_c" for c in ("l_extendedprice", "l_quantity")) + " FROM lineitem) " + _scaled({c: f"({c} - {c}_b) / ({c}_c - {c}_a)" for c in ("l_extendedprice", "l_quantity")}, "lineitem, q", "l_orderkey, l_linenumber"),
    "q42_skewed_log": f"WITH {M}, b AS (SELECT id, mu, r2 FROM m), t AS (SELECT id, {_SKEW.format(c='mu')} AS mu, {_SKEW.format(c='r2')} AS r2 FROM b) " + _scaled({c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in ("mu", "r2")}, "t", "id"),
    "q43_targets": f"""WITH {M}, k AS (SELECT id, mu, sqrt(mu) AS s, ln(1 + mu) AS l FROM m WHERE mu >= 0 AND z IS NOT NULL), f AS (SELECT avg(mu) AS m1, stddev_pop(mu) AS d1, avg(s) AS m2, stddev_pop(s) AS d2, avg(l) AS m3, stddev_pop(l) AS d3 FROM k)
 SELECT id, round((mu - m1) / d1, 6) + 0.0 AS standard, round(greatest(mu - d1, 0), 6) AS standard_back, round((s - m2) / d2, 6) + 0.0 AS sqrt, round(greatest(s - d2, 0) ** 2, 6) AS sqrt_back, round((l - m3) / d3, 6) + 0.0 AS log1p, round(greatest(exp(l - d3) - 1, 0), 6) AS log1p_back FROM k, f""",
    "q53_pca": f"WITH {M}, k AS (SELECT id, alpha, zpve, cv, " + ", ".join(f"len(list_filter(z, lambda x: x = {n})) AS n{n}" for n in (6, 1, 7, 8, 9)) + " FROM m WHERE z IS NOT NULL AND mu IS NOT NULL AND alpha IS NOT NULL AND zpve IS NOT NULL AND cv IS NOT NULL) SELECT id, round(" + " + ".join(f"({c} - avg({c}) OVER ()) ** 2" for c in ("n6", "n1", "n7", "n8", "n9", "alpha", "zpve", "cv")) + ", 4) AS squares FROM k",
    "q57_spectrum": f"""WITH {M}, k AS (SELECT alpha AS a, zpve AS b, cv AS c FROM m WHERE z IS NOT NULL AND mu IS NOT NULL AND alpha IS NOT NULL AND zpve IS NOT NULL AND cv IS NOT NULL),
 s AS (SELECT var_pop(a) AS xx, var_pop(b) AS yy, var_pop(c) AS zz, covar_pop(a, b) AS xy, covar_pop(a, c) AS xz, covar_pop(b, c) AS yz, corr(a, b) AS p, corr(a, c) AS q_, corr(b, c) AS r FROM k),
 t AS (SELECT *, (xx + yy + zz) / 3 AS m, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS w FROM s),
 u AS (SELECT *, acos(greatest(least(((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * w ** 3), 1), -1)) / 3 AS f FROM t),
 e AS (SELECT *, m + 2 * w * cos(f) AS l1, m + 2 * w * cos(f + 4 * pi() / 3) AS l2, m + 2 * w * cos(f + 2 * pi() / 3) AS l3 FROM u)
 SELECT round((l1 + l2 + l3) ** 2 / (l1 * l1 + l2 * l2 + l3 * l3), 6) AS participation, CASE WHEN l1 >= 0.95 * 3 * m THEN 1 WHEN l1 + l2 >= 0.95 * 3 * m THEN 2 ELSE 3 END AS components, round(sqrt(l1 / l3), 3) AS condition,
 round(greatest(1 - r * r, 1 - q_ * q_, 1 - p * p) / (1 + 2 * p * q_ * r - p * p - q_ * q_ - r * r), 6) AS inflation FROM e""",
    "q52_least_squares": f"WITH {M}, r AS (SELECT * FROM m WHERE mu IS NOT NULL AND alpha IS NOT NULL AND zpve IS NOT NULL AND cv IS NOT NULL) SELECT 'alpha' AS term, round(regr_slope(mu, alpha), 6) AS value FROM r UNION ALL SELECT 'intercept', round(regr_intercept(mu, alpha), 6) FROM r",
    "q20_zz_readout": _ZZ,
    "q20_zz_simulated": _ZZ,
    "q31_rbf_gram": f"WITH g AS ({_GRAM}) SELECT i, j, round(k, 6) AS k FROM g",
    "q32_target_alignment": f"""WITH g AS ({_GRAM}), c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS c FROM g),
 y AS (SELECT vec_id, embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER () AS t FROM embeddings)
 SELECT round(sum(c * a.t * b.t) / sqrt(sum(c * c) * sum((a.t * b.t) ** 2)), 6) AS alignment FROM c JOIN y a ON a.vec_id = i JOIN y b ON b.vec_id = j""",
    "q33_offdiagonal": f"WITH g AS ({_GRAM}) SELECT round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS std, round(min(k), 6) AS min, round(max(k), 6) AS max FROM g WHERE i <> j",
    "q50_cost_model": """WITH r AS (SELECT p_partkey, p_partkey % 3 AS t, p_size::BIGINT AS n FROM part), c AS (SELECT p_partkey, CASE t WHEN 0 THEN n * (n - 1) // 2 WHEN 1 THEN 3 * n ELSE n END AS train, CASE t WHEN 0 THEN n * n * 2 WHEN 1 THEN 6 * n ELSE 2 * n END AS "new" FROM r)
 SELECT p_partkey, train, "new", round(train * 1000 * (5e-6 + 2e-6 + 250e-6), 6) AS seconds FROM c""",
    "q51_mitigation": "WITH r AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS x FROM embeddings), l AS (SELECT *, least(greatest((1 - x - 0.125) / 0.875, 1e-3), 1) AS l FROM r) SELECT vec_id, round(least(greatest((x - (1 - l) * 0.125) / l, 0), 1), 6) AS overlap FROM l",
    "q56_model_names": "SELECT event_type AS base, (user_id % 5)::INT AS shots, count(*) AS n FROM events GROUP BY 1, 2",
}
