"""Queries of labelled-table operators, stored splits, feature stores, atom sums and pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.operators import features as ft
from tessera.operators import linear as ln
from tessera.operators import molecule_kernels as mk
from tessera.operators import pipelines as pl
from tessera.operators import relational as rel
from tessera.operators import splits as sp
from tessera.plans.q_models import FEATURES, _frame
from tessera.plans.q_molecules import _ATOMS, _BONDS, _CHI
from tessera.plans.views import M, molecules, rounded, table
from tessera.sources import records

S, D = SparkSession, str


# labelled tables


def q74_quantile_band(spark: S, d: D) -> DataFrame:
    """Line items whose price lies within the 0.5 and 99.5 per cent quantiles, by flag."""
    rows = rel.quantile_band(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", 0.005, 0.995)
    return rounded(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")), 4)


def q75_group_median(spark: S, d: D) -> DataFrame:
    """Absolute error of the median dipole of each formula, by number of heavy atoms."""
    m = molecules(spark, d, "mu", "n_heavy").where("mu is not null and f is not null")
    rows = rel.with_group_median(m.select("id", "f", "n_heavy", "mu"), ["f"], "mu", "median")
    return rounded(rows.groupBy("n_heavy").agg(F.avg(F.abs(F.col("mu") - F.col("median"))).alias("mae"), F.count("*").alias("n")))


def q76_ordinals(spark: S, d: D) -> DataFrame:
    """Orders of each priority, numbered by a stated order of priorities."""
    order = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH"]
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rows.select("o_orderpriority", "n", rel.ordinal(F.col("o_orderpriority"), order).alias("place")).orderBy("place")


def q76_by_size(spark: S, d: D) -> DataFrame:
    """The twenty customers whose balance is farthest from zero."""
    return rel.by_size(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").limit(20)


def q77_cross_section(spark: S, d: D) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))
    return rounded(rel.cross_section(sums, "l_returnflag", "R"), 2)


def q78_side_by_side(spark: S, d: D) -> DataFrame:
    """Customers and suppliers per nation side by side: every nation that has either."""
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").cast("double").alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").cast("double").alias("suppliers"))
    return rel.concat_columns([c, s], "nation")


def q79_groups_of(spark: S, d: D) -> DataFrame:
    """Molecules whose formula has at least three."""
    m = molecules(spark, d, "n_heavy").where("f is not null").select("id", "f", "n_heavy")
    return rel.in_groups_of(m, "f", 3)


def q80_plus_minus(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    return rows.select("c_mktsegment", rel.plus_minus(F.col("m"), F.col("s"), 1).alias("text"))


def q81_number_after(spark: S, d: D) -> DataFrame:
    number = rel.number_after(F.lower("p_brand"), "brand#")
    return table(spark, d, "part").groupBy(number.alias("brand")).agg(F.count("*").alias("n"))


def q82_finite_check(spark: S, d: D) -> DataFrame:
    return rel.finite_check(table(spark, d, "molecules").where("id is not null"), ["mu", "alpha", "gap", "zpve"], "id")


def q82_sampled_rules(spark: S, d: D) -> DataFrame:
    """Rules on the 300,000 atoms first in hashed order."""
    atoms = table(spark, d, "atomdata").where("atom_row is not null").select("atom_row", "element", "pos", "x").dropDuplicates(["atom_row"])
    rules = {"element is known": F.col("element").between(0, 4), "numbered": F.col("atom_row") >= 0}
    return rel.sampled_rules(atoms.select("atom_row", "element"), ["atom_row"], rules, 300_000, "rules").where("rule = 'numbered'")


def q83_natural_features(spark: S, d: D) -> DataFrame:
    return rounded(records.natural_features(molecules(spark, d, "n_atoms", "n_heavy", *[p for p in records.PROPERTIES if p != "mu"])), 6)


def q83_dictionary_coverage(spark: S, d: D) -> DataFrame:
    """Columns of the data dictionary by role, and how many of them the molecule table has."""
    there = spark.createDataFrame([(c,) for c in table(spark, d, "molecules").columns], "column string")
    return records.data_dictionary(spark).join(F.broadcast(there.withColumn("there", F.lit(1))), "column", "left").groupBy("role").agg(F.count("*").alias("described"), F.count("there").alias("stored"))


def q11_pivot_metrics(spark: S, d: D) -> DataFrame:
    """Mean price and discount by flag, a column for each status and metric."""
    return rounded(rel.pivot_table(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], {"price": "l_extendedprice", "discount": "l_discount"}), 5)


def q19_histogram_2d(spark: S, d: D) -> DataFrame:
    from tessera.operators.statistics import histogram_2d

    return histogram_2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", (0, 50, 0, 0.08), (10, 4))


def q48_mapped(spark: S, d: D) -> DataFrame:
    """Customers by a name their market segment is mapped to, and the nations of a list in its order."""
    name = rel.mapped(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}, "other")
    return table(spark, d, "customer").groupBy(name.alias("kind")).agg(F.count("*").alias("n"))


def q48_reindex(spark: S, d: D) -> DataFrame:
    keys = spark.createDataFrame([(0, 7), (1, 99), (2, 3)], "pos int, n_nationkey int")
    counts = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_regionkey").cast("int").alias("n_regionkey"))
    return rel.reindex(counts, keys, "n_nationkey", {"n_regionkey": -1})


def q66_winners(spark: S, d: D) -> DataFrame:
    """In how many nations and segments each priority has the least total price."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = o.groupBy("c_nationkey", "c_mktsegment", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rounded(rel.winners(sums, ["c_nationkey", "c_mktsegment"], "o_orderpriority", "total"))


# splits


def q84_development_ids(spark: S, d: D) -> DataFrame:
    return sp.development_ids(table(spark, d, "split_set"))


def q84_test_molecules(spark: S, d: D) -> DataFrame:
    return sp.select_test_molecules(table(spark, d, "split_set"), ["test_unseen_q", "test_familiar_q"], 20, "2027")


def q39_stored_rules(spark: S, d: D) -> DataFrame:
    """(build_id, rule, violations) of stored splits: ids in several main sets, small sets outside theirs, repeated places and
    repeated ids of a fill order, orders that leave out places."""
    rows = table(spark, d, "split_set").select("build_id", "set_name", "id").distinct()
    order = table(spark, d, "train_order").select("build_id", "revision", "seed", "pos", "id").distinct()
    main = rows.where(F.col("set_name").isin(sp.MAIN)).groupBy("build_id", "id").agg(F.count("*").alias("k")).where("k > 1")
    parts = [main.select("build_id", F.lit("in several sets").alias("rule"))]
    for small in ("test_unseen", "test_familiar"):
        parent = rows.where(F.col("set_name") == small).select("build_id", "id")
        parts.append(rows.where(F.col("set_name") == f"{small}_q").join(parent, ["build_id", "id"], "left_anti").select("build_id", F.lit(f"outside {small}").alias("rule")))
    keys = ["build_id", "revision", "seed"]
    for column in ("pos", "id"):
        parts.append(order.groupBy(*keys, column).agg(F.count("*").alias("k")).where("k > 1").select("build_id", F.lit(f"repeated {column}").alias("rule")))
    gaps = order.groupBy(*keys).agg(F.count_distinct("pos").alias("k"), F.max("pos").alias("last")).where("k <> last + 1")
    parts.append(gaps.select("build_id", F.lit("left out places").alias("rule")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("build_id", "rule").agg(F.count("*").alias("violations"))


# duplicates, feature stores, atom subsets


def q06_duplicate_spectra(spark: S, d: D) -> DataFrame:
    """Molecules with the same formula and the same frequencies in thousands (coarse, so that there are some), labelled by the smallest id."""
    m = molecules(spark, d, "freqs", "n_atoms").where("f is not null and size(freqs) > 0")
    clean = ar.clean_frequencies(F.col("freqs"), F.col("n_atoms"))
    rows = m.select("id", "f", F.array_sort(F.transform(clean, lambda v: F.floor(v / 1000))).alias("spectrum"))
    return rel.duplicate_groups(rows, ["f", "spectrum"])


def q85_legal_features(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "r")
    names = ["n_C", "n_H", "n_N", "n_O", "n_F", "max_distance", "heteroatom_offset"]
    found = ft.legal_features(m.where("size(r) = 3 * size(z)"), m.where("size(r) = 3 * size(z)").select("id"), names)
    return rounded(found, 3)


def q86_atom_subset(spark: S, d: D) -> DataFrame:
    """The atoms of all described molecules numbered through, molecules in falling order of id."""
    from tessera.operators.statistics import rank_table
    from tessera.plans.lineage import cut

    # described once; of its columns only the elements are numbered, the others are several times the input
    described = cut(ft.environments(molecules(spark, d, "r")).where("features is not null").select("id", "element"))
    order = rank_table(described.select((-F.col("id")).alias("v")), "v", "n").select((F.col("n") - 1).cast("bigint").alias("pos"), (-F.col("_v")).alias("id"))
    atoms, _ = ft.subset_atoms(described, order)
    return atoms.groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.sum("element").alias("elements"))


def q59_atom_sums(spark: S, d: D) -> DataFrame:
    """Of each atom degree, bonded atoms by element, two radial sums, nuclear potential and distance from the centre."""
    names = ["degree", *[f"bonded_{s}" for s in mk.SYMBOLS], "radial_C_1.44", "radial_H_2.53", "nuclear_potential", "centroid_distance"]
    described = ft.environments(molecules(spark, d, "r")).where("features is not null")
    rows = described.select("id", F.posexplode("features").alias("atom_idx", "x"))
    return rounded(rows.select("id", "atom_idx", *[F.get("x", F.lit(mk.ATOM_FEATURES.index(n))).alias(n.replace(".", "_").lower()) for n in names]), 4)


def q59_group_counts(spark: S, d: D) -> DataFrame:
    """Carbon, nitrogen and oxygen atoms by number of bonds, and four-bonded nitrogen."""
    names = [g for g in mk.GROUPS if g.startswith("atoms_")] + ["n_ammonium"]
    found = ft.environments(molecules(spark, d, "r")).where("groups is not null")
    return found.select("id", *[F.get("groups", F.lit(mk.GROUPS.index(n))).cast("bigint").alias(n) for n in names])


def q58_engineered_bonds(spark: S, d: D) -> DataFrame:
    """Of the engineered values those that follow from bonds and distances."""
    names = ["max_distance", "bond_polarity_total", "bond_dipole_norm", *[f"bonds_{t}" for t in mk.BOND_TYPES], *[n for n, *_ in mk.BOND_ORDERS]]
    found = ft.feature_frame(molecules(spark, d, "r"), "engineered")
    return rounded(found.where("max_distance is not null").select("id", *[F.col(f"`{n}`").alias(n.replace("-", "_").lower()) for n in names]), 4)


def q58_inertia(spark: S, d: D) -> DataFrame:
    """Principal moments of inertia by closed form and by the kernel: largest relative difference, which is rounding."""
    m = molecules(spark, d, "r").where("size(r) = 3 * size(z)")
    kernel = ft.feature_frame(m, "engineered").select("id", F.array(*[f"inertia_moment_{k}" for k in (1, 2, 3)]).alias("k"))
    both = m.select("id", ar.inertia_moments(F.col("z"), F.col("r")).alias("c")).join(kernel, "id")
    return rounded(both.where("k[0] is not null").select("id", *[F.get("c", F.lit(n)).alias(f"i{n + 1}") for n in range(3)], *[F.get("k", F.lit(n)).alias(f"k{n + 1}") for n in range(3)]), 3)


def q24_rotational_constants(spark: S, d: D) -> DataFrame:
    """Rotational constants against the moments of inertia of the structure: checked, and how many deviate by 1e-4 or more."""
    m = molecules(spark, d, "r", "a", "b", "c")
    own = ar.inertia_moments(F.col("z"), F.col("r"))
    told = F.array_sort(F.array(*[ar.moment_of_constant(F.col(k)) for k in "abc"]))
    rows = m.where("a is not null and b is not null and c is not null").select(own.alias("i"), told.alias("t"))
    off = F.array_max(F.zip_with("i", "t", lambda i, t: F.abs(i - t))) / F.greatest(F.array_max("i"), F.lit(1e-9))
    return rows.select(off.alias("d")).agg(F.count("*").alias("checked"), F.count_if(~F.coalesce(F.col("d") < 1e-4, F.lit(False))).alias("violations"), F.round(F.avg("d"), 5).alias("mean_deviation"))


# models


def q52_ridge_two(spark: S, d: D) -> DataFrame:
    """Ridge on two features, whose normal equations have a closed form."""
    w, b = ln.fit_ridge(_frame(spark, d), ["alpha", "cv"], "mu", 10.0)
    return rounded(spark.createDataFrame([("alpha", float(w[0])), ("cv", float(w[1])), ("intercept", b)], "term string, value double"), 5)


def q53_pls_first(spark: S, d: D) -> DataFrame:
    """The first score of partial least squares: the direction of the covariances with the target."""
    rows = _frame(spark, d)
    names = ["alpha", "zpve", "cv"]
    means, rotation = ln.pls(rows, names, "mu", 1)
    return rounded(ln.project(rows, names, means, rotation).select("id", "z0"), 4)


def q53_pca_two(spark: S, d: D) -> DataFrame:
    """Variances of the two components of two features."""
    _, _, l = ln.pca(_frame(spark, d), ["alpha", "cv"], 2)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(l)], "component int, variance double"), 4)


def q57_cv_ridge(spark: S, d: D) -> DataFrame:
    """Cross-validated errors of ridge on one standardized feature, three penalties."""
    rows = pl.make_folds(_frame(spark, d).select("id", "alpha", "mu"), 0)
    recipe = pl.Recipe("ridge")
    found = pl.tune(rows, {"ridge": (recipe, [{"alpha": a} for a in (0.0, 10.0, 1000.0)])}, ["alpha"], "mu")
    return rounded(found.candidates.select("candidate", "mae", "rmse", "fold_sd", "n_eval"), 5)


def q57_cv_mean(spark: S, d: D) -> DataFrame:
    """A learning curve of the training mean: error of each nested set's other folds."""
    frame = _frame(spark, d).select("id", "alpha", "mu")
    order = sp.hashed_rank(frame.select("id"), sp.draw("train:0", "id"), "n").select("id", (F.col("n") - 1).alias("pos"))
    sets = sp.nested_sets(order, [50, 200]).select(F.lit(0).alias("seed"), "n_train", "id")
    found = pl.learning_curve(frame, sets, {"one": ["alpha"]}, "mu", lambda seed, name: {"mean": pl.build("mean", 1)})
    return rounded(pl.curve_table(found).select("seed", "n_train", "model", "features", "mae", "rmse", "n_eval"), 5)


def q57_development_curve(spark: S, d: D) -> DataFrame:
    """Mean and least squares on one feature, trained on the first 200 molecules in hashed order, scored on all others."""
    frame = _frame(spark, d).select("id", "alpha", "mu")
    order = sp.hashed_rank(frame.select("id"), sp.draw("train:0", "id"), "n").select("id", (F.col("n") - 1).alias("pos"))
    sets = sp.nested_sets(order, [200]).select(F.lit(0).alias("seed"), "n_train", "id")
    found = pl.development_curve(frame, sets, {"rest": order.where("pos >= 200").select("id")}, ["alpha"], "mu", {"mean": pl.Recipe("mean"), "linear": pl.Recipe("linear")})
    return rounded(found, 5)


def q57_pca_curve(spark: S, d: D) -> DataFrame:
    rows = pl.make_folds(_frame(spark, d), 0)
    return pl.pca_cv_curve(rows, FEATURES, "mu", [1, 2, 4, 8])


def q57_importance_cv(spark: S, d: D) -> DataFrame:
    rows = pl.make_folds(_frame(spark, d), 0)
    return pl.permutation_importance_cv(rows, pl.Recipe("ridge").with_settings(alpha=1.0), FEATURES, "mu", repeats=2)


def q57_boosted(spark: S, d: D) -> DataFrame:
    """Predictions of boosted trees after a random search with early stopping."""
    rows = _frame(spark, d)
    return pl.BoostedFitter(FEATURES, "mu", trials=3, most_trees=60, patience=10).fit(rows).predict(rows)


def q57_tabular(spark: S, d: D) -> DataFrame:
    """Predictions of kernel ridge on four reduced features, tuned inside the training set (its first 300 in hashed order)."""
    rows = _frame(spark, d)
    some = sp.hashed_rank(rows, sp.draw("tabular", "id"), "n").where("n <= 300").drop("n")
    fitter = pl.TabularFitter(*pl.build("rbf_krr", len(FEATURES), reduction=("pls", 4), target="sqrt"), FEATURES, "mu")
    return fitter.fit(some).predict(rows)


def q57_latent_charge(spark: S, d: D) -> DataFrame:
    """Predictions of a latent-charge network for all molecules, trained on 200 of them."""
    from tessera.operators import latent_charge as lc
    from tessera.plans.lineage import cut

    # molecules are described twice, the 200 and then all of them on the way to the prediction: a stored table of their atoms
    # is ten times the input
    m = molecules(spark, d, "r", "mu").where("mu is not null and size(r) = 3 * size(z)")
    some = cut(sp.hashed_rank(m.select("id", "mu"), sp.draw("charge", "id"), "n").where("n <= 200").select("id", "mu", F.lit("one").alias("job")))
    own = m.join(F.broadcast(some.select("id")), "id", "left_semi")
    train = lc.molecule_rows(ft.environments(own, ("r",)), own).join(some, "id")
    import pickle

    model = lc.fit_jobs(train, "mu", hidden=(16,), epochs=3, least_steps=60).first().model
    return lc.predict_molecules(m, pickle.loads(bytes(model)))


def q57_quantum_scores(spark: S, d: D) -> DataFrame:
    """Errors of a projected-kernel model with exact features and with features from finite shots."""
    from tessera.operators import quantum_models as qm

    rows = sp.hashed_rank(_frame(spark, d), sp.draw("quantum", "id"), "n")
    names = ["alpha", "zpve", "cv"]
    _, x, y = pl.training_arrays(rows.where("n <= 80"), names, "mu")
    _, u, v = pl.training_arrays(rows.where("n > 80 and n <= 200"), names, "mu")
    model = qm.refit({"m": {"gamma": 0.4, "gamma_p": 1.0, "alpha": 0.1}}, {"m": pl.Recipe("projected")}, x, y)["m"]
    return spark.createDataFrame(qm.shot_scores(model, {"rest": (u, v)}, [100, 1000], 2, 7))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q") and callable(f) and name[1].isdigit()}

_FR = f"fr AS (SELECT id, mu, alpha, zpve, cv FROM m WHERE z IS NOT NULL AND mu IS NOT NULL AND alpha IS NOT NULL AND zpve IS NOT NULL AND cv IS NOT NULL)"  # noqa: F541
_FULL = "d AS (SELECT a.id, a.i, b.i AS j, a.e AS za, b.e AS zb, b.x - a.x AS dx, b.y - a.y AS dy, b.w - a.w AS dw, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.w - b.w) ** 2) AS d FROM p a JOIN p b ON a.id = b.id AND a.i <> b.i)"
_NEAR = "d < 1.15 * (CASE za WHEN 1 THEN 0.31 WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 WHEN 8 THEN 0.66 WHEN 9 THEN 0.57 END + CASE zb WHEN 1 THEN 0.31 WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 WHEN 8 THEN 0.66 WHEN 9 THEN 0.57 END)"
_NUMBER = {"C": 6, "H": 1, "N": 7, "O": 8, "F": 9}
_GOODZ = "mm AS (SELECT * FROM m WHERE z IS NOT NULL AND r IS NOT NULL AND len(z) > 0 AND len(r) = 3 * len(z) AND len(list_filter(r, lambda v: v IS NULL)) = 0)"
_GOOD_ATOMS = _ATOMS.replace("FROM m)", "FROM mm)")
_SPECTRUM = "CASE WHEN len(freqs) = 2 * (3 * n_atoms - 6) THEN freqs[1:3 * n_atoms - 6] WHEN len(freqs) = 2 * (3 * n_atoms - 5) THEN freqs[1:3 * n_atoms - 5] ELSE freqs END"
_MASS = "CASE e WHEN 1 THEN 1.00782503 WHEN 6 THEN 12.0 WHEN 7 THEN 14.0030740 WHEN 8 THEN 15.9949146 WHEN 9 THEN 18.9984032 END"
_INERTIA = f"""w AS (SELECT id, {_MASS} AS m, x, y, w FROM p), s AS (SELECT id, sum(m * x * x) - sum(m * x) ** 2 / sum(m) AS xx, sum(m * y * y) - sum(m * y) ** 2 / sum(m) AS yy, sum(m * w * w) - sum(m * w) ** 2 / sum(m) AS zz,
 sum(m * x * y) - sum(m * x) * sum(m * y) / sum(m) AS xy, sum(m * x * w) - sum(m * x) * sum(m * w) / sum(m) AS xz, sum(m * y * w) - sum(m * y) * sum(m * w) / sum(m) AS yz FROM w GROUP BY id),
 c AS (SELECT *, yy + zz AS a_, xx + zz AS b_, xx + yy AS c_, 2 * (xx + yy + zz) / 3 AS q FROM s), t AS (SELECT *, sqrt(((a_ - q) ** 2 + (b_ - q) ** 2 + (c_ - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS pp FROM c),
 u AS (SELECT *, acos(greatest(least(((a_ - q) * ((b_ - q) * (c_ - q) - yz * yz) - xy * (xy * (c_ - q) + yz * xz) - xz * (xy * yz + (b_ - q) * xz)) / (2 * pp ** 3), 1), -1)) / 3 AS f FROM t),
 inertia AS (SELECT id, q + 2 * pp * cos(f + 2 * pi() / 3) AS i1, q + 2 * pp * cos(f + 4 * pi() / 3) AS i2, q + 2 * pp * cos(f) AS i3 FROM u)"""


def _bond_counts() -> str:
    out = []
    for a, b in mk.PAIRS:
        x, y = mk.SYMBOLS[a], mk.SYMBOLS[b]
        out.append(f"count(*) FILTER (i < j AND least(za, zb) = {min(_NUMBER[x], _NUMBER[y])} AND greatest(za, zb) = {max(_NUMBER[x], _NUMBER[y])})::DOUBLE AS bonds_{x.lower()}_{y.lower()}")
    for name, p, lo, hi in mk.BOND_ORDERS:
        out.append(f"count(*) FILTER (i < j AND least(za, zb) = {p[0]} AND greatest(za, zb) = {p[1]} AND d >= {lo} AND d < {hi})::DOUBLE AS {name.replace('-', '_').lower()}")
    return ", ".join(out)


def _chi(column: str) -> str:
    return _CHI.replace("CASE e", f"CASE {column}")


SQL = {
    "q74_quantile_band": "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.005) AS a, quantile_cont(l_extendedprice, 0.995) AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 4) AS low, round(max(l_extendedprice), 4) AS high FROM lineitem, q WHERE l_extendedprice BETWEEN a AND b GROUP BY 1",
    "q75_group_median": f"WITH {M}, k AS (SELECT n_heavy, mu, median(mu) OVER (PARTITION BY f) AS md FROM m WHERE mu IS NOT NULL AND f IS NOT NULL AND z IS NOT NULL) SELECT n_heavy, round(avg(abs(mu - md)), 6) AS mae, count(*) AS n FROM k GROUP BY 1",
    "q76_ordinals": "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END AS place FROM orders GROUP BY 1",
    "q76_by_size": "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20",
    "q77_cross_section": "SELECT l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "q78_side_by_side": "WITH c AS (SELECT c_nationkey AS nation, count(*)::DOUBLE AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*)::DOUBLE AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT nation, customers, suppliers FROM c FULL JOIN s USING (nation)",
    "q79_groups_of": f"WITH {M} SELECT id, f, n_heavy FROM m WHERE z IS NOT NULL AND f IN (SELECT f FROM m WHERE z IS NOT NULL GROUP BY f HAVING count(*) >= 3)",
    "q80_plus_minus": "SELECT c_mktsegment, printf('%.1f ± %.1f', avg(c_acctbal), stddev_samp(c_acctbal)) AS text FROM customer GROUP BY 1",
    "q81_number_after": "SELECT try_cast(replace(lower(p_brand), 'brand#', '') AS INT) AS brand, count(*) AS n FROM part GROUP BY 1",
    "q82_finite_check": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (isnan({c}) OR isinf({c})) AS not_finite, count(DISTINCT id) AS keys FROM molecules WHERE id IS NOT NULL" for c in ("mu", "alpha", "gap", "zpve")),
    "q82_sampled_rules": "SELECT 'numbered' AS rule, least(300000, count(DISTINCT atom_row)) AS checked, 0 AS violations FROM atomdata",
    "q83_natural_features": f"WITH {M} SELECT id, n_atoms, n_heavy, " + ", ".join(f"len(list_filter(z, lambda x: x = {k})) AS n_{s.lower()}" for s, k in _NUMBER.items()) + ", " + ", ".join(f"round({p}, 6) + 0.0 AS {p}" for p in records.PROPERTIES if p != "mu") + " FROM m",
    "q83_dictionary_coverage": "WITH k AS (SELECT unnest([" + ", ".join(f"{{'c': '{c}', 'role': '{r}'}}" for c, _, _, _, r in records.DICTIONARY) + "]) AS e) SELECT e.role AS role, count(*) AS described, count(column_name) AS stored FROM k LEFT JOIN (DESCRIBE molecules) t ON t.column_name = e.c GROUP BY 1",
    "q11_pivot_metrics": "SELECT l_returnflag, " + ", ".join(f"round(avg({c}) FILTER (l_linestatus = '{v}'), 5) AS \"{v}_{n}\"" for v in "FO" for n, c in (("price", "l_extendedprice"), ("discount", "l_discount"))) + " FROM lineitem GROUP BY 1",
    "q19_histogram_2d": "SELECT floor(l_quantity / 5)::BIGINT + 1 AS bin_x, floor(l_discount / 0.08 * 4)::BIGINT + 1 AS bin_y, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 AND l_discount >= 0 AND l_discount < 0.08 GROUP BY 1, 2",
    "q48_mapped": "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS kind, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "q48_reindex": "SELECT pos, k AS n_nationkey, coalesce(n_regionkey, -1)::INT AS n_regionkey FROM (SELECT unnest([0, 1, 2]) AS pos, unnest([7, 99, 3]) AS k) LEFT JOIN nation ON n_nationkey = k",
    "q66_winners": "WITH s AS (SELECT c_nationkey, c_mktsegment, o_orderpriority, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), b AS (SELECT *, min(t) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM s), n AS (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) AS n FROM s) SELECT o_orderpriority, count(*) FILTER (t = m) AS cells, round(count(*) FILTER (t = m) / any_value(n), 6) AS share FROM b, n GROUP BY 1",
    "q84_development_ids": "SELECT DISTINCT id FROM split_set WHERE set_name IN ('pool', 'dev', 'dev_unseen')",
    "q84_test_molecules": "WITH s AS (SELECT DISTINCT set_name AS subset, id FROM split_set WHERE set_name IN ('test_unseen_q', 'test_familiar_q')) SELECT subset, id FROM s QUALIFY row_number() OVER (PARTITION BY subset ORDER BY md5('2027:' || subset || ':' || id)) <= 20",
    "q39_stored_rules": """WITH r AS (SELECT DISTINCT build_id, set_name, id FROM split_set), o AS (SELECT DISTINCT build_id, revision, seed, pos, id FROM train_order),
 v AS (SELECT build_id, 'in several sets' AS rule FROM r WHERE set_name IN ('pool','test_unseen','test_familiar','dev','dev_unseen') GROUP BY build_id, id HAVING count(*) > 1
 UNION ALL SELECT build_id, 'outside test_unseen' FROM r WHERE set_name = 'test_unseen_q' AND (build_id, id) NOT IN (SELECT (build_id, id) FROM r WHERE set_name = 'test_unseen')
 UNION ALL SELECT build_id, 'outside test_familiar' FROM r WHERE set_name = 'test_familiar_q' AND (build_id, id) NOT IN (SELECT (build_id, id) FROM r WHERE set_name = 'test_familiar')
 UNION ALL SELECT build_id, 'repeated pos' FROM o GROUP BY build_id, revision, seed, pos HAVING count(*) > 1 UNION ALL SELECT build_id, 'repeated id' FROM o GROUP BY build_id, revision, seed, id HAVING count(*) > 1
 UNION ALL SELECT build_id, 'left out places' FROM o GROUP BY build_id, revision, seed HAVING count(DISTINCT pos) <> max(pos) + 1)
 SELECT build_id, rule, count(*) AS violations FROM v GROUP BY 1, 2""",
    "q06_duplicate_spectra": f"WITH {M}, k AS (SELECT id, f, list_sort(list_transform({_SPECTRUM}, lambda v: floor(v / 1000))) AS s FROM m WHERE z IS NOT NULL AND len(freqs) > 0) SELECT id, min(id) OVER (PARTITION BY f, s) AS label, count(*) OVER (PARTITION BY f, s) AS size FROM k QUALIFY size > 1",
    "q85_legal_features": f"""WITH {M}, {_GOODZ}, {_GOOD_ATOMS}, x AS (SELECT a.id, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.w - b.w) ** 2)) AS far FROM p a JOIN p b USING (id) GROUP BY 1)
 SELECT p.id, {", ".join(f"count(*) FILTER (e = {k})::DOUBLE AS n_{s}" for s, k in _NUMBER.items())}, round(any_value(far)::FLOAT::DOUBLE, 3) AS max_distance,
 round(coalesce(sqrt((avg(x) FILTER (e > 6) - avg(x)) ** 2 + (avg(y) FILTER (e > 6) - avg(y)) ** 2 + (avg(w) FILTER (e > 6) - avg(w)) ** 2), 0)::FLOAT::DOUBLE, 3) AS heteroatom_offset FROM p JOIN x USING (id) GROUP BY p.id""",
    "q86_atom_subset": f"WITH {M}, {_GOODZ} SELECT id, (sum(len(z)) OVER (ORDER BY id DESC) - len(z))::BIGINT AS first, len(z) AS n, list_sum(list_transform(z, lambda v: CASE v WHEN 6 THEN 0 WHEN 1 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 3 ELSE 4 END))::BIGINT AS elements FROM mm",
    "q59_atom_sums": f"""WITH {M}, {_GOODZ}, {_GOOD_ATOMS}, {_FULL}, k AS (SELECT id, i, count(*) FILTER ({_NEAR}) AS degree, {", ".join(f"count(*) FILTER (zb = {n} AND {_NEAR})::DOUBLE AS bonded_{s.lower()}" for s, n in _NUMBER.items())},
 coalesce(sum(exp(-((d - (0.9 + 3.8 / 7)) ** 2) / 0.32) * (cos(pi() * d / 5) + 1) / 2) FILTER (zb = 6 AND d < 5), 0) AS radial_c_1_44, coalesce(sum(exp(-((d - (0.9 + 3 * 3.8 / 7)) ** 2) / 0.32) * (cos(pi() * d / 5) + 1) / 2) FILTER (zb = 1 AND d < 5), 0) AS radial_h_2_53,
 sum(zb / d) AS nuclear FROM d GROUP BY 1, 2), c AS (SELECT id, i, sqrt((x - avg(x) OVER g) ** 2 + (y - avg(y) OVER g) ** 2 + (w - avg(w) OVER g) ** 2) AS off FROM p WINDOW g AS (PARTITION BY id))
 SELECT id, i AS atom_idx, degree::DOUBLE AS degree, {", ".join(f"bonded_{s.lower()}" for s in _NUMBER)}, round(radial_c_1_44, 4) AS radial_c_1_44, round(radial_h_2_53, 4) AS radial_h_2_53, round(nuclear, 4) AS nuclear_potential, round(off, 4) AS centroid_distance FROM k JOIN c USING (id, i)""",
    "q59_group_counts": f"WITH {M}, {_GOODZ}, {_GOOD_ATOMS}, {_FULL}, k AS (SELECT id, i, za, count(*) FILTER ({_NEAR}) AS g FROM d GROUP BY ALL) SELECT id, " + ", ".join(f"count(*) FILTER (za = {_NUMBER[n[6]]} AND g = {n[7]}) AS {n}" for n in mk.GROUPS if n.startswith("atoms_")) + ", count(*) FILTER (za = 7 AND g = 4) AS n_ammonium FROM k GROUP BY id",
    "q58_engineered_bonds": f"""WITH {M}, {_GOODZ}, {_GOOD_ATOMS}, {_FULL}, far AS (SELECT id, max(d) AS far FROM d GROUP BY id), b AS (SELECT *, ({_chi("zb")} - {_chi("za")}) AS pull FROM d WHERE {_NEAR}),
 k AS (SELECT id, sum(abs(pull)) / 2 AS total, sqrt(sum(pull * dx / d) ** 2 + sum(pull * dy / d) ** 2 + sum(pull * dw / d) ** 2) / 2 AS dip, {_bond_counts()} FROM b GROUP BY id)
 SELECT far.id, round(far, 4) AS max_distance, round(coalesce(total, 0), 4) + 0.0 AS bond_polarity_total, round(coalesce(dip, 0), 4) + 0.0 AS bond_dipole_norm, COLUMNS(k.* EXCLUDE (id, total, dip)) FROM far LEFT JOIN k USING (id)""",
    "q58_inertia": f"WITH {M}, {_GOODZ}, {_GOOD_ATOMS}, {_INERTIA} SELECT id, " + ", ".join(f"round(greatest(i{k}, 0), 3) AS {p}{k}" for p in "ik" for k in (1, 2, 3)) + " FROM inertia",
    "q24_rotational_constants": f"""WITH {M}, {_ATOMS}, {_INERTIA}, k AS (SELECT list_sort([CASE WHEN a > 0 THEN 505.379009 / a ELSE 0 END, CASE WHEN b > 0 THEN 505.379009 / b ELSE 0 END, CASE WHEN c > 0 THEN 505.379009 / c ELSE 0 END]) AS t, i1, i2, i3 FROM m JOIN inertia USING (id) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
 e AS (SELECT greatest(abs(t[1] - i1), abs(t[2] - i2), abs(t[3] - i3)) / greatest(i3, 1e-9) AS d FROM k) SELECT count(*) AS checked, count(*) FILTER (NOT coalesce(d < 1e-4, false)) AS violations, round(avg(d), 5) AS mean_deviation FROM e""",
    "q52_ridge_two": f"""WITH {M}, {_FR}, s AS (SELECT count(*) AS n, covar_pop(alpha, alpha) * count(*) + 10 AS aa, covar_pop(cv, cv) * count(*) + 10 AS bb, covar_pop(alpha, cv) * count(*) AS ab, covar_pop(alpha, mu) * count(*) AS ay, covar_pop(cv, mu) * count(*) AS byy, avg(alpha) AS ma, avg(cv) AS mb, avg(mu) AS my FROM fr),
 w AS (SELECT (bb * ay - ab * byy) / (aa * bb - ab * ab) AS u, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS v, ma, mb, my FROM s) SELECT 'alpha' AS term, round(u, 5) AS value FROM w UNION ALL SELECT 'cv', round(v, 5) FROM w UNION ALL SELECT 'intercept', round(my - ma * u - mb * v, 5) FROM w""",
    "q53_pls_first": f"""WITH {M}, {_FR}, s AS (SELECT covar_pop(alpha, mu) AS a, covar_pop(zpve, mu) AS b, covar_pop(cv, mu) AS c, avg(alpha) AS ma, avg(zpve) AS mb, avg(cv) AS mc FROM fr)
 SELECT id, round(((alpha - ma) * a + (zpve - mb) * b + (cv - mc) * c) / sqrt(a * a + b * b + c * c), 4) + 0.0 AS z0 FROM fr, s""",
    "q53_pca_two": f"""WITH {M}, {_FR}, s AS (SELECT var_pop(alpha) AS a, var_pop(cv) AS b, covar_pop(alpha, cv) AS c FROM fr), e AS (SELECT (a + b) / 2 AS m, sqrt(((a - b) / 2) ** 2 + c * c) AS r FROM s) SELECT 0 AS component, round(m + r, 4) AS variance FROM e UNION ALL SELECT 1, round(m - r, 4) FROM e""",
    "q57_cv_ridge": f"""WITH {M}, {_FR}, k AS (SELECT id, alpha, mu, (row_number() OVER (ORDER BY md5('cv:0:' || id)) - 1) % 5 AS fold FROM fr), g AS (SELECT unnest(range(5)) AS hold),
 t AS (SELECT hold, avg(alpha) AS ma, stddev_pop(alpha) AS sa, avg(mu) AS my, stddev_pop(mu) AS sy FROM g JOIN k ON fold <> hold GROUP BY hold),
 x AS (SELECT t.*, id, fold, mu, greatest(least((alpha - ma) / sa, 10), -10) AS v FROM t, k), f AS (SELECT hold, avg(v) AS mv, var_pop(v) * count(*) AS vv, covar_pop(v, (mu - my) / sy) * count(*) AS vz FROM x WHERE fold <> hold GROUP BY hold),
 c AS (SELECT unnest([0, 1, 2]) AS candidate, unnest([0.0, 10.0, 1000.0]) AS alpha_), e AS (SELECT candidate, hold, greatest(my + sy * (v - mv) * vz / (vv + alpha_), 0) - mu AS e FROM x JOIN f USING (hold), c WHERE fold = hold),
 p AS (SELECT candidate, hold, count(*) AS n, sum(abs(e)) AS a, sum(e * e) AS s FROM e GROUP BY 1, 2) SELECT candidate, round(sum(a) / sum(n), 5) AS mae, round(sqrt(sum(s) / sum(n)), 5) AS rmse, round(stddev_samp(a / n), 5) AS fold_sd, sum(n)::BIGINT AS n_eval FROM p GROUP BY 1""",
    "q57_development_curve": f"""WITH {M}, {_FR}, o AS (SELECT alpha, mu, row_number() OVER (ORDER BY md5('train:0:' || id)) <= 200 AS own FROM fr), t AS (SELECT avg(alpha) AS ma, stddev_pop(alpha) AS sa, avg(mu) AS my FROM o WHERE own),
 x AS (SELECT own, mu, my, greatest(least((alpha - ma) / sa, 10), -10) AS v FROM o, t), w AS (SELECT regr_slope(mu, v) AS b, regr_intercept(mu, v) AS c FROM x WHERE own),
 e AS (SELECT unnest(['mean', 'linear']) AS model, unnest([my, c + b * v]) AS pred, mu FROM x, w WHERE NOT own), k AS (SELECT model, mu, greatest(pred, 0) - mu AS e FROM e)
 SELECT 0 AS seed, 200 AS n_train, model, 'rest' AS eval_set, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(sqrt(avg(e * e) FILTER (mu < 9)), 5) AS rmse_below_tail, round(1 - sum(e * e) / (var_pop(mu) * count(*)), 5) AS r2, round(avg(e), 5) + 0.0 AS bias, count(*) AS n_eval FROM k GROUP BY model""",
    "q57_cv_mean": f"""WITH {M}, {_FR}, o AS (SELECT id, mu, row_number() OVER (ORDER BY md5('train:0:' || id)) - 1 AS pos FROM fr), s AS (SELECT n AS n_train, id, mu, (row_number() OVER (PARTITION BY n ORDER BY md5('cv:0:' || n || ':' || id)) - 1) % 5 AS fold FROM o, (SELECT unnest([50, 200]) AS n) WHERE pos < n),
 t AS (SELECT n_train, fold, mu, (sum(mu) OVER (PARTITION BY n_train) - sum(mu) OVER (PARTITION BY n_train, fold)) / (count(*) OVER (PARTITION BY n_train) - count(*) OVER (PARTITION BY n_train, fold)) AS pred FROM s)
 SELECT 0 AS seed, n_train, 'mean' AS model, 'one' AS features, round(avg(abs(pred - mu)), 5) AS mae, round(sqrt(avg((pred - mu) ** 2)), 5) AS rmse, count(*) AS n_eval FROM t GROUP BY n_train""",
}
