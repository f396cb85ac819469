"""Queries of array kernels, descriptors, records and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.operators import features as ft
from tessera.operators.molecule_kernels import ATOM_FEATURES
from tessera.plans.views import M, molecules, rounded, table
from tessera.sources import records
from tessera.sources.results import FEATURE_SETS

S, D = SparkSession, str
N_ATOM_FEATURES = len(ATOM_FEATURES)


def q24_integrity(spark: S, d: D) -> DataFrame:
    """(rule, checked, violations, max_deviation): domain rules over all molecules, one aggregate."""
    m = molecules(spark, d, "r", "q", "n_atoms", "freqs", *records.PROPERTIES)
    c, n, listed = F.col, F.col("n_atoms"), F.size("freqs")
    gap = F.abs(c("gap") - (c("lumo") - c("homo")))
    enthalpy = F.abs(c("h") - c("u") - 0.000944)
    charge = F.abs(ar.total(c("q")))
    sizes = (F.size("z") == n) & (F.size("r") == 3 * n) & (F.size("q") == n)
    linear = (listed == 3 * n - 5) | (listed == 2 * (3 * n - 5))
    missing = F.lit(False)
    for p in records.PROPERTIES:
        missing = missing | c(p).isNull()
    rules = [
        ("sizes", sizes, None),
        ("no missing scalar", ~missing, None),
        ("neutral", charge < 1e-4, charge),
        ("mu not negative", c("mu") >= 0, None),
        ("gap", gap < 1.5e-4, gap),
        ("enthalpy", enthalpy < 3e-6, enthalpy),
        ("energy order", (c("u0") < c("u")) & (c("g") < c("h")), None),
        ("constants in order", ((c("a") >= c("b")) | (c("a") == 0)) & (c("b") >= c("c")), None),
        ("frequencies", (listed == 3 * n - 6) | (listed == 3 * n - 5), None),
        ("no imaginary frequency", F.array_min("freqs") > 0, None),
        ("connected", F.size(ar.bonds(c("z"), c("r"))) >= n - 1, None),
        ("linear molecules", ~linear | (c("a") == 0), None),
    ]
    cells = m.agg(*[F.struct(F.lit(name).alias("rule"), F.count("*").alias("checked"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations"), F.round(F.max(dev) if dev is not None else F.lit(None).cast("double"), 6).alias("max_deviation")).alias(f"r{k}") for k, (name, ok, dev) in enumerate(rules)])
    return cells.select(F.explode(F.array(*[F.col(f"r{k}") for k in range(len(rules))])).alias("e")).select("e.*")


def q25_parse_records(spark: S, d: D) -> DataFrame:
    """Every molecule written as a raw record and parsed again."""
    m = molecules(spark, d, "r", "q", "n_atoms", "freqs", *records.PROPERTIES).where("size(freqs) > 0")
    symbol = F.create_map(*[F.lit(v) for s, k in (("H", 1), ("C", 6), ("N", 7), ("O", 8), ("F", 9)) for v in (k, s)])
    at = F.sequence(F.lit(0), F.size("z") - 1)
    text = lambda v: F.coalesce(v.cast("string"), F.lit("0.0"))
    line = lambda i: F.concat_ws("\t", symbol[F.get("z", i).cast("int")], *[F.replace(text(F.get("r", i * 3 + k)), F.lit("E"), F.lit("*^")) for k in range(3)], text(F.get("q", i)))
    record = F.concat_ws(
        "\n",
        F.col("n_atoms").cast("string"),
        F.concat_ws("\t", F.concat(F.lit("gdb "), F.col("id")), *[text(F.col(p)) for p in records.PROPERTIES]),
        F.array_join(F.transform(at, line), "\n"),
        F.array_join(F.transform("freqs", lambda v: v.cast("string")), "\t"),
        F.lit("C\tC\nInChI=1\tInChI=1\n"),
    )
    parsed = records.parse_records(m.select(record.alias("text")))
    return parsed.select("error", "id", "formula", "n_atoms", "n_heavy", F.round("mu", 6).alias("mu"), F.round(ar.total(F.col("r")), 6).alias("sum_r"), F.size("freqs").alias("n_freqs"))


def q26_composition(spark: S, d: D) -> DataFrame:
    from tessera.functions.composition import ELEMENTS

    count = lambda k: F.size(F.filter("z", lambda v: v == k))
    return molecules(spark, d).select("id", "f", *[count(k).alias(f"n_{s.lower()}") for s, k in ELEMENTS])


def q27_charge_features(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "r", "q")
    return rounded(m.select("id", *[c.alias(n) for n, c in ar.charge_features(F.col("q"), F.col("r")).items()]), 8)


def q28_bonds(spark: S, d: D) -> DataFrame:
    return rounded(ft.bond_lengths(molecules(spark, d, "r")).groupBy("pair").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")))


def q29_bond_orders(spark: S, d: D) -> DataFrame:
    return ft.bond_order_counts(molecules(spark, d, "r"))


def q30_valence(spark: S, d: D) -> DataFrame:
    """(id, atoms_over): atoms with no bond or more bonds than their element takes."""
    from tessera.operators.molecule_kernels import VALENCE

    m = molecules(spark, d, "r").select("id", "z", ar.bonds(F.col("z"), F.col("r")).alias("b"))
    at = F.sequence(F.lit(0), F.size("z") - 1)
    cap = F.create_map(*[F.lit(v) for k, n in VALENCE.items() for v in (k, n)])
    degree = lambda i: F.size(F.filter("b", lambda e: (e["i"] == i) | (e["j"] == i)))
    wrong = F.size(F.filter(at, lambda i: (degree(i) < 1) | (degree(i) > cap[F.get("z", i).cast("int")])))
    return m.select("id", wrong.alias("atoms_over")).where("atoms_over > 0")


def q54_cm_spectrum(spark: S, d: D) -> DataFrame:
    """The sums of the eigenvalues and of their squares, which are the trace and the squared norm of the matrix."""
    found = ft.featurize(molecules(spark, d, "r"), "cm_spectrum").where("features is not null")
    return rounded(found.select("id", ar.total(F.col("features")).alias("trace"), ar.total(F.transform("features", lambda v: v * v)).alias("squares")), 3)


def q55_qeq(spark: S, d: D) -> DataFrame:
    return ft.feature_frame(molecules(spark, d, "r"), "qeq")


def q58_engineered(spark: S, d: D) -> DataFrame:
    return ft.feature_frame(molecules(spark, d, "r"), "engineered")


def q58_radius_of_gyration(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "r")
    return rounded(m.select("id", ar.radius_of_gyration(F.col("r")).alias("radius"), ar.electronegativity_dipole(F.col("z"), F.col("r")).alias("dipole"), ar.heteroatom_offset(F.col("z"), F.col("r")).alias("offset")), 5)


def q59_atom_table(spark: S, d: D) -> DataFrame:
    """The long atom table: centred positions (to 32 bits) and how many features each atom has."""
    m = molecules(spark, d, "r")
    rows = ft.atom_table(ft.environments(m), m)
    at = [F.get("pos", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyz")]
    return rounded(rows.select("id", "atom_idx", F.col("element").cast("int").alias("element"), *at, F.size("x").alias("features")), 3)


def q59_edge_table(spark: S, d: D) -> DataFrame:
    return ft.edge_table(ft.environments(molecules(spark, d, "r"))).select("id", "i", "j")


def q60_invariance(spark: S, d: D) -> DataFrame:
    """Every descriptor under every motion; the raw coordinates are the control that must change."""
    found = ft.invariance_table(molecules(spark, d, "r"))
    return found.select("descriptor", "transform", "n_molecules", "invariant")


def q61_frequency_features(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "freqs", "n_atoms").withColumn("freqs", ar.clean_frequencies(F.col("freqs"), F.col("n_atoms"))).where("size(freqs) > 0")
    return rounded(m.select("id", *[c.alias(n) for n, c in ar.frequency_features(F.col("freqs")).items()]), 7)


def q62_clean_frequencies(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "freqs", "n_atoms")
    clean = ar.clean_frequencies(F.col("freqs"), F.col("n_atoms"))
    return m.select("id", F.size("freqs").alias("listed"), F.size(clean).alias("kept"), ar.is_linear(clean, F.col("n_atoms")).alias("linear"))


def q63_moments(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "a", "b", "c")
    return rounded(m.select("id", *[ar.moment_of_constant(F.col(k)).alias(f"i_{k}") for k in "abc"]), 5)


def q64_summaries(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "r", "q", "freqs", "n_atoms")
    q = F.col("q")
    return rounded(m.select("id", ar.centroid_offset(F.col("r")).alias("centroid_offset"), ar.total(q).alias("q_sum"), F.array_max(F.transform(q, lambda v: F.abs(v))).alias("q_max_abs"), F.size("freqs").alias("n_freqs"), (3 * F.col("n_atoms") - 6).alias("n_expected"), F.array_min("freqs").alias("freq_min"), F.array_max("freqs").alias("freq_max")), 4)


def q65_coulomb_matrix(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "r")
    rows = F.flatten(ar.coulomb_matrix(F.col("z"), F.col("r")))
    return rounded(m.select("id", F.array_max(rows).alias("largest"), F.size(rows).alias("cells")), 3)


def q70_charge_correlation(spark: S, d: D) -> DataFrame:
    """Per element, correlation of stored and equilibrated charges over all atoms, for elements with more than 50 atoms."""
    m = molecules(spark, d, "r", "q")
    both = ft.environments(m).where("qeq_charges is not null").join(m.select("id", "z", "q"), "id")
    pairs = F.explode(F.arrays_zip(F.col("z"), F.col("q"), F.col("qeq_charges"))).alias("e")
    return both.select(pairs).groupBy(F.col("e.z").alias("z")).agg(F.corr("e.q", "e.qeq_charges").alias("r"), F.count("*").alias("n")).where("n > 50")


def q71_files(spark: S, d: D) -> DataFrame:
    """Sizes and digests of every file of the folder."""
    return records.digests(spark, f"{d}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "md5", "sha256")


def q72_current_table(spark: S, d: D) -> DataFrame:
    """Whether a table is the parsed one (its columns are exactly those stated)."""
    names = ["molecules", "feature_catalog", "atomdata"]
    found = [(n, records.table_is_current(spark, f"{d}/{n}.parquet", [*records.COLUMNS, "loaded_at"])) for n in names]
    return spark.createDataFrame(found, "name string, current boolean")


def q73_feature_sets(spark: S, d: D) -> DataFrame:
    """Named lists of kept features, in the order of their place in the vector, then by name."""
    from tessera.sources.results import feature_sets

    catalog = table(spark, d, "feature_catalog").withColumn("ord", F.coalesce(F.col("x_pos"), F.lit(1000)))
    found = feature_sets(catalog)
    return found.select("name", F.size("features").alias("n"), F.array_join("features", ",").alias("features"))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q") and callable(f)}

_ATOMS = "atoms AS (SELECT id, z, unnest(range(len(z))) AS i, r, q FROM m), p AS (SELECT id, i, z[i + 1]::INT AS e, r[3 * i + 1] AS x, r[3 * i + 2] AS y, r[3 * i + 3] AS w, q[i + 1] AS q FROM atoms)"
_RADIUS = "CASE {c} WHEN 1 THEN 0.31 WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 WHEN 8 THEN 0.66 WHEN 9 THEN 0.57 END"
_CHI = "CASE e WHEN 1 THEN 2.20 WHEN 6 THEN 2.55 WHEN 7 THEN 3.04 WHEN 8 THEN 3.44 WHEN 9 THEN 3.98 END"
_PLACE = "CASE {c} WHEN 6 THEN 0 WHEN 1 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 3 WHEN 9 THEN 4 END"
_SYMBOL = "CASE {c} WHEN 6 THEN 'C' WHEN 1 THEN 'H' WHEN 7 THEN 'N' WHEN 8 THEN 'O' WHEN 9 THEN 'F' END"
_BONDS = f"""{_ATOMS}, d AS (SELECT a.id, a.i, b.i AS j, a.e AS za, b.e AS zb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.w - b.w) ** 2) AS d FROM p a JOIN p b ON a.id = b.id AND a.i < b.i),
 b AS (SELECT * FROM d WHERE d < 1.15 * ({_RADIUS.format(c="za")} + {_RADIUS.format(c="zb")}))"""
_LISTED = "len(freqs)"
_DUP = "CASE WHEN len(freqs) = 2 * (3 * n_atoms - 6) THEN freqs[1:3 * n_atoms - 6] WHEN len(freqs) = 2 * (3 * n_atoms - 5) THEN freqs[1:3 * n_atoms - 5] ELSE freqs END"


def _rule(name: str, ok: str, dev: str = "NULL") -> str:
    return f"SELECT '{name}' AS rule, count(*) AS checked, count(*) FILTER (NOT coalesce({ok}, false)) AS violations, round(max({dev})::DOUBLE, 6) AS max_deviation FROM k"


SQL = {
    "q24_integrity": f"WITH {M}, {_BONDS}, nb AS (SELECT id, count(*) AS nb FROM b GROUP BY id), k AS (SELECT m.*, coalesce(nb, 0) AS nb FROM m LEFT JOIN nb USING (id)) "
    + " UNION ALL ".join(
        [
            _rule("sizes", "len(z) = n_atoms AND len(r) = 3 * n_atoms AND len(q) = n_atoms"),
            _rule("no missing scalar", " AND ".join(f"{p} IS NOT NULL" for p in records.PROPERTIES)),
            _rule("neutral", "abs(list_sum(q)) < 1e-4", "abs(list_sum(q))"),
            _rule("mu not negative", "mu >= 0"),
            _rule("gap", "abs(gap - (lumo - homo)) < 1.5e-4", "abs(gap - (lumo - homo))"),
            _rule("enthalpy", "abs(h - u - 0.000944) < 3e-6", "abs(h - u - 0.000944)"),
            _rule("energy order", "u0 < u AND g < h"),
            _rule("constants in order", "(a >= b OR a = 0) AND b >= c"),
            _rule("frequencies", "len(freqs) IN (3 * n_atoms - 6, 3 * n_atoms - 5)"),
            _rule("no imaginary frequency", "list_min(freqs) > 0"),
            _rule("connected", "nb >= n_atoms - 1"),
            _rule("linear molecules", "NOT (len(freqs) = 3 * n_atoms - 5 OR len(freqs) = 2 * (3 * n_atoms - 5)) OR a = 0"),
        ]
    ),
    "q25_parse_records": f"WITH {M} SELECT NULL::VARCHAR AS error, id, f AS formula, n_atoms, len(list_filter(z, lambda x: x > 1))::INT AS n_heavy, round(coalesce(mu, 0), 6) AS mu, round(list_sum(r), 6) + 0.0 AS sum_r, len(freqs)::INT AS n_freqs FROM m WHERE len(freqs) > 0",
    "q26_composition": f"WITH {M} SELECT id, f, " + ", ".join(f"len(list_filter(z, lambda x: x = {k})) AS n_{s}" for s, k in (("c", 6), ("h", 1), ("n", 7), ("o", 8), ("f", 9))) + " FROM m",
    "q27_charge_features": f"WITH {M}, {_ATOMS} SELECT id, round(sqrt(sum(q * x) ** 2 + sum(q * y) ** 2 + sum(q * w) ** 2) * 4.80320, 8) AS charge_dipole_d, round(max(abs(q)), 8) AS max_abs_charge, round(sum(abs(q)) / 2, 8) AS charge_separation FROM p GROUP BY id",
    "q28_bonds": f"WITH {M}, {_BONDS}, n AS (SELECT d, CASE WHEN {_PLACE.format(c='za')} <= {_PLACE.format(c='zb')} THEN {_SYMBOL.format(c='za')} || '-' || {_SYMBOL.format(c='zb')} ELSE {_SYMBOL.format(c='zb')} || '-' || {_SYMBOL.format(c='za')} END AS pair FROM b) SELECT pair, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS longest FROM n GROUP BY pair",
    "q29_bond_orders": f"""WITH {M}, {_BONDS}, k AS (SELECT id, least(za, zb) AS lo, greatest(za, zb) AS hi, d FROM b),
 n AS (SELECT id, CASE WHEN lo = 6 AND hi = 6 AND d < 1.26 THEN 'triple_C-C' WHEN lo = 6 AND hi = 7 AND d < 1.21 THEN 'triple_C-N' WHEN lo = 6 AND hi = 7 AND d < 1.43 THEN 'multiple_C-N' WHEN lo = 6 AND hi = 8 AND d < 1.27 THEN 'double_C-O' WHEN lo = 7 AND hi = 8 AND d < 1.28 THEN 'double_N-O' END AS name FROM k)
 SELECT id, name, count(*) AS n FROM n WHERE name IS NOT NULL GROUP BY 1, 2""",
    "q30_valence": f"""WITH {M}, {_BONDS}, e AS (SELECT id, i FROM b UNION ALL SELECT id, j FROM b), g AS (SELECT p.id, p.i, p.e, count(e.i) AS deg FROM p LEFT JOIN e ON e.id = p.id AND e.i = p.i GROUP BY 1, 2, 3)
 SELECT id, count(*) AS atoms_over FROM g WHERE deg < 1 OR deg > CASE e WHEN 1 THEN 1 WHEN 6 THEN 4 WHEN 7 THEN 4 WHEN 8 THEN 2 WHEN 9 THEN 1 END GROUP BY id""",
    "q54_cm_spectrum": f"""WITH {M}, {_ATOMS}, c AS (SELECT a.id, a.i = b.i AS own, CASE WHEN a.i = b.i THEN 0.5 * a.e ** 2.4 ELSE a.e * b.e / (1.8897261 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.w - b.w) ** 2)) END AS v FROM p a JOIN p b ON a.id = b.id)
 SELECT id, round(sum(v) FILTER (own), 3) AS trace, round(sum(v * v), 3) AS squares FROM c GROUP BY id""",
    "q58_radius_of_gyration": f"""WITH {M}, {_ATOMS}, c AS (SELECT *, {_CHI} AS chi FROM p), k AS (SELECT *, chi - avg(chi) OVER (PARTITION BY id) AS dc FROM c)
 SELECT id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(w)), 5) AS radius, round(sqrt(sum(dc * x) ** 2 + sum(dc * y) ** 2 + sum(dc * w) ** 2), 5) AS dipole,
 round(coalesce(sqrt((avg(x) FILTER (e > 6) - avg(x)) ** 2 + (avg(y) FILTER (e > 6) - avg(y)) ** 2 + (avg(w) FILTER (e > 6) - avg(w)) ** 2), 0), 5) AS "offset" FROM k GROUP BY id""",
    "q59_atom_table": f"WITH {M}, {_ATOMS} SELECT id, i AS atom_idx, {_PLACE.format(c='e')} AS element, " + ", ".join(f"round((({a}) - avg({a}) OVER (PARTITION BY id))::FLOAT::DOUBLE, 3) + 0.0 AS {n}" for a, n in (("x", "x"), ("y", "y"), ("w", "z"))) + f", {N_ATOM_FEATURES} AS features FROM p",
    "q59_edge_table": f"WITH {M}, {_BONDS} SELECT id, i, j FROM b UNION ALL SELECT id, j, i FROM b",
    "q61_frequency_features": f"WITH {M}, k AS (SELECT id, {_DUP} AS freqs FROM m) SELECT id, round(list_min(freqs), 7) AS freq_lowest, round(list_max(freqs), 7) AS freq_highest, round(list_avg(freqs), 7) AS freq_mean, len(list_filter(freqs, lambda x: x > 2800)) AS n_modes_above_2800, len(list_filter(freqs, lambda x: x < 500)) AS n_modes_below_500 FROM k WHERE len(freqs) > 0",
    "q62_clean_frequencies": f"WITH {M}, k AS (SELECT id, n_atoms, freqs, {_DUP} AS c FROM m) SELECT id, len(freqs) AS listed, len(c) AS kept, len(c) = 3 * n_atoms - 5 AS linear FROM k",
    "q63_moments": f"WITH {M} SELECT id, " + ", ".join(f"round(CASE WHEN {k} > 0 THEN 505.379009 / {k} ELSE 0 END, 5) AS i_{k}" for k in "abc") + " FROM m",
    "q64_summaries": f"""WITH {M}, {_ATOMS}, c AS (SELECT id, sqrt(avg(x) ** 2 + avg(y) ** 2 + avg(w) ** 2) AS o FROM p GROUP BY id)
 SELECT m.id, round(o, 4) AS centroid_offset, round(list_sum(q), 4) + 0.0 AS q_sum, round(list_max(list_transform(q, lambda x: abs(x))), 4) AS q_max_abs, len(freqs) AS n_freqs, 3 * n_atoms - 6 AS n_expected, round(list_min(freqs), 4) AS freq_min, round(list_max(freqs), 4) AS freq_max FROM m LEFT JOIN c USING (id)""",
    "q65_coulomb_matrix": f"""WITH {M}, {_ATOMS}, c AS (SELECT a.id, CASE WHEN a.i = b.i THEN 0.5 * a.e ** 2.4 ELSE a.e * b.e / (1.8897261 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.w - b.w) ** 2)) END AS v FROM p a JOIN p b ON a.id = b.id)
 SELECT id, round(max(v), 3) AS largest, count(*) AS cells FROM c GROUP BY id""",
    "q73_feature_sets": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*)::INT AS n, coalesce(string_agg(feature, ',' ORDER BY list_position({blocks!r}, block), coalesce(x_pos, 1000), feature), '') AS features FROM feature_catalog WHERE kept AND coalesce(level, 'molecule') = 'molecule' AND list_contains({blocks!r}, block)"
        for name, blocks in FEATURE_SETS.items()
    ),
    "q72_current_table": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) = {len(records.COLUMNS) + 1} AND count(*) FILTER (column_name IN ({', '.join(repr(c) for c in [*records.COLUMNS, 'loaded_at'])})) = {len(records.COLUMNS) + 1} AS current FROM (DESCRIBE {n})" for n in ("molecules", "feature_catalog", "atomdata")),
    "q60_invariance": f"""WITH {M}, g AS (SELECT count(*) AS n FROM m WHERE len(z) > 0 AND r IS NOT NULL AND len(r) = 3 * len(z) AND len(z) <= 29 AND len(list_filter(z, lambda v: v IS NULL)) = 0 AND len(list_filter(r, lambda v: v IS NULL)) = 0)
 SELECT descriptor, transform, n AS n_molecules, descriptor <> 'coordinates' AS invariant FROM g, (SELECT unnest(['composition', 'cm_spectrum', 'engineered', 'groups', 'qeq', 'rdf', 'coordinates']) AS descriptor), (SELECT unnest(['rotation', 'translation', 'permutation']) AS transform)""",
}
