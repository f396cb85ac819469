"""Descriptors, atom tables and invariance checks over molecule tables: one narrow Arrow stage each, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import molecule_kernels as k
from tessera.operators.surroundings import CHUNK, described, surroundings

#: Largest change that counts as none.
TOLERANCE = 1e-8


def _molecules(batch: pa.RecordBatch):
    """(z, r) or None of each row of a batch (id, z, r); rows with nulls, no atoms, other elements or odd lengths are None."""
    for z, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        if not z or r is None or None in z or None in r or len(r) != 3 * len(z) or not set(z) <= {1, 6, 7, 8, 9} or len(z) > k.MAX_ATOMS:
            yield None
        else:
            yield np.array(z), np.array(r, float).reshape(-1, 3)


def _batches(run):
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield run(batch)

    return outer


def _rows(name: str, found: list) -> pa.Array:
    """Lists of a descriptor's values, null for molecules that are None."""
    known = [m for m in found if m is not None]
    values = described(name, known) if known else np.zeros((0, len(k.DESCRIPTORS[name][1])))
    missing = np.array([m is None for m in found])
    lengths = np.where(missing, 0, values.shape[1])
    return _ragged(pa.array(values.ravel()), np.r_[0, np.cumsum(lengths)], missing)


def featurize(table: DataFrame, name: str) -> DataFrame:
    """(id, features ARRAY<DOUBLE>) by descriptor name; null where a molecule cannot be described."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(_molecules(batch))
        return pa.RecordBatch.from_arrays([batch.column(0), _rows(name, found)], ["id", "features"])

    return table.select("id", "z", "r").mapInArrow(_batches(run), "id bigint, features array<double>")


def feature_frame(table: DataFrame, name: str) -> DataFrame:
    """featurize as named columns."""
    _, names = k.DESCRIPTORS[name]
    return featurize(table, name).select("id", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])


ENVIRONMENT = "element array<tinyint>, features array<array<double>>, qeq_charges array<double>, groups array<double>, qeq array<double>, rdf array<double>, edges array<struct<i:int,j:int,ux:double,uy:double,uz:double>>"


def _ragged(values: pa.Array, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Lists of lengths told by offsets; null where missing."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=pa.array(missing))


def _matrix(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def environments(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ENVIRONMENT..., keep...): everything derived from one molecule; edges list each bond in both directions with its
    unit vector. Columns of the table named in `keep` come along, so that no join has to bring them back.

    Molecules are described CHUNK at a time from one table of their atom pairs; results leave as flat Arrow arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                found = _environments(part)
                yield pa.RecordBatch.from_arrays([*found.columns, *(part.column(3 + k) for k in range(len(keep)))], [*found.schema.names, *keep])

    kept = "".join(f", {c} {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select("id", "z", "r", *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)]).mapInArrow(run, f"id bigint, {ENVIRONMENT}{kept}")


def _environments(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = list(_molecules(batch))
    missing = np.array([m is None for m in found])
    sizes = np.array([0 if m is None else len(m[0]) for m in found])
    first = np.r_[0, np.cumsum(sizes)]
    known = [m for m in found if m is not None]
    z = np.concatenate([m[0] for m in known]) if known else np.zeros(0, int)
    r = np.concatenate([m[1] for m in known]) if known else np.zeros((0, 3))
    s = surroundings(z, r, first)
    owner = np.repeat(np.arange(len(found)), sizes)
    edges = np.r_[0, np.cumsum(np.bincount(owner[s.bond.i], minlength=len(found)))] if len(owner) else np.zeros(len(found) + 1, int)
    begin = first[owner[s.bond.i]] if len(owner) else np.zeros(0, int)
    edge = pa.StructArray.from_arrays(
        [pa.array((s.bond.i - begin).astype(np.int32)), pa.array((s.bond.j - begin).astype(np.int32)), *[pa.array(np.ascontiguousarray(s.bond.unit[:, a])) for a in range(3)]],
        ["i", "j", "ux", "uy", "uz"],
    )
    whole = np.arange(len(found) + 1)
    blocks = [_ragged(pa.array(b.ravel()), whole * b.shape[1], missing) for b in (s.groups, s.qeq, s.rdf)]
    columns = [_ragged(pa.array(s.element.astype(np.int8)), first, missing), _ragged(_matrix(s.x), first, missing), _ragged(pa.array(s.q), first, missing), *blocks, _ragged(edge, edges, missing)]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "element", "features", "qeq_charges", "groups", "qeq", "rdf", "edges"])


def atom_table(environment: DataFrame, table: DataFrame) -> DataFrame:
    """(id, atom_idx, element, pos, x): the long atom table of described molecules, positions centred per molecule."""
    from tessera.functions.arrays import mean, points

    p = points(F.col("r"))
    rows = environment.join(table.select("id", "r"), "id").where("features is not null")
    at = lambda axis: F.transform(p, lambda v: v[axis])
    centred = rows.select("id", "element", "features", at("x").alias("x"), at("y").alias("y"), at("z").alias("z"))
    moved = centred.select("id", "element", "features", *[F.col(a) for a in "xyz"], *[mean(F.col(a)).alias(f"m{a}") for a in "xyz"])
    long = moved.select("id", "element", "x", "y", "z", "mx", "my", "mz", F.posexplode("features").alias("atom_idx", "f"))
    pick = lambda c: F.get(F.col(c), F.col("atom_idx"))
    pos = F.array(*[(pick(a) - F.col(f"m{a}")).cast("float") for a in "xyz"])
    return long.select("id", "atom_idx", pick("element").alias("element"), pos.alias("pos"), F.col("f").cast("array<float>").alias("x"))


def edge_table(environment: DataFrame) -> DataFrame:
    """(id, i, j, ux, uy, uz) of every directed bond."""
    return environment.select("id", F.explode("edges").alias("e")).select("id", "e.*")


def bond_lengths(table: DataFrame) -> DataFrame:
    """(id, pair, length) of every bond, by native array expressions."""
    from tessera.functions.arrays import bonds
    from tessera.functions.composition import ELEMENTS

    symbol = F.create_map(*[F.lit(v) for s, n in ELEMENTS for v in (n, s)])
    place = F.create_map(*[F.lit(v) for i, (_, n) in enumerate(ELEMENTS) for v in (n, i)])
    long = table.select("id", "z", F.explode(bonds(F.col("z"), F.col("r"))).alias("b"))
    a, b = F.get("z", F.col("b.i")).cast("int"), F.get("z", F.col("b.j")).cast("int")
    pair = F.when(place[a] <= place[b], F.concat_ws("-", symbol[a], symbol[b])).otherwise(F.concat_ws("-", symbol[b], symbol[a]))
    return long.select("id", pair.alias("pair"), F.col("b.d").alias("length"))


def bond_order_counts(table: DataFrame) -> DataFrame:
    """(id, name, n) of multiple bonds: a range join of bond lengths with the fixed table of five rules."""
    from tessera.functions.arrays import bonds

    spark = table.sparkSession
    rules = spark.createDataFrame([(name, p[0], p[1], lo, hi) for name, p, lo, hi in k.BOND_ORDERS], "name string, a int, b int, lo double, hi double")
    long = table.select("id", "z", F.explode(bonds(F.col("z"), F.col("r"))).alias("e"))
    za, zb = F.get("z", F.col("e.i")).cast("int"), F.get("z", F.col("e.j")).cast("int")
    long = long.select("id", F.least(za, zb).alias("a"), F.greatest(za, zb).alias("b"), F.col("e.d").alias("d"))
    return long.join(F.broadcast(rules), ["a", "b"]).where("d >= lo and d < hi").groupBy("id", "name").agg(F.count("*").alias("n"))


def invariance_table(table: DataFrame, seed: int = 0, descriptors: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(descriptor, transform, n_molecules, mean_change, max_change, invariant); "coordinates" must come out as not invariant.

    Each molecule's motion depends on (seed, descriptor, transform, id), not on the work split.
    """
    names = descriptors or list(k.DESCRIPTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                found = [(ident, m) for ident, m in zip(part.column(0).to_pylist(), _molecules(part)) if m is not None]
                if not found:
                    continue
                mols = [m for _, m in found]
                for i, name in enumerate(names):
                    base = described(name, mols)
                    for j, (transform, move) in enumerate(k.TRANSFORMS.items()):
                        moved = [move(*m, np.random.default_rng([seed, i, j, ident])) for ident, m in found]
                        change = np.abs(described(name, moved) - base).max(1)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(mols)), pa.array([transform] * len(mols)), pa.array(change)], ["descriptor", "transform", "change"])

    changes = table.select("id", "z", "r").mapInArrow(run, "descriptor string, transform string, change double")
    return changes.groupBy("descriptor", "transform").agg(
        F.count("*").alias("n_molecules"), F.avg("change").alias("mean_change"), F.max("change").alias("max_change"), (F.max("change") <= tolerance).alias("invariant")
    )


def legal_features(table: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """(id, columns): descriptor values of the named molecules from z and r, rounded through 32-bit floats as a feature store
    keeps them; KeyError names columns that no descriptor has, MissingKeys ids that the table has not."""
    from tessera.operators.relational import MissingKeys

    every = {name: (descriptor, at) for descriptor in k.MODEL_DESCRIPTORS for at, name in enumerate(k.DESCRIPTORS[descriptor][1])}
    if missing := [c for c in columns if c not in every]:
        raise KeyError(f"features that no descriptor has: {missing[:5]}")
    wanted = ids.select("id").distinct()
    if lost := wanted.join(table, "id", "left_anti").limit(5).collect():
        raise MissingKeys([r.id for r in lost])
    needed = list(dict.fromkeys(every[c][0] for c in columns))
    places = [(needed.index(every[c][0]), every[c][1]) for c in columns]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(_molecules(batch))
        known, missing = [m for m in found if m is not None], np.array([m is None for m in found])
        blocks = [described(name, known) for name in needed] if known else []
        values = np.stack([blocks[b][:, at] for b, at in places], 1).astype(np.float32).astype(float) if known else np.zeros((0, len(places)))
        column = _ragged(pa.array(values.ravel()), np.r_[0, np.cumsum(np.where(missing, 0, len(places)))], missing)
        return pa.RecordBatch.from_arrays([batch.column(0), column], ["id", "features"])

    rows = table.select("id", "z", "r").join(wanted, "id", "left_semi").mapInArrow(_batches(run), "id bigint, features array<double>")
    return rows.select("id", *[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def evaluation_frame(stored: DataFrame, table: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Stored features of the molecules that have them, and computed ones of all other ids."""
    known = stored.select("id", *[F.col(c).cast("double").alias(c) for c in columns])
    return known.unionByName(legal_features(table, ids.select("id").distinct().join(known, "id", "left_anti"), columns))


def load_atoms(table: DataFrame, ids: DataFrame, kept: list[str]) -> DataFrame:
    """ENVIRONMENT rows of the named molecules with only the kept atom features, in the order of ATOM_FEATURES."""
    at = [n for n, name in enumerate(k.ATOM_FEATURES) if name in set(kept)]
    rows = environments(table.join(ids.select("id").distinct(), "id", "left_semi"))
    pick = F.transform("features", lambda row: F.array(*[F.get(row, F.lit(n)) for n in at]))
    return rows.withColumn("features", F.when(F.col("features").isNotNull(), pick))


def subset_atoms(environment: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(atoms (row, id, atom_idx, element, x), edges (i, j, ux, uy, uz)) of wanted molecules (pos, id) one after another: row
    numbers run on from molecule to molecule in order of pos, and edges point to them. Raises MissingKeys for unknown ids.

    An environment without features gives atoms without x, one without edges gives None for them.
    """
    from tessera.operators.relational import MissingKeys, running_total

    if lost := wanted.join(environment, "id", "left_anti").limit(5).collect():
        raise MissingKeys([r.id for r in lost])
    there = [c for c in ("features", "edges") if c in environment.columns]
    sized = wanted.join(environment.select("id", F.size("element").alias("n"), "element", *there), "id")
    first = running_total(sized.select("pos", "id", "n"), "pos", "n", "first").select("pos", "first")
    rows = sized.join(first, "pos")
    atoms = rows.select("first", "id", F.posexplode("element").alias("atom_idx", "element"), *[c for c in there if c == "features"])
    x = [F.get("features", F.col("atom_idx")).alias("x")] if "features" in there else []
    atoms = atoms.select((F.col("first") + F.col("atom_idx")).alias("row"), "id", "atom_idx", "element", *x)
    if "edges" not in there:
        return atoms, None
    edges = rows.select("first", F.explode("edges").alias("e"))
    return atoms, edges.select((F.col("first") + F.col("e.i")).alias("i"), (F.col("first") + F.col("e.j")).alias("j"), "e.ux", "e.uy", "e.uz")
