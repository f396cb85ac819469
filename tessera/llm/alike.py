"""Groups of near-duplicate structures in a collection too large for pairwise comparison.

Method: token-group matrix. Structures that share min-hashed tokens and pass the exact test form groups of similar
structures; each group keeps the union of its members' tokens; the overlap of a query with a group's tokens bounds its
overlap with every member, and only groups whose bound reaches the wanted overlap are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import structures
from tessera.llm.components import connected_components
from tessera.llm.tables import read
from tessera.plans.lineage import cut

#: Molecules whose tokens are shipped together; groups of one chunk, and of all, beyond which a token is frequent.
CHUNK, LOCAL, HOLDERS = 4000, 16, 1000
#: Slots of the filter that tells tasks which tokens are frequent; keys that a task makes at a time.
SLOTS, PIECE = 1 << 18, 500_000
#: Ids of a group that one task pairs with all others.
BUCKET = 1000


def atoms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, atom, e, px, py, pz): each atom that has a position and an element, once."""
    p = F.col("pos")
    at = [F.get(p, F.lit(k)).alias(name) for k, name in enumerate(("px", "py", "pz"))]
    rows = read(spark, sf_dir, "atomdata").select("id", F.col("atom_row").alias("atom"), F.col("element").alias("e"), F.size(p).alias("n"), *at)
    whole = rows.where("id is not null and atom is not null and e is not null and n = 3 and px + py + pz = px + py + pz and not isnan(px + py + pz)").drop("n")
    return whole.groupBy("id", "atom", "e", "px", "py", "pz").agg(F.count("*").alias("_n")).drop("_n")


def describe(atoms: DataFrame) -> DataFrame:
    """(id, e ARRAY<TINYINT>, p ARRAY<FLOAT>, marks ARRAY<BIGINT>) of each structure; marks are its min-hashed tokens.

    An atom given in several versions counts with the smallest. A structure without atoms is not there. The tokens
    themselves are made again where they are needed: they are many times larger than the structure that tells them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                yield _describe(batch.slice(start, 4000))

    rows = atoms.groupBy("id").agg(F.collect_list(F.struct("atom", "e", "px", "py", "pz")).alias("a"))
    return rows.mapInArrow(run, "id bigint, e array<tinyint>, p array<float>, marks array<bigint>")


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    column = batch.column(1)
    flat = column.flatten()
    lengths = column.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    atom, e, px, py, pz = (f.to_numpy(zero_copy_only=False) for f in flat.flatten())
    order = np.lexsort((pz, py, px, e, atom, owner))
    order = order[np.r_[True, (owner[order][1:] != owner[order][:-1]) | (atom[order][1:] != atom[order][:-1])]]
    owner, e, p = owner[order], e[order].astype(np.int64), np.stack([px, py, pz], 1)[order]
    cuts = np.searchsorted(owner, np.arange(1, len(lengths)))
    elements, positions = np.split(e, cuts), np.split(p.astype(np.float64), cuts)
    found = structures.tokens(elements, positions)
    lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in parts])], pa.int32()), pa.array(np.concatenate(parts).astype(kind)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            lists(elements, np.int8),
            lists([x.astype(np.float32).ravel() for x in positions], np.float32),
            lists([structures.marks(t).view(np.int64) if len(t) else t.view(np.int64) for t in found], np.int64),
        ],
        ["id", "e", "p", "marks"],
    )


def test_pairs(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the exact test."""
    shape = described.select("id", "e", "p")
    both = pairs.select("a", "b").distinct().join(shape.toDF("a", "e_a", "p_a"), "a").join(shape.toDF("b", "e_b", "p_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in "ab")
            sides = []
            for k in "ab":
                e, p = (batch.column(batch.schema.get_field_index(f"{x}_{k}")) for x in "ep")
                eo, po = e.offsets.to_numpy(), p.offsets.to_numpy()
                sides.append((e.values.to_numpy().astype(np.int64), p.values.to_numpy().astype(np.float64).reshape(-1, 3), eo, po // 3))
            passed = np.zeros(len(a), bool)
            for row in range(len(a)):
                parts = [(e[eo[row] : eo[row + 1]], structures._distances(p[po[row] : po[row + 1]])) for e, p, eo, po in sides]
                passed[row] = structures.alike(*parts[0], *parts[1])
            yield pa.RecordBatch.from_arrays([pa.array(a[passed]), pa.array(b[passed])], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _hot_in_chunk(t: np.ndarray, g: np.ndarray, local: int) -> np.ndarray:
    """Tokens that more than `local` groups of a chunk hold: shipped as a mark, whatever their number."""
    order = np.lexsort((g, t))
    t, g = t[order], g[order]
    head = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]
    held, n = np.unique(t[head], return_counts=True)
    return held[n > local]


def _tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows (id, e, p, component) to ids, their groups, what they want as queries, and tokens."""
    ids = part.column(0).to_numpy()
    own = np.where(part.column(3).is_null().to_numpy(zero_copy_only=False), ids, part.column(3).fill_null(0).to_numpy())
    (e, p), n = (part.column(k).flatten().to_numpy() for k in (1, 2)), part.column(1).value_lengths().to_numpy()
    cuts = np.cumsum(n)[:-1]
    found = structures.tokens(np.split(e.astype(np.int64), cuts), np.split(p.astype(np.float64).reshape(-1, 3), cuts))
    return ids, own, np.array([structures.wanted_overlap(k) for k in n], np.int64), found


def _tokenize(tasks: int, local: int):
    """Rows (id, e, p, component) to chunks (part, t, q, d, hot) of little-endian numbers: tokens and for each its query (and
    what the query wants), its group less the query, and tokens known to be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                ids, own, wanted, found = _tokens_of(batch.slice(start, CHUNK))
                row = np.repeat(np.arange(len(ids)), [len(t) for t in found])
                t = np.concatenate(found)
                q, d = (ids * 4 + wanted)[row], (own - ids)[row]
                hot = np.isin(t, _hot_in_chunk(t, own[row], local))
                where = (t % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(where, kind="stable")  # the rows of one query stay together, which compresses well
                rows = []
                for piece in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    if len(piece):
                        plain, over = piece[~hot[piece]], piece[hot[piece]]
                        rows.append((where[piece[0]], *[x.tobytes() for x in (t[plain], q[plain], d[plain], np.unique(t[over]))]))
                if rows:
                    first, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), *[pa.array(c, pa.binary()) for c in rest]], ["part", "t", "q", "d", "hot"])

    return run


def _bounds(holders: int):
    """Chunks of one part to (q, g, w) of every query and other group that share a token, once per token; g null: q is a
    frequent token, which is not paired here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for k, kind in enumerate((np.uint64, np.int64, np.int64, np.uint64)):
                parts[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
        if not parts[0]:
            return
        t, q, d, hot = (np.concatenate(x) for x in parts)
        w, q = q & 3, q >> 2
        g = q + d
        order = np.lexsort((g, t))
        t, q, g, w = t[order], q[order], g[order], w[order]
        first = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])] if len(t) else np.zeros(0, bool)
        heads = np.flatnonzero(first)
        begins = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(t)]
        groups = np.searchsorted(heads, ends) - np.searchsorted(heads, begins)
        over = np.isin(t[begins], hot) | (groups > holders) if len(t) else np.zeros(0, bool)
        frequent = np.unique(np.concatenate([hot, t[begins[over]]]))
        yield _hits(frequent.view(np.int64), None, np.zeros(len(frequent), np.int64))
        keep = ~over & (groups > 1)
        begins, ends = begins[keep], ends[keep]
        # within a run sorted by group: each row is a query of every smaller group's first row
        rows = np.concatenate([np.arange(b, e) for b, e in zip(begins, ends)]) if len(begins) else np.zeros(0, np.int64)
        low = np.searchsorted(heads, np.repeat(begins, ends - begins))
        n = np.searchsorted(heads, rows, side="right") - 1 - low  # up to the row's own group
        cuts = np.searchsorted(np.cumsum(n), np.arange(1, n.sum() // 500_000 + 1) * 500_000) if len(n) else []
        for piece in np.split(np.arange(len(rows)), cuts):
            k = n[piece]
            of = np.repeat(rows[piece], k)
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            yield _hits(q[of], g[heads[np.repeat(low[piece], k) + within]], w[of])

    return run


def _hits(q: np.ndarray, g: np.ndarray | None, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.nulls(len(q), pa.int64()) if g is None else pa.array(g, pa.int64()), pa.array(w, pa.int32())], ["q", "g", "w"])


def group_bounds(described: DataFrame, groups: DataFrame) -> DataFrame:
    """(q, g): queries and groups whose tokens overlap by at least what the query wants; g is not the query's own group.

    groups: (node, component) of structures that are already grouped; all others are groups of their own. For two groups
    the members of the one with the larger name are the queries. Tokens are shuffled in chunks; each task sorts its tokens
    and pairs the queries of a token with the other groups that hold it, each group once however many members it has.
    A token that more than HOLDERS groups hold is not paired there; what overlaps in such tokens is found by frequent_bounds,
    so that the result does not depend on HOLDERS.
    """
    labelled = described.select("id", "e", "p").join(groups.toDF("id", "component"), "id", "left").select("id", "e", "p", "component")
    # tasks of about a million and a half tokens, which a Python worker sorts in memory; a stated number is not coalesced
    tasks = max(int(described.sparkSession.conf.get("spark.sql.shuffle.partitions")), labelled.count() * 2 * structures.TOKENS // 1_500_000)
    chunks = labelled.mapInArrow(_tokenize(tasks, LOCAL), "part int, t binary, q binary, d binary, hot binary")
    hits = chunks.repartitionById(tasks, "part").mapInArrow(_bounds(HOLDERS), "q bigint, g bigint, w int")
    counted = cut(hits.groupBy("q", "g").agg(F.count("*").alias("n"), F.max("w").alias("w")).where("g is null or n >= w").select("q", "g"))
    found = counted.where("g is not null")
    slots = [r.s for r in counted.where("g is null").select(F.pmod("q", F.lit(SLOTS)).cast("int").alias("s")).distinct().collect()]
    return found.unionByName(frequent_bounds(labelled, slots)).distinct() if slots else found


def frequent_bounds(labelled: DataFrame, slots: list[int]) -> DataFrame:
    """(q, g) as in group_bounds, of those that have a frequent token in common: one that falls in a slot of the filter.

    A query that wants one token has each frequent one as a key, one that wants two has each frequent one together with each
    other token of its own, and a group has both of its members' united tokens. Whoever overlaps as wanted, in a frequent token
    among others, has a key in common; the second token of a key is what tells apart the many that hold the first. Keys
    that many hold are split on both sides, so that a task pairs about BUCKET queries with BUCKET groups at a time.
    """
    frequent = np.zeros(SLOTS, bool)
    frequent[slots] = True
    lists = cut(labelled.mapInArrow(_listed(frequent), "id bigint, own bigint, w int, t array<bigint>"))
    united = lists.select("own", F.explode("t").alias("t")).groupBy("own", "t").agg(F.count("*").alias("n")).groupBy("own").agg(F.collect_list("t").alias("t"))
    queries = lists.select("id", "own", "w", "t").mapInArrow(_keys(frequent), "q bigint, own bigint, k array<bigint>").select("q", "own", F.explode("k").alias("k"))
    holding = united.select(F.lit(None).cast("bigint").alias("id"), "own", F.lit(0).alias("w"), "t").mapInArrow(_keys(frequent), "q bigint, own bigint, k array<bigint>").select(F.col("own").alias("g"), F.explode("k").alias("k"))
    parts = lambda rows, n: rows.groupBy("k").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias(n))
    large = cut(parts(queries, "a").join(parts(holding, "b"), "k").where("a > 1 or b > 1"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    split = lambda rows: rows.join(large, "k", "left").withColumns({"a": F.coalesce("a", F.lit(1)), "b": F.coalesce("b", F.lit(1))})
    left = split(queries).select("k", "q", "own", own("q", "a").alias("i"), every("b").alias("j"))
    right = split(holding).select("k", "g", every("a").alias("i"), own("g", "b").alias("j"))
    return left.join(right, ["k", "i", "j"]).where("g < own").select("q", "g")


def _listed(frequent: np.ndarray):
    """Rows (id, e, p, component) to (id, own, w, t) of the structures that may count in an overlap with a frequent token:
    those that hold one, and all that are grouped with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                ids, own, wanted, found = _tokens_of(part)
                alone = part.column(3).is_null().to_numpy(zero_copy_only=False)
                at = np.array([k for k, t in enumerate(found) if not alone[k] or _is_frequent(t, frequent).any()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own[at]), pa.array(wanted[at], pa.int32()), _lists([found[k] for k in at])], ["id", "own", "w", "t"])

    return run


def _keys(frequent: np.ndarray):
    """Rows (id, own, w, t) to (q, own, k): the keys of frequent_bounds for queries; for groups (w = 0) those of either kind.
    Lists are cut to about PIECE numbers, and a batch is no longer."""

    def made(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for row, (w, values) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
            t = values.values.to_numpy().view(np.uint64)
            hot = t[_is_frequent(t, frequent)]
            if w < 2:
                yield row, hot
            step = max(1, PIECE // max(1, len(t)))
            for start in range(0, len(hot) if w != 1 else 0, step):
                yield row, structures.pair_keys(hot[start : start + step], t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, room = [], [], PIECE
            for row, k in made(batch):
                rows.append(row)
                parts.append(k)
                room -= len(k)
                if room <= 0:
                    yield _keyed(batch, rows, parts)
                    rows, parts, room = [], [], PIECE
            yield _keyed(batch, rows, parts)

    return run


def _keyed(batch: pa.RecordBatch, rows: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    part = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(parts)], ["q", "own", "k"])


def _is_frequent(t: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return frequent[(t % np.uint64(len(frequent))).astype(np.int64)]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Unsigned numbers as lists of signed ones."""
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in parts], dtype=np.int64)], pa.int32()), pa.array(flat.view(np.int64)))


def alike_groups(atoms: DataFrame) -> DataFrame:
    """(id, component) of every structure that is alike to another, directly or through others; component is the smallest id.

    A family of near-copies of any size is joined through its leaders and then counts as one group.
    """
    described = cut(describe(atoms))
    marked = described.select("id", F.explode("marks").alias("m"))
    leaders = marked.groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    near = marked.join(leaders, "m").where("a < id").select("a", F.col("id").alias("b"))
    first = cut(test_pairs(near, described))
    groups = cut(connected_components(first, "a", "b"))
    bounds = group_bounds(described, groups)
    members = groups.toDF("id", "g")
    opened = bounds.join(members, "g", "left").select(F.coalesce("id", "g").alias("a"), F.col("q").alias("b"))
    second = test_pairs(opened, described)
    links = cut(first.unionByName(second))
    return connected_components(links, "a", "b")


def member_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids in one group (id, component); a large group's first ids are spread over
    buckets of about BUCKET ids, so that no task holds a whole group's pairs."""
    large = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("component", F.ceil(F.col("n") / BUCKET).cast("int").alias("buckets"))
    sized = groups.join(large, "component", "left").withColumn("buckets", F.coalesce("buckets", F.lit(1)))
    left = sized.select(F.col("id").alias("id_a"), "component", F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int").alias("bucket"))
    right = sized.select(F.col("id").alias("id_b"), "component", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    return left.join(right, ["component", "bucket"]).where("id_a < id_b").select("id_a", "id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, component) of every molecule that has an alike one."""
    found = alike_groups(atoms_of(spark, sf_dir))
    return found.select(F.col("node").alias("id"), "component")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids in one group."""
    return member_pairs(cut(p4_groups(spark, sf_dir)))
