"""The most similar vectors of every vector, by collision counting on sorted projections.

Method: collision-counting hashing. In each of several tables every vector is projected on random orthonormal directions.
Coarse cells of some projections (virtual rehashing: the cell width follows the radius, the number of projections the size
of the collection) cut the sorted array of one further projection into runs; a window centred on each vector slides over
its run, collisions with it are counted on the remaining projections, and vectors with enough collisions are verified.
Rows that have too few verified neighbours within the radius go on with windows and cells of twice the width, on the same
projections; where windows would hold most of the collection, the rest is held against all of it in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tables import read
from tessera.plans.lineage import cut

#: Tables at least, projections whose collisions are counted, and how many of those must collide.
TABLES, COUNTED, COLLISIONS = 5, 12, 11
#: In units of the radius: cell width, half a window, and the step in which counted projections are kept, in so many bits.
CELL, WINDOW, STEP, BITS = 2.5, 0.6, 0.2, 5
#: Vectors of one cell that the number of cell projections aims at, for features of the given spread.
CELL_ROWS, SPREAD = 300, 1.0
#: Share of the pairs at the radius itself that the tables together are expected to find, at any number of rows.
RECALL = 0.985
#: Windows that one stretch of a sorted array is long; a full cell is cut into stretches, their edges belong to both.
STRETCH = 8
#: Records of one task (24 bytes each), which a Python worker sorts in memory.
TASK_RECORDS = 400_000
#: Words of 64 bits of the filter that keeps vectors without a candidate from being shuffled: at most so many rows are
#: broadcast, whatever the data; beyond some ten million candidates it lets more through, and nothing is lost.
FILTER_WORDS = 1 << 20

RECORD = np.dtype([("key", "<u4"), ("at", "<f4"), ("sketch", "<i8"), ("name", "<i8")])


def directions(width: int, table: int, columns: int, seed: int = 17) -> np.ndarray:
    """Orthonormal directions (as many as fit), the same for every task."""
    rng = np.random.default_rng([seed, table])
    return np.linalg.qr(rng.standard_normal((width, width)))[0][:, :columns]


def cell_projections(rows: int, width: int, radius: float, spread: float = SPREAD) -> int:
    """How many projections the cells need so that a cell holds about CELL_ROWS vectors."""
    same = min(0.9, 0.264 * CELL * radius / spread)
    return int(min(max(1, round(math.log(max(rows, 2) / CELL_ROWS) / -math.log(same))), max(1, width - COUNTED - 1)))


def counted_projections(n_cells: int, width: int) -> int:
    return max(0, min(COUNTED, width - n_cells - 1))


def table_chance(n_cells: int, width: int) -> float:
    """The chance that one table finds a pair at the radius; differences along a direction are about normal, 1 / width their variance."""
    sd = 1 / math.sqrt(width)
    counted = counted_projections(n_cells, width)
    hit = math.erf(WINDOW / sd / math.sqrt(2))
    enough = sum(math.comb(counted, k) * hit**k * (1 - hit) ** (counted - k) for k in range(max(0, counted - COUNTED + COLLISIONS), counted + 1))
    return (1 - math.sqrt(2 / math.pi) * sd / CELL) ** n_cells * hit * enough


def tables_needed(n_cells: int, width: int) -> int:
    """Tables that find RECALL of the pairs at the radius; TABLES at least."""
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - table_chance(n_cells, width))))


def _records(x: np.ndarray, name: np.ndarray, radius: float, n_cells: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of cell and stretch, records) of vectors in one table; a vector at the edge of a stretch is in both."""
    width = x.shape[1]
    counted = counted_projections(n_cells, width)
    p = x @ directions(width, table, min(width, n_cells + 1 + counted)) / radius
    shift = np.random.default_rng([23, table]).random(n_cells) * CELL
    cells = np.floor((p[:, :n_cells] + shift) / CELL).astype(np.int64).view(np.uint64)
    key = np.full(len(x), table + 1, np.uint64)
    for k in range(n_cells):
        key = (key ^ cells[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    at = p[:, n_cells % p.shape[1]].astype(np.float32)
    # kept modulo 2^BITS steps: far values may look near, never the other way round
    steps = np.floor(p[:, n_cells + 1 :] / STEP).astype(np.int64) & ((1 << BITS) - 1)
    sketch = (steps << (BITS * np.arange(counted))).sum(1)
    long = STRETCH * WINDOW
    stretch = np.floor(at / long)
    edge = at - stretch * long <= WINDOW
    row = np.r_[np.arange(len(x)), np.flatnonzero(edge)]
    where = np.r_[stretch, stretch[edge] - 1].astype(np.int64).view(np.uint64)
    key = (key[row] ^ where) * np.uint64(0xD1B54A32D192ED03)
    key ^= key >> np.uint64(31)
    out = np.empty(len(row), RECORD)
    out["key"], out["at"], out["sketch"], out["name"] = (key >> np.uint64(32)).astype(np.uint32), at[row], sketch[row], name[row]
    return key, out


def _hash_rows(radius: float, width: int, n_cells: int, tables: int, tasks: int):
    """Rows (h, x) to chunks (part, records) of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # copies in a batch count once
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)[first]
            good = np.isfinite(x).all(1)
            name, x = name[good], x[good]
            if not len(x):
                continue
            both = [_records(x, name, radius, n_cells, t) for t in range(tables)]
            part = np.concatenate([k % np.uint64(tasks) for k, _ in both]).astype(np.int64)
            records = np.concatenate([r for _, r in both])
            order = np.argsort(part, kind="stable")
            part, records = part[order], records[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["part", "records"])

    return run


def _window_pairs(radius_window: float, counted: int):
    limit, mask = math.ceil(round(radius_window / STEP, 9)), np.uint8((1 << BITS) - 1)
    least = max(0, counted - COUNTED + COLLISIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, RECORD) for batch in batches for x in batch.column(1).to_pylist()]
        if not parts:
            return
        records = np.concatenate(parts)
        key, at, sketch, name = (np.ascontiguousarray(records[c]) for c in RECORD.names)
        order = np.lexsort((name, at, key))
        # copies of a vector lie side by side; one of them stands for all before any pair is formed
        order = order[np.r_[True, (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])]]
        key, at, name = key[order], at[order], name[order]
        marks = ((sketch[order][:, None] >> (BITS * np.arange(counted))) & mask).astype(np.uint8)
        halves = np.ascontiguousarray(marks[:, : (counted + 1) // 2]), np.ascontiguousarray(marks[:, (counted + 1) // 2 :])
        active = np.arange(len(key) - 1)
        step = 1
        while len(active):
            active = active[active + step < len(key)]
            other = active + step
            stay = (key[other] == key[active]) & (at[other] - at[active] <= radius_window)
            active = active[stay]
            a, b = active, active + step
            missing = np.zeros(len(a), np.int64)
            for half in halves:
                if half.shape[1] and len(a):
                    # differences wrap, as the sketch does
                    off = (half[a] - half[b]) & mask
                    missing = missing + ((off > limit) & (off <= mask - limit)).sum(1)
                    fits = missing <= counted - least
                    a, b, missing = a[fits], b[fits], missing[fits]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(name[a], name[b])), pa.array(np.maximum(name[a], name[b]))], ["a", "b"])
            step += 1

    return run


def candidate_pairs(vectors: DataFrame, width: int, radius: float, rows: int, tables: int | None = None) -> DataFrame:
    """(a, b): pairs of different vectors, named by their hashes, with enough collisions.

    vectors: (h, x). Each vector is shuffled once per table, as its cell, two numbers and its name (24 bytes), never whole.
    """
    n_cells = cell_projections(rows, width, radius)
    tables = tables or tables_needed(n_cells, width)
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * tables * (1 + 1 / STRETCH) / TASK_RECORDS))
    chunks = vectors.select("h", "x").mapInArrow(_hash_rows(radius, width, n_cells, tables, tasks), "part int, records binary")
    found = chunks.repartitionById(tasks, "part").mapInArrow(_window_pairs(WINDOW, counted_projections(n_cells, width)), "a bigint, b bigint")
    return found.where("a <> b").distinct()


def _only_named(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of vectors (h, ...) whose h is among names (h); a fixed-size filter goes before the join."""
    word = lambda h: h.bitwiseAND(FILTER_WORDS - 1)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 20).bitwiseAND(63).cast("int"))
    words = names.groupBy(word(F.col("h")).alias("_word")).agg(F.bit_or(bit(F.col("h"))).alias("_bits"))
    likely = vectors.withColumn("_word", word(F.col("h"))).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit(F.col("h"))) != 0)
    # written, since the optimizer would push the second join below the filter and shuffle every vector
    return cut(likely.drop("_word", "_bits")).join(names, "h", "left_semi")


def most_similar(vectors: DataFrame, width: int, k: int, radius: float, rows: int, tables: int | None = None) -> DataFrame:
    """(row, neighbour, d): of each row the k nearest others within the radius, equal distances in order of row.

    vectors: (row BIGINT, x ARRAY<FLOAT>), a row once or several times with the same vector. Vectors of another width, or
    with null, NaN or infinite values, are not in the collection. A vector is named by a 64-bit hash of its values; copies
    have one name and are one before any pair is formed, however many there are: each copy's neighbours are the first of
    the others. A row without any vector within the radius is not in the result.
    """
    clean = vectors.where(F.col("row").isNotNull() & (F.size("x") == width)).select(F.xxhash64("x").alias("h"), "row", "x")
    pairs = cut(candidate_pairs(clean, width, radius, rows, tables))
    copies = clean.groupBy("h").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("h")
    asked = cut(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(copies).distinct())
    held = _only_named(clean, asked).where("not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    members = cut(held.groupBy("h", "row").agg(F.first("x").alias("x")))
    vector = members.groupBy("h").agg(F.min_by("x", "row").alias("x"))
    both = pairs.join(vector.toDF("a", "x_a"), "a").join(vector.toDF("b", "x_b"), "b")
    square = F.aggregate(F.zip_with("x_a", "x_b", lambda u, v: (u.cast("double") - v) * (u.cast("double") - v)), F.lit(0.0), lambda s, v: s + v)
    near = both.select("a", "b", F.sqrt(square).alias("d")).where(F.col("d") <= radius)
    ranked = members.select("h", "row").withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("row"))).where(F.col("n") <= k + 1)
    firsts = cut(ranked)
    near = cut(near)
    way = near.select(F.col("a").alias("u"), F.col("b").alias("h"), "d").unionByName(near.select(F.col("b").alias("u"), F.col("a").alias("h"), "d"))
    return _rows_near(way, firsts, members, k)


def _rows_near(way: DataFrame, firsts: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(row, neighbour, d) of members (h, row) from the names' distances (u, h, d) and the first rows (h, row, n) of each name."""
    others = way.join(firsts.where(F.col("n") <= k), "h").select("u", "d", F.col("row").alias("neighbour"))
    own = firsts.select(F.col("h").alias("u"), F.lit(0.0).alias("d"), F.col("row").alias("neighbour"))
    best = F.row_number().over(Window.partitionBy("u").orderBy("d", "neighbour"))
    lists = others.unionByName(own).withColumn("n", best).where(F.col("n") <= k + 1)
    lists = lists.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("d", "neighbour"))).alias("near"))
    rest = F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("row")), 1, k)
    return members.select(F.col("h").alias("u"), "row").join(lists, "u").select("row", F.explode(rest).alias("e")).select("row", "e.neighbour", "e.d")


#: Vectors of a broadcast piece of the collection (about 50 MB), and rows and columns of one block of distances.
PIECE, BLOCK_ROWS, BLOCK_COLUMNS = 500_000, 256, 20_000


def _nearest_names(piece, width: int, k: int):
    """Tasks that give (u, h, d): of each query vector the k nearest other vectors of the piece, and all as near as the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flat = piece.value
        v = flat.reshape(-1, width)
        for batch in batches:
            every = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            for start in range(0, len(every), BLOCK_ROWS):
                own, q = batch.column(0).to_numpy()[start : start + BLOCK_ROWS], every[start : start + BLOCK_ROWS]
                i, j, d = _nearest_block(own, q, names, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(names[j]), pa.array(d)], ["u", "h", "d"])

    return run


def _nearest_block(own: np.ndarray, q: np.ndarray, names: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.float32 if max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) < 1e15 else np.float64
    q_, best = q.astype(kind), np.full(len(q), np.inf)
    q2 = (q_ * q_).sum(1)
    i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(v), BLOCK_COLUMNS):
        part = v[at : at + BLOCK_COLUMNS].astype(kind)
        v2 = (part * part).sum(1)
        square = q_ @ part.T
        square *= -2
        square += v2
        # rounding may only add candidates; the distances themselves are taken again in double precision
        slack = 32 * np.finfo(kind).eps * (q2.astype(float) + float(v2.max()))
        if at == 0 and len(part) > k + 1:
            best = np.partition(square, k, 1)[:, k].astype(float) + q2 + 2 * slack
        a, b = np.nonzero(square <= (best - q2 + slack).astype(kind)[:, None])
        different = own[a] != names[at + b]
        a, b = a[different], b[different] + at
        off = q[a].astype(np.float64) - v[b]
        i, j, d = np.r_[i, a], np.r_[j, b], np.r_[d, np.sqrt((off * off).sum(1))]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        begin = np.searchsorted(i, np.arange(len(q)))
        n = np.diff(np.r_[begin, len(i)])
        last = np.full(len(q), np.inf)
        last[n >= k] = d[begin[n >= k] + k - 1]
        keep = d <= last[i]
        i, j, d = i[keep], j[keep], d[keep]
        best = np.minimum(best, last * last)
    return i, j, d


def k_nearest(vectors: DataFrame, width: int, k: int, radius: float, rows: int, rounds: int = 2) -> DataFrame:
    """(row, neighbour, d): of each row the k nearest others at any distance, equal distances in order of row.

    vectors as in most_similar. Each round takes the rows that have k verified neighbours within its radius; the others go on
    with twice the radius. After the last round the rows that are left are held against the whole collection, in pieces of
    PIECE vectors: features whose nearest neighbours are almost as far as any others leave nothing that wider windows could
    skip. The work of this step is rows without k near ones times vectors.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col("row").isNotNull() & (F.size("x") == width)).where("not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    members = cut(clean.select(F.xxhash64("x").alias("h"), "row", "x").groupBy("h", "row").agg(F.first("x").alias("x")))
    missing, done = members, None
    for turn in range(rounds):
        near = cut(most_similar(members.select("row", "x"), width, k, radius * 2**turn, rows))
        full = near.groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("row")
        ready = near.join(full, "row", "left_semi").join(missing.select("row"), "row", "left_semi").select("row", "neighbour", "d")
        done = ready if done is None else done.unionByName(ready)
        missing = cut(missing.join(full, "row", "left_anti"))
    vector = cut(members.groupBy("h").agg(F.min_by("x", "row").alias("x")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 20_000))
    asked = cut(vector.join(missing.select("h").distinct(), "h", "left_semi").repartition(tasks, "h"))
    pieces = max(1, -(-vector.count() // PIECE))
    way = None
    for piece in range(pieces):
        held = vector.where(F.pmod(F.xxhash64("h"), F.lit(pieces)) == piece).toArrow()
        flat = held.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        sent = spark.sparkContext.broadcast((held.column("h").to_numpy(), flat))
        found = cut(asked.mapInArrow(_nearest_names(sent, width, k), "u bigint, h bigint, d double"))
        sent.destroy()
        way = found if way is None else way.unionByName(found)
    ranked = members.select("h", "row").withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("row")))
    far = _rows_near(way, cut(ranked.where(F.col("n") <= k + 1)), missing.select("h", "row"), k)
    return done.unionByName(far)


# The features of an atom, the neighbours wanted, and the largest distance of a similar pair.
WIDTH, K, RADIUS = 24, 5, 0.5


def atom_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """((row, x) of the atoms of both tables, how many there are with repeated deliveries)."""
    atoms = read(spark, sf_dir, "atomdata").select(F.col("atom_row").alias("row"), F.col("x").cast("array<float>").alias("x"))
    environment = read(spark, sf_dir, "atom_environment")
    inner = environment.select("id", F.posexplode("features").alias("k", "x"))
    more = inner.select((F.col("id") * 32 + F.col("k")).alias("row"), F.col("x").cast("array<float>").alias("x"))
    inside = environment.agg(F.coalesce(F.sum(F.greatest(F.size("features"), F.lit(0))), F.lit(0))).first()[0]
    return atoms.unionByName(more), atoms.count() + inside


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, neighbour, d): of each atom the five most similar other atoms."""
    vectors, rows = atom_vectors(spark, sf_dir)
    return k_nearest(vectors, WIDTH, K, RADIUS, rows)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_a, row_b), row_a < row_b: pairs of which one is among the other's five nearest, at distance 0.5 or less."""
    vectors, rows = atom_vectors(spark, sf_dir)
    found = most_similar(vectors, WIDTH, K, RADIUS, rows)
    return found.select(F.least("row", "neighbour").alias("row_a"), F.greatest("row", "neighbour").alias("row_b")).distinct()
