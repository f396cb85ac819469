"""Splits that keep related records together and meet given shares.

Method: component swap search. Components start at hashed places; whole components are then moved or exchanged by
parallel annealing, which lowers the deviation of sizes and of label shares; the best of the parallel runs is kept.

A component may be allowed at some places only. Being at another place costs more than any deviation, so the search itself
brings every component to where it belongs. Random numbers are hashes of (seed, task, block, run, step): a task's result
does not depend on the tasks it is searched beside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import build_formulas, builds, fill_orders, molecule_keys, stored_members
from tessera.plans.lineage import cut

#: Components that one search holds: those larger than 1/BLOCK of their task (at most BLOCK) are searched first and together,
#: the others side by side in blocks of about BLOCK, each against its part of what is left of the goals.
BLOCK = 4096
#: Parallel runs, proposals per component and run, and searches that a task steps through at once.
RUNS, SWEEPS, LANES = 8, 12, 64
#: Weight of the deviation of label shares against that of sizes, and of records at places where they may not be.
LABEL_WEIGHT, FORBIDDEN = 0.3, 4
#: Rows (component and label) of one task, and copies of a task's totals that a join with its components is spread over.
TASK_ROWS, SALT = 200_000, 16
#: Sizes and goals are integers in units of 1/UNIT record, so that sums do not depend on their order.
UNIT = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(value: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    h = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Search:
    """One search: counts (components, labels) and goal (places, labels) in records, allowed (components, places), names."""

    key: int
    names: np.ndarray
    counts: np.ndarray
    allowed: np.ndarray
    goal: np.ndarray


def anneal(searches: list[Search], runs: int = RUNS, sweeps: int = SWEEPS) -> list[np.ndarray]:
    """Places of each search's components.

    The energy of a run is what its places hold above their goals, of all records and of each label; where everything is
    placed, what is above is also what is missing elsewhere. Each step proposes, in each run, to move the next component
    to a place it is allowed at, or to exchange it with a random one; worse states are taken with a probability that falls
    to nothing. The state of least energy over all steps and runs is the result.
    """
    n_places, n_labels = searches[0].goal.shape[0], max(s.goal.shape[1] for s in searches)
    size = np.array([len(s.names) for s in searches])
    base = np.r_[0, np.cumsum(size)[:-1]]
    counts = np.zeros((size.sum(), n_labels), np.int64)
    goal = np.zeros((len(searches), n_places, n_labels), np.int64)
    for s, b in zip(searches, base):
        counts[b : b + len(s.names), : s.counts.shape[1]] = np.rint(s.counts * UNIT)
    for k, s in enumerate(searches):
        goal[k, :, : s.goal.shape[1]] = np.rint(s.goal * UNIT)
    allowed = np.concatenate([s.allowed for s in searches])
    choices = np.argsort(~allowed, 1, kind="stable")
    n_choices = allowed.sum(1)
    mass = counts.sum(1)
    keys = np.array([s.key & (1 << 64) - 1 for s in searches], np.uint64)
    # lanes: every run of every search
    search = np.repeat(np.arange(len(searches)), runs)
    lane = np.arange(len(search))
    run = lane % runs
    lane_key = mixed(keys[search] + _GOLD * (run + 1).astype(np.uint64))
    lane_base, lane_size = base[search], size[search]
    total = np.maximum(np.add.reduceat(mass, base), 1)[search].astype(float)
    order = np.concatenate([np.argsort(mixed(s.names.view(np.uint64) ^ np.uint64(s.key & (1 << 64) - 1)), kind="stable") for s in searches])
    # hashed start, by the goals' shares of places
    shares = np.cumsum(np.maximum(goal.sum(2), 1), 1) / np.maximum(goal.sum(2), 1).sum(1, keepdims=True)
    owner = np.repeat(np.arange(len(searches)), size)
    names = np.concatenate([s.names for s in searches]).view(np.uint64)
    place = np.empty((runs, len(names)), np.int64)
    for r in range(runs):
        u = _unit(mixed(names * _GOLD + mixed(keys[owner] + np.uint64(7919 * (r + 1)))))
        place[r] = (u[:, None] >= shares[owner][:, :-1]).sum(1)
    held = np.zeros((len(lane), n_places, n_labels), np.int64)
    for r in range(runs):
        np.add.at(held, (owner * runs + r, place[r]), counts)
    above = held - goal[search]
    level = np.zeros(len(lane))  # energy against the start
    best, best_step = level.copy(), np.full(len(lane), -1)
    start = place.copy()
    steps = size * sweeps
    log: list[tuple[np.ndarray, ...]] = []

    def excess(over: np.ndarray) -> np.ndarray:
        return np.maximum(over.sum(-1), 0) + LABEL_WEIGHT * np.maximum(over, 0).sum(-1)

    lane_steps = steps[search]
    for step in range(int(steps.max())):
        on = np.flatnonzero(step < lane_steps)
        if len(on) == len(lane):
            on = lane
        draw = mixed(lane_key[on, None] + _GOLD * (np.uint64(4 * step) + np.arange(1, 5, dtype=np.uint64)))
        u = _unit(draw)
        n, r = lane_size[on], run[on]
        a = lane_base[on] + order[lane_base[on] + (step + r * n // runs) % n]
        b = lane_base[on] + (u[:, 1] * n).astype(np.int64)
        at_a, at_b = place[r, a], place[r, b]
        swap = u[:, 2] < 0.5
        to = np.where(swap, at_b, choices[a, (u[:, 0] * n_choices[a]).astype(np.int64)])
        legal = (to != at_a) & allowed[a, to] & (~swap | allowed[b, at_a])
        gain = counts[a] - counts[b] * swap[:, None]
        old_from, old_to = above[on, at_a], above[on, to]
        new_from, new_to = old_from - gain, old_to + gain
        change = excess(new_from) + excess(new_to) - excess(old_from) - excess(old_to)
        change = change - FORBIDDEN * (mass[a] * ~allowed[a, at_a] + mass[b] * (swap & ~allowed[b, at_b]))
        change = change / total[on]
        part = step / lane_steps[on]
        heat = 0.02 * np.maximum(1 - part / 0.75, 0) ** 2
        take = legal & ((change <= 0) | (u[:, 3] < np.exp(-np.maximum(change, 0) / np.maximum(heat, 1e-12))))
        if not take.any():
            continue
        t, a, b, r, swap = on[take], a[take], b[take], r[take], swap[take]
        above[t, at_a[take]], above[t, to[take]] = new_from[take], new_to[take]
        place[r, a] = to[take]
        both = swap
        place[r[both], b[both]] = at_a[take][both]
        log.append((np.full(len(t) + int(both.sum()), step), np.r_[t, t[both]], np.r_[a, b[both]], np.r_[to[take], at_a[take][both]]))
        level[t] += change[take]
        better = level[t] < best[t]
        best[t[better]], best_step[t[better]] = level[t[better]], step
    if log:  # the state of each lane at its best step
        at, who, unit, where = (np.concatenate(c) for c in zip(*log))
        keep = at <= best_step[who]
        start[run[who[keep]], unit[keep]] = where[keep]
    # energies are told against each run's own start, so they are made comparable once
    whole = np.zeros((len(lane), n_places, n_labels), np.int64)
    for r in range(runs):
        np.add.at(whole, (owner * runs + r, start[r]), counts)
    energy = excess(whole - goal[search]).sum(1)
    for r in range(runs):
        energy[r::runs] += np.bincount(owner, mass * ~allowed[np.arange(len(names)), start[r]] * FORBIDDEN, len(searches))
    chosen = energy.reshape(-1, runs).argmin(1)
    return [start[chosen[k], b : b + n] for k, (b, n) in enumerate(zip(base, size))]


def _part(left: np.ndarray, mass: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Goals (places, labels) of a block that holds `mass` of each label: sizes in proportion to what is left of each place,
    labels as the block has them, as near to what is left of both as these sums allow (iterative proportional fitting)."""
    size = np.maximum(left.sum(1), 0)
    if not mass.sum() or not size.sum():
        return np.zeros(left.shape)
    size = size * mass.sum() / size.sum()
    goal = np.maximum(left, 0) + 1e-6 * size[:, None]
    for _ in range(rounds):
        goal *= np.divide(mass, goal.sum(0), out=np.zeros(len(mass)), where=goal.sum(0) > 0)
        goal *= np.divide(size, goal.sum(1), out=np.zeros(len(size)), where=goal.sum(1) > 0)[:, None]
    return goal


SEARCHED = "task bigint, component bigint, place int, label int, n double"


def _search(n_places: int, pins: list[int], seed: int):
    """Rows (task, block, component, pin, place, label, n): components with their pin, or goals (component null) of places.

    Gives (task, component, place) of each component, and for each task and block (component null) what its goals leave over.
    """
    free = np.isin(np.arange(n_places), pins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # a task holds TASK_ROWS rows and at most one more block
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        task, block, label = (table.column(c).to_numpy() for c in ("task", "block", "label"))
        is_goal = table.column("component").is_null().to_numpy()
        component = table.column("component").fill_null(0).to_numpy()
        pin, place = (table.column(c).fill_null(-1).to_numpy() for c in ("pin", "place"))
        n = table.column("n").to_numpy()
        order = np.lexsort((label, component, is_goal, block, task))
        edges = np.flatnonzero(np.r_[True, (task[order][1:] != task[order][:-1]) | (block[order][1:] != block[order][:-1])])
        found: list[tuple[int, Search, np.ndarray]] = []
        for rows in np.split(order, edges[1:]):
            labels, at = np.unique(label[rows], return_inverse=True)
            goals, own = is_goal[rows], ~is_goal[rows]
            goal = np.zeros((n_places, len(labels)))
            goal[place[rows[goals]], at[goals]] = n[rows[goals]]
            names, unit = np.unique(component[rows[own]], return_inverse=True)
            counts = np.zeros((len(names), len(labels)))
            counts[unit, at[own]] = n[rows[own]]
            only = np.full(len(names), -1)
            only[unit] = pin[rows[own]]
            allowed = np.where(only[:, None] >= 0, np.arange(n_places) == only[:, None], free)
            if block[rows[0]] >= 0:  # a block's part of what the large components left
                goal = _part(goal, counts[only < 0].sum(0))
            np.add.at(goal, only[only >= 0], counts[only >= 0])
            key = int(mixed(mixed(np.array([task[rows[0]] ^ seed], np.int64).view(np.uint64)) + np.array([block[rows[0]] + 2], np.int64).view(np.uint64))[0])
            found.append((rows[0], Search(key, names, counts, allowed, goal), labels))
        some = sorted((k for k in range(len(found)) if len(found[k][1].names)), key=lambda k: len(found[k][1].names))
        places: dict[int, np.ndarray] = {}
        for start in range(0, len(some), LANES):
            part = some[start : start + LANES]
            places |= dict(zip(part, anneal([found[k][1] for k in part])))
        out: list[tuple] = []
        for k, (row, s, labels) in enumerate(found):
            left = s.goal.copy()
            if k in places:
                np.add.at(left, places[k], -s.counts)
                yield _rows(task[row], s.names, places[k])
            if block[row] < 0:
                p, l = np.nonzero(left)
                out += [(int(task[row]), int(a), int(labels[b]), float(left[a, b])) for a, b in zip(p, l)]
        if out:
            t, p, l, left = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.nulls(len(t), pa.int64()), pa.array(p, pa.int32()), pa.array(l, pa.int32()), pa.array(left, pa.float64())], ["task", "component", "place", "label", "n"])

    return run


def _rows(task: int, names: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    k = len(names)
    columns = [pa.array(np.full(k, task)), pa.array(names), pa.array(places.astype(np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["task", "component", "place", "label", "n"])


def _by_task(rows: DataFrame, totals: DataFrame, ident: str) -> DataFrame:
    """rows joined with totals on task, a hot task spread over SALT keys."""
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(SALT)).cast("int")).join(salted, ["task", "_salt"]).drop("_salt")


def _goals(sizes: DataFrame, shares: DataFrame, places: list[str], free: list[str]) -> DataFrame:
    """(task, place, label, n): records of each label that each place should hold.

    Records with a pin belong to it; the others are spread over the free places by their shares.
    """
    index = F.create_map(*[F.lit(v) for k, p in enumerate(places) for v in (p, k)])
    mass = sizes.groupBy("task", "label", "pin").agg(F.sum("n").alias("n"))
    given = [F.coalesce(F.col(f"share_{k}").cast("double"), F.lit(1.0)) for k in range(len(free))]
    some = sum(given, F.lit(0.0))
    spread = F.array(*[F.struct(F.lit(places.index(p)).alias("place"), F.when(some > 0, g / some).otherwise(1.0 / len(free)).alias("part")) for p, g in zip(free, given)])
    own = F.array(F.struct(index[F.col("pin")].alias("place"), F.lit(1.0).alias("part")))
    parts = mass.join(shares, "task", "left").select("task", "label", "n", F.explode(F.when(F.col("pin").isNull(), spread).otherwise(own)).alias("e"))
    return parts.groupBy("task", F.col("e.place").alias("place"), "label").agg(F.sum(F.col("n") * F.col("e.part")).alias("n"))


def _sizes(records: DataFrame) -> DataFrame:
    """(task, component, label, n, pin) of usable records; a component's pin is the first in order of name."""
    clean = records.where("task is not null and component is not null").withColumn("label", F.coalesce("label", F.lit(-1)).cast("int"))
    return clean.groupBy("task", "component", "label").agg(F.count("*").alias("n"), F.min("pin").alias("pin"))


def assign_places(records: DataFrame, shares: DataFrame, places: list[str], free: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(task, component, place): one place for every component of every task.

    records: task BIGINT, component BIGINT, label INT (few different ones), pin STRING (the one place of `places` allowed, or
    null: any of `free`), one row per record. free: all places unless named. shares: task and share_0 .. share_k in the order
    of `free`, any positive scale; a task without shares gets equal ones. A component with several pins keeps the first in
    order of name; a pin that is not in `places` is an error. Null components or tasks are left out, null labels are a label.
    Components are never bundled: each is moved by itself, however many there are and however large one is.
    """
    free = free or places
    counted = cut(_sizes(records))
    whole = counted.groupBy("task", "component").agg(F.sum("n").alias("size"), F.min("pin").alias("pin"), F.collect_list(F.struct("label", F.col("n").cast("double").alias("n"))).alias("labels"))
    index = F.create_map(*[F.lit(v) for k, p in enumerate(places) for v in (p, k)])
    pin = F.when(F.col("pin").isNotNull(), F.coalesce(index[F.col("pin")], F.raise_error(F.concat(F.lit("no such place: "), "pin")).cast("int")))
    total = whole.groupBy("task").agg(F.sum("size").alias("total"))
    split = cut(_by_task(whole, total, "component").select("task", "component", pin.alias("pin"), "labels", (F.col("size") * BLOCK > F.col("total")).alias("large")))
    blocks = split.groupBy("task").agg(F.ceil(F.count_if(~F.col("large")) / BLOCK).cast("int").alias("blocks"))
    number = F.when(F.col("large"), -1).otherwise(F.pmod(F.xxhash64(F.lit(seed), "task", "component"), F.greatest("blocks", F.lit(1))).cast("int"))
    long = _by_task(split, blocks, "component").select("task", number.alias("block"), "component", "pin", F.explode("labels").alias("e")).select("task", "block", "component", "pin", F.lit(None).cast("int").alias("place"), "e.label", "e.n")
    # records of pinned components are goals of their place, which the search adds by itself
    loose = split.where("pin is null").select("task", F.explode("labels").alias("e")).select("task", F.col("e.label").alias("label"), F.lit(None).cast("string").alias("pin"), F.col("e.n").alias("n"))
    goals = _goals(loose, shares, places, free)
    as_goal = lambda df, block: df.select("task", block.alias("block"), F.lit(None).cast("bigint").alias("component"), F.lit(None).cast("int").alias("pin"), "place", "label", F.col("n").cast("double").alias("n"))
    run = _search(len(places), [places.index(p) for p in free], seed)
    tasks = _tasks(counted)
    first = as_goal(goals, F.lit(-1)).unionByName(long.where("block = -1"))
    large = cut(first.repartition(tasks, "task").mapInArrow(run, SEARCHED))
    left = large.where("component is null").join(blocks.where("blocks > 0"), "task").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = as_goal(left, F.col("block")).unionByName(long.where("block >= 0"))
    small = second.repartition(tasks, "task", "block").mapInArrow(run, SEARCHED)
    named = F.element_at(F.array(*[F.lit(p) for p in places]), F.col("place") + 1)
    return large.unionByName(small).where("component is not null").select("task", "component", named.alias("place"))


def _tasks(counted: DataFrame) -> int:
    """Tasks of about TASK_ROWS rows; a stated number is not coalesced."""
    return max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // TASK_ROWS))


def place_report(records: DataFrame, places_: DataFrame, shares: DataFrame, places: list[str], free: list[str] | None = None) -> DataFrame:
    """(task, place, label, wanted, got, deviation): how far the places are from their goals; label null: all records."""
    sizes = _sizes(records)
    pin = sizes.groupBy("task", "component").agg(F.min("pin").alias("pin"))
    pinned = sizes.drop("pin").join(pin, ["task", "component"])
    index = F.create_map(*[F.lit(v) for k, p in enumerate(places) for v in (p, k)])
    got = pinned.join(places_, ["task", "component"]).groupBy("task", index[F.col("place")].alias("place"), "label").agg(F.sum("n").cast("double").alias("got"))
    wanted = _goals(pinned, shares, places, free or places).withColumnRenamed("n", "wanted")
    both = wanted.join(got, ["task", "place", "label"], "full").na.fill(0.0, ["wanted", "got"])
    every = both.unionByName(both.withColumn("label", F.lit(None).cast("int"))).groupBy("task", "place", "label").agg(F.sum("wanted").alias("wanted"), F.sum("got").alias("got"))
    named = F.element_at(F.array(*[F.lit(p) for p in places]), F.col("place") + 1)
    return every.select("task", named.alias("place"), "label", "wanted", "got", (F.col("got") - F.col("wanted")).alias("deviation"))


# The places of a molecule, and the stored sets that each of them allows.
FREE_PLACES = ["pool", "dev", "test_familiar"]
PLACES = [*FREE_PLACES, "test_unseen", "dev_unseen"]
ALLOWED = {
    "test_unseen": ["test_unseen", "test_unseen_q"],
    "dev_unseen": ["dev_unseen"],
    **{place: ["pool", "dev", "test_familiar", "test_familiar_q", "train_order"] for place in FREE_PLACES},
}


def stored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, id, set_name, comp, heavy) of every place a build stores; the fill order counts as set train_order."""
    members = stored_members(spark, sf_dir)
    order = fill_orders(spark, sf_dir).select("build_id", "id").distinct()
    order = order.join(molecule_keys(spark, sf_dir), "id", "left").select("build_id", F.lit("train_order").alias("set_name"), "id", "comp", "heavy")
    return members.unionByName(order)


def _component(pin: Column) -> Column:
    # a held-out formula and a single molecule must not share a component number
    return F.when(pin.isNull(), F.col("id") * 2).otherwise(F.col("comp") * 2 + 1)


def molecule_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, records, shares) of the builds: molecules of a held-out formula are one component that only its set may hold,
    every other molecule is its own component, for pool, dev or test_familiar in the proportions the build has stored."""
    stored = cut(stored_places(spark, sf_dir))
    every = builds(spark, sf_dir)
    held = build_formulas(every, "unseen_formulas").withColumn("pin", F.lit("test_unseen"))
    held = held.unionByName(build_formulas(every, "dev_unseen_formulas").withColumn("pin", F.lit("dev_unseen")))
    held = held.groupBy("build_id", "comp").agg(F.max("pin").alias("pin"))
    one = stored.groupBy("build_id", "id").agg(F.max("comp").alias("comp"), F.max("heavy").alias("heavy")).join(held, ["build_id", "comp"], "left")
    records = one.select(F.col("build_id").alias("task"), "id", _component(F.col("pin")).alias("component"), F.col("heavy").alias("label"), "pin")
    sizes = stored.groupBy(F.col("build_id").alias("task")).agg(*[F.count_if(F.col("set_name") == p).alias(f"share_{k}") for k, p in enumerate(FREE_PLACES)])
    return stored, cut(records), sizes


def molecule_places(records: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """(build_id, id, place): one place per build and molecule."""
    places = assign_places(records, shares, PLACES, FREE_PLACES, seed)
    return records.join(places, ["task", "component"]).select(F.col("task").alias("build_id"), "id", "place")


def p3_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records, shares = molecule_records(spark, sf_dir)
    return molecule_places(records, shares)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, place, label, wanted, got, deviation) of the assignment."""
    _, records, shares = molecule_records(spark, sf_dir)
    found = cut(assign_places(records, shares, PLACES, FREE_PLACES))
    return place_report(records, found, shares, PLACES, FREE_PLACES).withColumnRenamed("task", "build_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, id): molecules that a build stores where the place the search found for them does not allow it."""
    stored, records, shares = molecule_records(spark, sf_dir)
    allowed = F.create_map(*[x for place, sets in ALLOWED.items() for x in (F.lit(place), F.array(*map(F.lit, sets)))])
    wrong = stored.join(molecule_places(records, shares), ["build_id", "id"]).where(~F.array_contains(allowed[F.col("place")], F.col("set_name")))
    return wrong.select("build_id", "id").distinct()
