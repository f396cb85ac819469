"""Deterministic splits: stratified holdouts of whole groups, samples that leave every group represented, folds, fill orders,
and the checks that a stored split keeps its promises.

Every draw is an order by md5(salt : key): the same in any engine, on any partitioning and in every rerun. Ranks over a
whole table are taken by counting in bins of the hash first, so that no task sorts all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def draw(salt: str, *keys: str | Column) -> Column:
    """Hexadecimal draw of a row: text order of the draws is the random order."""
    return F.md5(F.concat_ws(":", F.lit(salt), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def hashed_rank(df: DataFrame, order: Column, out: str = "n", by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """df with the rank (1 ..) of each row in its group by a hexadecimal draw.

    Rows are counted by the draw's first digits; ranks within such a bin are shifted by the counts of the bins before, so a
    group of any size is ranked in 16^digits parts.
    """
    by = by or []
    rows = df.withColumn("_d", order).withColumn("_b", F.substring("_d", 1, digits))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = counts.select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_within", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d")))
    joined = ranked.join(marks, [*by, "_b"]).withColumn("_rank", (F.col("_before") + F.col("_within")).cast("bigint"))
    return joined.drop("_d", "_b", "_within", "_before").withColumnRenamed("_rank", out)


def choose_groups(groups: DataFrame, group: str, stratum: str, fraction: float, salt: str) -> DataFrame:
    """(group): from each stratum floor(fraction x count + 0.5) groups; groups are distinct and have one stratum each."""
    one = groups.groupBy(group).agg(F.min(stratum).alias(stratum)).where(F.col(group).isNotNull())
    sizes = one.groupBy(stratum).agg(F.floor(F.count("*") * F.lit(fraction) + 0.5).alias("_k"))
    ranked = hashed_rank(one, draw(salt, group), "_n", [stratum])
    return ranked.join(sizes, stratum).where("_n <= _k").select(group)


def sample_keeping_one(rows: DataFrame, ident: str, group: str, k: int, salt: str) -> DataFrame:
    """k rows in hashed order of which no group is taken whole: the last row of each group in that order is never taken.

    Raises ValueError if the groups cannot give k rows.
    """
    ranked = hashed_rank(rows, draw(salt, ident), "_n", [group])
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    free = ranked.join(sizes, group).where("_n < _size").drop("_n", "_size")
    found = hashed_rank(free, draw(salt, ident), "_n").where(F.col("_n") <= k).drop("_n")
    if found.count() < k:
        raise ValueError(f"fewer than {k} rows can be sampled without emptying a group")
    return found


def kfold(rows: DataFrame, ident: str, k: int, salt: str) -> DataFrame:
    """rows with fold 0 .. k-1, sizes equal to within one."""
    return hashed_rank(rows, draw(salt, ident), "_n").withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_n")


def group_kfold(rows: DataFrame, group: str, k: int, salt: str) -> DataFrame:
    """rows with a fold per group; a group is never split. Stateless: a narrow projection."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(draw(salt, group), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int"))


def holdout(rows: DataFrame, ident: str, salt: str, largest: int = 5000, smallest: int = 10, fraction: float = 0.1) -> DataFrame:
    """rows with validation BOOLEAN; min(largest, max(smallest, half-even round of fraction x n)) rows are true."""
    n = rows.count()
    wanted = min(largest, max(smallest, round(fraction * n)))
    return hashed_rank(rows, draw(salt, ident), "_n").withColumn("validation", F.col("_n") <= wanted).drop("_n")


def fill_order(pool: DataFrame, ident: str, group: str, anchored: DataFrame, salt: str) -> DataFrame:
    """(pos, ident, is_anchor): one anchor per anchored group first, in order of ident, then the rest in hashed order; pos from 0."""
    first = pool.join(anchored, group, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(draw(salt + ":anchor", ident)))).where("_n = 1").select(ident)
    # one row per anchored group
    heads = first.withColumn("pos", F.row_number().over(Window.orderBy(ident)).cast("bigint") - 1).withColumn("is_anchor", F.lit(True))
    n = first.count()
    rest = hashed_rank(pool.select(ident).join(first, ident, "left_anti"), draw(salt, ident), "_n")
    return heads.select("pos", ident, "is_anchor").unionByName(rest.select((F.col("_n") + n - 1).alias("pos"), ident, F.lit(False).alias("is_anchor")))


def nested_sets(order: DataFrame, sizes: list[int]) -> DataFrame:
    """(n_train, ...): the first n_train rows of an order for each size; each set holds the smaller ones."""
    return order.withColumn("n_train", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: F.col("pos") < n)))


def development_ids(members: DataFrame) -> DataFrame:
    """(id), in order: everything that exploring may read, that is the pool and both development sets; no test row."""
    return members.where(F.col("set_name").isin("pool", "dev", "dev_unseen")).select("id").distinct().orderBy("id")


def select_test_molecules(members: DataFrame, subsets: list[str], per: int, salt: str) -> DataFrame:
    """(subset, id): `per` rows of each named set, the first in hashed order, in order of id within a set."""
    some = members.where(F.col("set_name").isin(subsets)).select(F.col("set_name").alias("subset"), "id").distinct()
    ranked = hashed_rank(some, draw(salt, "subset", "id"), "_n", ["subset"]).where(F.col("_n") <= per)
    return ranked.select("subset", "id").orderBy("subset", "id")


@dataclass
class SplitConfig:
    split_seed: int = 7
    unseen_formula_frac: float = 0.15
    dev_unseen_formula_frac: float = 0.05
    familiar_test_frac: float = 0.10
    dev_size: int = 150
    quantum_unseen_per_formula: int = 5
    quantum_unseen_max_total: int = 60
    n_familiar_formulas: int = 10
    familiar_per_formula: int = 2
    train_sizes: list[int] = field(default_factory=lambda: [50, 150, 400])
    train_seeds: list[int] = field(default_factory=lambda: [0, 1, 2])
    track_b_sizes: list[int] = field(default_factory=lambda: [50, 150])


@dataclass
class Splits:
    """members (set_name, id, formula), order (seed, pos, id, is_anchor), formulas (kind, formula)."""

    config: SplitConfig
    members: DataFrame
    order: DataFrame
    formulas: DataFrame

    def ids(self, set_name: str) -> DataFrame:
        return self.members.where(F.col("set_name") == set_name).select("id")

    def train(self) -> DataFrame:
        """(seed, pos, id, is_anchor, n_train); the whole pool is the last size."""
        return nested_sets(self.order, sorted(self.config.train_sizes))


def build_splits(table: DataFrame, config: SplitConfig) -> Splits:
    """Splits of a table (id, formula, n_heavy), one row per id.

    Whole formulas are held out per stratum of n_heavy, once for test and once for development; from the rest, familiar test
    and development rows are drawn so that no formula is emptied; what is left is the pool. Small sets are drawn from the
    test sets, and each seed's fill order starts with one anchor per familiar formula.
    """
    c, salt = config, f"{config.split_seed}"
    sizes = sorted(c.train_sizes)
    if c.n_familiar_formulas >= sizes[0] or not set(c.track_b_sizes) <= set(sizes):
        raise ValueError("familiar formulas must be fewer than the smallest size, and track sizes among the sizes")
    rows = cut(table.select("id", "formula", "n_heavy"))
    unseen = cut(choose_groups(rows, "formula", "n_heavy", c.unseen_formula_frac, salt + ":unseen"))
    rest = rows.join(unseen, "formula", "left_anti")
    dev_unseen_f = cut(choose_groups(rest, "formula", "n_heavy", c.dev_unseen_formula_frac, salt + ":dev_unseen"))
    test_unseen, dev_unseen = rows.join(unseen, "formula", "left_semi"), rows.join(dev_unseen_f, "formula", "left_semi")
    remaining = cut(rest.join(dev_unseen_f, "formula", "left_anti"))
    n_familiar = int(c.familiar_test_frac * remaining.count() + 0.5)
    test_familiar = cut(sample_keeping_one(remaining, "id", "formula", n_familiar, salt + ":familiar"))
    left = cut(remaining.join(test_familiar, "id", "left_anti"))
    dev = cut(sample_keeping_one(left, "id", "formula", c.dev_size, salt + ":dev"))
    pool = cut(left.join(dev, "id", "left_anti"))
    if pool.count() < sizes[-1]:
        raise ValueError("the pool is smaller than the largest training size")
    some = hashed_rank(test_unseen, draw(salt + ":q", "id"), "_n", ["formula"]).where(F.col("_n") <= c.quantum_unseen_per_formula).drop("_n")
    test_unseen_q = hashed_rank(some, draw(salt + ":qcap", "id"), "_n").where(F.col("_n") <= c.quantum_unseen_max_total).drop("_n")
    eligible = test_familiar.groupBy("formula").agg(F.count("*").alias("n")).where(F.col("n") >= c.familiar_per_formula).select("formula")
    familiar = cut(hashed_rank(eligible, draw(salt + ":fam", "formula"), "_n").where(F.col("_n") <= c.n_familiar_formulas).select("formula"))
    if familiar.count() < c.n_familiar_formulas:
        raise ValueError("too few formulas have enough familiar test rows")
    mine = test_familiar.join(familiar, "formula", "left_semi")
    test_familiar_q = hashed_rank(mine, draw(salt + ":famq", "id"), "_n", ["formula"]).where(F.col("_n") <= c.familiar_per_formula).drop("_n")
    named = {"pool": pool, "test_unseen": test_unseen, "test_familiar": test_familiar, "dev": dev, "dev_unseen": dev_unseen, "test_unseen_q": test_unseen_q, "test_familiar_q": test_familiar_q}
    members = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("set_name"), "id", "formula")
        members = part if members is None else members.unionByName(part)
    order = None
    for s in c.train_seeds:
        part = fill_order(pool, "id", "formula", familiar, f"{salt}:{s}").withColumn("seed", F.lit(s))
        order = part if order is None else order.unionByName(part)
    kinds = [unseen.select(F.lit("unseen").alias("kind"), "formula"), dev_unseen_f.select(F.lit("dev_unseen").alias("kind"), "formula"), familiar.select(F.lit("familiar").alias("kind"), "formula")]
    return Splits(c, cut(members), cut(order.select("seed", "pos", "id", "is_anchor")), cut(kinds[0].unionByName(kinds[1]).unionByName(kinds[2])))


MAIN = ["pool", "test_unseen", "test_familiar", "dev", "dev_unseen"]


def check_splits(s: Splits, table: DataFrame, excluded: DataFrame) -> DataFrame:
    """(label, violations) of every promise, labels (id) and (a) to (i), in one union of counts; all must be 0.

    (id) unknown ids; (a) sets disjoint, training and small sets inside theirs; (b) no held-out formula elsewhere;
    (c) anchored formulas in the smallest training set; (d) nesting; (e) sizes; (f) unique ids; (g) no excluded id;
    (h) complete holdouts, familiar sets represented, anchors at the head; (i) every kept row in a main set.
    """
    c = s.config
    m, order = s.members, s.order
    sizes = sorted(c.train_sizes)
    known = table.select("id", F.col("formula").alias("f"))
    told = cut(m.join(known, "id", "left"))
    kept = known.join(excluded.select("id"), "id", "left_anti")
    main = m.where(F.col("set_name").isin(MAIN))
    held = s.formulas.where(F.col("kind").isin("unseen", "dev_unseen"))
    pool = s.ids("pool")
    in_order = order.join(known, "id", "left")
    n = lambda df: df.agg(F.count("*").alias("violations"))
    missing = lambda a, b: n(a.join(b, "id", "left_anti"))
    kind = lambda k: s.formulas.where(F.col("kind") == k).select(F.col("formula").alias("f"))
    small = order.where(F.col("pos") < sizes[0])
    checks: list[tuple[str, DataFrame]] = [
        ("id", n(told.where("f is null"))),
        ("id", n(in_order.where("f is null"))),
        ("a", n(main.select("set_name", "id").distinct().groupBy("id").count().where("count > 1"))),
        ("a", missing(order.select("id"), pool)),
        ("a", missing(s.ids("test_unseen_q"), s.ids("test_unseen"))),
        ("a", missing(s.ids("test_familiar_q"), s.ids("test_familiar"))),
        ("b", n(s.formulas.where(F.col("kind").isin("unseen", "dev_unseen")).groupBy("formula").agg(F.count_distinct("kind").alias("k")).where("k > 1"))),
        ("b", n(told.where(F.col("set_name").isin("pool", "test_familiar", "dev")).join(held.select(F.col("formula").alias("f")), "f", "left_semi"))),
        ("c", n(kind("familiar").join(order.select("seed").distinct()).join(small.join(known, "id").select("seed", "f"), ["seed", "f"], "left_anti"))),
        ("d", n(order.groupBy("seed", "pos").count().where("count > 1"))),
        ("e", n(order.groupBy("seed").agg(F.count("*").alias("k"), F.max("pos").alias("last"), F.min("pos").alias("first")).where(f"k < {sizes[-1]} or last <> k - 1 or first <> 0"))),
        ("e", order.agg(F.abs(F.count_distinct("seed") - len(c.train_seeds)).alias("violations"))),
        ("e", s.ids("dev").agg(F.abs(F.count("*") - c.dev_size).alias("violations"))),
        ("e", s.ids("test_familiar_q").agg(F.abs(F.count("*") - c.n_familiar_formulas * c.familiar_per_formula).alias("violations"))),
        ("e", s.ids("test_unseen_q").agg(F.greatest(F.count("*") - c.quantum_unseen_max_total, F.lit(0)).alias("violations"))),
        ("f", n(m.groupBy("set_name", "id").count().where("count > 1"))),
        ("f", n(order.groupBy("seed", "id").count().where("count > 1"))),
        ("g", n(m.select("id").unionByName(order.select("id")).join(excluded.select("id"), "id", "left_semi"))),
        ("h", missing(kept.join(kind("unseen"), "f", "left_semi"), s.ids("test_unseen"))),
        ("h", n(told.where("set_name = 'test_unseen'").join(kind("unseen"), "f", "left_anti"))),
        ("h", missing(kept.join(kind("dev_unseen"), "f", "left_semi"), s.ids("dev_unseen"))),
        ("h", n(told.where("set_name = 'dev_unseen'").join(kind("dev_unseen"), "f", "left_anti"))),
        ("h", n(told.where(F.col("set_name").isin("test_familiar", "dev")).join(told.where("set_name = 'pool'").select("f"), "f", "left_anti"))),
        ("h", n(told.where("set_name = 'test_familiar_q'").join(kind("familiar"), "f", "left_anti"))),
        ("h", n(kind("familiar").join(told.where("set_name = 'test_familiar_q'").select("f"), "f", "left_anti"))),
        ("h", n(kind("familiar").join(order.select("seed").distinct()).join(in_order.where("is_anchor").select("seed", "f"), ["seed", "f"], "left_anti"))),
        ("h", n(order.where(f"is_anchor and pos >= {c.n_familiar_formulas}"))),
        ("i", missing(kept.select("id"), main.select("id"))),
    ]
    out = None
    for label, df in checks:
        part = df.select(F.lit(label).alias("label"), F.col("violations").cast("bigint").alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("label").agg(F.sum("violations").alias("violations"))


class SplitCheckError(ValueError):
    """A split breaks a promise; the message starts with the label of the first one broken."""


def require_valid(checks: DataFrame) -> None:
    order = {label: k for k, label in enumerate(["id", *"abcdefghi"])}
    broken = sorted((r for r in checks.where("violations > 0").collect()), key=lambda r: order[r.label])
    if broken:
        raise SplitCheckError(f"({broken[0].label}) {broken[0].violations} violations")
