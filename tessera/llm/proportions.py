"""Samples whose categories have given shares and minimums, and the targets that could not be met.

Method: acceptance probabilities from target-to-observed ratios, independent draws with slight oversampling, then
exact correction of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.composition import key_of_formula
from tessera.llm.tables import builds, read, stored_members
from tessera.plans.lineage import cut

#: Bins into which the draws of one category are counted, so that no task ranks a whole category.
BINS = 256
#: Copies of a category's goal that a join with its members is spread over.
SALT = 16
#: Oversampling in standard deviations of the number accepted, and a few rows more for small targets.
SPREAD, EXTRA = 3.0, 4.0


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def smallest_per_group(rows: DataFrame, keys: list[str], draw: str, ident: str, wanted: str, bins: int = BINS, bin_: Column | None = None) -> DataFrame:
    """Of each group the `wanted` rows with the smallest draws (ties: smaller ident), without sorting a group in one task.

    The draws, in [0, 1), are counted in bins (`bin_` numbers them otherwise, in order of the draw); only the bin in which
    the target falls is ranked. A hot group is spread over its bins in every shuffle.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(draw) * bins).cast("int") if bin_ is None else bin_)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.first(wanted).alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    marks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before < _w")
    marks = marks.select(*keys, "_bin", (F.col("_w") - F.col("_before")).alias("_left"), (F.col("_n") <= F.col("_w") - F.col("_before")).alias("_all"))
    joined = binned.join(marks, [*keys, "_bin"])
    whole = joined.where("_all").select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(draw, ident))
    part = joined.where("not _all").withColumn("_rank", rank).where("_rank <= _left").select(*rows.columns)
    return whole.unionByName(part)


def proportional_sample(members: DataFrame, targets: DataFrame, keys: list[str], ident: str = "id", wanted: str = "wanted", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    members: one row per candidate with `keys` and `ident`; repeated rows count once. targets: one row per category
    with `keys`, `wanted` and any other columns. sample: keys and ident, exactly min(wanted, available) rows a category.
    report: the targets' columns with available, taken and deficit. A category of targets without members has available 0;
    members of categories without a target, with a null key or a null ident are not drawn; a null or negative target is 0.
    The draw of a record depends on its identifier, its category and the seed only.

    A record is accepted if its draw lies under its category's rate, which aims at slightly more than the target; accepted
    records are counted in BINS bins, rejected ones in as many beyond, and the exact correction takes the first records in
    order of the bins: it thins what chance accepted too many, and reaches for rejected ones where it accepted too few.
    """
    clean = cut(members.select(*keys, ident).dropna().distinct())
    targets = targets.withColumn(wanted, F.greatest(F.coalesce(F.col(wanted), F.lit(0)), F.lit(0)).cast("bigint"))
    seen = cut(clean.groupBy(*keys).agg(F.count("*").alias("available")))
    goals = targets.select(*keys, F.col(wanted).alias("_wanted")).dropna().join(seen, keys)
    rate = F.least(F.lit(1.0), (F.col("_wanted") + SPREAD * F.sqrt("_wanted") + EXTRA) / F.col("available"))
    goals = goals.select(*keys, "_wanted", rate.alias("_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    # a category may hold a third of all members: its goal is there SALT times
    salted = clean.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(SALT)).cast("int"))
    drawn = salted.join(goals, [*keys, "_salt"]).drop("_salt").withColumn("_u", uniform(seed, *[F.col(k) for k in keys], F.col(ident)))
    u, r = F.col("_u"), F.col("_rate")
    bin_ = F.when(u < r, F.floor(u / r * BINS)).otherwise(BINS + F.floor((u - r) / (1 - r) * BINS)).cast("int")
    sample = smallest_per_group(drawn, keys, "_u", ident, "_wanted", bin_=bin_).select(*keys, ident)
    taken = sample.groupBy(*keys).agg(F.count("*").alias("taken"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = targets.join(seen, keys, "left").join(taken, keys, "left").withColumn("available", zero("available")).withColumn("taken", zero("taken"))
    return sample, report.withColumn("deficit", F.col(wanted) - F.col("taken"))


# The parent set of each drawn set.
PARENTS = {"test_unseen_q": "test_unseen", "test_familiar_q": "test_familiar"}


def quota_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quota_id, build_id, set_name, comp, wanted), set_name being the parent set."""
    sizes = builds(spark, sf_dir).select("build_id", "n_test_unseen_q", "n_test_familiar_q")
    quota = read(spark, sf_dir, "quota").dropDuplicates(["quota_id"]).join(sizes, "build_id", "left")
    n = F.when(F.col("set_name") == "test_unseen_q", F.col("n_test_unseen_q")).when(F.col("set_name") == "test_familiar_q", F.col("n_test_familiar_q"))
    share = F.floor(F.col("target_share") * n + 0.5)
    parent = F.create_map(*[F.lit(x) for pair in PARENTS.items() for x in pair])
    return quota.select(
        "quota_id",
        "build_id",
        parent[F.col("set_name")].alias("set_name"),
        key_of_formula(F.col("formula")).alias("comp"),
        F.greatest(F.coalesce("min_count", F.lit(0)).cast("bigint"), F.coalesce(share, F.lit(0)).cast("bigint")).alias("wanted"),
    )


def quota_draw(spark: SparkSession, sf_dir: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    members = stored_members(spark, sf_dir).where(F.col("set_name").isin(*PARENTS.values())).select("build_id", "set_name", "comp", "id")
    return proportional_sample(members, quota_targets(spark, sf_dir), ["build_id", "set_name", "comp"], seed=seed)


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn members: (build_id, set_name, comp, id), set_name being the set drawn from."""
    return quota_draw(spark, sf_dir)[0]


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quota with its target count, the members there are, those taken and the deficit."""
    return quota_draw(spark, sf_dir)[1].select("quota_id", "build_id", "wanted", "available", "taken", "deficit")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotas that the sample could not meet."""
    return quota_draw(spark, sf_dir)[1].where("deficit > 0").select("quota_id")
