"""Samples that stay the same in every rerun and keep what they chose when records are added.

Method: a Feistel permutation over a fixed numeric identifier domain; an identifier is chosen if its permuted value lies
under rate x domain size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.feistel import feistel, under_rate
from tessera.llm.tables import builds, fill_orders


def stable_sample(rows: DataFrame, ident: str, rate: Column | float, *key: Column | int | str, keep: Column | None = None) -> DataFrame:
    """The rows whose identifier is chosen at this rate under this key, and those that `keep` names; columns as given.

    The choice looks at one row only: no state, no shuffle, the same under any partitioning, nested in the rate, and never
    undone by other rows. Rows whose identifier is null, negative or beyond the domain are never chosen by the permutation;
    a repeated identifier is chosen with all its rows or none; a null rate or a null `keep` chooses nothing.
    """
    chosen = F.coalesce(under_rate(feistel(F.col(ident), *key), rate), F.lit(False))
    return rows.where(chosen if keep is None else chosen | F.coalesce(keep, F.lit(False)))


def continued_sample(orders: DataFrame, group: list[str], revision: str, ident: str, rank: str, limits: str) -> DataFrame:
    """(group, revision, limit, ident, before, rank): what a stable sample of each revision holds, for every limit.

    orders: one row per place of a fill order (group, revision, ident, rank) with `limits`, an array of sample sizes; the
    stored sample under a limit is the identifiers with a smaller rank. The sample of a revision keeps all that the stored
    sample of revision - 1 held and the revision still has (`before`), and takes newcomers by the permutation at the rate
    of the limit to the size of the group's first revision. rank is where the revision itself stores the identifier.
    Null ranks choose nothing; a revision whose predecessor is not there keeps nothing; a record listed twice counts with
    its smallest rank.
    """
    held = orders.select(*group, revision, ident, rank, limits)
    held = held.groupBy(*group, ident, revision).agg(F.min(rank).alias("_rank"), F.first(limits).alias("_limits"))
    sizes = held.groupBy(*group, revision).agg(F.count("*").alias("_held")).groupBy(*group).agg(F.min_by("_held", revision).alias("_held"))
    earlier = Window.partitionBy(*group, ident).orderBy(revision)
    follows = F.lag(revision).over(earlier) == F.col(revision) - 1
    placed = held.withColumn("_was", F.when(follows, F.lag("_rank").over(earlier)))
    sized = placed.select(*group, revision, ident, "_rank", "_was", F.explode(F.array_distinct("_limits")).alias("_limit")).join(sizes, group)
    before = F.coalesce(F.col("_was") < F.col("_limit"), F.lit(False))
    sample = stable_sample(sized, ident, F.col("_limit") / F.col("_held"), *[F.col(g) for g in group], keep=before)
    return sample.select(*group, revision, "_limit", ident, before.alias("before"), "_rank")


def dropped_records(orders: DataFrame, group: list[str], revision: str, ident: str, rank: str, limits: str) -> DataFrame:
    """(group, revision, limit, ident): members that the stable sample keeps and the stored sample of the revision lacks."""
    kept = continued_sample(orders, group, revision, ident, rank, limits)
    return kept.where(F.col("before") & (F.col("_rank") >= F.col("_limit"))).select(*group, revision, "_limit", ident)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_orders(spark, sf_dir).join(builds(spark, sf_dir).select("build_id", "train_sizes"), "build_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, revision, seed, n_train, id): members of S_(seed,n_train) that the next revision dropped though it holds them."""
    found = dropped_records(_orders(spark, sf_dir), ["build_id", "seed"], "revision", "id", "pos", "train_sizes")
    return found.select("build_id", "revision", "seed", F.col("_limit").alias("n_train"), "id")


def stable_training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, revision, seed, n_train, id): training sets that keep their members when molecules are added.

    An anchor of an order is in every set from the revision that names it on. The other members are chosen at the rate that
    fills n_train in the first revision; it stays as it is later, so a set loses only molecules that were withdrawn.
    """
    orders = _orders(spark, sf_dir)
    since = Window.partitionBy("build_id", "seed", "id").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    orders = orders.withColumn("anchor", F.max("is_anchor").over(since))
    first = orders.groupBy("build_id", "seed", "revision").agg(F.count("*").alias("held"), F.count_if("anchor").alias("anchors"))
    first = first.groupBy("build_id", "seed").agg(F.min_by("held", "revision").alias("held"), F.min_by("anchors", "revision").alias("anchors"))
    sized = orders.select("build_id", "seed", "revision", "id", "anchor", F.explode(F.array_distinct("train_sizes")).alias("n_train")).join(first, ["build_id", "seed"])
    rate = F.try_divide(F.greatest(F.col("n_train") - F.col("anchors"), F.lit(0)), F.col("held") - F.col("anchors"))
    chosen = stable_sample(sized, "id", rate, F.col("build_id"), F.col("seed"), keep=F.col("anchor"))
    return chosen.select("build_id", "revision", "seed", "n_train", "id")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_training_sets(spark, sf_dir)
