"""The project's tables as these operators read them: each record once, each composition as one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.composition import key_of_formula, key_of_numbers


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def molecule_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, comp, heavy) of every molecule, however often it was delivered."""
    z = F.col("z")
    rows = read(spark, sf_dir, "molecules").select("id", key_of_numbers(z).alias("comp"), F.size(F.filter(z, lambda x: x > 1)).alias("heavy"))
    return rows.where("id is not null").groupBy("id").agg(F.max("comp").alias("comp"), F.max("heavy").alias("heavy"))


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per build; of repeated deliveries the earliest."""
    rows = read(spark, sf_dir, "split_build").where("build_id is not null")
    columns = [c for c in rows.columns if c not in ("build_id", "written_at")]
    first = rows.groupBy("build_id").agg(F.min_by(F.struct(*columns), F.struct("written_at", F.xxhash64(*columns))).alias("r"))
    return first.select("build_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def build_formulas(builds_: DataFrame, column: str) -> DataFrame:
    """(build_id, comp) of a formula list, unreadable formulas left out."""
    parts = builds_.select("build_id", F.explode(column).alias("f"))
    return parts.select("build_id", key_of_formula(F.col("f")).alias("comp")).where("comp is not null").distinct()


def stored_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, set_name, id, comp, heavy): each stored member once, its composition told by the molecule.

    A member whose molecule is missing keeps the composition its own formula tells, or null.
    """
    rows = read(spark, sf_dir, "split_set").where("build_id is not null and set_name is not null and id is not null")
    once = rows.groupBy("build_id", "set_name", "id").agg(F.max(key_of_formula(F.col("formula"))).alias("told"))
    keys = molecule_keys(spark, sf_dir)
    return once.join(keys, "id", "left").select("build_id", "set_name", "id", F.coalesce("comp", "told").alias("comp"), "heavy")


def fill_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, revision, seed, id, pos, is_anchor): each place of a fill order once, the first one if an id has several."""
    rows = read(spark, sf_dir, "train_order")
    rows = rows.where("build_id is not null and revision is not null and seed is not null and id is not null and pos is not null")
    return rows.groupBy("build_id", "revision", "seed", "id").agg(F.min("pos").alias("pos"), F.max(F.coalesce("is_anchor", F.lit(False))).alias("is_anchor"))
