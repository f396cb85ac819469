"""Sources and sinks of splits, catalogs, logs and results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "feature string, block string, level string, legal boolean, kept boolean, reason string, description string"


def save_splits(members: DataFrame, order: DataFrame, folder: str, meta: dict) -> None:
    """Sets partitioned by name, orders by seed, and meta.json; the stamp is taken before anything is replaced."""
    from tessera.operators.provenance import config_hash, git_hash, plain

    stamp = {"config_hash": config_hash(meta), "git_hash": git_hash(), **plain(meta)}
    members.write.mode("overwrite").partitionBy("set_name").json(f"{folder}/sets")
    order.write.mode("overwrite").partitionBy("seed").json(f"{folder}/orders")
    Path(folder, "meta.json").write_text(json.dumps(stamp, indent=2, sort_keys=True))


def load_splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    members = spark.read.schema("id bigint, formula string, set_name string").json(f"{folder}/sets")
    order = spark.read.schema("pos bigint, id bigint, is_anchor boolean, seed int").json(f"{folder}/orders")
    return members, order, json.loads(Path(folder, "meta.json").read_text())


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).option("header", True).csv(path)


def load_config(path: str) -> dict:
    """A JSON configuration, or a YAML one where a YAML reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional

        return yaml.safe_load(text)
    return json.loads(text)


def log_run(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").option("header", True).csv(path)


def next_run_number(log: DataFrame | None) -> int:
    """Largest run number plus one; 1 without a log."""
    return 1 if log is None else log.agg((F.coalesce(F.max("run"), F.lit(0)) + 1).cast("int")).first()[0]


def read_score_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Every CSV that matches a pattern, with the name of its file, repeated rows once."""
    return spark.read.option("header", True).csv(pattern).select("*", F.col("_metadata.file_name").alias("file")).dropDuplicates()


# The blocks of each named set of molecule features, in order; structure+dft holds computed properties.
FEATURE_SETS = {
    "composition": ["composition"],
    "cm": ["cm"],
    "structure": ["composition", "engineered"],
    "structure+": ["composition", "engineered", "groups", "qeq"],
    "all_legal": ["composition", "engineered", "groups", "qeq", "rdf", "cm"],
    "structure+dft": ["composition", "engineered", "dft_property", "charge", "frequency"],
}
EXPLORATION_ONLY = ["structure+dft"]


def feature_sets(catalog: DataFrame) -> DataFrame:
    """(name, features): ordered lists of the kept molecule features of FEATURE_SETS, block after block, within a block in the
    order of the column `ord`; a set none of whose blocks has a feature is empty."""
    blocks = [(name, at, block) for name, parts in FEATURE_SETS.items() for at, block in enumerate(parts)]
    plan = catalog.sparkSession.createDataFrame(blocks, "name string, at int, block string")
    kept = catalog.where("kept and coalesce(level, 'molecule') = 'molecule'").select("block", "ord", "feature")
    # a fixed table of some twenty rows
    joined = kept.join(F.broadcast(plan), "block", "right")
    listed = F.array_sort(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("at", "ord", "feature"))))
    return joined.groupBy("name").agg(F.transform(listed, lambda e: e["feature"]).alias("features"))


def atom_feature_names(catalog: DataFrame) -> list[str]:
    """The kept features of atoms, in the order of ATOM_FEATURES."""
    from tessera.operators.molecule_kernels import ATOM_FEATURES

    kept = {r.feature for r in catalog.where("kept and level = 'atom'").select("feature").collect()}
    return [f for f in ATOM_FEATURES if f in kept]
