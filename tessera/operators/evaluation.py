"""Evaluation of fitted models: learning curves and development curves as one job table, with a result cache."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.linear import fit_ridge, linear
from tessera.operators.provenance import config_hash
from tessera.operators.scaling import clip_predictions
from tessera.operators.statistics import scores

#: fit(train, features, y) gives predict(rows), a DataFrame (id, pred).
Fitter = Callable[[DataFrame, list[str], str], Callable[[DataFrame], DataFrame]]


def mean_fitter(train: DataFrame, features: list[str], y: str) -> Callable[[DataFrame], DataFrame]:
    m = train.agg(F.avg(y)).first()[0]
    return lambda rows: rows.select("id", F.lit(m).alias("pred"))


def ridge_fitter(alpha: float = 1.0) -> Fitter:
    def fit(train: DataFrame, features: list[str], y: str):
        w, b = fit_ridge(train, features, y, alpha)
        return lambda rows: rows.select("id", clip_predictions(linear(features, w, b)).alias("pred"))

    return fit


def tree_fitter(kind: str = "forest", trees: int = 20, depth: int = 5, seed: int = 0) -> Fitter:
    """Random forest or gradient-boosted trees of Spark ML; boosted trees stand in for other boosting libraries and differ from them."""

    def fit(train: DataFrame, features: list[str], y: str):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        assemble = VectorAssembler(inputCols=features, outputCol="_x")
        if kind == "forest":
            learner = RandomForestRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", numTrees=trees, maxDepth=depth, seed=seed)
        else:
            learner = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxIter=trees, maxDepth=depth, seed=seed)
        model = learner.fit(assemble.transform(train))
        return lambda rows: model.transform(assemble.transform(rows)).select("id", clip_predictions(F.col("pred")).alias("pred"))

    return fit


def dev_curve(table: DataFrame, train_sets: DataFrame, eval_sets: dict[str, DataFrame], features: list[str], y: str, fitters: dict[str, Fitter], cache: str | None = None, tail: float = 9.0) -> DataFrame:
    """Long results (seed, n_train, model, eval_set, mae, rmse, rmse_below_tail, r2, bias, n_eval).

    train_sets: (seed, n_train, id). Every fit sees its own training rows only. With `cache`, results are kept as Parquet
    under the hash of (seed, size, model, features, target) and read again.
    """
    spark = table.sparkSession
    out = None
    for seed, n in sorted((r.seed, r.n_train) for r in train_sets.select("seed", "n_train").distinct().collect()):
        ids = train_sets.where((F.col("seed") == seed) & (F.col("n_train") == n)).select("id")
        train = None
        for name, fit in fitters.items():
            key = config_hash({"seed": seed, "n": n, "model": name, "features": features, "y": y, "sets": sorted(eval_sets)})
            path = cache and f"{cache}/{key}"
            if path and _exists(spark, path):
                part = spark.read.parquet(path)
            else:
                train = train if train is not None else table.join(ids, "id", "left_semi")
                predict = fit(train, features, y)
                part = None
                for set_name, members in eval_sets.items():
                    rows = table.join(members.select("id"), "id", "left_semi")
                    got = scores(rows.select("id", y).join(predict(rows), "id"), y, "pred", tail)
                    one = got.select(F.lit(seed).alias("seed"), F.lit(n).alias("n_train"), F.lit(name).alias("model"), F.lit(set_name).alias("eval_set"), "*")
                    part = one if part is None else part.unionByName(one)
                if path:
                    part.write.mode("overwrite").parquet(path)
                    part = spark.read.parquet(path)
            out = part if out is None else out.unionByName(part)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_result(df: DataFrame, folder: str | Path, name: str, meta: dict, routes: list[tuple[str, str]] | None = None) -> Path:
    """A small result table as one CSV folder, with its provenance as JSON beside it, under the folder its name is routed to."""
    from tessera.operators.provenance import git_hash, package_versions, plain, routed_path

    path = routed_path(folder, name, routes or [])
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(str(path))
    stamp = {"git_hash": git_hash(), "versions": package_versions(["pyspark", "numpy", "pandas", "pyarrow"]), **plain(meta)}
    path.with_name(f"{name}.meta.json").write_text(json.dumps(stamp, indent=2, sort_keys=True))
    return path


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Every result under a pattern with its file's name and, where there is one, the commit of its sidecar."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    rows = spark.read.option("header", True).csv(pattern).select("*", name.alias("result"))
    sides = spark.read.option("wholetext", True).text(f"{pattern}.meta.json").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.meta\.json$", 1).alias("result"), F.get_json_object("value", "$.git_hash").alias("git_hash"))
    return rows.join(sides, "result", "left")
