"""Tables as queries read them, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.composition import hill_formula
from tessera.operators.relational import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecules(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each molecule once, the earliest delivery, with f, the formula its atoms tell; only the columns asked for are read."""
    rows = table(spark, sf_dir, "molecules")
    wanted = list(dict.fromkeys(["id", "z", *columns]))
    once = latest(rows.where("id is not null").select(*wanted, "loaded_at"), ["id"], ["loaded_at"])
    return once.select(*wanted, hill_formula(F.col("z")).alias("f"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of additions does not show; -0.0 becomes 0.0."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.round(c.cast("double"), places) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() in ("double", "float") else c)
    return df.select(*out)


_COUNT = "len(list_filter(z, lambda x: x = {n}))"
_PART = "CASE WHEN {c} > 1 THEN '{s}' || {c}::VARCHAR WHEN {c} = 1 THEN '{s}' ELSE '' END"


def _hill() -> str:
    order = [("C", 6), ("H", 1), ("F", 9), ("N", 7), ("O", 8)]
    return " || ".join(_PART.format(s=s, c=_COUNT.format(n=n)) for s, n in order)


#: A common table m: molecules, each once, with f.
M = f"m AS (SELECT * EXCLUDE (rn_), {_hill()} AS f FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn_ FROM molecules WHERE id IS NOT NULL) WHERE rn_ = 1)"
