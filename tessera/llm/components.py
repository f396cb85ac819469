"""Connected components of an edge table, by rounds of distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node of its group.

    Alternates the large-star and small-star steps, each a group-by on the node, until the edge set no longer
    changes; every round is checkpointed, so neither lineage nor driver state grows. A hub is only ever pre-aggregated
    (min per node), its neighbours are never gathered into one row. Null ends are ignored, self loops keep their node,
    repeated edges count once, an empty table gives an empty result.
    """
    base = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = base.select("u").union(base.select("v")).distinct()
    links = cut(base.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        links, now = _round(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def _round(links: DataFrame) -> tuple[DataFrame, tuple]:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # large star: every larger neighbour of u is linked to u's smallest neighbour
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: u and its smaller neighbours are linked to the smallest of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(least, "u")
    small = (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(linked.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )
    done = cut(small)
    mark = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return done, tuple(mark)
