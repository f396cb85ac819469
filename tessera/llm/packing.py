"""Filling containers of fixed capacity with documents of varying length.

Method: sum-of-squares online packing. Each document goes to the fill level that makes the sum of the squared numbers of
partly filled containers smallest; the numbers are kept in an array indexed by fill level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import read
from tessera.llm.tokens import token_counts
from tessera.plans.lineage import cut

CAPACITY = 2048
#: Documents, and containers' worth of tokens, that one shard is meant to hold; shards are packed side by side.
SHARD_ITEMS, SHARD_CONTAINERS = 5_000, 1_000
#: Equal rows, and containers of one long item, that are made from one row at once.
STRETCH = 500


def pack_in_order(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of items of 1 to `capacity`, placed one after another by the sum-of-squares rule.

    Level h holds the open containers filled up to h. Moving one from h to h + size changes the sum of squares by
    2 n[h + size] + 1 - (2 n[h] - 1); a new container starts at level 0, a full one leaves the sum. Of equal changes the
    fullest level is taken.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    container = np.empty(len(sizes), np.int64)
    offset = np.empty(len(sizes), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for k, size in enumerate(sizes.tolist()):
        room = capacity - size
        arrive = 2 * count[size : capacity + 1] + 1
        arrive[-1] = 0  # a full container
        leave = 2 * count[: room + 1] - 1
        leave[0] = 0  # a new container
        change = arrive - leave
        change[1:][count[1 : room + 1] == 0] = far
        level = room - int(np.argmin(change[::-1]))
        if level:
            at = open_[level].pop()
            count[level] -= 1
        else:
            at = made
            made += 1
        container[k], offset[k] = at, level
        if level + size < capacity:
            open_[level + size].append(at)
            count[level + size] += 1
    return container, offset


def pack(items: DataFrame, ident: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(container BIGINT, ident, part INT, begin BIGINT, tokens BIGINT, place INT): what each container holds.

    An item of at most `capacity` stays whole; a longer one is cut into full containers and one rest, parts counted from 0,
    `begin` being the part's first token and `place` its place in the container. Items of size 0 (or null, or negative)
    take no room and lie in the first container of their shard. Repeated identifiers are items of their own; null
    identifiers are packed too. Equal rows are counted and numbered, and items are spread over shards by a hash of
    identifier, size and number, so that no identifier or size, however often it comes, fills a shard. The parts of an item
    longer than a shard's containers are spread as well. The result depends on the items only.
    """
    clean = items.select(F.col(ident), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size"))
    counted = cut(clean.groupBy(ident, "_size").agg(F.count("*").alias("_rows")))
    n, total = counted.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum(F.col("_rows") * F.col("_size")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-total // (capacity * SHARD_CONTAINERS)))
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    # copies, then stretches of at most STRETCH containers, each first in runs and then one by one, so that no row grows far
    runs = lambda count, step: F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)) - 1, F.lit(step).cast("bigint")))
    copies = counted.withColumn("_from", runs(F.col("_rows"), STRETCH)).repartition(tasks, ident, "_size", "_from")
    copies = copies.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + STRETCH, F.col("_rows")) - 1)))
    pieces = copies.withColumn("_begin", runs(F.col("_size"), STRETCH * capacity))
    shard = F.pmod(F.xxhash64(ident, "_size", "_copy", "_begin"), F.lit(shards))
    sharded = pieces.select(shard.alias("_shard"), ident, "_begin", F.least(F.col("_size") - F.col("_begin"), F.lit(STRETCH * capacity)).alias("_size"), F.xxhash64(F.lit("order"), ident, "_begin").alias("_order"), "_copy")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", ident, "_begin", "_size", "_copy"], kind="stable")
        sizes = pdf["_size"].to_numpy()
        parts = np.maximum(1, -(-sizes // capacity))
        row = np.repeat(np.arange(len(pdf)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(sizes[row] - part * capacity, capacity)
        container = np.zeros(len(row), np.int64)
        place = np.zeros(len(row), np.int64)
        some = length > 0
        container[some], place[some] = pack_in_order(length[some], capacity)
        begin = pdf["_begin"].to_numpy()[row] + part * capacity
        return pd.DataFrame(
            {
                "container": (pdf["_shard"].to_numpy()[row] << 32) + container,
                ident: pdf[ident].to_numpy()[row],
                "part": begin // capacity,
                "begin": begin,
                "tokens": length,
                "place": place,
            }
        )

    kind = items.schema[ident].dataType.simpleString()
    schema = f"container bigint, `{ident}` {kind}, part int, begin bigint, tokens bigint, place int"
    # a stated number of tasks is not coalesced, so shards are packed side by side
    return sharded.repartition(tasks, "_shard").groupBy("_shard").applyInPandas(fill, schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, least, unused, unused_share): how tight a packing is; least is the number of containers that
    the tokens would fill without a gap."""
    held = packed.where("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    every = held.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity
    return every.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), (room - F.col("tokens")).alias("unused"), F.try_divide(room - F.col("tokens"), room).alias("unused_share"))


def document_containers(spark: SparkSession, sf_dir: str, capacity: int = CAPACITY) -> DataFrame:
    sizes = cut(token_counts(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return pack(sizes, "doc_id", "n_tokens", capacity)


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each container the documents, or parts of documents, that it holds."""
    return document_containers(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are and how much room in them is unused."""
    return fill_report(document_containers(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing had to split."""
    return document_containers(spark, sf_dir).where("part = 1").select("doc_id").distinct()
