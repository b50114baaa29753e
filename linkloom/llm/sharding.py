"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F, Window

from .runtime import Scratch


def lpt(loads: list[tuple], shards: int) -> dict:
    """Longest first, each to the least-loaded shard through a heap; ties by name and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        at, shard = heap[0]
        out[name] = shard
        heapq.heapreplace(heap, (at + load, shard))
    return out


def shard_groups(docs: DataFrame, shards: int, size: F.Column, group: F.Column, id_col: str = "doc_id", resolution: int = 2048, slot_buckets: int = 1024, keep: dict | None = None) -> DataFrame:
    """Puts all rows into ``shards`` shards of near equal total size; rows of a group share a shard.

    A group (rows with equal ``group`` hash, a long) larger than 1/(shards*resolution) of all is scheduled
    by itself; there are at most shards*resolution of those. Smaller groups are first hashed into
    shards*resolution bundles, and each bundle is scheduled as one item. So the heap on the driver and the
    two broadcast tables have at most 2*shards*resolution rows at every input size, and the difference
    of two shards is at most the largest item.

    Returns id, size, ``keep``'s columns, shard (int) and slot (long, gapless from 0 in each shard). A null
    size counts as 0. Repeated ids, null ids, ties and empty tables are fine; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shard")
    keep = keep or {}
    slim = scratch.table(docs.select(F.col(id_col), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.coalesce(group, F.lit(0)).cast("long").alias("_group"), *[c.alias(k) for k, c in keep.items()]), "slim")
    total = slim.agg(F.sum("size")).first()[0] or 0
    items = shards * resolution
    groups = slim.groupBy("_group").agg(F.sum("size").alias("load"))
    large = F.col("load") * items > F.lit(total)
    loads = groups.groupBy(large.alias("large"), F.when(large, F.col("_group")).otherwise(F.pmod("_group", F.lit(items))).alias("item")).agg(F.sum("load").alias("load")).collect()
    placed = lpt([((r["large"], r["item"]), r["load"]) for r in loads], shards)
    table = lambda kind, name: F.broadcast(spark.createDataFrame([(k, s) for (big, k), s in placed.items() if big is kind], f"{name} long, {name}_shard int"))
    assigned = (
        slim.withColumn("_bundle", F.pmod("_group", F.lit(items)))
        .join(table(True, "_big"), F.col("_group") == F.col("_big"), "left")
        .join(table(False, "_small"), F.col("_bundle") == F.col("_small"), "left")
        .withColumn("shard", F.coalesce("_big_shard", "_small_shard"))
        .withColumn("_part", F.pmod(F.xxhash64(id_col, "_group", "size"), F.lit(slot_buckets)).cast("int"))
    )
    offsets, at = [], dict.fromkeys(range(shards), 0)  # at most shards * slot_buckets rows
    for r in sorted(assigned.groupBy("shard", "_part").count().collect()):
        offsets.append((r[0], r[1], at[r[0]]))
        at[r[0]] += r[2]
    offsets = F.broadcast(spark.createDataFrame(offsets, "shard int, _part int, _from long"))
    order = Window.partitionBy("shard", "_part").orderBy(F.col(id_col), F.col("_group"), F.col("size"))
    return assigned.join(offsets, ["shard", "_part"]).select(id_col, "size", *keep, "shard", (F.col("_from") + F.row_number().over(order) - 1).alias("slot"))
