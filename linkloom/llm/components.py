"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import Scratch, small


#: Edge lists of up to so many rows, 16 bytes each, are solved in one task.
SMALL_EDGES = 1 << 18


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, component) for all ends of the edges (a, b), two longs: the smallest id that is reachable.

    Each step re-links neighbours to the smallest neighbour, found by a partly summed minimum, so a vertex with
    very many neighbours is split over tasks; the join back is one that Spark splits where it is skewed. Each
    step is written to the shared folder, and its predecessor removed. Ends when a step changes nothing, which it
    does: every change lowers the sum of the edges' ends. Lists of up to ``small_edges`` edges take the same steps in one task of an
    executor, as jobs for each step would cost more than all of the work.
    """
    tidy = lambda e: e.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, state = scratch.table(tidy(edges), f"{name}_0"), None
    selves = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    if now.count() <= small_edges:
        solved = now.coalesce(1).mapInArrow(_solve, "id long, component long")
        return solved.unionByName(selves.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    nodes = scratch.table(now.select(F.explode(F.array("hi", "lo")).alias("id")).union(selves).distinct(), f"{name}_nodes")
    k, before = 0, ()
    while state is None or (state != before and state[0]):
        k += 1
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # written first, so that the join reads plain shuffles, which Spark splits where a vertex has very many neighbours
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}_{k}_least")
        large = tidy(both.where(F.col("v") > F.col("u")).join(small(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = scratch.table(large, f"{name}_{k}_large")
        lower = scratch.table(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}_{k}_lower")
        stars = large.join(small(lower), "hi").select(F.col("lo").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("hi").alias("a"), F.col("m").alias("b")))
        after = scratch.table(tidy(stars), f"{name}_{k}")
        row = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}_{k}_large", f"{name}_{k}_least", f"{name}_{k}_lower", f"{name}_{k - 1}")
        now, before, state = after, state, tuple(row)
    stars = now.groupBy("hi").agg(F.min("lo").alias("component"))
    return nodes.join(stars, F.col("id") == F.col("hi"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _solve(batches):
    """Large-star and small-star on arrays, until nothing changes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    names, node = np.unique(np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in held]), return_inverse=True)
    hi, lo = np.split(node, 2)
    while True:
        least = np.arange(len(names))
        np.minimum.at(least, hi, lo)
        # large-star: all larger neighbours of u go to u's smallest neighbour
        large = _distinct(hi, least[lo], len(names))
        lower = np.arange(len(names))
        np.minimum.at(lower, *large)
        # small-star: all smaller neighbours of u, and u, go to u's smallest neighbour
        stars = _distinct(np.concatenate([large[1], large[0]]), np.concatenate([lower[large[0]], lower[large[0]]]), len(names))
        if len(stars[0]) == len(hi) and (stars[0] == hi).all() and (stars[1] == lo).all():
            break
        hi, lo = stars
    component = np.arange(len(names))
    component[hi] = lo
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[component])], ["id", "component"])


def _distinct(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different edges of two ends, the larger end first, sorted."""
    apart = a != b
    edge = np.unique(np.maximum(a[apart], b[apart]) * np.int64(n) + np.minimum(a[apart], b[apart]))
    return edge // n, edge % n


def unite(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """labels (each node's smallest member so far) after joining the nodes u[i] and v[i]."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v = u[apart], v[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        labels = parent[labels]
