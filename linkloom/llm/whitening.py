"""Embedding whitening by a one-sided Jacobi SVD.

Entries become whole numbers, so that sums are exact. The centred rows are compressed by TSQR: each block of rows to its
triangular R, and 64 of these at a time to one, in tasks, until one is left. Plane rotations make the columns of that R
orthogonal; their norms are the singular values, to full relative precision as nothing is squared before, and the
accumulated rotations are the components. What reaches the driver is one matrix of a vector's length squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import Scratch
from .vectors import matrix

#: How many partial results a task combines to one.
FAN_IN = 64
#: Rows of a block that are compressed at once.
BLOCK = 8192


def whole(vectors: DataFrame, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vectors with ``_x``, floor(scale * entry) + shift as long; without rows that are null, hold null or non-finite entries,
    or entries whose product is beyond 2**31: sums of these are exact for up to 2**31 rows."""
    v = F.col(vector)
    most = F.lit(float(2**31))
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale <= most))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).withColumn("_x", x)


def combined(partial: DataFrame, combine: Callable[[np.ndarray], np.ndarray], scratch: Scratch, name: str) -> np.ndarray | None:
    """One vector of doubles of many (k, v), by ``combine`` on those of 64 neighbouring k at a time, in tasks. Their number falls by that
    factor with each round. k is different for each."""
    kind = "k long, v array<double>"

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("k").column("v").combine_chunks()
        out = combine(matrix(rows, len(rows[0])))
        return pa.table({"k": pa.array([table.column("g")[0].as_py()], pa.int64()), "v": pa.array([out.tolist()], pa.list_(pa.float64()))})

    at, k = scratch.table(partial, f"{name}-0"), 0
    # k is a task's number, or a group's, so groups hold that many at most
    while (least_most := at.agg(F.min("k"), F.max("k")).first())[0] != least_most[1]:
        k += 1
        at = scratch.table(at.withColumn("g", F.floor(F.col("k") / FAN_IN)).groupBy("g").applyInArrow(run, kind), f"{name}-{k}")
    row = at.first()
    return None if row is None else np.array(row["v"], np.float64)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, d x d: rows of zeros below where there are fewer rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns in rounds of disjoint ones: a tournament, with a bye where d is odd."""
    ring, out = list(range(d + d % 2)), []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < d]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(r: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; components as columns) of r: pairs of columns are rotated until all are orthogonal to rounding.

    The rotations of a round touch different columns, so they are done at once. A pair counts as orthogonal if its product is
    within rounding of the product of its norms, so small singular values are as accurate as large ones.
    """
    u, v = r.copy(), np.eye(r.shape[1])
    order, eps = rounds(r.shape[1]), np.finfo(float).eps * max(1.0, math.sqrt(len(r)))
    for _ in range(most_sweeps):
        turned = False
        for p, q in order:
            a, b, c = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            go = np.abs(c) > eps * np.sqrt(a) * np.sqrt(b)
            if not go.any():
                continue
            turned = True
            p, q, a, b, c = p[go], q[go], a[go], b[go], c[go]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            for m in (u, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    else:
        raise RuntimeError(f"columns are not orthogonal after {most_sweeps} sweeps")
    s = np.linalg.norm(u, axis=0)
    falling = np.argsort(-s, kind="stable")
    v = v[:, falling]
    return s[falling], v / np.linalg.norm(v, axis=0)


def _moments(rows: np.ndarray) -> np.ndarray:
    """Count, means and the upper part of the sums of products, centred, as one vector."""
    mean = rows.mean(0)
    c = rows - mean
    return np.concatenate([[len(rows)], mean, (c.T @ c).ravel()])


def _joined_moments(parts: np.ndarray) -> np.ndarray:
    """Of several counts, means and centred sums of products those of all: what lies between the means is added, centred too."""
    d = math.isqrt(parts.shape[1])
    n, means = parts[:, 0], parts[:, 1 : 1 + d]
    mean = (n[:, None] * means).sum(0) / n.sum()
    between = means - mean
    return np.concatenate([[n.sum()], mean, parts[:, 1 + d :].sum(0) + ((n[:, None] * between).T @ between).ravel()])


def _deviation(off: np.ndarray) -> list[int | None]:
    """Sum of squares of each row of whole numbers, exact; None beyond 64 bits."""
    if not off.size or float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(1).tolist()
    sums = [sum(x * x for x in row) for row in off.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def whiten(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = 32) -> DataFrame:
    """A row for each vector and component up to ``components``: id, component (from 1 by falling variance), n, deviation,
    whitened, explained, identity_error.

    Vectors are whole numbers x (``whole``); n of them with sums S. deviation: the exact sum of (n * x - S)**2, null beyond 64 bits;
    whitened: x - S / n on the component, over the square root of its variance; explained: its share of the whole
    variance; identity_error: the largest entry of the covariance of the whitened vectors, less the identity, by absolute value.

    Null vectors, and those with null or non-finite entries (or entries beyond 2**31 / 64), are left out. Vectors of each length are a
    space of their own; empty ones have no components. Components without variance to rounding can't be whitened and give no row, so a single
    vector, or copies of one, give none. Repeated rows and null ids are rows like others; other columns are not read; an empty table gives
    no rows. The square of a vector's length in doubles has to fit a task and the driver.
    """
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    rows = whole(source, "_v").select("_id", "_x")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], schema)
    sizes = rows.where(F.size("_x") > 0).groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    for size in sorted(sizes):
        out = out.unionByName(_whitened(rows.where(F.size("_x") == size["d"]), size["d"], size["n"], components, schema))
    return out.withColumnRenamed("_id", id_col)


def _whitened(rows: DataFrame, d: int, n: int, components: int, schema: str) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")

    def sums(batches):
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _longs(batch.column(0), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], ["j", "s"])

    total = {r["j"]: r["s"] for r in rows.select("_x").mapInArrow(sums, "j int, s long").groupBy("j").agg(F.sum("s").alias("s")).collect()}
    s = np.array([total[j] for j in range(d)], np.int64)

    def partial(work):
        """A batch's rows, centred, to a vector of doubles for each block, and those of a task to one."""

        def run(batches):
            from pyspark import TaskContext

            for out in work((n * _longs(batch.column(0), d) - s) / n for batch in batches):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["k", "v"])

        return rows.select("_x").mapInArrow(run, "k long, v array<double>")

    def compress(blocks):
        r, held, many = None, [], 0
        for block in blocks:
            held.append(block)
            many += len(block)
            if many >= BLOCK:
                r, held, many = triangle(np.vstack([*held] if r is None else [r, *held])), [], 0
        if many or r is not None:
            yield triangle(np.vstack([*held] if r is None else [r, *held]))

    r = combined(partial(compress), lambda parts: triangle(parts.reshape(-1, d)).ravel(), scratch, "r").reshape(d, d)
    values, basis = one_sided_jacobi(r)
    keep = min(components, int((values > values[0] * d * np.finfo(float).eps * 4).sum()))
    if not keep:
        return spark.createDataFrame([], schema)
    explained = (values**2 / (values**2).sum())[:keep]
    onto = basis[:, :keep] / (values[:keep] / math.sqrt(n))

    def moments(blocks):
        have = None
        for block in blocks:
            if len(block):
                now = _moments(block @ onto)
                have = now if have is None else _joined_moments(np.vstack([have, now]))
        if have is not None:
            yield have

    spread = combined(partial(moments), _joined_moments, scratch, "moments")
    error = float(np.abs(spread[1 + keep :].reshape(keep, keep) / n - np.eye(keep)).max())

    def project(batches):
        for batch in batches:
            off = n * _longs(batch.column(1), d) - s
            white, m = (off / n) @ onto, len(off)
            each = np.repeat(np.arange(m), keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)), pa.array(np.full(m * keep, n, np.int64)), pa.array(_deviation(off), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * keep, error)),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def _longs(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
