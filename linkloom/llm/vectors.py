"""Embeddings: near-duplicates by PCA-ordered tiled comparison; nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .components import connected_components, unite
from .runtime import Scratch, integer_ids


def usable(vector: str, dim: int | None = None) -> Column:
    """Not null, of dim components, all finite, not all zero."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == dim) if dim else fine, F.lit(False))


def dimensions(vectors: DataFrame, vector: str) -> list[int]:
    """The lengths of usable vectors, as a rule one. Only vectors of one length are compared with each other."""
    return sorted(r["d"] for r in vectors.where(usable(vector)).select(F.size(vector).alias("d")).distinct().collect())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of norm 1; scaled first, so that squares of very large or small components don't overflow or vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def dot_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a and b, summed from the first component to the last: equal rows have equal products, wherever
    they stand in a matrix."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _sample(vectors: DataFrame, id_col: str, dim: int, most: int) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(most).select("_v").collect()
    return np.array([r[0] for r in rows], np.float64).reshape(len(rows), dim)


#: Products this close to the threshold are summed again in a fixed order, so that they don't depend on how they were come by.
_UNSURE = 1e-9


def compare(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool, steps: tuple[int, ...] = (8, 16, 32), block: int = 1024):
    """Yields (rows of a, rows of b) that reach the cosine threshold; a and b are unit rows.

    In the PCA basis the product of the components so far plus the product of the norms of the rest bounds the cosine.
    ``steps`` are where it is looked at: the first one for a block at once, with the norms as one more component, in
    single precision with a margin; then only the pairs whose bound still reaches the threshold go on to the next step. A block of
    which most pairs go on is finished at once. What is left after all components is decided in double precision.
    """
    dim = a.shape[1]
    steps = [*[s for s in steps if s < dim], dim]
    x, y = a @ basis, b @ basis
    rest_x, rest_y = ([np.linalg.norm(z[:, s:], axis=1) for s in steps] for z in (x, y))
    bounded = lambda z, rest: np.hstack([z[:, : steps[0]], rest[0][:, None]]).astype(np.float32)
    lead_x, lead_y, least = bounded(x, rest_x), bounded(y, rest_y), threshold - 1e-4

    def decided(u, v, cosine):
        unsure = np.abs(cosine - threshold) <= _UNSURE
        sure = cosine >= threshold
        sure[unsure] = dot_in_order(a[u[unsure]], b[v[unsure]]) >= threshold
        return u[sure], v[sure]

    for i in range(0, len(a), block):
        for j in range(i if same else 0, len(b), block):
            near = lead_x[i : i + block] @ lead_y[j : j + block].T >= np.float32(least)
            if same and i == j:
                near = np.triu(near, 1)
            n = np.count_nonzero(near)
            if n > near.size // 16:
                cosine = a[i : i + block] @ b[j : j + block].T
                u, v = np.nonzero(near & (cosine >= threshold - _UNSURE))
                found = [decided(u + i, v + j, cosine[u, v])]
            else:
                u, v = np.nonzero(near)
                u, v = u + i, v + j
                cosine = np.einsum("ij,ij->i", x[u, : steps[0]], y[v, : steps[0]])
                for k, (lo, hi) in enumerate(zip(steps[:-1], steps[1:]), 1):
                    cosine += np.einsum("ij,ij->i", x[u, lo:hi], y[v, lo:hi])
                    go = cosine + rest_x[k][u] * rest_y[k][v] >= threshold - _UNSURE
                    u, v, cosine = u[go], v[go], cosine[go]
                found = [decided(u, v, cosine)]
            for u, v in found:
                if len(u):
                    yield u, v


class Tiles:
    """Boxes in the space of the leading principal components: all are halved at a sample's median, again and again, in the
    component in which they are widest.

    Unit vectors with cosine >= t lie within sqrt(2 - 2t) of each other, so boxes further apart than that hold no link.
    """

    def __init__(self, sample: np.ndarray, basis: np.ndarray, tiles: int, threshold: float, components: int = 8):
        y = sample @ basis[:, :components]
        levels, m = max(0, math.ceil(math.log2(tiles))), y.shape[1]
        self.basis, self.count, self.borders = basis[:, :components], 1 << levels, []
        self.reach = max(0.0, 2 - 2 * threshold) + 1e-9
        low, high, at = np.full((1, m), -np.inf), np.full((1, m), np.inf), np.zeros(len(y), np.int64)
        for level in range(levels):
            inner = [y[at == t] for t in range(1 << level)]
            c = int(np.argmax(sum(np.ptp(z, axis=0) for z in inner if len(z)))) if len(y) else 0
            middle = [np.median(z[:, c]) if len(z) else 0.0 for z in inner]
            border = np.clip(np.array(middle), low[:, c], high[:, c])
            self.borders.append((c, border))
            at = 2 * at + (y[:, c] >= border[at])
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            high[0::2, c], low[1::2, c] = border, border
        self.low, self.high = low, high

    def of(self, unit_rows: np.ndarray) -> np.ndarray:
        y, at = unit_rows @ self.basis, np.zeros(len(unit_rows), np.int64)
        for c, border in self.borders:
            at = 2 * at + (y[:, c] >= border[at])
        return at

    def near(self, tile: int) -> np.ndarray:
        """The tiles that are within reach, itself included."""
        gap = np.maximum(0, np.maximum(self.low - self.high[tile], self.low[tile] - self.high))
        return np.flatnonzero((gap * gap).sum(1) <= self.reach)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", id_col: str = "vec_id", tile: int = 16384, steps: tuple[int, ...] = (8, 16, 32), sample: int = 20_000) -> DataFrame:
    """A row for each vector: id, n_links (other vectors with cosine >= threshold), component_id, kept.

    Equal vectors are compared once and counted. Vectors are put in ``Tiles``; the basis and the borders come from at most
    ``sample`` vectors; any basis gives the same result. Each pair of tiles is a group that holds two tiles, and
    returns counts and a spanning forest of its links, not the links. Vectors are compared with those of their own length.
    Unusable vectors (null, empty, zero, with null or non-finite components) link with nothing and are their own component. Ids are
    integers and expected to be unique: rows that share an id are one vertex. A row with a null id has no links and a null component. Other
    columns are ignored; an empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession, "tiles")
    integer_ids(vectors, id_col)
    keys = [F.xxhash64(F.col(vector)), F.xxhash64(F.lit(1), F.col(vector))]
    fine = usable(vector) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col), F.when(fine, keys[0]).alias("_h"), F.when(fine, keys[1]).alias("_g"), F.when(fine, F.col(vector).cast("array<double>")).alias("_v"))
    classes = rows.where(F.col("_h").isNotNull()).groupBy("_h", "_g").agg(F.min(id_col).cast("long").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("_v").alias("_v"))
    classes = scratch.table(classes, "classes")
    found = vectors.sparkSession.createDataFrame([], "a long, links long, b long")
    for dim in dimensions(classes, "_v"):
        found = found.unionByName(scratch.table(_links(classes.where(F.size("_v") == dim), dim, threshold, tile, steps, sample), f"found_{dim}"))
    links = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.where(F.col("b").isNotNull()).select("a", "b"), scratch)
    known = (
        classes.select("_h", "_g", "rep", "n").join(links, F.col("rep") == F.col("a"), "left").join(components, F.col("rep") == F.col("id"), "left")
        .select("_h", "_g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.drop("_v").join(known, ["_h", "_g"], "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dim: int, threshold: float, tile: int, steps: tuple[int, ...], sample: int) -> DataFrame:
    """Of different vectors of one length: (a, links, null), the number of vectors that a vector is linked with by a pair of tiles,
    and (a, 0, b), links that join what is linked there."""
    x = unit(_sample(classes, "rep", dim, sample))
    basis = np.linalg.eigh(np.cov(x, rowvar=False).reshape(dim, dim) if len(x) > 1 else np.eye(dim))[1][:, ::-1].copy()
    tiles = Tiles(x, basis, math.ceil(classes.count() / tile), threshold)

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = tiles.of(unit(matrix(batch.column(2), dim)))
            partners = {t: tiles.near(t) for t in np.unique(at).tolist()}
            take = np.repeat(np.arange(len(at)), [len(partners[t]) for t in at.tolist()])
            other, own = np.concatenate([partners[t] for t in at.tolist()]), at[take]
            pair = np.minimum(own, other) * tiles.count + np.maximum(own, other)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(own, pa.int32()), *batch.take(pa.array(take)).columns], ["pair", "tile", "rep", "n", "_v"])

    def link(key, table):
        i, j = divmod(key[0].as_py(), tiles.count)
        ids, n, tile_of = (table.column(c).to_numpy() for c in ("rep", "n", "tile"))
        v = unit(matrix(table.column("_v").combine_chunks(), dim))
        a, b = np.flatnonzero(tile_of == i), np.flatnonzero(tile_of == j)
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s, t in compare(v[a], v[b], basis, threshold, i == j, steps):
            s, t = a[s], b[t]
            links += np.bincount(s, n[t], len(ids)).astype(np.int64) + np.bincount(t, n[s], len(ids)).astype(np.int64)
            labels = unite(labels, s, t)
        linked, apart = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(ids)))
        none = np.arange(len(linked) + len(apart)) < len(linked)
        return pa.table(
            [
                pa.array(np.concatenate([ids[linked], ids[apart]]), pa.int64()),
                pa.array(np.concatenate([links[linked], np.zeros(len(apart), np.int64)]), pa.int64()),
                pa.array(np.concatenate([np.zeros(len(linked), np.int64), ids[labels[apart]]]), pa.int64(), mask=none),
            ],
            ["a", "links", "b"],
        )

    dealt = classes.select("rep", "n", "_v").mapInArrow(spread, "pair long, tile int, rep long, n long, _v array<double>")
    return dealt.groupBy("pair").applyInArrow(link, "a long, links long, b long")


class Forest:
    """Trees of sorted hash strings over the rows of one block.

    A row's string in a tree is ``bits`` signs of random projections, held as one integer, so that sorting gives the
    tree's leaves in order and a prefix of any length is a range of the sorted array.
    """

    def __init__(self, rows: np.ndarray, trees: int, bits: int, seed: int):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees, rows.shape[1], bits)).astype(np.float32)
        strings = self.strings(rows)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        rows = rows.astype(np.float32)
        return np.stack([(rows @ p > 0) @ weight for p in self.planes])

    def ranges(self, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range of rows that share the string's first ``length`` signs."""
        cut = (np.uint64(self.bits) - length.astype(np.uint64))[None, :]
        low = (strings >> cut) << cut
        high = low + (np.uint64(1) << cut) - np.uint64(1)
        lo = np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, low)])
        return lo, np.stack([np.searchsorted(s, q, "right") for s, q in zip(self.sorted, high)])

    def search(self, queries: np.ndarray, enough: int):
        """For each query its candidates. The descent finds the longest prefix that any tree matches; then all trees
        ascend together, a sign at a time, until their ranges hold ``enough`` different rows or everything."""
        strings = self.strings(queries)
        longest, shortest = np.full(len(queries), self.bits), np.zeros(len(queries), np.int64)
        # the rows within all trees' ranges only grow as the prefix shortens, so the level is found by bisection
        while (shortest < longest).any():
            middle = (shortest + longest + 1) // 2
            lo, hi = self.ranges(strings, middle)
            held = (hi - lo).sum(0) >= enough
            shortest, longest = np.where(held, middle, shortest), np.where(held, longest, middle - 1)
        # ranges of several trees overlap, so the ascent goes on until there are as many different rows
        waiting = np.arange(len(queries))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        while len(waiting):
            lo, hi = self.ranges(strings[:, waiting], shortest[waiting])
            again = []
            for k, q in enumerate(waiting.tolist()):
                mark = np.zeros(self.order.shape[1], bool)
                for t, (x, y) in enumerate(zip(lo[:, k].tolist(), hi[:, k].tolist())):
                    mark[self.order[t, x:y]] = True
                found = np.flatnonzero(mark)
                if len(found) >= enough or shortest[q] == 0:
                    out[q] = found
                else:
                    shortest[q] -= 1
                    again.append(q)
            waiting = np.array(again, np.int64)
        return out


def search_block(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, forest: Forest, k: int, share: float, least: int):
    """For each query (its rows' places in the block, scores, and how many rows it was compared with): the k largest inner products found.

    Scores are by any order of sums first; those that are near the k-th are then summed in the fixed one.
    """
    longest = np.sqrt((v * v).sum(1).max())
    enough = max(k + 1, least, math.ceil(share * len(ids)))
    scaled = q / np.maximum(np.abs(q).max(1, keepdims=True), np.finfo(float).tiny)
    for i, found in enumerate(forest.search(np.hstack([scaled, np.zeros((len(q), 1))]), enough)):
        compared = len(found)
        found = found[ids[found] != q_ids[i]]
        rough = v[found] @ q[i]
        if len(found) > k:
            found = found[rough >= np.partition(rough, -k)[-k] - 1e-12 * longest * np.linalg.norm(q[i])]
        score = dot_in_order(v[found], np.broadcast_to(q[i], (len(found), v.shape[1])))
        order = np.lexsort((ids[found], -score))[:k]
        yield found[order], score[order], compared


def block_forest(v: np.ndarray, trees: int, bits: int, seed: int) -> Forest:
    """A forest in which inner products are angles: one more component makes the norms of all rows of the block equal."""
    scaled = v / np.abs(v).max()
    squares = (scaled * scaled).sum(1)
    return Forest(np.hstack([scaled, np.sqrt(np.maximum(0, squares.max() * (1 + 1e-9) - squares))[:, None]]), trees, bits, seed)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", id_col: str = "vec_id", block: int = 4096, trees: int = 80, bits: int = 24, share: float = 0.55, least: int = 0, seed: int = 7) -> DataFrame:
    """The k rows with the largest inner product found for each query: query_id, rank, vec_id, score.

    Rows are dealt to blocks of about ``block``, of similar norms (within a factor of the root of 2); each block indexes all its rows in a
    forest and answers all queries, and the best k of all blocks are kept. Trees ascend until their ranges hold ``share`` of the
    block's rows, and k + 1 at least (or ``least``, if that is more): vectors without any structure need so many for a recall above 0.9, and the share
    is the same at every size. Inner product becomes an angle by one more component that makes the block's norms equal (0 for queries); as
    they are similar, it stays small, whatever the norms of other rows. Scores
    are in double precision on the vectors as they are, summed in the order of components, so equal vectors have equal scores; ties
    go to the smaller id. A query is compared with vectors of its own length. Unusable vectors, and rows with a null id, take no
    part. A query's own row isn't returned, nor others with its id. Ids are integers; repeated rows are rows like others, and repeated
    queries are asked once; other columns are ignored; an empty table gives none.
    """
    integer_ids(vectors, id_col)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in dimensions(vectors, vector):
        rows = vectors.where(usable(vector, dim) & F.col(id_col).isNotNull())
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector).cast("array<double>").alias("v"))
        out = out.unionByName(_nearest(rows, dim, k, block, trees, bits, share, least, seed))
    return out


def _nearest(rows: DataFrame, dim: int, k: int, block: int, trees: int, bits: int, share: float, least: int, seed: int) -> DataFrame:
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    # squares that over- or underflow are bands of their own; there are some 2000 bands at most
    rows = rows.withColumn("band", F.when(square == 0, -2000).when(square == float("inf"), 2000).otherwise(F.floor(F.log2(square) + 0.5)).cast("int"))
    bands, blocks = [], 0
    for r in sorted(rows.groupBy("band").count().collect()):
        n = math.ceil(r["count"] / block)
        bands.append((r["band"], blocks, n))
        blocks += n
    known = F.broadcast(rows.sparkSession.createDataFrame(bands, "band int, first int, n int"))
    data = rows.join(known, "band").select("id", F.lit(0).alias("kind"), (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int").alias("block"), "v")
    asked = rows.where("q").dropDuplicates(["id"]).select("id", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"), "v")

    def answer(batches):
        forest, ids, v, held, at = None, None, None, [], None
        for batch in batches:
            # a task may have several blocks, one after another: of each the rows come first
            numbers, kinds = batch.column(2).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if numbers[lo] != at:
                    forest, held, at = None, [], numbers[lo]
                if not kinds[lo]:
                    held.append(part)
                    continue
                if forest is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held)
                    ids, v = table.column(0).to_numpy(), matrix(table.column(3).combine_chunks(), dim)
                    held, forest = [], block_forest(v, trees, bits, seed)
                q, q_ids = matrix(part.column(3), dim), part.column(0).to_numpy()
                out = ([], [], [])
                for i, (found, score, _) in enumerate(search_block(ids, v, q_ids, q, forest, k, share, least)):
                    out[0].append(np.full(len(found), q_ids[i]))
                    out[1].append(ids[found])
                    out[2].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    dealt = data.unionByName(asked).repartitionById(max(blocks, 1), F.col("block")).sortWithinPartitions("block", "kind")
    found = dealt.select("id", "kind", "block", "v").mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
