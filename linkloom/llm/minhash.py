"""Near-duplicate documents: universal hash minima, banding, verification, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components, unite
from .hashing import LOWER, inside, mixed, window_hashes, word_hashes, words
from .runtime import Scratch, integer_ids, slices, small, text_bytes


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's k-word shingles, and n+1 offsets.

    A-Z are lower-cased. A document of 1 to k-1 words has its whole sequence as one shingle; one without words none.
    """
    raw = LOWER[raw]
    starts, ends, at = words(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    whole, ok = window_hashes(hashes, k), inside(at, k)
    parts, bounds = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        lo, hi = at[i], at[i + 1]
        n = hi - lo
        if n >= k:
            s = np.sort(whole[lo : hi - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])] if n > k else s
        elif n:
            s = window_hashes(hashes[lo:hi], int(n)) + np.uint64(n)
        else:
            s = hashes[:0]
        parts.append(s)
        bounds[i + 1] = bounds[i] + len(s)
    assert ok.sum() == sum(max(0, n - k + 1) for n in np.diff(at))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), bounds


def signatures(sets: np.ndarray, bounds: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """Minima of ``hashes`` functions a*x + b modulo 2**32 over each set; empty sets give zeros."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, hashes, np.uint32)
    out = np.zeros((len(bounds) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    x = (sets >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < len(full):  # parts that stay in the cache
        hi = max(lo + 1, int(np.searchsorted(bounds[full], bounds[full[lo]] + 32_768)))
        part, cut = x[bounds[full[lo]] : bounds[full[min(hi, len(full)) - 1] + 1]], bounds[full[lo:hi]] - bounds[full[lo]]
        for i in range(hashes):
            out[full[lo:hi], i] = np.minimum.reduceat(part * a[i] + b[i], cut)
        lo = hi
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.shape[1] // rows
    factor = mixed(np.arange(1, rows + 1, dtype=np.uint64))
    keys = (signature[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64) + np.uint64(1)) * factor
    return mixed(mixed(keys).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _digest(docs: DataFrame, k: int, hashes: int, rows: int, seed: int, id_col: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for lo, hi in slices(offs):
                sets, bounds = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                n = np.diff(bounds)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets + np.uint64(c)), dtype=np.uint64)]) for c in (1, 0x5851F42D4C957F2D)]
                s = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
                sig = signatures(sets, bounds, hashes, seed)
                keys = band_keys(sig, rows).view(np.int64)
                small = (mixed(sig.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(s[0]), pa.array(s[1]), lists, pa.array([r.tobytes() for r in small], pa.binary())],
                    ["id", "n", "s1", "s2", "bands", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """The shingle sets of the wanted documents (id, s1, s2), from their whole texts."""

    def run(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column(3))
            for lo, hi in slices(offs):
                sets, bounds = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets + np.uint64(1)), dtype=np.uint64)])
                same = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64) == batch.column(1).slice(lo, hi - lo).to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["id", "shingles"]).filter(pa.array(same))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_text"))
    found = texts.join(wanted, "id").select("id", "s1", "s2", "_text").mapInArrow(run, "id long, shingles array<long>")
    return found.dropDuplicates(["id"])


def _placed(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """Bucket members with their component so far."""
    if components is None:
        return members.withColumn("component", F.col("rep"))
    return members.join(components.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, component: np.ndarray, percent: int, width: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows left, right) of different components that reach the threshold, exactly: intersections of all
    sets at once, as products of 0/1 matrices over ranges of the shingles that both sides have."""
    flat = lambda rows: (np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows]))
    (a, row_a), (b, row_b) = flat(left), flat(right)
    names = np.intersect1d(a, b)
    both = np.zeros((len(left), len(right)), np.float32)

    def columns(x, rows):
        at = np.searchsorted(names, x)
        known = (at < len(names)) & (names[np.minimum(at, max(len(names) - 1, 0))] == x) if len(names) else np.zeros(len(x), bool)
        order = np.argsort(at[known], kind="stable")
        return at[known][order], rows[known][order]

    (col_a, row_a), (col_b, row_b) = columns(a, row_a), columns(b, row_b)
    for lo in range(0, len(names), width):
        n = min(width, len(names) - lo)
        parts = []
        for col, row, size in ((col_a, row_a, len(left)), (col_b, row_b, len(right))):
            x, y = np.searchsorted(col, [lo, lo + n])
            m = np.zeros((size, n), np.float32)
            m[row[x:y], col[x:y] - lo] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T
    sizes = np.array([len(x) for x in sets])
    both = both.astype(np.int64)
    hit = (both * 100 >= (sizes[left][:, None] + sizes[right][None, :] - both) * percent) & (component[left][:, None] != component[right][None, :])
    return np.nonzero(hit)


def _between_components(scratch: Scratch, placed: DataFrame, sets: DataFrame, percent: int, family_most: int = 8192, block: int = 128) -> DataFrame:
    """Links between members of a bucket that are in different components, enough of them to join these.

    Buckets that share members make a family. A family of at most ``family_most`` documents is compared as one group,
    so its sets travel once; in a larger one each bucket is a group. In a group all members outside its largest
    component are compared with all members, in blocks: a task gets a sixteenth of each side (``block`` sets at least, 32 times as many at most) and gives a spanning
    forest of the links that it finds. No pair is made as a row.
    """
    split = lambda p: p.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first")).where(F.col("lo") < F.col("hi")).select("key", "first")
    placed = scratch.table(placed, "placed_last")
    open_ = scratch.table(placed.join(small(scratch.table(split(placed), "split")), "key"), "open")
    edges = open_.where(F.col("rep") != F.col("first")).select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    families = connected_components(edges, scratch, "families").select(F.col("id").alias("rep"), F.col("component").alias("family"))
    families = scratch.table(families, "families")
    large = families.groupBy("family").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > family_most).select("family", F.lit(True).alias("large"))
    of = scratch.table(families.join(large, "family", "left"), "families_sized")
    # a member of a small family is one row, however many buckets it is in
    within = open_.select("rep", "component").distinct().join(of.where(F.col("large").isNull()), "rep").select(F.xxhash64("family", F.lit(False)).alias("group"), "rep", "component")
    apart = open_.join(of.where("large").select("rep"), "rep", "left_semi").select(F.xxhash64("key", F.lit(True)).alias("group"), "rep", "component").distinct()
    grouped = within.unionByName(apart)
    grouped = scratch.table(grouped, "grouped")
    parts = grouped.groupBy("group", "component").agg(F.count(F.lit(1)).alias("c"))
    shape = parts.groupBy("group").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("s"))
    # members travel to at most 16 blocks of the other side, until a block has as many as a task should hold
    each = F.least(F.greatest(F.lit(block), F.ceil(F.col("m") / 16)), F.lit(32 * block))
    blocks = lambda c: F.ceil(F.col(c) / each).cast("int")
    shape = scratch.table(shape.select("group", "main", blocks("s").alias("left_blocks"), blocks("m").alias("right_blocks")), "shape")
    rows = grouped.join(small(shape), "group")
    own = lambda c: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = rows.select("group", "rep", "component", F.lit(False).alias("left"), own("right_blocks").alias("j"), every("left_blocks").alias("i"))
    left = rows.where(F.col("component") != F.col("main")).select("group", "rep", "component", F.lit(True).alias("left"), every("right_blocks").alias("j"), own("left_blocks").alias("i"))
    dealt = left.unionByName(right).join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").select("group", "i", "j", "left", "rep", "component", "shingles")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def task(rows: pa.RecordBatch):
            ids, component = rows.column("rep").to_numpy(), rows.column("component").to_numpy()
            is_left = rows.column("left").to_numpy(zero_copy_only=False)
            lists = rows.column("shingles")
            flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            sets_ = [flat[a - offs[0] : b - offs[0]] for a, b in zip(offs[:-1], offs[1:])]
            l, r = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            if not len(l) or not len(r):
                return [], []
            tiles = [(l[i : i + 4 * block], r[j : j + 4 * block]) for i in range(0, len(l), 4 * block) for j in range(0, len(r), 4 * block)]
            hits = [(x[u], y[v]) for x, y in tiles for u, v in [block_links(sets_, x, y, component, percent)]]
            # one node for each component: only links that join two of them matter
            names, node = np.unique(component, return_inverse=True)
            a, b = (np.concatenate([h[side] for h in hits]) for side in (0, 1))
            labels, out = np.arange(len(names)), []
            while len(a):
                apart = labels[node[a]] != labels[node[b]]
                a, b = a[apart], b[apart]
                if len(a):
                    out.append((ids[a[0]], ids[b[0]]))
                    labels = unite(labels, node[a[:1]], node[b[:1]])
            return [x for x, _ in out], [y for _, y in out]

        def tasks(batch: pa.RecordBatch):
            """Cuts where (group, i, j) changes."""
            keys = [batch.column(c).to_numpy() for c in ("group", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            return [batch.slice(a, b - a) for a, b in zip(bounds[:-1], bounds[1:])]

        def whole(held):
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        def result(found):
            return pa.RecordBatch.from_arrays([pa.array([x for a, _ in found for x in a], pa.int64()), pa.array([y for _, b in found for y in b], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for part in tasks(batch):
                if held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in ("group", "i", "j")):
                    found.append(task(whole(held)))
                    held = []
                held.append(part)
            yield result(found)
        if held:
            yield result([task(whole(held))])

    ready = dealt.repartition(F.col("group"), F.col("i"), F.col("j")).sortWithinPartitions("group", "i", "j", "left", "rep")
    return scratch.table(ready.mapInArrow(compare, "a long, b long"), "joining")


def near_duplicate_groups(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = 160, rows: int = 5, star_rounds: int = 1, seed: int = 11, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each document: id, n_shingles, component_id, kept (the smallest id of each group).

    Documents with 100 * |A and B| >= percent * |A or B| over distinct k-word shingles are linked; components are
    those of the links. Equal sets are one class. With ``hashes`` minima in bands of ``rows`` two sets of similarity s
    share a band but for a chance of (1 - s**rows)**(hashes/rows), 3e-6 at 0.8. Candidates are verified first by the
    share of equal minima, at 5 standard deviations below the threshold, and then on the full sets.

    A group of m similar documents isn't compared pair by pair: in each bucket of a band all are compared with one
    pivot, another one in each of ``star_rounds`` rounds. After that those outside a group's largest component are
    compared with all of the group, in blocks, so no link that joins two components is lost. Nothing is capped.
    Families of buckets with at most 8192 documents are compared as a whole, so pairs that share no band are found there as
    well; in larger ones, only pairs that share a bucket.

    Null and empty texts have no shingles and link with nothing, as have rows with a null id (null component,
    kept). Ids are integers and expected to be unique: components go by text, so rows that share an id but not a text may
    be in different ones, and callers whose ids repeat give a key of their own. Other columns are ignored; very long
    texts are taken as a whole; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    integer_ids(docs, id_col)
    digest = scratch.table(_digest(docs, k, hashes, rows, seed, id_col, text), "digest")
    linkable = digest.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = scratch.table(linkable.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("key")
    members = scratch.table(banded.join(small(scratch.table(shared, "shared")), "key"), "members")
    wanted = members.select("rep").distinct().join(classes.select("rep", "n", "s1", "s2", "sig"), "rep")
    wanted = scratch.table(wanted, "wanted")
    names = scratch.table(wanted.select(F.col("rep").alias("id"), "s1", "s2"), "names")
    sets = scratch.table(_sets(docs, small(names), k, id_col, text), "sets")
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / hashes) ** 0.5

    possible = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)

    def similar(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, hashes) for c in (2, 3))
            yield batch.filter(pa.array((a == b).mean(1) >= least)).select([0, 1])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sig = lambda x: wanted.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
        sized = pairs.join(sig("a"), "a").join(sig("b"), "b").where(possible)
        likely = scratch.table(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(similar, "a long, b long"), f"{name}_likely")
        side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        exact = likely.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
        return scratch.table(exact.where(F.col("both") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("both")) * percent).select("a", "b"), name)

    links = components = tested = None
    for r in range(star_rounds):
        now = scratch.table(_placed(members, components), f"placed_{r}") if r else _placed(members, components)
        order = F.struct((F.col("rep") if r == 0 else F.xxhash64("rep", F.lit(r))).alias("o"), "rep", "component")
        pivots = now.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.component").alias("pivot_component"))
        # written first, so that Spark can split the join where a bucket is very large
        pairs = now.join(small(scratch.table(pivots, f"pivots_{r}")), "key").where(F.col("component") != F.col("pivot_component")).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        pairs = scratch.table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"pairs_{r}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = verified(pairs, f"links_{r}")
        links = more if links is None else links.unionByName(more)
        components = scratch.table(connected_components(links, scratch, f"cc_{r}"), f"components_{r}")
    more = _between_components(scratch, _placed(members, components), sets, percent)
    components = scratch.table(connected_components(links.unionByName(more), scratch, "cc"), "components")
    scratch.keep("digest", "classes", "components")

    known = classes.select("s1", "s2", "rep").join(components.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = digest.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("s1")).alias("s1"), "s2").join(known, ["s1", "s2"], "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))
