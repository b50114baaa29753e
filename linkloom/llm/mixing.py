"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from .runtime import input_bytes, Scratch

#: Lists of sources up to this length are broadcast.
MOST_BROADCAST = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[float], weights: list[float], budget: float, cap: float) -> list[float]:
    """Shares of budget by weight; a share above cap * size stops there and the excess is shared anew."""
    targets, open_, left = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return targets


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weigh, share: float, cap: float = 2.0, seed: int = 17, text: str = "text", source: str = "source", id_col: str = "doc_id", bucket_bytes: int = 1 << 20, prefix: str = "") -> DataFrame:
    """docs with size, source_size, target and taken added (words; columns of those names are replaced, so give a ``prefix``
    for the new ones to keep them).

    ``weigh(names, sizes)`` gives the weight of each source; they come sorted by code point, null last. The list
    of sources, one row each, is the mix's configuration and is held on the driver. A source takes
    floor(target / size) whole repetitions of all its documents; of the fractional repetition it takes
    documents in the order of a seeded hash, until the target is met, the last one in part. So each
    source's taken words equal its rounded target, and no document exceeds ceil(cap) times its size.

    Texts are read twice: sizes and hashes are written first, and the hash at which each source's target is met (its cut) is
    found there; then each document is decided where it is read. The cut is looked for in one range of hashes of each source
    only; ranges are halved until one holds about ``bucket_bytes`` of what is written, 4096 of them at least, and how many
    there are doesn't change the result. Null text has size 0; a source of size 0 gets target 0; an empty table gives
    none. Repeated rows and ids are taken row by row; those at a cut, if several, go by id, then by a hash of the text, in a task for each source. Null
    ids are hashed by their text. Very long texts are only counted. Columns that begin with _mix_ are reserved.
    """
    spark = docs.sparkSession
    size, whole_size, target, taken_ = (f"{prefix}{n}" for n in ("size", "source_size", "target", "taken"))
    hashed = F.xxhash64(F.when(F.col(id_col).isNull(), F.col(text)), F.col(id_col), F.lit(seed))
    rows = docs.drop(whole_size, target, taken_).withColumns({size: word_count(F.col(text)), "_mix_h": F.shiftrightunsigned(hashed, 1), "_mix_s": F.col(source)})
    scratch = Scratch(spark, "mix")
    sizes_of = scratch.table(rows.select("_mix_s", "_mix_h", F.col(size).alias("n")), "sizes")
    bits = min(30, max(12, (input_bytes(sizes_of) // bucket_bytes).bit_length()))
    bucket = F.shiftright("_mix_h", 63 - bits)
    by_bucket = scratch.table(sizes_of.groupBy("_mix_s", bucket.alias("_mix_bucket")).agg(F.sum("n").alias("n")), "buckets")
    totals = sorted(((r["_mix_s"], int(r["n"])) for r in by_bucket.groupBy("_mix_s").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    targets = water_fill(sizes, weigh([s for s, _ in totals], sizes), share * sum(sizes), cap)
    whole = [int(t // n) if n else 0 for t, n in zip(targets, sizes)]
    rest = [round(t) - w * n if n else 0 for t, w, n in zip(targets, whole, sizes)]

    def by_source(values: list[tuple], columns: str) -> DataFrame:
        df = spark.createDataFrame([(s, *v) for (s, _), v in zip(totals, values)], f"_mix_source string, {columns}")
        return F.broadcast(df) if len(totals) <= MOST_BROADCAST else df  # else Spark chooses by size

    def met(groups: DataFrame, order: str, base: str) -> dict:
        """By source, the group in which its rest is met: at most one row each."""
        before = F.sum("n").over(Window.partitionBy("_mix_s").orderBy(order)) - F.col("n") + F.col(base)
        at = groups.withColumn("before", before).where((F.col("before") < F.col("_mix_rest")) & (F.col("before") + F.col("n") >= F.col("_mix_rest")))
        return {r["_mix_s"]: r for r in at.collect()}

    same = F.col("_mix_s").eqNullSafe(F.col("_mix_source"))
    edge = met(by_bucket.join(by_source([(r, 0) for r in rest], "_mix_rest long, _mix_base long"), same), "_mix_bucket", "_mix_base")
    edges = [(r, edge[s]["before"], edge[s]["_mix_bucket"]) if s in edge else (r, None, None) for (s, _), r in zip(totals, rest)]
    inside = sizes_of.join(by_source(edges, "_mix_rest long, _mix_base long, _mix_edge long"), same).where(bucket == F.col("_mix_edge"))
    inside = inside.groupBy("_mix_s", "_mix_h", "_mix_rest", "_mix_base").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    cut = met(inside, "_mix_h", "_mix_base")
    scratch.drop("sizes", "buckets")
    decided = [(n, t, w, r - cut[s]["before"], cut[s]["_mix_h"]) if s in cut else (n, t, w, 0, None) for (s, n), t, w, r in zip(totals, targets, whole, rest)]
    plan = by_source(decided, f"{whole_size} long, {target} double, _mix_whole long, _mix_left long, _mix_cut long")
    rows = rows.join(plan, same)
    at_cut = F.coalesce(F.col("_mix_h") == F.col("_mix_cut"), F.lit(False))
    taken = lambda e: (F.col("_mix_whole") * F.col(size) + e).cast("long")
    extra = F.when(F.col("_mix_h") < F.col("_mix_cut"), F.col(size)).when(at_cut, F.col("_mix_left")).otherwise(F.lit(0))
    if all(r["copies"] == 1 for r in cut.values()):
        out = rows.withColumn(taken_, taken(extra))
    else:
        order = Window.partitionBy("_mix_s").orderBy(id_col, F.hash(text)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        prior = F.sum(size).over(order) - F.col(size)
        shared = F.least(F.col(size), F.greatest(F.lit(0), F.col("_mix_left") - prior))
        out = rows.where(~at_cut).withColumn(taken_, taken(extra)).unionByName(rows.where(at_cut).withColumn(taken_, taken(shared)))
    return out.drop("_mix_h", "_mix_s", "_mix_source", "_mix_whole", "_mix_left", "_mix_cut")


def repeat_texts(mixed: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The mix itself: a row for each repetition, the fractional one cut to its words (joined by a space). Documents
    without words have no repetition."""
    size, taken = F.col(f"{prefix}size"), F.col(f"{prefix}taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    rows = mixed.withColumn("_mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    left = taken - (F.col("_mix_copy") - 1) * size
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return rows.withColumn(text, F.when(left >= size, F.col(text)).otherwise(cut)).drop("_mix_copy")
