"""Rolling statistics, rates, log compaction, ordering and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.window import WindowSpec

from ..folders import written


def segments(df: DataFrame, order: list[str], partition: list[str], last: int) -> DataFrame:
    """df dealt by ranges of its keys and their order, so that a key with most of the rows is many tasks: ``_segment`` is the range, and
    with each key's part of a range come the ``last`` - 1 rows of the key before it, marked ``_halo``. A frame of ``last`` rows within
    key and segment is then what it is within the key."""
    dealt = written(df.repartitionByRange(*partition, *order).withColumn("_segment", F.spark_partition_id()), "segments").withColumn("_halo", F.lit(False))
    part = [*partition, "_segment"]
    back = F.row_number().over(Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order]))
    ends = dealt.withColumn("_back", back).where(F.col("_back") < last)
    sizes = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    # the parts after each one, and how many rows lie between: as each has a row at least, no more than last - 1 can matter
    later = F.collect_list(F.struct(F.col("_segment").alias("to"), F.col("_n").alias("n"))).over(Window.partitionBy(*partition).orderBy("_segment").rowsBetween(1, last - 1))
    gaps = F.transform(later, lambda x, i: F.struct(x["to"].alias("to"), F.aggregate(F.slice(later, F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("gap")))
    reach = sizes.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(part)], gaps.alias("_gaps"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(part)]
    halo = ends.join(reach, same).withColumn("_to", F.explode("_gaps")).where(F.col("_to.gap") + F.col("_back") < last)
    return dealt.unionByName(halo.select(*df.columns, F.col("_to.to").alias("_segment"), F.lit(True).alias("_halo")))


def _framed(df: DataFrame, order: list[str], partition: list[str], last: int, split: bool, add: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """df with columns over a frame of the last rows of each key; ``split``: of keys that may be too large for a task."""
    if split:
        df, partition = segments(df, order, partition, last), [*partition, "_segment"]
    out = df.withColumns(add(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(last - 1), Window.currentRow)))
    return out.where(~F.col("_halo")).drop("_halo", "_segment") if split else out


def rolling_stats(df: DataFrame, value: str, order: list[str], partition: list[str], last: int = 64, split: bool = False) -> DataFrame:
    """min, max, mean and mode of the last values up to each row; of equally frequent values the smallest is the mode."""
    add = lambda w: {"min_last": F.min(value).over(w), "max_last": F.max(value).over(w), "mean_last": F.avg(value).over(w), "mode_last": F.mode(value, True).over(w)}
    return _framed(df, order, partition, last, split, add)


def rate(df: DataFrame, value: str, order: list[str], partition: list[str], samples: int = 5, split: bool = False) -> DataFrame:
    """(last - first) / (samples - 1) over the last samples; null for the first row."""
    add = lambda w: {"rate": F.when(F.count(value).over(w) > 1, (F.col(value) - F.first(value).over(w)) / (F.count(value).over(w) - 1))}
    return _framed(df, order, partition, samples, split, add)


def ages(df: DataFrame, created: str, now: Column, keys: list[str]) -> DataFrame:
    """Oldest, newest and mean age in seconds of what is waiting."""
    age = F.unix_timestamp(now) - F.unix_timestamp(created)
    return df.groupBy(*keys).agg(F.max(age).alias("oldest"), F.min(age).alias("newest"), F.avg(age).alias("mean_age"))


def explored_ratio(finished: Column, scheduled: Column) -> Column:
    return F.format_string("%.2f%%", F.when(scheduled == 0, 0.0).otherwise(100.0 * finished / scheduled))


def compact_log(log: DataFrame, keys: list[str], order: str = "seq", action: str = "action", keep: str = "add") -> DataFrame:
    """The keys whose last action is ``keep``, with that row."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")
    return last.where(F.col(action) == keep)


def limit_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def label_sequence(df: DataFrame, order: list[Column], partition: list[str], start: int = 0, name: str = "label", as_text: bool = False) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1 + start
    return df.withColumn(name, n.cast("string") if as_text else n)


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A repeatable shuffle: within each partition by a seeded hash, which other engines know as well."""
    return df.sortWithinPartitions(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
