"""Running sums by key in an order, also where one key has most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..folders import written


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with ``name``, the sum of ``value`` up to each row of its key; order tells the rows of a key apart.

    Rows are dealt by ranges of key and order, so a large key is many tasks: each sums its own part of it, and what comes before
    a part is one row for each key and part. Minus infinity stays once it is there. Sums of parts are added, so of values that
    have no exact sums the last bits may differ from those of one pass.
    """
    dealt = written(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy(key, "_part").agg(F.sum(value).alias("_sum")).select(F.col(key).alias("_sum_key"), F.col("_part").alias("_sum_part"), before.alias("_before"))
    here = F.sum(value).over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = dealt.withColumn(name, here).join(parts, F.col(key).eqNullSafe(F.col("_sum_key")) & (F.col("_part") == F.col("_sum_part")))
    return summed.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce(name, F.lit(0))).drop("_sum_key", "_sum_part", "_part", "_before")
