"""Shared run-time helpers: written intermediate tables, partition counts, Arrow text access."""

from __future__ import annotations

import atexit
import contextlib
import math
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..folders import shared_folder

#: What was written and isn't removed yet: (session, folder, catalog table or None). Without a scope it stays until the driver ends.
_Written = list[tuple[SparkSession, str, str | None]]
_ALL: _Written = []
_SCOPE: ContextVar[_Written] = ContextVar("linkloom_scope", default=_ALL)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _release(written: _Written) -> None:
    for spark, path, table in written:
        with contextlib.suppress(Exception):  # the session may have ended, and its folders with it
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(spark, path)
    written.clear()


atexit.register(_release, _ALL)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Removes at its end what operators have written within it. Their results are lazy and read those tables, so they must
    have been written or collected by then."""
    mine: _Written = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _release(mine)


class Scratch:
    """Written tables of one run of an operator, in the shared folder, so that a lost executor loses nothing.

    Lazy results read them, so a table lives until the operator drops it, the enclosing ``scope`` ends, or the driver does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/linkloom-{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        _SCOPE.get().append((spark, self.path, None))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again: cuts the lineage."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Write df as a table hashed by a column, so that later joins on it don't shuffle this side. Spark's limit on the
        number of buckets is raised where it is lower."""
        limit = "spark.sql.sources.bucketing.maxBuckets"
        if buckets > int(self.spark.conf.get(limit, "100000")):
            self.spark.conf.set(limit, str(buckets))
        table = f"linkloom_{name}_{self.path[-12:]}"
        _SCOPE.get().append((self.spark, f"{self.path}/{name}", table))
        df.repartition(buckets, column).write.option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(buckets, column).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        self.drop(*(self.names - set(names)))


def integer_ids(df: DataFrame, id_col: str) -> None:
    """Ids are compared and sent as 64-bit integers."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df begins with it, in any case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below df, by the optimiser's statistics; no job runs."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def partitions(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions for work of df's size: the session's number, or more where the input is larger."""
    size = input_bytes(df)
    asked = math.ceil(size / bytes_each) if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked)


#: Tables of at most so many bytes on disk are broadcast.
BROADCAST_BYTES = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are small; else Spark shuffles both sides."""
    return F.broadcast(df) if input_bytes(df) <= BROADCAST_BYTES else df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array as one uint8 array, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = 2 << 20):
    """Row ranges (lo, hi) of at most so many bytes each, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
