"""Exact deduplication as a stream with keyed state on disk, in DataFrame expressions only.

Two streams run one after the other over the files that are there. The first one reads each file once and writes an entry for
each row: its identifier, the digest of its normalised text, and its locator (file and row). The second one keeps a state
for each digest, in RocksDB and in the checkpoint of the shared folder, without expiry: how many rows have it, and of the row that
stays the identifier and the locator of its content. Texts are in neither. Then the full bytes of all rows whose digest
was hit are compared: copies fall together within each task before anything is shuffled. Rows of a digest that turns out to
stand for several contents are told apart by their texts.

With a folder of its own the state outlives the run: a later call reads files that are new only.
"""

from __future__ import annotations

import contextlib
import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import BROADCAST_BYTES, Scratch, input_bytes, partitions, small

_ROCKS = "spark.sql.streaming.stateStore.rocksdb."
#: How the state is kept; held while a stream starts, as it takes its settings then.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}changelogCheckpointing.enabled": "true",
    f"{_ROCKS}boundedMemoryUsage": "true",
    f"{_ROCKS}maxMemoryUsageMB": "256",
    f"{_ROCKS}allowFAllocate": "false",  # each partition's store would take disk in advance
}
#: A digest with more than 1 / HOT of all rows is hot; there are fewer than HOT of them, so they can be broadcast.
HOT = 4096


def normal(text: str | Column) -> Column:
    """A-Z lower-cased, no other letter; null is empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _file_stream(spark: SparkSession, path: str, max_bytes: int, max_files: int | None) -> DataFrame:
    """New files at a path, which may be a folder or one file: a stream takes a file by a pattern only."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def follow(spark: SparkSession, path: str, folder: str, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, max_bytes: int = 1 << 40, max_files: int | None = None) -> None:
    """Brings the entries and the state in ``folder`` up to date with the Parquet files at ``path``, in batches of at most
    ``max_bytes`` (or ``max_files``) of files. A batch that was interrupted is done again, and counts once."""
    docs = _file_stream(spark, path, max_bytes, max_files)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    entries = docs.select(F.col(id_col).alias("id"), digest(normal(text)).alias("digest"), at.alias("at"))
    entries = entries.select("id", "digest", F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    once = {"availableNow": True}
    entries.writeStream.format("parquet").option("checkpointLocation", f"{folder}/entries-log").option("path", f"{folder}/entries").trigger(**once).start().awaitTermination()
    if not _exists(spark, f"{folder}/entries") or spark.read.schema(entries.schema).parquet(f"{folder}/entries").isEmpty():
        return
    reader = spark.readStream.schema(entries.schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    seen = reader.parquet(f"{folder}/entries").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
    parts = partitions(spark.read.parquet(path), 256 << 20)
    with _settings(spark, **STATE, **{"spark.sql.shuffle.partitions": str(parts)}):
        stream = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(**once).start()
    stream.awaitTermination()


def _grouped(rows: DataFrame, groups: DataFrame, hot: DataFrame | None, key: str, how: str) -> DataFrame:
    """rows joined with groups, which has each key once. Without ``hot`` groups is small; else rows of hot keys are joined
    where they are, and only the others are shuffled."""
    if hot is None:
        return rows.join(F.broadcast(groups), key, how)
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key, how)
    return (here if how != "left_semi" else here.select(rest.columns)).unionByName(rest)


def deduplicate(
    spark: SparkSession, path: str, folder: str | None = None, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, max_bytes: int = 1 << 40, max_files: int | None = None
) -> DataFrame:
    """A row for each document at ``path``, dropped ones too: ``id_col``, keep_id, group_size, kept, digest (binary), file and row, and
    keep_file and keep_row, where the content that stays is.

    Texts are equal when they are so after lower-casing A-Z; null is empty. Of equal texts the row with the largest id stays (null
    ids first); of rows that share it the one that is last by file and row, so of repeated rows one. Texts are compared as a whole,
    however long. Ids may be of any type that has an order; other columns are not read, whatever their names; an empty table gives
    no rows. ``folder``: where entries and state stay for later calls, which give all rows of all calls; files must not
    change, and are read once. ``digest`` may be any function of the text: equal digests of different texts cost time only.
    """
    scratch = Scratch(spark, "exact")
    folder = folder or f"{scratch.path}/stream"
    follow(spark, path, folder, text, id_col, digest, max_bytes, max_files)
    docs = spark.read.parquet(path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, digest binary, file string, row bigint"
    if not _exists(spark, f"{folder}/state"):
        rows = spark.createDataFrame([], f"{schema}, n bigint, keep struct<id:{kind},file:string,row:bigint>")
        return _told(rows, id_col)
    entries = spark.read.schema(schema).parquet(f"{folder}/entries")
    state = spark.read.format("statestore").load(f"{folder}/state").select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("keep"))
    hits = scratch.table(state.where("n > 1"), "hits")
    hot = None if input_bytes(hits) <= BROADCAST_BYTES else scratch.table(hits.where(F.col("n") > entries.count() / HOT), "hot")
    # full bytes of all hits: distinct drops copies within a task first
    contents = docs.select(digest(normal(text)).alias("digest"), normal(text).alias("text"))
    contents = _grouped(contents, hits.select("digest"), hot.select("digest") if hot is not None else None, "digest", "left_semi").distinct()
    clash = scratch.table(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest"), "clash")
    rows = _grouped(entries, hits, hot, "digest", "left")
    rows = rows.withColumn("keep", F.coalesce("keep", F.struct("id", "file", "row"))).withColumn("n", F.coalesce("n", F.lit(1)).cast("long"))
    if not clash.isEmpty():
        rows = _by_content(rows, docs, small(clash), text)
    return _told(rows, id_col)


def _by_content(rows: DataFrame, docs: DataFrame, clash: DataFrame, text: str) -> DataFrame:
    """Rows of the digests that stand for several contents, grouped by their texts, which their locators lead to."""
    mixed = rows.join(clash, "digest", "left_semi").select("id", "digest", "file", "row")
    texts = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normal(text).alias("text"))
    mixed = mixed.join(texts, ["file", "row"])
    groups = mixed.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
    return rows.join(clash, "digest", "left_anti").unionByName(mixed.join(groups, ["digest", "text"]).drop("text"))


def _told(rows: DataFrame, id_col: str) -> DataFrame:
    kept = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return rows.select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest", "file", "row", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row")
    )
