"""Structured Streaming: feed pages into a store, site counts with state, event-time windows."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import is_absolute_http, site
from ..model import Catalog, Conflict, Store
from ..operators.storage import additions
from ..sources.pages import entries, parse_pages, tables_of, with_links


def page_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of JSON pages from files as they come."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).where((F.col("value") != "\0") & (F.trim("value") != ""))


def stream_of(spark: SparkSession, checkpoint: str) -> str:
    """A stream's own name, by which its batches are told from others': it is in its checkpoint from the first start on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    file = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(file.readAllBytes()).decode())["id"]
    finally:
        file.close()


def ingest(
    spark: SparkSession, path: str | DataFrame, store: Store, checkpoint: str, max_files: int | None = None, on_batch: Callable[[int, Catalog], None] | None = None, on_stage: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Merges each micro-batch of pages into the store, once; ends when what is there is done. path: a folder of files of pages, or a
    stream with them in ``value``, as ``sources.paged.paged_stream`` gives them.

    A batch is parsed once and staged beside the tables; then the rows that the tables haven't got are appended, and what is there
    isn't written again. Of the tables only folders that may hold keys of the batch are read. The append and the batch's number are one change: a
    batch that is repeated after a failure isn't merged again if it is done, and starts from its stage if that is complete. So a
    stage that was left behind never overwrites what later batches brought. ``on_stage`` is called between the two steps.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        this = stream_of(spark, checkpoint), batch_id
        staged = store.staging(this)
        if store.done(this[0]) < batch_id:
            if not staged.manifest():
                staged.remove()
                parsed = with_links(entries(parse_pages(batch))).persist(StorageLevel.DISK_ONLY)
                try:
                    staged.append(tables_of(parsed))
                finally:
                    parsed.unpersist()
            if on_stage:
                on_stage(batch_id)
            _merge(store, staged, this)
        staged.remove()
        if on_batch:
            on_batch(batch_id, store.open(locked=True))

    stream = page_stream(spark, path, max_files) if isinstance(path, str) else path
    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merge(store: Store, staged: Store, batch: tuple[str, int] | None, tries: int = 5) -> None:
    """Another writer's change in between is a Conflict: what is to be added is found anew then."""
    for left in reversed(range(tries)):
        base = store.generation
        main = store.open(locked=True) if base >= 0 else Catalog(store.spark)
        try:
            store.append(additions(main, staged.open(locked=True)), base, batch)
            return
        except Conflict:
            if not left:
                raise
            time.sleep(random.uniform(0.5, 2))


def merge_staged(store: Store) -> int:
    """Merges what interrupted ingestion has left beside the tables, by stream and batch, and removes it; gives how many were merged.
    A stage whose batch is done is removed unread. Half-written ones hold nothing that their batch won't bring again."""
    merged = 0
    for staged, batch in store.staged():
        if staged.manifest() and not (batch and store.done(batch[0]) >= batch[1]):
            _merge(store, staged, batch)
            merged += 1
        staged.remove()
    return merged


def site_counts(links: DataFrame, threshold: int) -> DataFrame:
    """Running mentions by site of a stream of (source, target), in update mode; those over the threshold. A pair counts once,
    however often it comes."""
    once = links.where(is_absolute_http(F.col("target"))).dropDuplicates(["source", "target"])
    found = once.groupBy(site(F.col("target")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") > threshold)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Event-time windows with a watermark; for batches and streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
