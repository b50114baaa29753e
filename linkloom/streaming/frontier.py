"""The site frontier as a stream: mentions are counted by site, with state, and each site is scheduled once."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..folders import written
from ..functions.urls import site

_PAIRS = "site string, depth int, n long, known boolean"
_SCHEDULED = "site string, depth int, n long"
#: A site's mentions are looked up in so many tasks.
SHARDS = 16
#: The pairs of a shard are kept in so many sets.
SETS = 32
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_MENTION = "site string, shard long, a long, b long, depth int, known boolean"


class Pairs(StatefulProcessor):
    """New pairs of source and target of a shard of a site, by depth."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "a long, b long", "there boolean", ttlDurationMs=self.ttl or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        known = False
        for batch in rows:
            for a, b, depth, marks in zip(batch["a"].tolist(), batch["b"].tolist(), batch["depth"].tolist(), batch["known"].tolist()):
                if marks:
                    known = True
                elif not self.seen.containsKey((a, b)):
                    self.seen.updateValue((a, b), (True,))
                    new[depth] = new.get(depth, 0) + 1
        out = [(key[0], d, n, False) for d, n in sorted(new.items())] + ([(key[0], 0, 0, True)] if known else [])
        yield pd.DataFrame(out, columns=["site", "depth", "n", "known"])

    def close(self) -> None:
        pass


class PairSets(StatefulProcessor):
    """As ``Pairs``, where nothing is forgotten: a set of pairs is one value of the state, so it is read and written once for all of its
    pairs in a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("sets", "k int", "pairs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batches = [(b["known"].to_numpy(bool), b["a"].to_numpy("<i8"), b["b"].to_numpy("<i8"), b["depth"].to_numpy("i4")) for b in rows]
        marks, a, b, depth = (np.concatenate(c) for c in zip(*batches))
        known, told = bool(marks.any()), ~marks
        pairs, depth = np.empty(int(told.sum()), _PAIR), depth[told]
        pairs["a"], pairs["b"] = a[told], b[told]
        place = np.lexsort((pairs["b"], pairs["a"], pairs["a"] & (SETS - 1)))
        pairs, depth = pairs[place], depth[place]
        first = np.ones(len(pairs), bool)
        first[1:] = pairs[1:] != pairs[:-1]  # the first one that came
        pairs, depth = pairs[first], depth[first]
        number = pairs["a"] & (SETS - 1)
        new = np.ones(len(pairs), bool)
        for k in np.unique(number).tolist():
            low, high = np.searchsorted(number, [k, k + 1])
            kept = b""
            if self.seen.containsKey((k,)):
                kept = bytes(self.seen.getValue((k,))[0])
                new[low:high] = ~_among(pairs[low:high], np.frombuffer(kept, _PAIR))
            more = pairs[low:high][new[low:high]]
            if len(more):
                self.seen.updateValue((k,), (kept + more.tobytes(),))
        depths, counts = np.unique(depth[new], return_counts=True)
        out = [(key[0], d, n, False) for d, n in zip(depths.tolist(), counts.tolist())] + ([(key[0], 0, 0, True)] if known else [])
        yield pd.DataFrame(out, columns=["site", "depth", "n", "known"])

    def close(self) -> None:
        pass


def _among(pairs: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which of different pairs are among different kept ones."""
    both = np.concatenate([pairs, kept])
    place = np.lexsort((both["b"], both["a"]))
    same = np.zeros(len(both), bool)
    same[1:] = both[place][1:] == both[place][:-1]
    found = np.zeros(len(both), bool)
    found[place[same]] = True
    found[place[:-1][same[1:]]] = True
    return found[: len(pairs)]


class Counts(StatefulProcessor):
    """A site's mentions, and whether it is scheduled."""

    def __init__(self, threshold: int, depth_limit: int, ttl: int):
        self.threshold, self.depth_limit, self.ttl = threshold, depth_limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mentions", "n long, scheduled boolean", ttlDurationMs=self.ttl or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, scheduled = self.state.get() if self.state.exists() else (0, False)
        found = sorted((not marks, depth, more) for batch in rows for depth, more, marks in zip(batch["depth"].tolist(), batch["n"].tolist(), batch["known"].tolist()))
        out = []
        for counts, depth, more in found:
            n += more
            scheduled = scheduled or not counts
            if n > self.threshold and not scheduled and (not self.depth_limit or depth < self.depth_limit):
                scheduled = True
                out.append((key[0], depth + 1, n))
        self.state.update((n, scheduled))
        yield pd.DataFrame(out, columns=["site", "depth", "n"])

    def close(self) -> None:
        pass


def scheduled_sites(links: DataFrame, threshold: int, depth_limit: int = 0, ttl_seconds: int = 0) -> DataFrame:
    """(site, depth, n) of each site once, when more than ``threshold`` pairs of a stream of (source, target, depth) mention it.

    depth is that of the source, and a site is one deeper than the mention that it is scheduled by; mentions at ``depth_limit`` or below
    count, but schedule nothing (0: no limit). A pair counts once, however often it comes. A row without a source says that the
    target's site is scheduled already. ``ttl_seconds``: pairs and sites that weren't seen for so long are forgotten, which bounds the
    state; such a pair counts again, and such a site may be scheduled again. 0: nothing is forgotten.

    Pairs are kept in sets, or one by one where they are forgotten. The pairs of a site are looked up in ``SHARDS`` tasks, and one row for each of them and depth goes on, so a site that most
    links lead to is no more than that. Needs the RocksDB state store: ``start`` sets it.
    """
    return _scheduled(mentions(links), threshold, depth_limit, ttl_seconds)


def mentions(links: DataFrame) -> DataFrame:
    """What counts of (source, target, depth): the target's site and the pair as two hashes."""
    return _told(links).where("site IS NOT NULL")


def _told(links: DataFrame, *more: str) -> DataFrame:
    """As ``mentions``, of all links, without a site where the target is no absolute URL; so that its parts are looked for once, not in a
    filter too."""
    pair, whole = ["source", "target"], F.regexp_extract("target", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+(?=[^?#]*(?:[?][^#]*)?(?:#.*)?$)", 0)
    scheme = F.lower(F.substring_index(whole, "//", 1))
    at = F.when((whole != "") & scheme.isin("http:", "https:", ""), F.concat(F.when(scheme == "", ":").otherwise(scheme), F.lit("//"), F.substring_index(whole, "//", -1)))
    return links.select(
        at.alias("site"), F.pmod(F.xxhash64(*pair, F.lit(3)), F.lit(SHARDS)).alias("shard"), F.xxhash64(*pair).alias("a"), F.xxhash64(*pair, F.lit(1)).alias("b"), F.col("depth").cast("int"), F.col("source").isNull().alias("known"), *more
    )


def _scheduled(rows: DataFrame, threshold: int, depth_limit: int, ttl_seconds: int = 0) -> DataFrame:
    mode, ttl = ("processingTime" if ttl_seconds else "none"), ttl_seconds * 1000
    new = rows.groupBy("site", "shard").transformWithStateInPandas(Pairs(ttl) if ttl else PairSets(), _PAIRS, "append", mode)
    return new.groupBy("site").transformWithStateInPandas(Counts(threshold, depth_limit, ttl), _SCHEDULED, "append", mode)


@contextlib.contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """How the state is kept while a stream starts; without new rows no batch runs only to forget."""
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(sites: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the sites that a stream schedules to Parquet files; ends when what is there is done."""
    with _state_settings(sites.sparkSession):
        return sites.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expand_stream(links: DataFrame, seeds: DataFrame, threshold: int, depth_limit: int, folder: str) -> DataFrame:
    """(site, depth) of all sites that are reached, as ``operators.frontier.expand`` gives them, by a stream whose own results
    decide what it reads next: the items of the sites that it has just scheduled.

    links: (source, target), sources being URLs of items. ``folder`` keeps what is read, the state and the results; a run that was
    interrupted goes on from there.
    """
    spark = links.sparkSession
    # URLs are read once; what is kept and handed on is numbers
    links = written(_told(links.select("source", "target", F.lit(0).alias("depth"), site(F.col("source")).alias("_site")), "_site").drop("depth"), "links").where("site IS NOT NULL")
    read = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/read")
    read.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(read)
    stream = _scheduled(spark.readStream.schema(_MENTION).parquet(f"{folder}/read"), threshold, depth_limit)
    reached = seeds.select("site").distinct().withColumn("depth", F.lit(1))
    known = mentions(reached.select(F.lit(None).cast("string").alias("source"), F.concat("site", F.lit("/")).alias("target"), "depth"))
    level, front = 1, reached
    while True:
        found = links.join(front.select(F.col("site").alias("_site"), "depth"), "_site").select(*known.columns)
        _hand_on(found if level > 1 else found.unionByName(known), folder, level)
        start(stream, f"{folder}/scheduled", f"{folder}/checkpoint").awaitTermination()
        new = spark.read.schema(_SCHEDULED).parquet(f"{folder}/scheduled").select("site", "depth")
        level += 1
        front = new.where(F.col("depth") == level)
        if front.isEmpty():
            return reached.unionByName(new)


def _hand_on(rows: DataFrame, folder: str, level: int) -> None:
    """Writes a level's rows as a whole, then moves the files to where the stream reads; what an interrupted run has written or moved
    stays."""
    spark, at = rows.sparkSession, f"{folder}/levels/{level:05d}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(f"{at}/_SUCCESS")):
        rows.write.mode("overwrite").parquet(at)
    for status in fs.globStatus(path(f"{at}/part-*")) or []:
        fs.rename(status.getPath(), path(f"{folder}/read/{level:05d}-{status.getPath().getName()}"))
