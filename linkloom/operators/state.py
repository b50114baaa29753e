"""Named state that outlives a run, by version and in shards: request logs, keys that wait for their parents."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..folders import written
from ..model import Conflict, Store
from .stats import compact_log


#: Rows of a shard beyond so many go to another task.
_ROWS_EACH = 1 << 19


class State:
    """A folder of named tables, each in shards by a hash of its key. A change reads and writes the shards that it touches; the others
    stay as they are. Each change is a version, which lists the folder of every shard and is created once; the last ``keep``
    versions can be read. A large shard is written by several tasks, so its size bounds no task's memory. A run's change of a name counts once: repeated after a failure it does nothing.

    Writers hold the lease of ``model.Store``.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 16, keep: int = 5):
        self.spark, self.path, self.shards, self.keep = spark, path.rstrip("/"), shards, keep
        self._files = Store(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n.rpartition("-")[2]) for n in self._files._names("_state-*"))

    def manifest(self, version: int | None = None) -> dict:
        """version, and of each name its schema, the folder of each shard, and the runs that are done."""
        for v in [version] if version is not None else reversed(self.versions()):
            with contextlib.suppress(json.JSONDecodeError):  # its writer ended
                return {"version": v, "names": json.loads(self._files._get(f"_state-{v:06d}"))}
        return {"version": -1, "names": {}}

    def read(self, name: str, version: int | None = None, shards: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its shards; None if no version has it."""
        found = self.manifest(version)["names"].get(name)
        return found and self._rows(found, shards)

    def _rows(self, found: dict, shards: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(found["schema"])
        paths = [f"{self.path}/{folder}/_shard={s}" for s, folder in sorted(found["shards"].items()) if shards is None or int(s) in shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def update(self, name: str, keys: list[str], new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], run: str | None = None, every: bool = False) -> bool:
        """Puts ``merge(old, new)`` in the place of the shards that rows of ``new`` are in (``every``: of all). Both have the same columns. False
        if the run is done."""
        of = F.pmod(F.xxhash64(*keys), F.lit(self.shards)).cast("int")
        with self._files._held() as token:
            found = self.manifest()
            names = dict(found["names"])
            mine = names.get(name, {"schema": json.loads(new.schema.json()), "shards": {}, "done": []})
            if run is not None and run in mine["done"]:
                return False
            new = written(new, "state")
            touched = list(range(self.shards)) if every else [r["s"] for r in new.select(of.alias("s")).distinct().collect()]
            folder = f"{name}-{found['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
            old = self._rows(mine, touched)
            changed = merge(old, new)
            pieces = -(-(old.count() + new.count()) // (_ROWS_EACH * max(1, len(touched))))
            dealt = changed.withColumn("_shard", of)
            if pieces > 1:
                dealt = dealt.repartition(pieces * len(touched), "_shard", F.pmod(F.xxhash64(*changed.columns, F.lit(5)), F.lit(pieces)))
            else:
                dealt = dealt.repartition("_shard")
            dealt.write.partitionBy("_shard").parquet(f"{self.path}/{folder}")
            full = [n.split("=")[1] for n in self._files._names(f"{folder}/_shard=*")]
            kept = {s: f for s, f in mine["shards"].items() if int(s) not in touched}
            names[name] = {"schema": mine["schema"], "shards": {**kept, **{s: folder for s in full}}, "done": [*mine["done"], run][-100:] if run is not None else mine["done"]}
            if not self._files._renew(token):
                raise Conflict(f"{self.path}: the lease ended before the change did")
            self._files._create(f"_state-{found['version'] + 1:06d}", json.dumps(names))
            self._forget()
        return True

    def _forget(self) -> None:
        versions = self.versions()
        for v in versions[: -self.keep]:
            self._files._delete(f"_state-{v:06d}")
        used = {f for v in versions[-self.keep :] for n in self.manifest(v)["names"].values() for f in n["shards"].values()}
        for name in self._files._names("*-[0-9]*-*"):
            if name not in used:
                self._files._delete(name)


def log_run(state: State, name: str, log: DataFrame, keys: list[str], order: str = "seq", action: str = "action", run: str | None = None) -> bool:
    """Adds a run's log to what is kept of those before: the keys whose last action is to add. Runs come in the order of ``order``."""
    return state.update(name, keys, log, lambda old, new: compact_log(old.unionByName(new), keys, order, action).select(log.columns), run)


class LateKeys:
    """Rows whose parent may come in a later batch: natural keys are replaced by ids where the parent is known, and rows without wait.

    column: the row's natural key of the parent, as text. Rows are kept with the batch that told them (null: they wait), so one change
    per batch is all, and a batch that is repeated gives the same again.
    """

    def __init__(self, state: State, name: str, column: str):
        self.state, self.name, self.column = state, name, column

    def batch(self, number: int, rows: DataFrame, parents: DataFrame, natural: str, key: str = "id") -> DataFrame:
        """The rows, of this batch and of those that waited, whose parent is among ``parents`` (all that are known); the column is the parent's
        id as text. Null keys wait for nothing and are given as they are. What earlier batches told is dropped, so only the last
        batch can be repeated."""
        first = parents.where(F.col(natural).isNotNull()).groupBy(F.col(natural).alias("_natural")).agg(F.min(key).alias("_id"))

        def tell(old: DataFrame, new: DataFrame) -> DataFrame:
            open_ = old.where(F.col("_batch").isNull()).unionByName(new)
            found = open_.join(first, F.col(self.column) == F.col("_natural"), "left")
            told = F.col("_id").isNotNull() | F.col(self.column).isNull()
            return found.select(*[F.col(c) for c in rows.columns], F.when(told, F.lit(number)).cast("long").alias("_batch"), F.col("_id").cast("string").alias("_parent"))

        new = rows.withColumns({"_batch": F.lit(None).cast("long"), "_parent": F.lit(None).cast("string")})
        self.state.update(self.name, [self.column], new, tell, str(number), every=True)
        told = self.state.read(self.name).where(F.col("_batch") == number)
        return told.withColumn(self.column, F.coalesce("_parent", self.column)).select(rows.columns)

    def waiting(self) -> DataFrame | None:
        """Rows whose parent hasn't come, and their natural keys."""
        found = self.state.read(self.name)
        return found if found is None else found.where(F.col("_batch").isNull()).drop("_batch", "_parent")
