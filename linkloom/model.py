"""Data model: eight tables with natural keys, and a folder of Parquet tables with a version and a lock."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

VERSION = "1"


@dataclass(frozen=True)
class TableSpec:
    """columns: name and type, without the surrogate id; key: the natural key; links: column -> table; keep: which
    of several rows with one key stays (the first or the last id)."""

    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    links: dict[str, str] = field(default_factory=dict)
    keep: str = "first"

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(["id bigint", *[f"{n} {t}" for n, t in self.columns]]))


SPECS = {
    s.name: s
    for s in (
        TableSpec("url", (("url", "string"),), ("url",)),
        TableSpec("keyword", (("keyword", "string"),), ("keyword",)),
        TableSpec(
            "item",
            (("url", "bigint"), ("source", "bigint"), ("title", "string"), ("author", "string"), ("published", "string"), ("updated", "string"), ("crawled", "double")),
            ("url",), {"url": "url", "source": "url"},
        ),
        TableSpec("hyperlink", (("source_id", "bigint"), ("target_id", "bigint"), ("element", "string")), ("source_id", "target_id", "element"), {"source_id": "url", "target_id": "url"}),
        TableSpec("feed", (("url_id", "bigint"), ("title", "string"), ("dead", "boolean")), ("url_id",), {"url_id": "url"}),
        TableSpec("tagging", (("url_id", "bigint"), ("keyword_id", "bigint")), ("url_id", "keyword_id"), {"url_id": "url", "keyword_id": "keyword"}),
        TableSpec("summary", (("url_id", "bigint"), ("markup", "string")), ("url_id",), {"url_id": "url"}, "last"),
        TableSpec("webpage", (("url_id", "bigint"), ("markup", "string")), ("url_id",), {"url_id": "url"}, "last"),
    )
}


class Catalog:
    """A set of tables by name; those that are missing are empty.

    ``named`` may hold tables with the URLs of some id columns beside them (``<column>_url``), where the source of the tables
    has them; queries then need no join with url, the largest table. Its ``links_of`` are the links of items by the items' ``_own`` key, which
    the source of the tables has joined and dealt them by.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, named: dict[str, DataFrame] | None = None):
        self.spark, self.tables, self.named = spark, dict(tables or {}), dict(named or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SPECS[name].schema)
        return self.tables[name]

    def with_tables(self, **tables: DataFrame) -> Catalog:
        named = {} if "url" in tables else {n: t for n, t in self.named.items() if n not in tables and not (n == "links_of" and {"item", "hyperlink"} & set(tables))}
        return Catalog(self.spark, {**self.tables, **tables}, named)

    def lookup(self, name: str, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
        """Rows of a table among which are all whose key is in ``keys``: here all rows."""
        return self[name]

    def n_rows(self, name: str) -> int | None:
        """How many rows a table has at most, where that is known without a job."""
        return None

    def with_urls(self, name: str, *columns: str) -> DataFrame:
        """A table with ``<column>_url`` for each of the columns; rows whose ids url hasn't got drop out."""
        out = self.named.get(name)
        if out is not None and all(f"{c}_url" in out.columns for c in columns):
            return out
        out = self[name]
        for c in columns:  # url has the same names in each join, so that it is dealt once for all of them
            out = out.join(self["url"].select(F.col("id").alias("_id"), F.col("url").alias("_url")), F.col(c) == F.col("_id")).drop("_id").withColumnRenamed("_url", f"{c}_url")
        return out

    def links_of(self, items: DataFrame) -> DataFrame:
        """The rows of items (with their id in ``url``), each with its hyperlinks: target_id, target_id_url, element."""
        if "links_of" in self.named and "_own" in items.columns:
            return items.join(self.named["links_of"], "_own")
        links = self.with_urls("hyperlink", "target_id").select("source_id", "target_id", "target_id_url", "element")
        return links.join(items, F.col("source_id") == F.col("url"))


class Conflict(RuntimeError):
    """Another writer was faster, or is at work: the change may be tried again on what is there then."""


def _key_hash(spec: TableSpec) -> Column:
    return F.xxhash64(*spec.key)


#: Bits of a block of a folder's key filter, and bits for each key; four are set.
_BLOCK, _BITS_EACH, _SET = 1 << 15, 10, 4
#: Each task writes to up to so many buckets; rows of more are dealt by bucket, to so many pieces of it.
_FEW_BUCKETS, _PIECES = 16, 256


def _filter_block(h: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(1)), blocks).cast("int")


def _filter_bits(h: Column) -> list[Column]:
    mixed = F.xxhash64(h, F.lit(2))
    return [F.shiftrightunsigned(mixed, 15 * j).bitwiseAND(_BLOCK - 1) for j in range(_SET)]


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1


class Store:
    """A folder of Parquet tables. Each change adds a generation: a folder ``tables-N`` with new rows, and ``_version-N``, the manifest that
    lists the folders of all tables.

    A version's file is created once and never overwritten, so readers see a generation as a whole or not at all. ``append`` writes new
    rows only; of tables that keep the last row of a key the row of the newest folder counts. ``save`` writes everything anew. Folders
    that neither of the last two versions lists are removed, so a reader that has just opened a store may finish.

    Writers hold a lease: a file with an owner, a time until which it holds (it is renewed while the writer is alive) and the
    generation it started from, which fences it: a writer that stopped for longer than its lease, while others took over,
    finds its lease gone, its generation's number taken or a newer one there, and gets a ``Conflict``, as does one whose ``base`` isn't the newest generation.
    A writer that crashed blocks others until its lease ends. Clocks that differ can shorten a lease, not break this.

    A batch of a stream is a transaction: the manifest has each stream's last batch, and a batch that is done isn't appended again.

    The manifest also has each folder's number of rows and range of keys, and beside the folder's tables there is a Bloom filter of their
    keys in blocks of 4 KB. ``lookup`` reads only the folders that may hold the keys that are asked for, and, where the store has
    ``buckets``, of these only the buckets. After ``MOST_PARTS`` folders of a table an append joins the newest with it: those
    that are not larger than what is joined, and half of them at least.

    Folders are reached through Spark's file system. It has to create a file only if there is none, in one step, as HDFS and
    local folders do; on object stores without that, one writer at a time.
    """

    MOST_PARTS = 32
    #: Seconds.
    LEASE = 600.0

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1):
        """buckets: of a new store; one that is there keeps its own."""
        self.spark, self.path, self._new_buckets, self._renewing = spark, path.rstrip("/"), buckets, threading.Lock()
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _put(self, name: str, text: str, over: bool) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), over)
        out.write(bytearray(text.encode()))
        out.close()

    def _create(self, name: str, text: str) -> None:
        """A new file; Conflict if it is there."""
        try:
            self._put(name, text, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or self._exists(name):
                raise Conflict(f"{self.path}/{name} was written by another writer") from None
            raise

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _names(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.path}/{pattern}"))
        return sorted(s.getPath().getName() for s in found or [])

    # ---- the lease

    def lease(self) -> dict | None:
        """Who writes: owner, token, expires and generation. A file without these (another program's, or half-written) holds for
        a lease from its last change on."""
        try:
            changed = self._fs.getFileStatus(self._path(f"{self.path}/_lock")).getModificationTime() / 1000
            text = self._get("_lock")
        except Exception as e:
            if self._exists("_lock"):
                raise
            del e
            return None
        with contextlib.suppress(json.JSONDecodeError):
            if isinstance(found := json.loads(text), dict) and {"token", "expires"} <= set(found):
                return found
        return {"owner": text, "token": f"{changed:.0f}", "expires": changed + self.LEASE, "generation": None}

    @property
    def locked(self) -> bool:
        """A writer's lease holds."""
        found = self.lease()
        return found is not None and found["expires"] > time.time()

    def lock(self, owner: str = "") -> str:
        """Takes the lease and gives its token; Conflict while another's holds. One that has ended is put aside."""
        token = uuid.uuid4().hex
        for _ in range(3):
            text = json.dumps({"owner": owner or VERSION, "token": token, "expires": time.time() + self.LEASE, "generation": self.generation})
            try:
                self._create("_lock", text)
                return token
            except Conflict:
                held = self.lease()
                if held and held["expires"] > time.time():
                    raise Conflict(self._in_change()) from None
                if held:  # of several that find it, one can rename it
                    self._fs.rename(self._path(f"{self.path}/_lock"), self._path(f"{self.path}/_ended-{held['token']}"))
        raise Conflict(self._in_change())

    def unlock(self, token: str | None = None) -> None:
        """Gives the lease back. Without a token: whoever holds it."""
        found = self.lease() if token else None
        if token is None or found and found["token"] == token:
            self._delete("_lock")

    def _renew(self, token: str) -> bool:
        with self._renewing:  # the writer and its heartbeat don't read what the other one is writing
            found = self.lease()
            if not found or found["token"] != token:
                return False
            self._put("_lock", json.dumps({**found, "expires": time.time() + self.LEASE}), True)
            return True

    @contextlib.contextmanager
    def _held(self) -> Iterator[str]:
        token, ended = self.lock(), threading.Event()

        def alive():
            while not ended.wait(self.LEASE / 3):
                with contextlib.suppress(Exception):  # what it couldn't renew is told at the commit
                    if not self._renew(token):
                        return

        beat = threading.Thread(target=alive, daemon=True)
        beat.start()
        try:
            yield token
        finally:
            ended.set()
            beat.join(10)
            self.unlock(token)

    def _in_change(self) -> str:
        return f"{self.path} is locked: a change of it goes on, or its writer ended and its lease still holds"

    # ---- versions

    def _versions(self) -> list[tuple[str, dict]]:
        """Names and contents of the versions whose file is complete, newest first."""
        out = []
        for name in reversed(self._names("_version-*")):
            with contextlib.suppress(json.JSONDecodeError):  # being written, or its writer ended
                out.append((name, json.loads(self._get(name))))
        return out

    def manifest(self) -> dict | None:
        """The newest version: its generation, version, buckets, done batches by stream, and each table's folders, oldest first, as
        path, rows, low, high and blocks (of the key filter); of folders without a filter the path only."""
        found = self._versions()
        if not found:
            return None
        name, out = found[0]
        tables = {n: [f if isinstance(f, dict) else {"path": f} for f in folders] for n, folders in out["tables"].items()}
        return {"buckets": 1, "done": {}, **out, "generation": int(name.rpartition("-")[2]), "tables": tables}

    def open(self, locked: bool = False) -> Catalog:
        """Needs the exact version and no writer; with ``locked`` the newest version also while one writes."""
        return StoredCatalog(self, self._opened(VERSION, locked))

    def open_old(self) -> tuple[str, dict[str, DataFrame]]:
        """The version and the tables as they are, of any version."""
        found = self._opened(None)
        return found["version"], {n: self.spark.read.parquet(*[f"{self.path}/{f['path']}" for f in folders]) for n, folders in found["tables"].items()}

    def _opened(self, version: str | None, locked: bool = False) -> dict:
        if not locked and self.locked:
            raise RuntimeError(self._in_change())
        found = self.manifest()
        if not found:
            raise FileNotFoundError(f"{self.path} holds no tables")
        if version and found["version"] != version:
            raise RuntimeError(f"{self.path} has version {found['version']}, not {version}; upgrade it")
        return found

    def _folder(self, name: str, part: dict, buckets: list[int] | None = None) -> DataFrame:
        """A folder's rows, or those of some of its buckets."""
        spec, path = SPECS[name], f"{self.path}/{part['path']}"
        reader = self.spark.read.schema(spec.schema)
        if buckets is None:
            return reader.parquet(path).select([f.name for f in spec.schema])
        return reader.option("basePath", path).parquet(*[f"{path}/_bucket={b}" for b in buckets]).select([f.name for f in spec.schema])

    def _joined(self, name: str, parts: list[DataFrame]) -> DataFrame:
        """Rows of folders, oldest first: all of them, or of each key that of the newest."""
        spec = SPECS[name]
        if not parts:
            return self.spark.createDataFrame([], spec.schema)
        if spec.keep == "first" or len(parts) == 1:
            return reduce(DataFrame.unionByName, parts)
        numbered = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
        rest = [f.name for f in spec.schema if f.name not in spec.key]
        newest = numbered.groupBy(*spec.key).agg(F.max_by(F.struct(*rest), "_part").alias("_row"))
        return newest.select(*[F.col(f"_row.{f.name}") if f.name in rest else F.col(f.name) for f in spec.schema])

    @property
    def generation(self) -> int:
        """The newest one's number, -1 without any."""
        found = self._names("_version-*")
        for name in reversed(found):
            with contextlib.suppress(json.JSONDecodeError):
                json.loads(self._get(name))
                return int(name.rpartition("-")[2])
        return -1

    def done(self, stream: str) -> int:
        """The last batch of a stream that is in the tables, -1 without any."""
        found = self.manifest()
        return found["done"].get(stream, -1) if found else -1

    def save(self, catalog: Catalog, base: int | None = None) -> None:
        """All tables anew. With ``base``, the generation that the catalog was made from, another one since is a Conflict."""
        self._write(lambda have: ({n: catalog[n] for n in SPECS}, {}), VERSION, base)

    def save_old(self, tables: dict[str, DataFrame], version: str) -> None:
        """Tables of another version, with their own columns."""
        self._write(lambda have: (tables, {}), version, None)

    def append(self, new: Catalog, base: int | None = None, batch: tuple[str, int] | None = None) -> bool:
        """New rows of the tables that ``new`` has, beside what is there. Rows of keys that are there are to be in tables that keep the
        last row only (``operators.storage.additions`` gives such rows). ``base`` as in ``save``. ``batch``: the stream and
        number of the batch that these rows are; False, and no change, if it is done."""

        def change(have):
            fresh, before = {}, dict(have)
            for name, df in new.tables.items():
                kept, joined = self._to_join(before.get(name, []))
                if joined:
                    df = self._joined(name, [*[self._folder(name, p) for p in joined], df.select([f.name for f in SPECS[name].schema])])
                fresh[name], before[name] = df, kept
            return fresh, before

        return self._write(change, VERSION, base, batch)

    def _to_join(self, parts: list[dict]) -> tuple[list[dict], list[dict]]:
        """(folders that stay, newest ones that are joined with what is appended)."""
        at, total = len(parts), 0
        if at >= self.MOST_PARTS:
            while at and (at > self.MOST_PARTS // 2 or parts[at - 1].get("rows", 0) <= 2 * total):
                at -= 1
                total += parts[at].get("rows", 0)
        return parts[:at], parts[at:]

    @staticmethod
    def _generation_of(found: dict | None) -> int:
        return found["generation"] if found else -1

    def _write(self, change: Callable[[dict], tuple[dict[str, DataFrame], dict[str, list[dict]]]], version: str, base: int | None, batch: tuple[str, int] | None = None) -> bool:
        with self._held() as token:
            found = self.manifest()
            if base is not None and base != self._generation_of(found):
                raise Conflict(f"{self.path} has changed since generation {base}")
            done = dict(found["done"]) if found else {}
            if batch:
                if done.get(batch[0], -1) >= batch[1]:
                    return False
                done[batch[0]] = batch[1]
            buckets = found["buckets"] if found else self._new_buckets
            number = max((int(n.rpartition("-")[2]) for n in self._names("_version-*")), default=-1) + 1
            folder = f"tables-{number:06d}-{uuid.uuid4().hex[:8]}"
            try:
                tables, before = change(found["tables"] if found else {})
                listed = {n: list(parts) for n, parts in before.items()}
                for name, df in tables.items():
                    self._write_table(df, name, f"{self.path}/{folder}/{name}", version, buckets)
                described = self._described(folder, list(tables), buckets) if version == VERSION else {n: {} for n in tables}
            except Exception as e:  # those who took over remove what isn't listed
                if not self._renew(token):
                    raise Conflict(f"{self.path}: the lease ended before the change did") from e
                raise
            for name, part in described.items():
                listed.setdefault(name, []).append({"path": f"{folder}/{name}", **part})
            if not self._renew(token):
                raise Conflict(f"{self.path}: the lease ended before the change did")
            self._create(f"_version-{number:06d}", json.dumps({"version": version, "buckets": buckets, "done": done, "tables": listed}))
            if self.generation != number:  # others went on from the same generation, and its number was free again
                self._delete(f"_version-{number:06d}")
                raise Conflict(f"{self.path} has changed while this was written")
            self._forget()
        return True

    def _write_table(self, df: DataFrame, name: str, path: str, version: str, buckets: int) -> None:
        if version != VERSION:
            df.write.option("compression", "zstd").parquet(path)
            return
        df = df.select([f.name for f in SPECS[name].schema])
        if buckets == 1:
            df.write.option("compression", "zstd").parquet(path)
        else:
            h = _key_hash(SPECS[name])
            dealt = df.withColumn("_bucket", F.pmod(h, F.lit(buckets)).cast("int"))
            if buckets > _FEW_BUCKETS:  # by pieces of a bucket, so that its size bounds no task's memory; Spark joins small ones
                dealt = dealt.repartition("_bucket", F.pmod(F.xxhash64(h, F.lit(5)), F.lit(_PIECES)))
            dealt.write.option("compression", "zstd").partitionBy("_bucket").parquet(path)

    def _described(self, folder: str, names: list[str], buckets: int) -> dict[str, dict]:
        """Rows and range of keys of the tables that have rows, and their key filters, written beside them."""
        rows = {n: self.spark.read.schema(SPECS[n].schema).parquet(f"{self.path}/{folder}/{n}") for n in names}
        first = {n: SPECS[n].key[0] for n in names}
        sums = [r.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.min(first[n]).cast("string").alias("low"), F.max(first[n]).cast("string").alias("high")) for n, r in rows.items()]
        if not sums:
            return {}
        out = {}
        for r in reduce(DataFrame.unionByName, sums).collect():
            if r["rows"]:
                plain = (lambda v: v) if dict(SPECS[r["name"]].columns)[first[r["name"]]] == "string" else lambda v: v if v is None else int(v)
                out[r["name"]] = {"rows": r["rows"], "low": plain(r["low"]), "high": plain(r["high"]), "blocks": max(1, -(-r["rows"] * _BITS_EACH // (_BLOCK * buckets)))}
        h, keys, names = F.col("_h"), [], list(out)
        for i, n in enumerate(names):
            key = rows[n].select(_key_hash(SPECS[n]).alias("_h"))
            keys.append(key.select(F.lit(i).alias("t"), F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), _filter_block(h, F.lit(out[n]["blocks"])).alias("block"), "_h"))
        if keys:
            # keys travel to their block as numbers: bitmaps of each task would be as many as tasks x blocks, the square of the input
            of = ["t", "bucket", "block"]
            each = reduce(DataFrame.unionByName, keys).repartition(*of).groupBy(*of).agg(F.array(*[F.bitmap_construct_agg(at) for at in _filter_bits(h)]).alias("each"))
            made = each.select(*of, F.explode("each").alias("bits")).groupBy(*of).agg(F.bitmap_or_agg("bits").alias("bits"))
            made = made.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("t") + 1).alias("name"), "bucket", "block", "bits")
            made.write.partitionBy("name").parquet(f"{self.path}/{folder}/_keys")
        return out

    def _forget(self) -> None:
        """Removes versions before the last two, folders that neither of these lists, and leases that ended."""
        kept = self._versions()[:2]
        for name in self._names("_version-*"):
            if name not in {n for n, _ in kept}:
                self._delete(name)
        path = lambda f: f["path"] if isinstance(f, dict) else f
        used = {path(f).split("/")[0] for _, found in kept for folders in found["tables"].values() for f in folders}
        for name in self._names("tables-*"):
            if name not in used:
                self._delete(name)
        for name in self._names("_ended-*"):
            self._delete(name)

    def staging(self, batch: tuple[str, int] | None = None) -> Store:
        """A store beside the tables, for rows that are to be merged; that of a batch is always the same one."""
        return Store(self.spark, f"{self.path}/staged-{f'{batch[0]}.{batch[1]:012d}' if batch else uuid.uuid4().hex[:8]}")

    def staged(self, pattern: str = "staged-*") -> list[tuple[Store, tuple[str, int] | None]]:
        """Stores left beside the tables by ingestion that was interrupted before its merge, by stream and batch; those without a version are
        incomplete."""
        out = []
        for n in self._names(pattern):
            stream, dot, number = n.removeprefix("staged-").rpartition(".")
            out.append((Store(self.spark, f"{self.path}/{n}"), (stream, int(number)) if dot and number.isdigit() else None))
        return out

    def remove(self) -> None:
        self._fs.delete(self._path(self.path), True)


class StoredCatalog(Catalog):
    """The tables of one version of a store."""

    def __init__(self, store: Store, found: dict):
        self.store, self.found = store, found
        super().__init__(store.spark, {n: store._joined(n, [store._folder(n, p) for p in parts]) for n, parts in found["tables"].items()})

    def n_rows(self, name: str) -> int | None:
        parts = self.found["tables"].get(name, [])
        return sum(p["rows"] for p in parts) if all("rows" in p for p in parts) else None

    def lookup(self, name: str, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
        """The rows of a table whose key may be among ``keys`` (its key's columns), from the folders and buckets whose range and
        filter say so; all rows whose key is among them are there. One job over the keys and the filters finds
        these; none of it runs where no folder has a filter, or ``n_keys``, how many keys there are, is known and no smaller than a quarter of the rows, as
        then all folders hold some. Tables that keep the last row give each key's newest one."""
        parts = self.found["tables"].get(name, [])
        if not any("blocks" in p for p in parts) or n_keys is not None and 4 * n_keys >= sum(p.get("rows", 0) for p in parts):
            return self[name]
        spec, buckets, store = SPECS[name], self.found["buckets"], self.store
        typed = dict(spec.columns)[spec.key[0]]
        ask = keys.select(_key_hash(spec).alias("h"), F.col(spec.key[0]).alias("k"))
        known = [(i, p) for i, p in enumerate(parts) if "blocks" in p]
        folders = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p["low"]).cast(typed).alias("low"), F.lit(p["high"]).cast(typed).alias("high"), F.lit(p["blocks"]).alias("blocks")) for i, p in known])
        ask = ask.select("h", F.explode(F.filter(folders, lambda f: F.coalesce(F.col("k").between(f["low"], f["high"]), F.lit(True)))).alias("f"))
        ask = ask.select("h", F.col("f.i").alias("i"), F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), _filter_block(F.col("h"), F.col("f.blocks")).alias("block"))
        filters = [self.spark.read.schema("bucket int, block int, bits binary").parquet(f"{store.path}/{p['path'].split('/')[0]}/_keys/name={name}").withColumn("i", F.lit(i)) for i, p in known]
        held = ask.join(reduce(DataFrame.unionByName, filters), ["i", "bucket", "block"])
        held = held.where(reduce(Column.__and__, [_is_set(F.col("bits"), at) for at in _filter_bits(F.col("h"))]))
        hit: dict[int, list[int]] = {}
        for r in held.select("i", "bucket").distinct().collect():  # folders x buckets at most
            hit.setdefault(r["i"], []).append(r["bucket"])
        chosen = [(p, None if "blocks" not in p or buckets == 1 else sorted(hit[i])) for i, p in enumerate(parts) if "blocks" not in p or i in hit]
        return store._joined(name, [store._folder(name, p, b) for p, b in chosen])
