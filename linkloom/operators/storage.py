"""Storage algebra: deduplication by natural key, late keys, merge, check and repair, counts, migrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..folders import written
from ..model import SPECS, VERSION, Catalog, TableSpec


def dedup(df: DataFrame, keys: list[str], keep: str = "first", order: str = "id") -> DataFrame:
    """One whole row for each key: the one with the smallest (first) or largest (last) order column.

    min_by over the row is summed in part before the shuffle, so a key with very many rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def dedup_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    return dedup(df, list(spec.key), spec.keep)


def resolve_late(child: DataFrame, column: str, parent: DataFrame, natural: str, key: str = "id") -> DataFrame:
    """Replaces natural keys in a column by ids where the parent has them; others stay as they are. The column is text."""
    first = parent.groupBy(F.col(natural).alias("_natural")).agg(F.min(key).alias("_id"))
    return child.join(first, F.col(column) == F.col("_natural"), "left").withColumn(column, F.coalesce(F.col("_id").cast("string"), F.col(column))).drop("_natural", "_id")


def orphans(tables: Catalog) -> DataFrame:
    """Rows that link to nothing: (table, id, column, value)."""
    found = None
    for name, spec in SPECS.items():
        for column, parent in spec.links.items():
            ids = tables[parent].select(F.col("id").alias("_parent"))
            lost = tables[name].where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_parent"), "left_anti")
            lost = lost.select(F.lit(name).alias("table"), F.col("id"), F.lit(column).alias("column"), F.col(column).alias("value"))
            found = lost if found is None else found.unionByName(lost)
    return found


def duplicates(tables: Catalog) -> DataFrame:
    """Natural keys, and ids, with several rows: (table, by, n_keys, n_rows)."""
    found = None
    for name, by, keys in [(n, "key", s.key) for n, s in SPECS.items()] + [(n, "id", ("id",)) for n in SPECS]:
        many = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        row = many.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("table"), F.lit(by).alias("by"), "n_keys", "n_rows")
        found = row if found is None else found.unionByName(row)
    return found


def repair(tables: Catalog) -> Catalog:
    """Drops duplicates (the table's rule says which stays, links to the others follow it) and then orphans."""
    out = tables
    for name, spec in SPECS.items():
        df = out[name]
        for column, parent in spec.links.items():
            winner = SPECS[parent].keep
            keys = list(SPECS[parent].key)
            best = dedup(tables[parent], keys, winner).select(F.col("id").alias("_best"), *[F.col(k).alias(f"_{k}") for k in keys])
            same = tables[parent].join(best, [F.col(k) == F.col(f"_{k}") for k in keys]).select(F.col("id").alias("_old"), "_best")
            df = df.join(same, F.col(column) == F.col("_old"), "left")
            df = df.where(F.col("_best").isNotNull() | F.col(column).isNull()).withColumn(column, F.col("_best")).drop("_old", "_best")
        out = out.with_tables(**{name: dedup_table(df.select(tables[name].columns), spec)})
    return out


def additions(main: Catalog, other: Catalog) -> Catalog:
    """The rows that a merge of ``other`` adds to ``main``, or replaces in tables that keep the last row of a key; links are
    rewritten to main's ids.

    Rows of other whose key main has take main's id; new ones get a hash of their key, so that a merge that is repeated
    gives the same ids and needs no global numbering; ``duplicates`` finds ids that clash. Of main only ids and keys are read, and
    of a store only the folders that may hold keys of other. Links are joined only with the ids that change, and only rows of new keys are summed.
    """
    out, moved = {}, {}
    for name, spec in SPECS.items():
        if name not in other.tables and not _linked_to(name):
            continue
        new = other[name]
        for column, parent in spec.links.items():
            if moved[parent] is None:
                continue
            new = new.join(moved[parent].select(F.col("_old").alias(f"_{column}"), F.col("_new").alias(f"_n_{column}")), F.col(column) == F.col(f"_{column}"), "left")
            new = new.withColumn(column, F.coalesce(f"_n_{column}", column)).drop(f"_{column}", f"_n_{column}")
        have = main.lookup(name, new.select(*spec.key), other.n_rows(name)).where(F.col("id").isNotNull()).select("id", *spec.key)
        if _broadcastable(asked := new.select(*spec.key)):  # else a large table would travel to few rows
            have = have.join(F.broadcast(asked), list(spec.key), "left_semi").select("id", *spec.key)
        # both sides have the same names, so that of a merge with the same rows one side travels
        new, have = new.alias("n"), have.alias("h")
        same, new_id = [F.col(f"n.{k}") == F.col(f"h.{k}") for k in spec.key], F.xxhash64(*spec.key)
        if _linked_to(name):  # several rows of other may share a key; all of their ids lead to the key's one
            told = new.join(have, same, "left").select("n.*", F.col("h.id").alias("_have")).withColumn("_new", F.coalesce("_have", new_id))
            changed = F.col("_have").isNull() | ~F.col("id").eqNullSafe(F.col("_new"))
            told = told.select(*[f.name for f in spec.schema], "_new", F.col("_have").isNotNull().alias("_had"))
            told = written(told.where(changed) if spec.keep == "first" else told, f"ids-{name}")
            moves = written(told.where("id <> _new").select(F.col("id").alias("_old"), "_new"), f"moved-{name}")
            moved[name] = None if moves.isEmpty() else moves
            added = dedup(told if spec.keep == "last" else told.where("NOT _had"), list(spec.key), spec.keep)
        elif spec.keep == "last":
            added = dedup_table(new.select(other[name].columns), spec).alias("n").join(have, same, "left").select("n.*", F.col("h.id").alias("_have")).withColumn("_new", F.coalesce("_have", new_id))
        else:
            added = dedup_table(new.join(have, same, "left_anti").select(other[name].columns), spec).withColumn("_new", new_id)
        out[name] = added.withColumn("id", F.col("_new")).select([f.name for f in spec.schema])
    return Catalog(main.spark, out)


def merge(main: Catalog, other: Catalog) -> Catalog:
    """The union of both on natural keys, in the order of dependence. For tables that keep the first row main's wins, for
    those that keep the last other's does."""
    out, added = main, additions(main, other)
    for name, new in added.tables.items():
        columns, kept = new.columns, main[name]
        if SPECS[name].keep == "last":
            kept = kept.join(new.select("id"), "id", "left_anti")
        out = out.with_tables(**{name: kept.select(columns).unionByName(new)})
    return out


def _broadcastable(df: DataFrame) -> bool:
    """Whether Spark would broadcast a table by its own estimate."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def _linked_to(name: str) -> bool:
    return any(name in s.links.values() for s in SPECS.values())


def merge_all(catalogs: list[Catalog]) -> Catalog:
    out = catalogs[0]
    for c in catalogs[1:]:
        out = merge(out, c)
    return out


def table_counts(tables: Catalog) -> DataFrame:
    """(table, n_rows, max_id) of all tables."""
    found = None
    for name in SPECS:
        row = tables[name].agg(F.count("id").alias("n_rows"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id")).select(F.lit(name).alias("table"), "n_rows", "max_id")
        found = row if found is None else found.unionByName(row)
    return found


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("table", F.col("n_rows").alias("n_before"))
    return after.join(old, "table", "left").select("table", "n_rows", (F.col("n_rows") - F.coalesce("n_before", F.lit(0))).alias("n_new"))


Migration = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def _split_markup(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """item had summary and content texts: content, where there is one, replaces summary."""
    marked = t["item"].select("url", F.coalesce("content", "summary").alias("markup")).where(F.col("markup").isNotNull())
    summary = marked.select(F.xxhash64("url").alias("id"), F.col("url").alias("url_id"), "markup")
    return {**t, "item": t["item"].drop("content", "summary"), "summary": dedup(summary, ["url_id"], "last")}


def _tag_urls(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tagging pointed to items; feed had no state; items of one URL are one."""
    of_item = t["item"].select(F.col("id").alias("item_id"), F.col("url").alias("url_id"))
    tagging = t["tagging"].join(of_item, "item_id").select("id", "url_id", "keyword_id")
    feed = t["feed"].withColumn("dead", F.lit(None).cast("boolean")) if "dead" not in t["feed"].columns else t["feed"]
    return {**t, "tagging": dedup(tagging, ["url_id", "keyword_id"]), "item": dedup(t["item"], ["url"]), "feed": feed}


def _same_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only what a database does on deleting a row changed, and tables of files have no such rules."""
    return dict(t)


def _own_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of this library: columns and types by ``SPECS``, missing ones null; numbered ids stay, new rows get hashes."""
    out = {}
    for name, spec in SPECS.items():
        if name in t:
            out[name] = t[name].select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in t[name].columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema])
    return out


MIGRATIONS: dict[tuple[str, str], Migration] = {
    ("0.10", "0.10.3"): _split_markup,
    ("0.10.3", "0.10.5"): _tag_urls,
    ("0.10.3", "0.10.6"): _tag_urls,
    ("0.10.5", "0.10.6"): _same_tables,
    ("0.10.6", "1"): _own_tables,
}


def migration_path(start: str, end: str, steps: dict[tuple[str, str], Migration] = MIGRATIONS) -> list[tuple[str, str]]:
    """The steps from one version to another, fewest first; ValueError if there are none."""
    queue, seen = [(start, [])], {start}
    while queue:
        at, path = queue.pop(0)
        if at == end:
            return path
        for a, b in steps:
            if a == at and b not in seen:
                seen.add(b)
                queue.append((b, [*path, (a, b)]))
    raise ValueError(f"no way from version {start} to {end}")


def upgrade(store) -> list[tuple[str, str]]:
    """Brings a store of an older version to this one; the steps that were taken."""
    base = store.generation
    version, tables = store.open_old()
    steps = migration_path(version, VERSION)
    if steps:
        store.save(Catalog(store.spark, migrate(tables, version, VERSION)), base)
    return steps


def migrate(tables: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
    for step in migration_path(start, end):
        tables = MIGRATIONS[step](tables)
    return tables

