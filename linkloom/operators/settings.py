"""Settings in layers, merged deeply as rows: mappings recurse, sets unite, lists append, all else is overridden.

A layer of a scope (a feed's, a run's) is told by rows (scope columns, layer, path, kind, pos, value): ``path`` is the array of
names down to a setting, ``kind`` is value, list, set or map. A list or set has a row for each element, numbered by ``pos``; a row with
kind list, set or map and null ``pos`` tells the container itself, so that empty ones count. Later layers have larger numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LAYER = "layer long, path array<string>, kind string, pos int, value string"


def flat(config: dict, layer: int, path: tuple[str, ...] = ()) -> list[tuple]:
    """The rows of one layer, without scope columns; values are told as text."""
    rows = []
    for name, v in config.items():
        at = [*path, name]
        if isinstance(v, dict):
            rows += [(layer, at, "map", None, None), *flat(v, layer, tuple(at))]
        elif isinstance(v, (list, set)):
            kind, elements = ("list", v) if isinstance(v, list) else ("set", sorted(v, key=str))
            rows += [(layer, at, kind, None, None), *[(layer, at, kind, i, str(e)) for i, e in enumerate(elements)]]
        else:
            rows.append((layer, at, "value", None, None if v is None else str(v)))
    return rows


def nested(rows: list[tuple]) -> dict:
    """The settings of one scope from its composed rows."""
    out: dict = {}
    for layer, path, kind, pos, value in sorted(rows, key=lambda r: (len(r[1]), r[0], -1 if r[3] is None else r[3])):
        at = out
        for name in path[:-1]:
            at = at.setdefault(name, {})
        if kind == "value":
            at[path[-1]] = value
            continue
        held = at.setdefault(path[-1], {"map": dict, "list": list, "set": set}[kind]())
        if pos is not None:
            held.append(value) if kind == "list" else held.add(value)
    return out


def compose_layers(rows: DataFrame, scope: list[str]) -> DataFrame:
    """What stays of all layers of each scope, in the same columns: of a value the last row, of a list all rows in the order of
    (layer, pos), of a set a row for each element with its last layer.

    Each row claims that its path has its kind and that the paths above are mappings. Where a path has had several kinds, rows
    up to the last layer with another kind than the final one are overridden, with all that lies below. Only the last layer of each
    (path, kind) is shuffled for that, so a scope with most of the rows is summed before, and no list or set is collected. If one
    layer claims two kinds for a path, neither counts. Layers aren't null; rows with an empty path or a null one are dropped.
    """
    rows = rows.where(F.size("path") > 0).select(*scope, "layer", "path", "kind", "pos", "value")
    steps = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.slice("path", F.lit(1), i).alias("at"), F.when(i < F.size("path"), "map").otherwise(F.col("kind")).alias("as")))
    claims = rows.select(*scope, "layer", "path", F.explode(steps).alias("step")).select(*scope, "layer", "path", "step.at", "step.as")
    last = claims.groupBy(*scope, "at", "as").agg(F.max("layer").alias("last"))
    kinds = F.reverse(F.array_sort(F.collect_list(F.col("last"))))  # one for each kind
    cuts = last.groupBy(*scope, "at").agg(kinds.alias("kinds")).where(F.size("kinds") > 1).select(*[F.col(s).alias(f"cut_{s}") for s in scope], F.col("at").alias("cut_at"), F.col("kinds")[1].alias("cut"))
    same = [F.col(s).eqNullSafe(F.col(f"cut_{s}")) for s in scope]
    gone = claims.join(cuts, [*same, F.col("at") == F.col("cut_at"), F.col("layer") <= F.col("cut")]).select(*[F.col(s).alias(f"gone_{s}") for s in scope], F.col("layer").alias("gone_layer"), F.col("path").alias("gone_path")).distinct()
    kept = rows.join(gone, [*[F.col(s).eqNullSafe(F.col(f"gone_{s}")) for s in scope], F.col("layer") == F.col("gone_layer"), F.col("path") == F.col("gone_path")], "left_anti")
    element = F.col("pos").isNotNull() & F.col("kind").isin("list", "set")
    single = kept.where(~(element & (F.col("kind") == "list"))).withColumn("element", F.when(element, F.struct("value")))
    single = single.groupBy(*scope, "path", "kind", "element").agg(F.max(F.struct("layer", "pos", "value")).alias("top"))
    return single.select(*scope, "top.layer", "path", "kind", "top.pos", "top.value").unionByName(kept.where(element & (F.col("kind") == "list")))
