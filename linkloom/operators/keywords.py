"""Keywords of items by category: MAP<category, ARRAY<keyword>> columns and their set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def build(rows: DataFrame, item: str = "item", category: str = "category", keyword: str = "keyword") -> DataFrame:
    """(item, keywords): long rows to a map of sorted sets."""
    sets = rows.groupBy(item, category).agg(F.sort_array(F.collect_set(keyword)).alias("k"))
    return sets.groupBy(item).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "k")))).alias("keywords"))


def query(store: DataFrame, **wanted: str | None) -> DataFrame:
    """Items that have all of it: ``_category=...`` the category, ``category='kw'`` the keyword in it."""
    out = store
    for name, value in wanted.items():
        if name.startswith("_"):
            out = out.where(F.map_contains_key("keywords", name[1:]))
        else:
            out = out.where(F.coalesce(F.array_contains(F.element_at("keywords", F.lit(name)), value), F.lit(False)))
    return out


def _combined(a: Column, b: Column, how) -> Column:
    empty = F.array().cast("array<string>")
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    sets = F.transform(names, lambda c: F.struct(c.alias("key"), F.array_sort(how(F.coalesce(F.try_element_at(a, c), empty), F.coalesce(F.try_element_at(b, c), empty))).alias("value")))
    return F.map_from_entries(F.filter(sets, lambda s: F.size(s["value"]) > 0))


def algebra(a: DataFrame, b: DataFrame, how: str, item: str = "item") -> DataFrame:
    """intersection (items of both), union (of either) or difference (of a, also if nothing is left) by category."""
    function, join = {"intersection": (F.array_intersect, "inner"), "union": (F.array_union, "full"), "difference": (F.array_except, "left")}[how]
    none = F.create_map().cast("map<string,array<string>>")
    joined = a.select(item, F.col("keywords").alias("_a")).join(b.select(item, F.col("keywords").alias("_b")), item, join)
    return joined.select(item, _combined(F.coalesce("_a", none), F.coalesce("_b", none), function).alias("keywords"))
