"""The wide row: each hyperlink with its source, target, item and feed, as 26 attributes.

Only inner equi joins and native expressions, so Catalyst drops unused attributes and their joins' columns and
moves filters on one side's attributes below the joins, down to the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import date_part
from ..functions.urls import url_part
from ..model import Catalog

URL_PARTS = ("scheme", "netloc", "path", "query", "url")
DATE_PARTS = ("year", "month", "day", "hour", "minute", "second", "date")
ATTRIBUTES = tuple(
    [f"{t}:{p}" for t in ("feed", "source", "target") for p in URL_PARTS] + [f"published:{p}" for p in DATE_PARTS] + ["tag", "source:title", "feed:title", "feed:isdead"]
)
TYPES = {a: "string" for a in ATTRIBUTES} | {f"published:{p}": "int" for p in DATE_PARTS[:-1]} | {"feed:isdead": "boolean"}


def attribute(name: str) -> Column:
    return F.col(f"`{name}`")


def columns() -> dict[str, Column]:
    return {a: attribute(a) for a in ATTRIBUTES}


def _parts(url: str, role: str) -> list[Column]:
    return [(F.col(url) if p == "url" else url_part(F.col(url), p)).alias(f"{role}:{p}") for p in URL_PARTS]


def wide(tables: Catalog) -> DataFrame:
    """All attributes of all hyperlinks whose source is an item of a known feed; the ids are _source, _target, _feed.

    The URLs come with the tables' rows where the tables have them, else by joins with url.
    """
    items = tables.with_urls("item", "url", "source")
    own = ["_own"] if "_own" in items.columns else []
    items = items.select(
        "url", *own, F.col("source").alias("_feed"), F.col("title").alias("source:title"), F.col("published").alias("_published"), F.col("url_url").alias("_source_url"), F.col("source_url").alias("_feed_url")
    )
    feeds = tables["feed"].select(F.col("url_id").alias("_feed_info"), F.col("title").alias("feed:title"), F.col("dead").alias("feed:isdead"))
    # feeds join the items, of which there are fewer than links
    rows = tables.links_of(items.join(feeds, F.col("_feed") == F.col("_feed_info")))
    dates = [date_part(F.col("_published"), p).alias(f"published:{p}") for p in DATE_PARTS]
    rows = rows.select(
        F.col("url").alias("_source"), F.col("target_id").alias("_target"), "_feed", *_parts("_feed_url", "feed"), *_parts("_source_url", "source"), *_parts("target_id_url", "target"), *dates, F.col("element").alias("tag"), "`source:title`", "`feed:title`", "`feed:isdead`"
    )
    return rows.select("_source", "_target", "_feed", *columns().values())
