"""Which sites to visit next: the frontier of a store's links under the settings of a preset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import host_under, is_absolute_http, site, url_part
from ..model import Catalog
from ..operators.frontier import expand, state_priority
from ..presets import Preset, feed_candidates


def site_edges(tables: Catalog, follow: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(site, target, n): different pairs of URLs by which the items of a site mention another site; ``follow``: only sites at or under
    these domains (none: all), ``ignore``: none at these domains."""
    links = tables.with_urls("hyperlink", "source_id", "target_id").select(F.col("source_id_url").alias("source"), F.col("target_id_url").alias("target"))
    links = links.where(is_absolute_http(F.col("target")))
    if follow:
        links = links.where(host_under(F.col("target"), list(follow)))
    if ignore:
        links = links.where(~url_part(F.col("target"), "netloc").isin(*ignore))
    return links.distinct().groupBy(site(F.col("source")).alias("site"), site(F.col("target")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


def planned_sites(tables: Catalog, seeds: DataFrame, preset: Preset, threshold: int = 0, state: str | None = None) -> DataFrame:
    """(site, depth, dead, priority, candidates) of the sites that are reached from the seeds' (site), no deeper than the preset's depth.

    dead: true if all feeds of the site whose state is known are dead, false if one is alive, null if nothing is known. priority: by that and
    the preset's mode; sites with 0 are left out, but for the seeds. candidates: where a preset expects the site's feeds, null if none knows the site.
    ``state``: a folder for what is done, from which an interrupted run goes on.
    """
    reached = expand(site_edges(tables, preset.follow, preset.ignore), seeds, threshold, preset.depth, state=state)
    feeds = tables.with_urls("feed", "url_id").groupBy(site(F.col("url_id_url")).alias("site")).agg(F.bool_and("dead").alias("dead"))
    known = reached.join(feeds, "site", "left")
    known = known.withColumn("priority", state_priority(F.col("dead"), preset.feed_state)).where((F.col("priority") != 0) | (F.col("depth") == 1))
    return known.select("site", "depth", "dead", "priority", feed_candidates(F.concat("site", F.lit("/")), preset.feeds).alias("candidates"))
