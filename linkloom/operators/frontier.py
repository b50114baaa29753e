"""The site frontier: mentions, threshold, bounded expansion, state selection, probing, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..folders import shared_folder, written
from ..functions.text import is_feed_type, keyword_score
from ..functions.urls import host_under, site
from .ordered import running_sum

# Priority by selection mode and feed state (unknown, dead, alive); 0 drops.
STATE_PRIORITY = {
    "all": (1, 1, 1),
    "dead": (0, 1, 0),
    "alive": (0, 0, 1),
    "dead+": (-128, 1, 0),
    "alive+": (-128, 0, 1),
}
# Answers of a feed that is there.
LIVE_STATUS = (200, 206, 405)


def site_mentions(links: DataFrame, item: str = "source", url: str = "target") -> DataFrame:
    """(site, n): distinct pairs of item and link URL for each site (scheme://host)."""
    return links.select(item, url).distinct().groupBy(site(F.col(url)).alias("site")).agg(F.count(F.lit(1)).alias("n"))


def over_threshold(mentions: DataFrame, scheduled: DataFrame, threshold: int) -> DataFrame:
    """Sites mentioned more than threshold times that aren't scheduled."""
    return mentions.where(F.col("n") > threshold).join(scheduled.select("site"), "site", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, threshold: int, depth_limit: int, most_levels: int = 0, state: str | None = None) -> DataFrame:
    """(site, depth) of all sites that are reached: the seeds are at depth 1; a site is scheduled when the items of all
    sites scheduled so far mention it more than ``threshold`` times, at one more than the depth of the newest level.

    edges: (site, target, n): n mentions of target by the items of site. Each level is one aggregation over the edges
    of the reached sites, checkpointed. depth_limit 0: no limit. With
    ``most_levels`` it is an error if sites are left beyond so many levels. With ``state``, a folder, the levels are
    kept there, and a run that was interrupted goes on after the last whole one (remove the folder to begin anew); of other edges,
    seeds or another threshold they are a ValueError.
    """
    edges = written(edges.select("site", "target", "n"), "edges")  # read once for each level
    reached = seeds.select("site").distinct().withColumn("depth", F.lit(1))
    if state:
        _same_run(edges, reached, f"threshold {threshold}", state)
    level = 1
    while not (depth_limit and level >= depth_limit):
        known = edges.join(reached.select("site"), "site").groupBy("target").agg(F.sum("n").alias("n")).where(F.col("n") > threshold)
        new = known.select(F.col("target").alias("site")).join(reached.select("site"), "site", "left_anti").withColumn("depth", F.lit(level + 1))
        new = _kept(new, f"{state}/level-{level + 1:05d}") if state else _checkpointed(new)
        if new.isEmpty():
            break
        if most_levels and level >= most_levels:
            raise RuntimeError(f"sites are left after {most_levels} levels")
        reached, level = _checkpointed(reached.unionByName(new)), level + 1
    return reached


def _same_run(edges: DataFrame, seeds: DataFrame, what: str, state: str) -> None:
    """Writes what the levels in a folder are of, or compares it with what is there."""
    many = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0))).first()
    found = f"{what} edges {tuple(map(str, many(edges)))} seeds {tuple(map(str, many(seeds)))}"
    kept = _kept(edges.sparkSession.createDataFrame([(found,)], "run string"), f"{state}/run").first()["run"]
    if kept != found:
        raise ValueError(f"{state} holds levels of another run: {kept}, not {found}")


def _kept(df: DataFrame, path: str) -> DataFrame:
    """What is at the path if it was written to its end; else df, written there."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def next_depth(depth: Column, flagged: Column, probing: Column | None = None) -> Column:
    """Depth grows for flagged requests only; a flagged probe doesn't count as a level of its own."""
    start = depth if probing is None else F.when(flagged & probing, depth - 1).otherwise(depth)
    return F.when(flagged, start + 1).otherwise(start)


def state_priority(dead: Column, mode: str) -> Column:
    """Priority of a feed by its state: unknown (null), dead, alive; rows with 0 are dropped by ``select_feeds``."""
    unknown, is_dead, alive = STATE_PRIORITY[mode]
    return F.when(dead.isNull(), unknown).when(dead, is_dead).otherwise(alive)


def select_feeds(feeds: DataFrame, mode: str) -> DataFrame:
    return feeds.withColumn("priority", state_priority(F.col("dead"), mode)).where(F.col("priority") != 0)


def dead_state(status: Column, content_type: Column, failed: Column | None = None, failure_is_dead: bool = True) -> Column:
    """True for a status other than 200, 206, 405 or content that isn't a feed; a failed transport is dead, or unknown."""
    out = F.when(status.isNull(), None).otherwise(~status.isin(*LIVE_STATUS) | ~is_feed_type(content_type))
    return out if failed is None else F.when(failed, F.lit(True) if failure_is_dead else None).otherwise(out)


def probe(candidates: DataFrame, available: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that are known to answer with items, the first one of each site."""
    live = candidates.join(available.where(F.col("n_items") > 0).select(key), key, "left_semi")
    return live.groupBy("site").agg(F.min_by(key, F.col("place")).alias(key))


def offsite(feeds: DataFrame, follow: Sequence[str], url: str = "url") -> DataFrame:
    """Only feeds at or under one of the domains; no domains: all."""
    return feeds.where(host_under(F.col(url), list(follow))) if follow else feeds


def prioritised(mentions: DataFrame, start: DataFrame, weights: Mapping[float, list[str]]) -> DataFrame:
    """(target, priority): for each target of a level the largest, over the items that mention it, of the source's
    priority plus the scores of its keywords; a score of minus infinity drops the target.

    mentions: (source, target, phrases); start: (source, priority). Sources without a priority have 0. The level is
    taken as a whole, so the result doesn't depend on the order of items.
    """
    scored = mentions.join(start, "source", "left").withColumn("score", keyword_score(dict(weights), F.col("target"), F.coalesce("phrases", F.lit(""))))
    best = scored.groupBy("target").agg(F.max(F.coalesce("priority", F.lit(0.0)) + F.col("score")).alias("priority"), F.min("score").alias("least"))
    return best.where(F.col("least") != float("-inf")).select("target", "priority")


def carried_priorities(mentions: DataFrame, seeds: DataFrame, weights: Mapping[float, list[str]], levels: int) -> DataFrame:
    """(target, priority, level): the priorities of ``levels`` levels, each of which starts with those of the level before.

    seeds: (source, priority). A target is of the level that reaches it first, and keeps its priority; one that is dropped leads
    nowhere and isn't reached again. mentions is scored once, whatever the number of levels.
    """
    scored = mentions.select("source", "target", keyword_score(dict(weights), F.col("target"), F.coalesce("phrases", F.lit(""))).alias("score"))
    pairs = _checkpointed(scored.groupBy("source", "target").agg(F.max("score").alias("score"), F.min("score").alias("least")))
    dropped = pairs.where(F.col("least") == float("-inf")).select("target").distinct()
    pairs = pairs.join(dropped, "target", "left_anti").select("source", "target", "score")
    reached = seeds.groupBy(F.col("source").alias("target")).agg(F.max("priority").alias("priority")).withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        front = reached.where(F.col("level") == level - 1).select(F.col("target").alias("source"), "priority")
        found = pairs.join(front, "source").groupBy("target").agg(F.max(F.col("priority") + F.col("score")).alias("priority"))
        new = _checkpointed(found.join(reached.select("target"), "target", "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        reached = _checkpointed(reached.unionByName(new))
    return reached.where(F.col("level") > 0)


def accumulated_priorities(mentions: DataFrame, order: Sequence[str], weights: Mapping[float, list[str]], columns: Sequence[str] | None = None) -> DataFrame:
    """mentions, or only the ``columns`` of them, with ``priority``: what the target's is after each mention, in their order.

    mentions: source, target, phrases and the columns of ``order``, which tells them apart. A target starts with the priority that
    its first source has at that time, a source that no mention before led to with 0; each mention adds its score, and
    minus infinity, once added, stays: such mentions are to be dropped.

    A fold over all mentions, in parts: running sums by target (``running_sum``) give what each node has gained at any
    time. What it started with is a path in the tree of first mentions, summed in as many rounds as the logarithm of its depth.
    With a mention travel its score, its target and order, and such ``columns`` as are neither; name only those that are read.
    """
    order, columns = list(order), list(columns or mentions.columns)
    rest = [c for c in columns if c not in ("target", *order)]
    at = F.struct(*order)
    scored = mentions.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    scored = scored.withColumn("_score", keyword_score(dict(weights), F.col("target"), F.coalesce("phrases", F.lit(""))))
    scored = written(scored.select(*dict.fromkeys(["source", "target", *order, *rest, "_score"])), "scored")
    as_target = scored.groupBy(F.col("target").alias("_node")).agg(F.min(at).alias("_first"), F.min_by("source", at).alias("_up"))
    as_source = scored.groupBy(F.col("source").alias("_node")).agg(F.min(at).alias("_led"))
    born = as_target.join(as_source, "_node", "left").where(F.col("_led").isNull() | (F.col("_led") > F.col("_first")))
    # a node's first mention asks what its source has gained before
    asks = born.select(F.col("_up").alias("_key"), *[F.col(f"_first.{c}").alias(c) for c in order], F.lit(0).alias("_kind"), F.col("_node"), F.lit(0.0).alias("_score"))
    gains = scored.select(F.col("target").alias("_key"), *order, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_node"), "_score", *[F.col(c).alias(f"_row_{c}") for c in rest])
    gained = written(running_sum(asks.unionByName(gains, allowMissingColumns=True), "_key", [*order, "_kind", "_node"], "_score", "_gained"), "gained")
    start = written(gained.where("_kind = 0").select("_node", F.col("_key").alias("_up"), F.col("_gained").alias("_start")), "start")
    while not start.where(F.col("_up").isNotNull()).isEmpty():
        above = start.select(F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_start").alias("_more"))
        start = written(start.join(above, "_up", "left").select("_node", F.col("_next").alias("_up"), (F.col("_start") + F.coalesce("_more", F.lit(0.0))).alias("_start")), "start")
    out = gained.where("_kind = 1").join(start.select(F.col("_node").alias("_key"), "_start"), "_key", "left")
    kept = [F.col({"target": "_key"}.get(c, f"_row_{c}" if c in rest else c)).alias(c) for c in columns]
    return out.select(*kept, (F.coalesce("_start", F.lit(0.0)) + F.col("_gained")).alias("priority"))
