"""Feed pages as JSON: reading, normalised entries, and the rows of the eight tables that they give."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from ..folders import written
from ..functions.html import links
from ..functions.text import epoch_time, iso_time, lower_set
from ..functions.urls import feed_uri, is_absolute_http, url_part
from ..model import Catalog

#: ``alternate`` may be the text 'none', so it is read as text first.
PAGE = (
    "id string, title string, continuation string, items array<struct<originId string, title string, author string, published double, updated double, "
    "keywords array<string>, alternate string, origin struct<streamId string, title string, htmlUrl string>, content struct<content string>, summary struct<content string>>>"
)
_ALTERNATE = "array<struct<href string, type string>>"


def read_pages(spark: SparkSession, path: str, delimiter: str = "\0", on_error: str = "continue") -> DataFrame:
    """Lines of JSON pages with delimiter lines between; on_error: continue (drop the line), raise, or stop (drop the
    line and what follows it in its file).

    A file may be read in several parts, by several tasks: a line's place is where its part begins in the file, and its number
    there. The first bad line of each file that has one is found in a first pass over the files, and a second one
    leaves out what comes after it.
    """
    lines = spark.read.text(path)
    if on_error != "stop":
        return parse_pages(lines.where((F.col("value") != delimiter) & (F.trim("value") != "")), on_error)
    at = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    placed = lines.select(F.col("_metadata.file_path").alias("_file"), at.alias("_at"), "value").where((F.col("value") != delimiter) & (F.trim("value") != ""))
    placed = placed.select("_file", "_at", F.from_json("value", PAGE, {"mode": "PERMISSIVE"}).alias("page"))
    stops = placed.where(_is_bad(F.col("page"))).groupBy("_file").agg(F.min("_at").alias("_stop"))
    return placed.join(written(stops, "stops"), "_file", "left").where(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop"))).select("page.*")


def _is_bad(page: Column) -> Column:
    """What bad JSON, or JSON that is no page, gives: nothing in any field."""
    return page.isNull() | (page["id"].isNull() & page["title"].isNull() & page["continuation"].isNull() & page["items"].isNull())


def parse_pages(lines: DataFrame, on_error: str = "continue", value: str = "value") -> DataFrame:
    """One row for each page; bad JSON gives no row, or with on_error='raise' an error."""
    mode = {"continue": "PERMISSIVE", "raise": "FAILFAST"}[on_error]
    parsed = lines.select(F.from_json(value, PAGE, {"mode": mode}).alias("page"))
    return parsed.where(~_is_bad(F.col("page"))).select("page.*")


def entries(pages: DataFrame, feed_url: Column | None = None) -> DataFrame:
    """Normalised entries: url, source, feed_title, title, author, published, updated, keywords, markup, valid.

    url: originId if it has a host, else the first alternate's href, else ''. source: the feed of the origin, else the
    page's own feed. Entries without a time of publication or a URL aren't valid.
    """
    e = pages.select(F.col("id").alias("_page"), F.col("title").alias("_page_title"), F.explode("items").alias("i"))
    origin = F.col("i.originId")
    first = F.get(F.from_json("i.alternate", _ALTERNATE), F.lit(0)).getField("href")
    own = feed_url if feed_url is not None else feed_uri(F.col("_page"))
    markup = F.when(F.col("i.content").isNotNull(), F.col("i.content.content")).otherwise(F.col("i.summary.content"))
    out = e.select(
        F.when(F.coalesce(url_part(origin, "netloc"), F.lit("")) != "", origin).otherwise(F.coalesce(first, F.lit(""))).alias("url"),
        F.coalesce(feed_uri(F.col("i.origin.streamId")), own, F.lit("")).alias("source"),
        F.coalesce("i.title", F.lit("")).alias("title"),
        F.col("i.author").alias("author"),
        iso_time(epoch_time(F.col("i.published"))).alias("published"),
        iso_time(epoch_time(F.col("i.updated"))).alias("updated"),
        lower_set(F.coalesce("i.keywords", F.array().cast("array<string>"))).alias("keywords"),
        markup.alias("markup"),
    )
    return out.withColumn("valid", (F.col("url") != "") & F.col("published").isNotNull())


def with_links(items: DataFrame, markup: str = "markup", resolve: bool = False) -> DataFrame:
    """entries with ``links``: array<struct<url, tag>>; of several tags of one URL the smallest counts."""
    found = links(F.col(markup), F.col("url")) if resolve else links(F.col(markup))
    return items.withColumn("links", found)


def enriched(items: DataFrame, pages: DataFrame, resolve: bool = False) -> DataFrame:
    """entries with the links of their own web pages added, and ``webpage``: the page's markup.

    pages: (url, html, status). Answers of 400 and above, and items without a page, add nothing.
    """
    good = pages.where(F.coalesce("status", F.lit(200)) < 400).groupBy("url").agg(F.max("html").alias("webpage"))
    base = items if "links" in items.columns else with_links(items, resolve=resolve)
    joined = with_links(base.withColumnRenamed("links", "_links").join(good, "url", "left"), "webpage", resolve)
    return joined.withColumn("links", F.array_distinct(F.concat("_links", "links"))).drop("_links")


def link_rows(items: DataFrame) -> DataFrame:
    """(source, target, element), one for each item and URL."""
    rows = items.select(F.col("url").alias("source"), F.explode("links").alias("l")).where(is_absolute_http(F.col("l.url")))
    return rows.groupBy("source", F.col("l.url").alias("target")).agg(F.min("l.tag").alias("element"))


def url_id(c: Column) -> Column:
    """Ids come from a hash of the natural key, so that no global order is needed; ``Catalog`` checks find clashes."""
    return F.xxhash64(c)


def tables_of(items: DataFrame, markup_table: str = "summary") -> Catalog:
    """The rows that entries with links give to the tables, deduplicated."""
    spark = items.sparkSession
    items = items.where("valid")
    targets = link_rows(items)
    words = items.select("url", F.explode("keywords").alias("keyword")).distinct()
    urls = items.select(F.explode(F.array("url", "source")).alias("url")).unionByName(targets.select(F.col("target").alias("url"))).where(F.col("url") != "").distinct()
    key = lambda *c: F.xxhash64(*[F.col(x) for x in c])
    item = items.groupBy("url").agg(F.min(F.struct("published", "source", "title", "author", "updated")).alias("r"))
    return Catalog(
        spark,
        {
            "url": urls.select(url_id(F.col("url")).alias("id"), "url"),
            "keyword": words.select("keyword").distinct().select(key("keyword").alias("id"), "keyword"),
            "item": item.select(
                key("url").alias("id"), url_id(F.col("url")).alias("url"), url_id(F.col("r.source")).alias("source"), "r.title", "r.author", "r.published", "r.updated", F.lit(None).cast("double").alias("crawled")
            ),
            "hyperlink": targets.select(key("source", "target", "element").alias("id"), url_id(F.col("source")).alias("source_id"), url_id(F.col("target")).alias("target_id"), "element"),
            "feed": items.where(F.col("source") != "").select("source").distinct().select(key("source").alias("id"), url_id(F.col("source")).alias("url_id"), F.lit("").alias("title"), F.lit(None).cast("boolean").alias("dead")),
            "tagging": words.select(key("url", "keyword").alias("id"), url_id(F.col("url")).alias("url_id"), key("keyword").alias("keyword_id")),
            **_webpages(items),
            markup_table: items.where(F.col("markup").isNotNull()).groupBy("url").agg(F.max_by("markup", F.struct("published", "markup")).alias("markup")).select(key("url").alias("id"), url_id(F.col("url")).alias("url_id"), "markup"),
        },
    )


def _webpages(items: DataFrame) -> dict[str, DataFrame]:
    if "webpage" not in items.columns:
        return {}
    rows = items.where(F.col("webpage").isNotNull()).groupBy("url").agg(F.max("webpage").alias("markup"))
    return {"webpage": rows.select(F.xxhash64("url").alias("id"), url_id(F.col("url")).alias("url_id"), "markup")}


def without_crawled(items: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Items whose URL isn't in a text file of URLs."""
    done = spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url") != "")
    return items.join(done, "url", "left_anti")


def fetch_batches(rows: DataFrame, size: int = 100_000) -> Iterator[list]:
    """Lists of up to ``size`` rows, one after another: the driver holds one partition at a time."""
    rest = rows.toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(rest, size)):
        yield batch


def numbered_batches(rows: DataFrame, order: list[str], size: int = 100_000) -> DataFrame:
    """rows with ``batch``: 0 for the first ``size`` of them in their order, 1 for the next ones.

    They are dealt by ranges of the order and numbered within each; only how many each range has is added up, so no task holds all rows.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").withColumn("batch", F.floor(place / size).cast("long")).select(*rows.columns, "batch")


def image_links(wide_rows: DataFrame, host: str, seed: int, source_part: str = "") -> DataFrame:
    """img links to a media host from sources with a text in their URL, shuffled by a seed."""
    from ..functions.urls import under

    rows = wide_rows.where((F.col("tag") == "img") & under(F.col("`target:netloc`"), host) & F.col("`source:url`").contains(source_part))
    return rows.select(F.col("`target:url`").alias("url")).distinct().orderBy(F.xxhash64("url", F.lit(seed)))
