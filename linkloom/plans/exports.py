"""Export queries: urls, hyperlink and domain graphs, uncharted domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.templates import file_path, template_keys
from ..functions.text import ESCAPES
from ..functions.urls import url_part
from ..model import Catalog
from .filters import Filter, domain_filter, where
from .wide import ATTRIBUTES, TYPES, attribute, columns, wide


def urls(tables: Catalog, include: Sequence[Filter] = (), exclude: Sequence[Filter] = (), key: str | None = None, format: str = "lines", fmt: str = "urls.txt", escape: str | None = None, distinct: bool = True) -> DataFrame:
    """Filtered hyperlinks, one row for each different key, with ``_path``: the file that fmt sends the row to.

    lines: one key, by default target:url. csv: a comma list, by default all attributes, in the order given. Of the
    rows with one key the one with the smallest source, target and tag stays, for the attributes that only the
    template uses; only those are kept in the aggregate.
    """
    keys = (key.split(",") if key else list(ATTRIBUTES)) if format == "csv" else [key or "target:url"]
    for k in [*keys, *template_keys(fmt)]:
        if k not in ATTRIBUTES:
            raise KeyError(f"unknown attribute {k!r}; known are {', '.join(ATTRIBUTES)}")
    if escape not in ESCAPES:
        raise ValueError(f"unknown escape {escape!r}; known are {', '.join(str(e) for e in ESCAPES)}")
    rows = wide(tables).where(where(include, exclude, columns(), TYPES))
    others = [k for k in template_keys(fmt) if k not in keys]
    if distinct and others:
        order = F.struct(attribute("source:url"), attribute("target:url"), attribute("tag"))
        best = rows.groupBy(*[attribute(k) for k in keys]).agg(F.min_by(F.struct(*[attribute(k) for k in others]), order).alias("_rest"))
        rows = best.select(*[attribute(k) for k in keys], *[F.col("_rest").getField(k).alias(k) for k in others])
    else:
        rows = rows.select(*[attribute(k) for k in [*keys, *others]])
        rows = rows.distinct() if distinct else rows
    path = file_path(fmt, columns(), ESCAPES[escape], TYPES)
    return rows.withColumn("_path", path).select(*[attribute(k) for k in keys], "_path")


def domains(tables: Catalog) -> DataFrame:
    """id and domain (host and port) of each URL."""
    return tables["url"].select("id", url_part(F.col("url"), "netloc").alias("domain"))


def _named(name: Column, include: Sequence[Filter], exclude: Sequence[Filter]) -> Column:
    return domain_filter(name, include) & domain_filter(name, exclude, exclude=True)


def hyperlink_graph(tables: Catalog, include: Sequence[Filter] = (), exclude: Sequence[Filter] = ()) -> tuple[DataFrame, DataFrame]:
    """vertices (name) and edges (source, target, type, timestamp) of the links of items; of several links between
    two URLs the one with the largest tag and time stays. Filters give the subgraph that their vertices induce."""
    links = tables.links_of(tables.with_urls("item", "url")).select(F.col("url_url").alias("source"), F.col("target_id_url").alias("target"), "element", F.col("published").alias("timestamp"))
    last = F.max(F.struct(F.col("element").alias("type"), "timestamp")).alias("last")
    edges = links.where(_named(F.col("source"), include, exclude)).groupBy("source", "target").agg(last).select("source", "target", "last.type", "last.timestamp")
    # a vertex is there through an edge of the whole graph, also if its partner is filtered out
    ends = links.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return ends.where(_named(F.col("name"), include, exclude)), edges.where(_named(F.col("target"), include, exclude))


def domain_vertices(tables: Catalog, include: Sequence[Filter] = (), exclude: Sequence[Filter] = ()) -> DataFrame:
    """All domains, isolated ones too, with weight: their number of URLs."""
    named = _named(F.concat(F.lit("http://"), F.col("name")), include, exclude)
    return domains(tables).groupBy(F.col("domain").alias("name")).agg(F.count(F.lit(1)).alias("weight")).where(named)


def domain_links(tables: Catalog, include: Sequence[Filter] = (), exclude: Sequence[Filter] = ()) -> DataFrame:
    """source, target, tag, n: links between domains. Links are summed by URL pair's domains before the last shuffle
    by Spark's partial aggregation, so hub domains cost no more than others."""
    domain = lambda role: url_part(F.col(f"{role}_id_url"), "netloc").alias(role)
    rows = tables.with_urls("hyperlink", "source_id", "target_id").select(domain("source"), domain("target"), "element")
    for role in ("source", "target"):
        rows = rows.where(_named(F.concat(F.lit("http://"), F.col(role)), include, exclude))
    return rows.groupBy("source", "target", F.col("element").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def domain_graph(tables: Catalog, tags: Sequence[str] | None = None, include: Sequence[Filter] = (), exclude: Sequence[Filter] = ()) -> tuple[DataFrame, DataFrame]:
    """vertices (name, weight) and edges (source, target, a count for each tag, 0 where there is none); the tags named
    source and target become source_tag and target_tag."""
    tag = F.when(F.col("tag").isin("source", "target"), F.concat("tag", F.lit("_tag"))).otherwise(F.col("tag"))
    links = domain_links(tables, include, exclude).withColumn("tag", tag)
    pivot = links.groupBy("source", "target").pivot("tag", list(tags)) if tags else links.groupBy("source", "target").pivot("tag")
    return domain_vertices(tables, include, exclude), pivot.sum("n").na.fill(0)


def uncharted(tables: Catalog, include: Sequence[Filter] = (), exclude: Sequence[Filter] = ()) -> dict[str, DataFrame]:
    """Domains that no feed is at: pages (domain, page_count), keywords (domain, keyword, n), referrers (domain,
    referrer, n) in long form."""
    domain = lambda column: url_part(F.col(f"{column}_url"), "netloc").alias("domain")
    charted = tables.with_urls("feed", "url_id").select(domain("url_id")).distinct()
    keep = lambda df: df.join(charted, "domain", "left_anti").where(_named(F.concat(F.lit("http://"), F.col("domain")), include, exclude))
    pages = domains(tables).groupBy("domain").agg(F.count(F.lit(1)).alias("page_count"))
    words = tables.with_urls("tagging", "url_id").select(domain("url_id"), "keyword_id").groupBy("domain", "keyword_id").agg(F.count(F.lit(1)).alias("n"))
    words = words.join(tables["keyword"].select(F.col("id").alias("keyword_id"), "keyword"), "keyword_id").groupBy("domain", "keyword").agg(F.sum("n").alias("n"))
    links = domain_links(tables).groupBy(F.col("target").alias("domain"), F.col("source").alias("referrer")).agg(F.sum("n").alias("n"))
    return {"pages": keep(pages), "keywords": keep(words), "referrers": keep(links)}


def uncharted_report(tables: Catalog, include: Sequence[Filter] = (), exclude: Sequence[Filter] = ()) -> DataFrame:
    """One row for each uncharted domain: name, page_count, keywords and referrers as maps."""
    parts = uncharted(tables, include, exclude)
    folded = lambda df, name, out: df.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct(name, "n"))).alias(out))
    none = F.create_map().cast("map<string,bigint>")
    return (
        parts["pages"].join(folded(parts["keywords"], "keyword", "keywords"), "domain", "left")
        .join(folded(parts["referrers"].withColumn("referrer", F.concat(F.lit("http://"), F.col("referrer"))), "referrer", "referrers"), "domain", "left")
        .select(F.concat(F.lit("http://"), F.col("domain")).alias("name"), "page_count", F.coalesce("keywords", none).alias("keywords"), F.coalesce("referrers", none).alias("referrers"))
    )
