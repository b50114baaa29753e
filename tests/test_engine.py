import csv
import json
import os
import random
import xml.etree.ElementTree as ET
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom import cli, presets, queries, sinks
from linkloom.model import SPECS, Catalog, Conflict, Store
from linkloom.operators import frontier, keywords, settings, stats, storage
from linkloom.plans import exports
from linkloom.plans.wide import ATTRIBUTES
from linkloom.sources.pages import enriched, entries, fetch_batches, parse_pages, read_pages, tables_of, with_links, without_crawled
from linkloom.streaming.ingest import ingest, site_counts, windowed_counts

from . import oracle


def page(*items, feed="http://f.com/rss"):
    return json.dumps({"id": f"feed/{feed}", "title": "F", "continuation": "c", "items": list(items)})


def item(url, html="", **more):
    return {"originId": url, "title": "T", "published": 1313121904000, "keywords": ["Comic", "comic", "Fun"], "origin": {"streamId": "feed/http://f.com/rss"}, "alternate": [{"href": "http://alt.com/x"}], "summary": {"content": html}, **more}


PAGES = [
    page(item("https://xkcd.com/937/", '<img src="https://imgs.xkcd.com/comics/tornadoguard.png"><a href="http://other.net/p">x</a><video src="http://other.net/p">'), item("guid-1", '<a href="http://xkcd.com/">x</a>')),
    page(item("http://late.com/1", "old", alternate="none"), item("http://late.com/1", content={"content": '<a href="http://other.net/q">new</a>'}), item("x", alternate="none"), item("http://no.time/", published=None)),
    "{broken",
    "\0",
]


def held(tables):
    """The same rows without their history: small plans keep the tests quick."""
    return tables.with_tables(**{n: tables.spark.createDataFrame(tables[n].collect(), s.schema) for n, s in SPECS.items()})


@pytest.fixture(scope="module")
def tables(spark):
    lines = spark.createDataFrame([(p,) for p in PAGES], "value string")
    return held(tables_of(with_links(entries(parse_pages(lines.where("value != '\\0'"))))))


def test_entries(spark):
    rows = entries(parse_pages(spark.createDataFrame([(p,) for p in PAGES], "value string"))).collect()
    by = {r["url"]: r for r in rows}
    assert by["http://alt.com/x"]["valid"] and not by[""]["valid"] and not by["http://no.time/"]["valid"]
    assert by["https://xkcd.com/937/"]["published"] == "2011-08-12T04:05:04+00:00" and by["https://xkcd.com/937/"]["source"] == "http://f.com/rss"
    assert sorted(by["https://xkcd.com/937/"]["keywords"]) == ["comic", "fun"]


def test_read_modes(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(PAGES))
    assert read_pages(spark, str(tmp_path)).where(F.col("items").isNotNull()).count() == 2
    with pytest.raises(Exception):
        read_pages(spark, str(tmp_path), on_error="raise").collect()
    (tmp_path / "stop").mkdir()
    (tmp_path / "stop" / "p.jsonl").write_text("\n".join([PAGES[0], PAGES[2], PAGES[1]]))
    assert read_pages(spark, str(tmp_path / "stop"), on_error="stop").count() == 1
    (tmp_path / "done.txt").write_text("http://alt.com/x\n\n")
    left = without_crawled(entries(read_pages(spark, str(tmp_path / "p.jsonl"))), spark, str(tmp_path / "done.txt"))
    assert left.where("url = 'http://alt.com/x'").count() == 0


def test_tables(tables):
    counts = {r["table"]: r["n_rows"] for r in storage.table_counts(tables).collect()}
    assert counts == {"url": 8, "keyword": 2, "item": 3, "hyperlink": 4, "feed": 1, "tagging": 6, "summary": 3, "webpage": 0}
    assert storage.orphans(tables).count() == 0 and storage.duplicates(tables).where("n_keys > 0").count() == 0
    tags = {r["element"] for r in tables["hyperlink"].collect()}
    assert tags == {"a", "img"}  # the smaller of a and video


def test_enriched(spark):
    lines = spark.createDataFrame([(page(item("http://a.com/1", '<a href="http://b.com/">'), item("http://a.com/2")),)], "value string")
    web = spark.createDataFrame([("http://a.com/1", '<img src="http://c.com/i.png">', 200), ("http://a.com/2", '<a href="http://d.com/">', 404)], "url string, html string, status int")
    t = tables_of(enriched(entries(parse_pages(lines)), web))
    assert {u["url"] for u in t["url"].collect()} == {"http://a.com/1", "http://a.com/2", "http://b.com/", "http://c.com/i.png", "http://f.com/rss"}
    assert [r["markup"] for r in t["webpage"].collect()] == ['<img src="http://c.com/i.png">']


def test_wide_row_golden(tables):
    row = exports.urls(tables, [("target:path", "endswith", ".PNG")], format="csv").first()
    want = {"feed:netloc": "f.com", "feed:path": "/rss", "source:netloc": "xkcd.com", "source:path": "/937/", "target:netloc": "imgs.xkcd.com", "published:year": 2011, "published:month": 8, "tag": "img", "published:date": "2011-08-12T04:05:04+00:00"}
    assert {k: row[k] for k in want} == want and row["_path"] == "urls.txt" and len(ATTRIBUTES) == 26


def test_plans_push_filters_and_prune(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(tables)
    saved = store.open()
    plan = exports.urls(saved, [("tag", "is", "img")])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(element,img)" in plan and "Python" not in plan and "markup" not in plan and "author" not in plan


def test_exports_reject_unknown(tables):
    for bad in (dict(key="nope"), dict(fmt="%(nope)s"), dict(include=[("nope", "is", "x")])):
        with pytest.raises(KeyError):
            exports.urls(tables, **bad)
    with pytest.raises(ValueError):
        exports.urls(tables, escape="nope")


def test_graphs(tables):
    v, e = exports.hyperlink_graph(tables)
    assert v.count() == 7 and e.count() == 4
    v, e = exports.hyperlink_graph(tables, include=[("domain", "under", "xkcd.com")])
    assert {r["name"] for r in v.collect()} == {"https://xkcd.com/937/", "https://imgs.xkcd.com/comics/tornadoguard.png", "http://xkcd.com/"} and e.count() == 1
    v, e = exports.domain_graph(tables)
    assert sum(r["weight"] for r in v.collect()) == 8 and {"a", "img"} <= set(e.columns)
    empty = Catalog(tables.spark)
    assert [x.count() for x in exports.hyperlink_graph(empty)] == [0, 0]


def test_uncharted(tables):
    rows = {r["name"]: r for r in exports.uncharted_report(tables).collect()}
    assert "http://f.com" not in rows and rows["http://other.net"]["page_count"] == 2
    assert rows["http://other.net"]["referrers"] == {"http://xkcd.com": 1, "http://late.com": 1}
    assert rows["http://late.com"]["keywords"] == {"comic": 1, "fun": 1}


def natural(tables, name):
    urls = {r["id"]: r["url"] for r in tables["url"].collect()}
    words = {r["id"]: r["keyword"] for r in tables["keyword"].collect()}
    links = SPECS[name].links
    show = lambda r, c: (urls if links.get(c) == "url" else words)[r[c]] if c in links else r[c]
    return sorted(tuple(str(show(r, c)) for c, _ in SPECS[name].columns) for r in tables[name].collect())


def test_merge(spark, tables):
    lines = spark.createDataFrame([(page(item("http://late.com/1", "newest"), item("http://more.org/", '<a href="http://other.net/q">')),)], "value string")
    other = held(tables_of(with_links(entries(parse_pages(lines)))))
    shifted = other.with_tables(  # other ids, as another run could have given
        **{n: other[n].select((F.col("id") + 1).alias("id"), *[(F.col(c) + 1 if c in SPECS[n].links else F.col(c)).alias(c) for c, _ in SPECS[n].columns]) for n in SPECS}
    )
    for o in (other, shifted):
        m = held(storage.merge(tables, o))
        assert storage.orphans(m).count() == 0 and storage.duplicates(m).where("n_keys > 0").count() == 0
        assert ("http://late.com/1", "newest") in natural(m, "summary")
        again = held(storage.merge(m, o))
        for n in SPECS:
            assert natural(again, n) == natural(m, n)
    m = held(storage.merge(tables, shifted))
    reverse = held(storage.merge(shifted, tables))
    for n in ("url", "keyword", "hyperlink", "tagging"):
        assert natural(m, n) == natural(reverse, n)


def test_repair(spark, tables):
    u = tables["url"]
    broken = tables.with_tables(url=u.union(u.select((F.col("id") % 1000003).alias("id"), "url")), hyperlink=tables["hyperlink"].union(spark.createDataFrame([(1, 2, 3, "a")], SPECS["hyperlink"].schema)))
    assert storage.orphans(broken).count() > 0 and storage.duplicates(broken).where("n_keys > 0").count() > 0
    fixed = held(storage.repair(broken))
    assert storage.orphans(fixed).count() == 0 and storage.duplicates(fixed).where("n_keys > 0").count() == 0
    assert natural(fixed, "hyperlink") == natural(tables, "hyperlink")


def test_store(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.open()
    store.save(tables)
    assert natural(store.open(), "item") == natural(tables, "item")
    store.lock()
    with pytest.raises(RuntimeError):
        store.open()
    store.unlock()
    store.save(storage.merge(store.open(), tables))  # reads the old generation while writing the new
    assert natural(store.open(), "hyperlink") == natural(tables, "hyperlink")


def test_migrations():
    assert storage.migration_path("0.10", "1") == [("0.10", "0.10.3"), ("0.10.3", "0.10.6"), ("0.10.6", "1")]
    with pytest.raises(ValueError):
        storage.migration_path("1", "0.10")


def test_sinks(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    rows = exports.urls(tables, fmt="%(target:netloc)s/%(published:year)d/", escape=None)
    written = {r["_path"]: r["n_rows"] for r in sinks.write_by_path(rows, out).collect()}
    assert written == {"imgs.xkcd.com/2011/index": 1, "other.net/2011/index": 2, "xkcd.com/2011/index": 1}
    lines = [x for p in written for x in (tmp_path / "out" / p).read_text().splitlines()]
    assert sorted(lines) == sorted(r[0] for r in rows.collect())
    sinks.write_by_path(exports.urls(tables, key="target:url,tag", format="csv", fmt="all.csv"), out, "csv").collect()
    parsed = list(csv.reader((tmp_path / "out" / "all.csv").open()))
    assert parsed[0] == ["target:url", "tag"] and len(parsed) == 5
    sinks.write_by_path(exports.urls(tables, key="target:url,tag", format="csv", fmt="all.json"), out, "json").collect()
    assert json.loads((tmp_path / "out" / "all.json").read_text())["http://other.net/q"] == {"tag": "a"}
    sinks.write_graphml(*exports.domain_graph(tables), str(tmp_path / "g"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{ns}node")) == exports.domain_vertices(tables).count() and len(root.findall(f".//{ns}edge")) > 0
    sinks.write_report(exports.uncharted_report(tables), str(tmp_path / "r"))
    report = json.loads("".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))))
    assert report["http://other.net"]["page_count"] == 2


def test_streaming_ingest_is_idempotent(spark, tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, p in enumerate(PAGES[:3]):
        (source / f"{i}.jsonl").write_text(p)
    store = Store(spark, str(tmp_path / "store"))
    ingest(spark, str(source), store, str(tmp_path / "c1"), max_files=1).awaitTermination()
    first = {n: natural(store.open(), n) for n in SPECS}
    ingest(spark, str(source), store, str(tmp_path / "c2")).awaitTermination()
    assert {n: natural(store.open(), n) for n in SPECS} == first
    assert first["hyperlink"] == natural(tables, "hyperlink") and first["url"] == natural(tables, "url")


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "http://x.com/1"), ("b", "http://x.com/2"), ("c", "http://y.com/")], "source string, target string")
    rows.write.parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "l"))
    q = site_counts(stream, 1).writeStream.outputMode("update").format("memory").queryName("sites").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("sites").collect()] == [("http://x.com", 2)]
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "view", 1.0), (2, "2024-01-01 00:50:00", "view", 2.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_counts(events).first()["n"] == 2


def test_cli(spark, tables, tmp_path, capsys):
    store = str(tmp_path / "store")
    Store(spark, store).save(tables)
    assert cli.run(["options"], spark) == 0 and "target:netloc" in capsys.readouterr().out
    assert cli.run(["export", "urls", "-i", store, "-o", str(tmp_path / "o"), "+f", "tag", "is", "img", "fmt=%(tag)s.txt"], spark) == 0
    assert (tmp_path / "o" / "img.txt").read_text() == "https://imgs.xkcd.com/comics/tornadoguard.png\n"
    assert cli.run(["check", store], spark) == 0
    assert cli.run(["merge", store, store, "-o", str(tmp_path / "m")], spark) == 0
    assert natural(Store(spark, str(tmp_path / "m")).open(), "url") == natural(tables, "url")
    Store(spark, f"{store}/staged-1").save(tables)
    (tmp_path / "store" / "staged-2" / "tables-0").mkdir(parents=True)
    capsys.readouterr()
    assert cli.run(["cleanup", store], spark) == 0 and json.loads(capsys.readouterr().out) == {"merged": 1}
    assert not list((tmp_path / "store").glob("staged-*")) and natural(Store(spark, store).open(), "url") == natural(tables, "url")
    for topic in cli.HELP:
        assert cli.run(["options", topic], spark) == 0 and "filters" in capsys.readouterr().out
    Store(spark, store).lock()
    assert cli.run(["repair", store], spark) == 1 and cli.run(["repair", store, "--unlock"], spark) == 0
    assert cli.run(["export", "graph", "-i", store, "-o", str(tmp_path / "g"), "graphtype=domain"], spark) == 0
    assert cli.run(["export", "uncharted", "-i", store, "-o", str(tmp_path / "u")], spark) == 0
    assert cli.compose({"a": {1}, "b": [1], "c": {"x": 1}}, {"a": {2}, "b": [2], "c": {"y": 2}, "d": 3}) == {"a": {1, 2}, "b": [1, 2], "c": {"x": 1, "y": 2}, "d": 3}


def test_keyword_sets(spark):
    rows = lambda *r: keywords.build(spark.createDataFrame(list(r), "item string, category string, keyword string"))
    a, b = rows(("i", "t", "x"), ("i", "t", "y"), ("j", "t", "x")), rows(("i", "t", "y"), ("i", "u", "z"), ("k", "t", "q"))
    got = lambda how: {r["item"]: r["keywords"] for r in keywords.algebra(a, b, how).collect()}
    assert got("intersection") == {"i": {"t": ["y"]}}
    assert got("union") == {"i": {"t": ["x", "y"], "u": ["z"]}, "j": {"t": ["x"]}, "k": {"t": ["q"]}}
    assert got("difference") == {"i": {"t": ["x"]}, "j": {"t": ["x"]}}
    assert [r["item"] for r in keywords.query(b, _u=None, t="y").collect()] == ["i"]


def test_frontier(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "d", 9), ("d", "a", 9)], "site string, target string, n long")
    seeds = spark.createDataFrame([("a",)], "site string")
    reach = lambda t, d: {r["site"]: r["depth"] for r in frontier.expand(edges, seeds, t, d).collect()}
    assert reach(2, 0) == {"a": 1, "b": 2, "c": 3, "d": 4} and reach(2, 2) == {"a": 1, "b": 2} and reach(3, 0) == {"a": 1}
    steps = spark.createDataFrame([(1, True, False), (1, False, False), (2, True, True)], "d int, f boolean, p boolean")
    assert [r[0] for r in steps.select(frontier.next_depth(F.col("d"), F.col("f"), F.col("p"))).collect()] == [2, 1, 2]
    answers = spark.createDataFrame([(200, "text/xml", False), (404, None, False), (200, "text/html", False), (None, None, True), (None, None, False)], "s int, c string, f boolean")
    assert [r[0] for r in answers.select(frontier.dead_state(F.col("s"), F.col("c"), F.col("f"))).collect()] == [False, True, True, True, None]


def test_frontier_tells_of_sites_beyond_its_levels(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "site string, target string, n long")
    seeds = spark.createDataFrame([("a",)], "site string")
    with pytest.raises(RuntimeError):
        frontier.expand(edges, seeds, 0, 0, most_levels=2)
    assert frontier.expand(edges, seeds, 0, 0, most_levels=4).count() == 4 and frontier.expand(edges, seeds, 0, 2).count() == 2


def test_stats(spark):
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate([5, 1, 1, 5, 9])], "i int, k string, v long")
    rows = stats.rolling_stats(df, "v", ["i"], ["k"], last=3).orderBy("i").collect()
    assert [(r["min_last"], r["max_last"], r["mode_last"]) for r in rows] == [(5, 5, 5), (1, 5, 1), (1, 5, 1), (1, 5, 1), (1, 9, 1)]
    assert [r["rate"] for r in stats.rate(df, "v", ["i"], ["k"]).orderBy("i").collect()] == [None, -4.0, -2.0, 0.0, 1.0]
    log = spark.createDataFrame([("a", 1, "add"), ("a", 2, "remove"), ("b", 1, "add")], "key string, seq int, action string")
    assert [r["key"] for r in stats.compact_log(log, ["key"]).collect()] == ["b"]


def test_two_writers(spark, tables, tmp_path):
    """Of two writers that start from one generation the second is told; a lock is taken once."""
    store = Store(spark, str(tmp_path / "store"))
    store.save(tables)
    a, b = store.generation, Store(spark, store.path).generation
    one = storage.additions(store.open(), tables)
    store.append(one, a)
    with pytest.raises(Conflict):
        Store(spark, store.path).append(one, b)
    with pytest.raises(Conflict):
        store.save(tables, b)
    with pytest.raises(Conflict):
        store._create(f"_version-{store.generation:06d}", "x")
    store.lock()
    with pytest.raises(RuntimeError):
        Store(spark, store.path).lock()
    store.unlock()
    (tmp_path / "store" / "_version-000099").write_text('{"version": "1", "tab')  # being written
    assert store.generation == 1 and natural(store.open(), "item") == natural(tables, "item")
    store.append(one, 1)  # its writer ended: the next version comes after it
    assert store.generation == 100 and not (tmp_path / "store" / "_version-000099").exists()


def test_append_writes_new_rows_only(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save(tables)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*.parquet") if "_keys" not in p.parts}
    before = files()
    u = spark.createDataFrame([(1, "http://new.example/a"), (2, "http://new.example/b")], SPECS["url"].schema)
    new = Catalog(spark, {"url": u, "summary": spark.createDataFrame([(9, 1, "new")], SPECS["summary"].schema)})
    store.append(storage.additions(store.open(), new), store.generation)
    after = files()
    assert all(after.get(p) == t for p, t in before.items())
    rows = sum(spark.read.parquet(p).count() for p in set(after) - set(before))
    assert rows == 3 and store.open()["url"].count() == tables["url"].count() + 2
    # the last row of a key counts, and many parts are put together
    store.MOST_PARTS = 3
    for text in ("newer", "newest"):
        again = Catalog(spark, {"url": u, "summary": spark.createDataFrame([(9, 1, text)], SPECS["summary"].schema)})
        store.append(storage.additions(store.open(), again), store.generation)
        assert [r["markup"] for r in store.open().with_urls("summary", "url_id").where("url_id_url = 'http://new.example/a'").collect()] == [text]
    assert len(store.manifest()["tables"]["summary"]) < 4 and store.open()["url"].count() == tables["url"].count() + 2
    store.save(store.open())
    store.save(store.open())
    assert {p.split("/")[-3] for p in files()} == {f["path"].split("/")[0] for n in ("_version-*",) for v in (tmp_path / "store").glob(n) for fs in json.loads(v.read_text())["tables"].values() for f in fs}


def test_upgrade(spark, tmp_path, capsys):
    """A store of the oldest version by the command line."""
    row = lambda data, schema: spark.createDataFrame(data, schema)
    old = {
        "url": row([(1, "http://a.example/feed"), (2, "http://a.example/1"), (3, "http://a.example/2")], "id long, url string"),
        "keyword": row([(1, "k")], "id long, keyword string"),
        "item": row([(1, 2, 1, "t", None, "2011-01-01", None, 1.0, "short", "long"), (2, 3, 1, "u", "me", "2011-01-02", None, 1.0, "only", None), (3, 3, 1, "u", "me", "2011-01-02", None, 1.0, None, None)],
                    "id long, url long, source long, title string, author string, published string, updated string, crawled double, summary string, content string"),
        "tagging": row([(1, 1, 1), (2, 2, 1), (3, 3, 1)], "id long, item_id long, keyword_id long"),
        "feed": row([(1, 1, "f")], "id long, url_id long, title string"),
        "hyperlink": row([(1, 2, 3, "a")], "id long, source_id long, target_id long, element string"),
    }
    store = Store(spark, str(tmp_path / "old"))
    store.save_old(old, "0.10")
    with pytest.raises(RuntimeError, match="upgrade"):
        store.open()
    assert cli.run(["upgrade", store.path], spark) == 0 and json.loads(capsys.readouterr().out) == [["0.10", "0.10.3"], ["0.10.3", "0.10.6"], ["0.10.6", "1"]]
    new = store.open()
    assert sorted((r["url_id"], r["markup"]) for r in new["summary"].collect()) == [(2, "long"), (3, "only")]
    assert sorted((r["url_id"], r["keyword_id"]) for r in new["tagging"].collect()) == [(2, 1), (3, 1)]
    assert new["item"].count() == 2 and [r["dead"] for r in new["feed"].collect()] == [None] and new["hyperlink"].count() == 1
    assert cli.run(["check", store.path], spark) == 0 and cli.run(["upgrade", store.path], spark) == 0 and store.generation == 1


def test_plan_of_the_flagship(spark):
    """Each table is read once, and no column twice: URLs come with their rows."""
    if not os.path.isdir(oracle.DATA):
        pytest.skip("needs the test tables")
    for name, links in (("urls_flagship", 1), ("urls_wide_row", 1), ("graph_domain_edges", 1)):
        plan = queries.QUERIES[name](spark, oracle.DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == links and plan.count("orders.parquet") <= 2


def test_numbered_files(spark, tables, tmp_path):
    names = spark.createDataFrame([("a/b.txt", 0), ("a/b.txt", 2), ("a.d/b", 1), (".x", 1), ("a/.x.tar.gz", 3)], "p string, n int")
    assert [r[0] for r in names.select(sinks.numbered_path(F.col("p"), F.col("n"))).collect()] == ["a/b.txt", "a/b.2.txt", "a.d/b.1", ".x.1", "a/.x.3.tar.gz"]
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.lit("all.json").alias("_path"))
    rows = rows.unionByName(rows.where("v = 1").withColumn("v", F.lit(9)))
    written = sinks.write_by_path(rows, str(tmp_path / "o"), "json", parts=4).collect()
    assert sorted(r["_path"] for r in written) == ["all.1.json", "all.2.json", "all.3.json", "all.json"] and sum(r["n_rows"] for r in written) == rows.count()
    held = {}
    for r in written:
        held |= json.loads((tmp_path / "o" / r["_path"]).read_text())
    assert held == {str(i): {"v": 9 if i % 7 == 1 else i % 7} for i in range(500)}


def test_fetch_batches(spark):
    assert [len(b) for b in fetch_batches(spark.range(25), 10)] == [10, 10, 5] and list(fetch_batches(spark.range(0))) == []


def test_frontier_goes_on_where_it_was(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "site string, target string, n long")
    seeds, state = spark.createDataFrame([("a",)], "site string"), str(tmp_path / "state")
    assert frontier.expand(edges, seeds, 0, 3, state=state).count() == 3
    kept = [p.stat().st_mtime_ns for p in sorted((tmp_path / "state").glob("level-*/part-*.parquet"))]
    (tmp_path / "state" / "level-00003" / "_SUCCESS").unlink()  # interrupted there
    got = {r["site"]: r["depth"] for r in frontier.expand(edges, seeds, 0, 0, state=state).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert [p.stat().st_mtime_ns for p in sorted((tmp_path / "state").glob("level-00002/part-*.parquet"))] == kept[: len(list((tmp_path / "state").glob("level-00002/part-*.parquet")))]


def test_own_presets(spark, tmp_path):
    (tmp_path / "mine.json").write_text(json.dumps({"site": r".*\\.mine\\.example/.*".replace("\\\\", "\\"), "feeds": {r".*\.mine\.example/": ["http://%(netloc)s/rss"]}, "follow": ["mine.example"], "depth": 3}))
    (tmp_path / "ours.py").write_text("from pyspark.sql import functions as F\nSITE = '.*//ours[.]example/.*'\nFEEDS = {'.*//ours[.]example/(.*)': lambda f: F.array(F.concat(F.lit('http://'), f['netloc'], F.lit('/'), F.upper(f['1'])))}\n")
    before = dict(presets.PRESETS)
    try:
        assert presets.register(str(tmp_path)) == ["mine", "ours"]
        assert presets.for_feed("http://a.mine.example/x").depth == 3 and presets.for_feed("http://ours.example/x").follow == ()
        urls = spark.createDataFrame([("http://a.mine.example/x",), ("http://ours.example/ab",), ("http://b.wordpress.com/",)], "u string")
        got = [r[0] for r in urls.select(presets.feed_candidates(F.col("u"))).collect()]
        assert got[0] == ["http://a.mine.example/rss"] and got[1] == ["http://ours.example/AB"] and len(got[2]) > 5
    finally:
        presets.PRESETS.clear()
        presets.PRESETS.update(before)
    (tmp_path / "bad.json").write_text('{"sight": "x"}')
    with pytest.raises(KeyError, match="sight"):
        presets.load(str(tmp_path / "bad.json"))


def test_carried_priorities(spark):
    rows = [("a", "b", "x"), ("a", "c", "hot"), ("b", "d", ""), ("c", "d", ""), ("d", "e", "hot"), ("a", "bad", ""), ("bad", "f", "")]
    mentions = spark.createDataFrame(rows, "source string, target string, phrases string")
    seeds = spark.createDataFrame([("a", 1.0)], "source string, priority double")
    got = {r["target"]: (r["priority"], r["level"]) for r in frontier.carried_priorities(mentions, seeds, {2.0: ["hot"], float("-inf"): ["bad"]}, 5).collect()}
    assert got == {"b": (1.0, 1), "c": (3.0, 1), "d": (3.0, 2), "e": (5.0, 3)}


def test_files_are_named_when_all_tasks_have_ended(spark, tmp_path):
    """What fails leaves no file, and what was there stays."""
    root = tmp_path / "o"
    root.mkdir()
    (root / "a.txt").write_text("before")
    rows = spark.range(40).select(F.concat("id", F.lit("")).alias("v"), F.concat(F.lit("abcd"), F.lit("/"), F.col("id") % 4, F.lit(".txt")).alias("_path"))
    fails = rows.withColumn("v", F.when(F.col("v") == "37", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    fails = fails.unionByName(spark.createDataFrame([("x", "a.txt")], "v string, _path string"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_by_path(fails, str(root), partitions=4)
    assert [p.name for p in root.rglob("*")] == ["a.txt"] and (root / "a.txt").read_text() == "before"
    fine = rows.unionByName(spark.createDataFrame([("x", "a.txt")], "v string, _path string"))
    listed = {r["_path"]: r["n_rows"] for r in sinks.write_by_path(fine, str(root), partitions=4).collect()}
    assert listed == {"a.txt": 1, **{f"abcd/{k}.txt": 10 for k in range(4)}}
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == sorted(listed) and (root / "a.txt").read_text() == "x\n"
    assert sinks.write_by_path(fine.limit(0), str(root)).count() == 0


def test_an_attempt_that_failed_leaves_nothing(tmp_path):
    """Of two attempts of a task only the one that counts gives a file."""
    import pyarrow as pa

    def broken():
        yield pa.RecordBatch.from_pydict({"v": ["1"], "_path": ["x.txt"]})
        raise OSError("executor lost")

    w = sinks.RoutedWriter(str(tmp_path / "o"), str(tmp_path / "l"), "lines", ["v"])
    with pytest.raises(OSError):
        w.write(broken())
    counts = w.write(iter([pa.RecordBatch.from_pydict({"v": ["1", "2"], "_path": ["x.txt", "y/z.txt"]})]))
    twice = w.write(iter([pa.RecordBatch.from_pydict({"v": ["1", "2"], "_path": ["x.txt", "y/z.txt"]})]))  # a speculative one
    assert not (tmp_path / "o" / "x.txt").exists() and len(twice.files) == 2
    w.commit([counts, None])
    assert sorted(str(p.relative_to(tmp_path / "o")) for p in (tmp_path / "o").rglob("*") if p.is_file()) == ["x.txt", "y/z.txt"]


def test_stop_mode_over_several_parts_of_a_file(spark, tmp_path):
    """A file that several tasks read ends at its first bad line; others go on."""
    good = [page(item(f"http://a.example/{i}"), feed=f"http://f.example/{i}") for i in range(60)]
    (tmp_path / "a.jsonl").write_text("\n\0\n".join([*good[:40], "{ no json", *good[40:], "{ nor this"]))
    (tmp_path / "b.jsonl").write_text("\n".join(good[:30]))
    (tmp_path / "c.jsonl").write_text("\n".join(["[1, 2]", *good[:3]]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pages = read_pages(spark, str(tmp_path), on_error="stop")
        assert pages.rdd.getNumPartitions() > 5
        got = sorted(r["id"] for r in pages.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([f"feed/http://f.example/{i}" for i in range(40)] + [f"feed/http://f.example/{i}" for i in range(30)])
    assert parse_pages(spark.createDataFrame([("{ no json",), ("[1]",), (good[0],), (None,)], "value string")).count() == 1


def test_the_report_is_the_same_without_maps(spark, tables, tmp_path):
    sinks.write_report(exports.uncharted_report(tables), str(tmp_path / "a"))
    sinks.write_uncharted(exports.uncharted(tables), str(tmp_path / "b"))
    read = lambda p: json.loads("".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*"))))
    assert read("a") == read("b") and any(v["referrers"] for v in read("b").values())
    odd = {
        "pages": spark.createDataFrame([('q"\\', 2), ("hub", 1)], "domain string, page_count long"),
        "keywords": spark.createDataFrame([("hub", "a\nb", 3), ("hub", "é", 1)], "domain string, keyword string, n long"),
        "referrers": spark.createDataFrame([("hub", f"r{i}", i) for i in range(2000)], "domain string, referrer string, n long"),
    }
    sinks.write_uncharted(odd, str(tmp_path / "c"))
    assert read("c") == {'http://q"\\': {"page_count": 2, "keywords": {}, "referrers": {}}, "http://hub": {"page_count": 1, "keywords": {"a\nb": 3, "é": 1}, "referrers": {f"http://r{i}": i for i in range(2000)}}}
    sinks.write_uncharted({n: t.limit(0) for n, t in odd.items()}, str(tmp_path / "d"))
    assert read("d") == {}


def test_frames_of_a_hot_key_are_several_tasks(spark):
    df = spark.range(900).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") < 880, "hot").otherwise("cold").alias("k"), F.col("id").alias("o"), (F.col("id") * 7919 % 101).alias("v"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # parts smaller than a frame too
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for f in (lambda **x: stats.rolling_stats(df, "v", ["o"], ["k"], **x), lambda **x: stats.rate(df, "v", ["o"], ["k"], **x)):
            assert sorted(map(repr, f(split=True).collect())) == sorted(map(repr, f().collect()))
        assert stats.segments(df, ["o"], ["k"], 64).where("k = 'hot' AND NOT _halo").select("_segment").distinct().count() > 5
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_kept_levels_of_another_run_are_refused(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 9)], "site string, target string, n long")
    seeds = spark.createDataFrame([("a",)], "site string")
    run = lambda e, t: frontier.expand(e, seeds, t, 0, state=str(tmp_path / "s")).count()
    assert run(edges, 2) == run(edges, 2) == 2
    with pytest.raises(ValueError, match="another run"):
        run(edges, 3)
    with pytest.raises(ValueError, match="another run"):
        run(edges.union(edges), 2)


def test_layers_as_rows_compose_like_mappings(spark):
    """Random layers with all changes of kind, empty containers and a scope without a name, against the merge of mappings."""
    rng = random.Random(5)

    def config(depth=0):
        make = lambda: rng.choice(["v", "w", None, [], ["a"], ["b", "a"], set(), {"a"}, {"b", "c"}, *([{}] + [config(depth + 1) for _ in range(3)] if depth < 3 else [])])
        return {name: make() for name in rng.sample(["p", "q", "r"], rng.randint(0, 2))}

    scopes = {s: [config() for _ in range(rng.randint(1, 6))] for s in [None, *map(str, range(60))]}
    rows = [(s, *r) for s, layers in scopes.items() for i, c in enumerate(layers) for r in settings.flat(c, i)]
    out = defaultdict(list)
    for r in settings.compose_layers(spark.createDataFrame(rows, f"scope string, {settings.LAYER}"), ["scope"]).collect():
        out[r["scope"]].append(tuple(r)[1:])
    for s, layers in scopes.items():
        assert settings.nested(out[s]) == cli.compose(*layers), layers
    assert settings.compose_layers(spark.createDataFrame([], f"scope string, {settings.LAYER}"), ["scope"]).count() == 0
