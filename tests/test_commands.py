import json
import shutil
import sys

import pytest
from pyspark.sql import functions as F

from linkloom import cli, presets
from linkloom.model import Store
from linkloom.plans.sites import planned_sites
from linkloom.sources.paged import page_path
from linkloom.sources.pages import entries, parse_pages, tables_of, with_links

FEED = "http://a.wordpress.com/feed/"


def page(post, *targets, source=FEED, after=None):
    markup = "".join(f'<a href="{t}">x</a>' for t in targets)
    item = {"originId": post, "title": "T", "published": 1313121904, "origin": {"streamId": f"feed/{source}"}, "summary": {"content": markup}}
    return json.dumps({"id": f"feed/{source}", **({"continuation": after} if after else {}), "items": [item]})


PAGES = [
    page("http://a.wordpress.com/1", "http://b.wordpress.com/1", "http://b.wordpress.com/2", "http://c.tumblr.com/1"),
    page("http://b.wordpress.com/1", "http://d.wordpress.com/1", "http://own.example/1", source="http://b.wordpress.com/feed/"),
    page("http://d.wordpress.com/1", "http://e.wordpress.com/1", source="http://d.wordpress.com/feed/"),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Store(spark, str(tmp_path_factory.mktemp("commands") / "store"))
    out.save(tables_of(with_links(entries(parse_pages(spark.createDataFrame([(p,) for p in PAGES], "value string"))))))
    return out


def sites(spark, path):
    return {r["site"].split("//")[1]: r["depth"] for r in spark.read.parquet(f"{path}/sites").collect()}


def test_frontier_and_resume(spark, store, tmp_path, capsys):
    out = tmp_path / "out"
    argv = ["frontier", store.path, FEED, "-o", str(out), "--depth", "3"]
    assert cli.run(argv, spark) == 0 and json.loads(capsys.readouterr().out) == {"sites": 3, "depth": 3}
    want = {"a.wordpress.com": 1, "b.wordpress.com": 2, "d.wordpress.com": 3}  # the feed's site chooses the preset, which stays at its domain
    assert sites(spark, out) == want
    found = {r["site"]: r["candidates"] for r in spark.read.parquet(f"{out}/sites").collect()}
    assert "http://d.wordpress.com/feed/" in found["http://d.wordpress.com"]
    assert cli.run(argv, spark) == 1 and "resume" in capsys.readouterr().err
    shutil.rmtree(out / "sites")
    shutil.rmtree(out / "state" / "level-00003")  # as if it had been interrupted in its second level
    first = sorted(p.name for p in (out / "state" / "level-00002").glob("part-*"))
    assert cli.run(["resume", str(out)], spark) == 0 and sites(spark, out) == want
    assert sorted(p.name for p in (out / "state" / "level-00002").glob("part-*")) == first
    assert cli.run(["resume", str(tmp_path / "none")], spark) == 1


def test_frontier_options(spark, store, tmp_path):
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "mine.json").write_text(json.dumps({"site": "none", "feeds": {r"http://(\w+)\.tumblr\.com/": ["http://own.example/%(1)s"]}, "depth": 2}))
    before = dict(presets.PRESETS)
    try:
        assert cli.run(["frontier", store.path, FEED, "-o", str(tmp_path / "o"), "--preset", "mine", "--presets", str(tmp_path / "own")], spark) == 0
    finally:
        presets.PRESETS.clear()
        presets.PRESETS.update(before)
    assert sites(spark, tmp_path / "o") == {"a.wordpress.com": 1, "b.wordpress.com": 2, "c.tumblr.com": 2}
    got = spark.read.parquet(str(tmp_path / "o" / "sites")).where(F.col("site").contains("tumblr")).first()
    assert got["candidates"] == ["http://own.example/c"] and got["dead"] is None and got["priority"] == 1
    assert cli.run(["frontier", store.path, FEED, "-o", str(tmp_path / "p"), "--threshold", "1", "--follow", "wordpress.com", "--follow", "own.example", "--depth", "0"], spark) == 0
    assert sites(spark, tmp_path / "p") == {"a.wordpress.com": 1, "b.wordpress.com": 2}
    with pytest.raises(KeyError, match="no preset"):
        presets.chosen("other", FEED)
    assert presets.chosen(None, "http://none.example/") == presets.Preset(".*", {}, depth=1)


def test_states_of_sites(spark, store):
    tables = store.open()
    feed = tables["feed"].join(tables["url"].withColumnRenamed("id", "url_id"), "url_id")
    dead = F.when(F.col("url").contains("b.wordpress"), True).when(F.col("url").contains("//a."), True)
    tables = tables.with_tables(feed=feed.withColumn("dead", dead).select("id", "url_id", "title", "dead"))
    seeds = spark.createDataFrame([("http://a.wordpress.com",)], "site string")
    plan = lambda mode: {r["site"][7:8]: (r["dead"], r["priority"]) for r in planned_sites(tables, seeds, presets.Preset("", {}, ("wordpress.com",), 3, mode)).collect()}
    assert plan("all") == {"a": (True, 1), "b": (True, 1), "d": (None, 1)}
    assert plan("alive+") == {"a": (True, 0), "d": (None, -128)}  # seeds stay


def test_own_exporter(spark, store, tmp_path, capsys, monkeypatch):
    (tmp_path / "linkloom_exporters").mkdir()
    (tmp_path / "linkloom_exporters" / "counts.py").write_text(
        "HELP = 'number of rows of a table'\ndef export(tables, output, include, exclude, table='url'):\n    open(output, 'w').write(f'{table} {tables[table].count()} {include}')\n"
    )
    (tmp_path / "linkloom_exporters" / "broken.py").write_text("import no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert cli.run(["export", "counts", "-i", store.path, "-o", str(tmp_path / "n"), "+f", "tag", "is", "a", "table=item"], spark) == 0
    assert (tmp_path / "n").read_text() == "item 3 [('tag', 'is', 'a')]"
    assert cli.run(["options", "counts"], spark) == 0 and "number of rows" in capsys.readouterr().out
    assert cli.run(["export", "none", "-i", store.path, "-o", "x"], spark) == 1 and "no exporter" in capsys.readouterr().err
    with pytest.raises(ModuleNotFoundError, match="no_such_module"):
        cli.exporter("broken")
    for name in [n for n in sys.modules if n.startswith("linkloom_exporters")]:
        del sys.modules[name]


def test_ingest_of_chains(spark, tmp_path):
    for n, text in enumerate([page("http://a.wordpress.com/1", "http://x.example/", after="m"), page("http://a.wordpress.com/2", "http://y.example/")]):
        file = tmp_path / "pages" / page_path("c", "m" if n else "")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert cli.run(["ingest", str(tmp_path / "pages"), store.path, str(tmp_path / "checkpoint"), "--paged"], spark) == 0
    assert sorted(r["url_url"] for r in store.open().with_urls("item", "url").collect()) == ["http://a.wordpress.com/1", "http://a.wordpress.com/2"]
    assert store.open()["hyperlink"].count() == 2
