"""What travels between tasks, and how much of it a task gets, where tables are large."""

import contextlib
import json
import os

import pytest
from pyspark.sql import functions as F

from linkloom import queries, queries_io, sinks
from linkloom.model import Catalog, Store
from linkloom.operators import frontier, state as states, storage
from linkloom.sources import starschema

from . import oracle

needs_tables = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


@contextlib.contextmanager
def without_broadcasts(spark, above="-1"):
    """Plans as of tables that are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", above)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@needs_tables
def test_links_travel_once_by_their_order_and_once_to_be_told_apart(spark):
    with without_broadcasts(spark):
        for name in ("filter_ge", "filter_under", "filter_contains_int", "filter_exclude_null"):
            found = exchanges(queries.QUERIES[name](spark, oracle.DATA))
            assert len(found) <= 5 and not any("_source#" in e or "source_id#" in e for e in found)
        oracle.same(spark, queries.QUERIES["filter_ge"], queries.ORACLE["filter_ge"])


def test_a_large_shard_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(states, "_ROWS_EACH", 100)
    state = states.State(spark, str(tmp_path / "s"), shards=2)
    rows = spark.range(2000).select(F.lit("one key").alias("key"), F.col("id").alias("n"))
    for run in ("0", "1"):
        state.update("t", ["key"], rows, lambda old, new: old.unionByName(new), run)
    shards = [p for p in (tmp_path / "s").glob("t-000001-*/_shard=*")]
    assert len(shards) == 1 and len(list(shards[0].glob("part-*.parquet"))) > 4
    assert state.read("t").count() == 4000 and state.read("t").distinct().count() == 2000


@needs_tables
def test_pages_are_parsed_once_for_all_tables(spark):
    tables = queries_io._page_tables(spark, oracle.DATA)
    for name in ("url", "item", "hyperlink", "tagging"):
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert "from_json" not in plan and "JsonToStructs" not in plan and "orders.parquet" not in plan


@needs_tables
def test_orders_travel_to_their_pages_as_numbers(spark):
    assert not any("concat" in e for e in exchanges(queries_io.page_lines(spark, oracle.DATA)))
    plan = queries_io.page_lines(spark, oracle.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "originId" not in plan[plan.index("Exchange") :]


def test_members_of_a_group_travel_to_few_blocks(spark):
    """A member is in one row of its family, however many buckets it is in, and meets at most 16 blocks of the other side."""
    from linkloom.llm import minhash
    from linkloom.llm.runtime import Scratch

    made = {}

    class Recorded(Scratch):
        def table(self, df, name):
            made[name] = super().table(df, name)
            return made[name]

    reps = spark.range(2600).select(F.col("id").alias("rep"))
    placed = reps.select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("key"), "rep", F.col("rep").alias("component"))
    sets = reps.select(F.col("rep").alias("id"), F.array(F.when(F.col("rep") == 2599, 7).otherwise(F.col("rep")).cast("long")).alias("shingles"))
    links = minhash._between_components(Recorded(spark, "minhash"), placed, sets, 80)
    assert [sorted(r) for r in links.collect()] in ([[7, 2599]], [[7, 2599]] * 2)
    assert made["grouped"].count() == 2600
    shape = made["shape"].first()
    assert shape["left_blocks"] <= 16 and shape["right_blocks"] <= 16


def test_keys_travel_to_their_filters_as_numbers_not_as_bitmaps(spark, tmp_path):
    """Bitmaps of each task, summed after they travel, are as many as tasks x blocks: the square of the rows."""
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.range(0, 40_000, numPartitions=40).select("id", F.concat(F.lit("http://a/"), "id").alias("url"))
    before = shuffled(spark)
    store.save(Catalog(spark, {"url": rows}))
    assert shuffled(spark) - before < 40_000 * 80  # the table once, its keys once; 40 tasks x 14 blocks of 4 KB are 2.3 MB more
    blocks = spark.read.parquet(f"{tmp_path}/s/tables-000000-*/_keys").where("name = 'url'")
    assert blocks.count() == blocks.select("bucket", "block").distinct().count() == 2 * 7
    assert all(len(r["bits"]) == 4096 for r in blocks.collect())
    asked = spark.createDataFrame([("http://a/39999",)], "url string")
    assert store.open().lookup("url", asked).where("url = 'http://a/39999'").count() == 1


def test_a_merge_with_itself_joins_links_with_no_unchanged_ids(spark, tmp_path):
    ids = [(i, f"http://a/{i}") for i in range(2000)]
    links = spark.createDataFrame([(i, i, (i + 1) % 2000, "a") for i in range(2000)], "id long, source_id long, target_id long, element string")
    tables = Catalog(spark, {"url": spark.createDataFrame(ids, "id long, url string"), "hyperlink": links})
    with without_broadcasts(spark, "5000"):
        added = storage.additions(tables, tables)
        assert len(exchanges(added["hyperlink"])) == 2  # its own rows and main's, by their key
    assert added["url"].count() == added["hyperlink"].count() == 0
    other = Catalog(spark, {"url": spark.createDataFrame([(900 + i, u) for i, u in ids] + [(7, "http://new/")], "id long, url string"), "hyperlink": spark.createDataFrame([(1, 903, 904, "a"), (2, 903, 7, "a")], links.schema)})
    merged = storage.merge(tables, other)
    assert merged["url"].count() == 2001 and merged["hyperlink"].count() == 2001
    assert merged.with_urls("hyperlink", "source_id", "target_id").where("target_id_url = 'http://new/'").first()["source_id_url"] == "http://a/3"


def test_a_small_merge_moves_no_large_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.save(Catalog(spark, {"url": spark.range(20_000).select("id", F.concat(F.lit("http://a/"), F.xxhash64("id")).alias("url"))}))
    few = Catalog(spark, {"url": spark.range(3).select((F.col("id") + 5).alias("id"), F.concat(F.lit("http://b/"), "id").alias("url"))})
    few.tables["url"] = few["url"].unionByName(store.open()["url"].where("id < 3"))
    few.tables["url"] = spark.createDataFrame(few["url"].collect(), "id long, url string")
    before = shuffled(spark)
    added = storage.additions(store.open(), few)["url"]
    assert sorted(r["url"] for r in added.collect()) == ["http://b/0", "http://b/1", "http://b/2"]
    assert shuffled(spark) - before < 100_000


@needs_tables
def test_pairs_of_links_are_told_apart_where_their_orders_lines_are(spark):
    with without_broadcasts(spark):
        found = exchanges(starschema.raw(spark, oracle.DATA)["pair"])
        assert len(found) == 2 and all("hashpartitioning(k#" in e for e in found)


def test_mentions_travel_without_what_is_not_asked_for(spark):
    rows = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.concat(F.lit("t"), F.col("id") % 7).alias("target"), F.sha2(F.col("id").cast("string"), 256).alias("phrases"), "id")
    before = shuffled(spark)
    few = frontier.accumulated_priorities(rows, ["id"], {1.0: ["t"]}, columns=["target", "id"])
    got = few.select("target", "id", "priority").orderBy("id").collect()
    assert few.columns == ["target", "id", "priority"] and len(got) == 4000
    assert shuffled(spark) - before < 4000 * 50  # a phrase alone is 64 bytes
    assert got == frontier.accumulated_priorities(rows, ["id"], {1.0: ["t"]}).select("target", "id", "priority").orderBy("id").collect()


def test_a_report_works_its_counts_out_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        runs.add(1)
        return n

    pages = spark.createDataFrame([("a", 1), ("b", 2)], "domain string, n long").select("domain", counted.asNondeterministic()("n").alias("page_count"))
    parts = {"pages": pages}
    for table, name in (("keywords", "keyword"), ("referrers", "referrer")):
        rows = spark.createDataFrame([("a", "x", 3), ("a", "y", 4)], f"domain string, {name} string, n long")
        parts[table] = rows.select("domain", name, counted.asNondeterministic()("n").alias("n"))
    sinks.write_uncharted(parts, str(tmp_path / "r"))
    assert runs.value == 6
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert json.loads(text)["http://a"] == {"page_count": 1, "keywords": {"x": 3, "y": 4}, "referrers": {"http://x": 3, "http://y": 4}}
