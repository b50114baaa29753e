"""Priorities in order against a plain fold, running sums, and the frontier as a stream."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.operators import frontier
from linkloom.operators.ordered import running_sum
from linkloom.functions import urls
from linkloom.streaming.frontier import SETS, Pairs, PairSets, expand_stream, mentions, scheduled_sites, start

WEIGHTS = {2.0: ["hot"], -0.5: ["cold", "ice"], float("-inf"): ["bad"]}


def plain_fold(events):
    held, out = {}, []
    for _, source, target, phrases in sorted(events):
        first = held.setdefault(source, 0.0)
        now = held.setdefault(target, first)
        for weight, words in WEIGHTS.items():
            now += weight if re.search("|".join(words), target, re.I) else 0
            now += weight if re.search(rf"\b(?:{'|'.join(words)})\b", phrases, re.I) else 0
        held[target] = now
        out.append(now)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_accumulated_priorities_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    names = [f"{k}{i}" for i in range(8) for k in ("s", "hot", "cold")] + ["bad1"]
    events = [(i, rng.choice(names), rng.choice(names), rng.choice(["", "hot x", "HOT ice", "hotter", "bad"] if i % 40 == 7 else ["", "hot x", "HOT ice"])) for i in range(300)]
    if seed == 2:  # a chain: each is first led to by the one before
        events = [(2 * i + j, f"n{i}", f"n{i + 1}", "hot" if j else "") for i in range(40) for j in range(2)]
    df = spark.createDataFrame(events, "seq long, source string, target string, phrases string").repartition(3)
    got = frontier.accumulated_priorities(df, ["seq"], WEIGHTS).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [e[0] for e in events] and [r["priority"] for r in got] == plain_fold(events)


def test_accumulated_priorities_of_odd_rows(spark):
    rows = [(1, "a", "a", None), (2, None, "b", "hot"), (3, "a", None, "hot"), (4, "a", "hot", None)]
    df = spark.createDataFrame(rows, "seq long, source string, target string, phrases string")
    assert [(r["seq"], r["priority"]) for r in frontier.accumulated_priorities(df, ["seq"], WEIGHTS).orderBy("seq").collect()] == [(1, 0.0), (4, 2.0)]
    assert frontier.accumulated_priorities(df.limit(0), ["seq"], WEIGHTS).count() == 0


def test_a_running_sum_of_one_key_is_several_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, "cold").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
        out = running_sum(df, "k", ["o"], "v", "total")
        want, sums = {}, {}
        for r in df.orderBy("o").collect():
            sums[r["k"]] = want[r["o"]] = sums.get(r["k"], 0) + r["v"]
        assert {r["o"]: r["total"] for r in out.collect()} == want
        parts = df.repartitionByRange("k", "o").withColumn("p", F.spark_partition_id()).where("k = 'hot'").select("p").distinct().count()
        assert parts > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


LINK = "source string, target string, depth int"


def test_sites_are_scheduled_once_over_several_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    settings = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(rows, **options):
        spark.createDataFrame(rows, LINK).write.mode("append").parquet(source)
        start(scheduled_sites(spark.readStream.schema(LINK).parquet(source), **options), out, str(tmp_path / "c")).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    a = lambda i: ("http://x.example/1", f"http://a.example/{i}", 1)
    assert run([a(1), a(2), a(2), (None, "http://known.example/", 1), ("s", "/relative", 1), ("s", None, 1)], threshold=2, depth_limit=3) == []
    deep = [("http://y.example/", f"http://b.example/{i}", 3) for i in range(5)]  # too deep to schedule
    more = [("http://y.example/", f"http://known.example/{i}", 1) for i in range(5)]
    assert run([a(1), a(2), a(3), *deep, *more], threshold=2, depth_limit=3) == [("http://a.example", 2, 3)]
    assert run([a(4), a(5), ("http://z.example/", "http://b.example/9", 2)], threshold=2, depth_limit=3) == [("http://a.example", 2, 3), ("http://b.example", 3, 6)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == settings


def test_a_time_to_live_bounds_the_state(spark, tmp_path):
    import time

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.createDataFrame([("s", f"http://a.example/{i}", 1) for i in range(3)], LINK).write.mode("append").parquet(source)
        start(scheduled_sites(spark.readStream.schema(LINK).parquet(source), threshold=2, ttl_seconds=1), out, str(tmp_path / "c")).awaitTermination()
        time.sleep(2)
    assert spark.read.parquet(out).count() == 2  # forgotten, and found again


def test_a_streamed_frontier_is_the_frontier(spark, tmp_path):
    rng = random.Random(5)
    hosts = [f"http://h{i}.example" for i in range(12)]
    links = [(f"{rng.choice(hosts[: 2 + i // 20])}/{i}", f"{rng.choice(hosts)}/{rng.randrange(9)}") for i in range(260)]
    df = spark.createDataFrame(links, "source string, target string").distinct()
    host = lambda c: F.regexp_extract(c, "^(http://[^/]*)", 1)
    edges = df.groupBy(host("source").alias("site"), host("target").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    seeds = spark.createDataFrame([(hosts[0],)], "site string")
    want = sorted(map(tuple, frontier.expand(edges, seeds, threshold=3, depth_limit=4).collect()))
    got = sorted(map(tuple, expand_stream(df, seeds, threshold=3, depth_limit=4, folder=str(tmp_path / "f")).collect()))
    assert got == want and len({d for _, d in want}) > 2
    again = expand_stream(df, seeds, threshold=3, depth_limit=4, folder=str(tmp_path / "f"))  # resumed: all is there
    assert sorted(map(tuple, again.collect())) == want


class Held:
    """A map state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getMapState(self, *_, **__):  # noqa: N802
        return self

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.rows[key] = value


def test_pairs_are_looked_up_in_sets_not_one_by_one():
    rng, states = random.Random(2), (Held(), Held())
    plain, sets = Pairs(0), PairSets()
    for p, held in zip((plain, sets), states):
        p.init(held)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(3000)]
    pairs += [(a, b ^ 1) for a, b in pairs[:500]]
    for turn in range(4):
        rows = [(*rng.choice(pairs), rng.choice([1, 2]), False) for _ in range(2000)] + ([(0, 0, 1, True)] if turn == 2 else [])
        df = pd.DataFrame(rows, columns=["a", "b", "depth", "known"])
        df = df.drop_duplicates(["a", "b"]) if turn % 2 else df
        want, got = (pd.concat(p.handleInputRows(("s", 1), iter([df[:700], df[700:]]), None)).values.tolist() for p in (plain, sets))
        assert got == want
    few = pd.DataFrame([(0, 0, 1, True)], columns=["a", "b", "depth", "known"])
    assert pd.concat(sets.handleInputRows(("s", 1), iter([few]), None)).values.tolist() == [["s", 0, 0, True]]
    assert len(states[1].rows) <= SETS and states[1].calls <= 4 * 3 * SETS < states[0].calls
    kept = {bytes(v[0][i : i + 16]) for v in states[1].rows.values() for i in range(0, len(v[0]), 16)}
    assert len(kept) == len(states[0].rows)


def test_mentions_are_of_absolute_sites(spark):
    found = ["http://a.b/c", "HTTPS://A.b?x", "//host", "//host/p#f", "http:///x", "ftp://a/", "/rel", "http:x", "", "a//b", "http://a#f\ng", "http://a:80#f", None, "x y", "http://u@h/?q#//z"]
    df = spark.createDataFrame([(str(i), u, 1) for i, u in enumerate(found)], "source string, target string, depth int")
    want = [r["s"] for r in df.where(urls.is_absolute_http(F.col("target"))).select(urls.site(F.col("target")).alias("s")).collect()]
    assert sorted(want) == sorted(r["site"] for r in mentions(df).collect()) and len(want) > 5
