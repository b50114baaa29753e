"""State between runs: logs, versions, shards, and keys whose parents come later."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.model import Conflict
from linkloom.operators.state import LateKeys, State, log_run
from linkloom.operators.stats import compact_log

LOG = "key string, seq long, action string, url string"


def test_runs_equal_one_log_and_shards_stay(spark, tmp_path):
    rng = random.Random(2)
    state = State(spark, str(tmp_path / "s"), shards=8)
    rows = [(f"k{rng.randrange(40)}", i, rng.choice(["add", "add", "remove"]), f"u{i}") for i in range(200)]
    rows = rows[:192]
    runs = [rows[:90], rows[90:190], rows[190:]]
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("part-*.parquet")}
    for k, run in enumerate(runs):
        before = files()
        assert log_run(state, "requests", spark.createDataFrame(run, LOG), ["key"], run=f"r{k}")
    shards = {r[0] for r in spark.createDataFrame(runs[2], LOG).select(F.pmod(F.xxhash64("key"), F.lit(8))).collect()}
    assert len([p for p in files() if p not in before]) <= len(shards) <= 2 and all(files()[p] == t for p, t in before.items())
    want = sorted(map(tuple, compact_log(spark.createDataFrame(rows, LOG), ["key"]).select("key", "seq", "action", "url").collect()))
    assert sorted(map(tuple, state.read("requests").collect())) == want
    assert not log_run(state, "requests", spark.createDataFrame(rows[:5], LOG), ["key"], run="r1")  # done
    older = sorted(map(tuple, compact_log(spark.createDataFrame(rows[:190], LOG), ["key"]).select("key", "seq", "action", "url").collect()))
    assert sorted(map(tuple, state.read("requests", version=1).collect())) == older and state.versions() == [0, 1, 2]
    assert state.read("nothing") is None


def test_versions_are_forgotten_and_writers_wait(spark, tmp_path):
    state = State(spark, str(tmp_path / "s"), shards=2, keep=2)
    for k in range(4):
        state.update("a", ["x"], spark.createDataFrame([(k,)], "x long"), lambda old, new: old.unionByName(new))
    assert state.versions() == [2, 3] and state.read("a").count() == 4 and state.read("a", version=2).count() == 3
    (tmp_path / "s" / "_state-000009").write_text("{half")
    assert state.manifest()["version"] == 3
    (tmp_path / "s" / "_state-000009").unlink()
    state._files.lock("other")
    with pytest.raises(Conflict):
        state.update("a", ["x"], spark.createDataFrame([(9,)], "x long"), lambda old, new: new)
    state._files.unlock()
    state.update("a", ["x"], state.read("a"), lambda old, new: old.limit(0))  # empty shards have no folder
    assert state.read("a").count() == 0


def test_rows_wait_for_their_parents(spark, tmp_path):
    late = LateKeys(State(spark, str(tmp_path / "s")), "hyperlink", "source_id")
    child = lambda *r: spark.createDataFrame(list(r), "id long, source_id string")
    parent = lambda *r: spark.createDataFrame(list(r), "id long, url string")
    first = late.batch(0, child((1, "http://a"), (2, "http://b"), (3, None), (1, "http://a")), parent((10, "http://b")), "url")
    assert sorted(map(tuple, first.collect()), key=repr) == [(2, "10"), (3, None)]
    assert sorted(map(tuple, late.waiting().collect())) == [(1, "http://a"), (1, "http://a")]
    parents = parent((10, "http://b"), (12, "http://a"), (11, "http://a"), (13, None))
    second = late.batch(1, child((4, "http://c")), parents, "url")
    assert sorted(map(tuple, second.collect())) == [(1, "11"), (1, "11")]
    again = late.batch(1, child((4, "http://c")), parents, "url")  # repeated after a failure
    assert sorted(map(tuple, again.collect())) == [(1, "11"), (1, "11")] and late.waiting().count() == 1
    assert late.batch(2, spark.createDataFrame([], "id long, source_id string"), parent((14, "http://c")), "url").collect()[0]["source_id"] == "14"
    assert late.waiting().count() == 0
