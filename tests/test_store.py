"""The store: leases, batches as transactions, key filters."""

import json
import threading
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linkloom.model import SPECS, Catalog, Conflict, Store
from linkloom.operators import storage
from linkloom.streaming.ingest import ingest, merge_staged, stream_of


def urls(spark, *names):
    return Catalog(spark, {"url": spark.createDataFrame([(i, n) for i, n in enumerate(names)], SPECS["url"].schema)})


def summary(spark, text, url="http://a.example/1"):
    return urls(spark, url).with_tables(summary=spark.createDataFrame([(1, 0, text)], SPECS["summary"].schema))


def markups(store):
    return [r["markup"] for r in store.open()["summary"].collect()]


def page(url, text):
    return json.dumps({"id": "feed/http://f.example/rss", "title": "F", "items": [{"originId": url, "title": "T", "published": 1313121904, "summary": {"content": text}}]})


class Killed(Exception):
    pass


def run(spark, source, store, checkpoint, **hooks):
    try:
        ingest(spark, str(source), store, str(checkpoint), max_files=1, **hooks).awaitTermination()
    except StreamingQueryException:
        pass


def kill_at(number):
    def hook(batch_id, *_):
        if batch_id == number:
            raise Killed

    return hook


def test_a_stage_left_behind_does_not_overwrite_later_batches(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()
    (source / "0.jsonl").write_text(page("http://a.example/1", "batch 0"))
    run(spark, source, store, tmp_path / "c", on_stage=kill_at(0))
    assert len(store.staged()) == 1 and store.generation == -1
    left = tmp_path / "left"
    (tmp_path / "store" / store.staged()[0][0].path.rpartition("/")[2]).rename(left)  # as if the replay had not seen it
    run(spark, source, store, tmp_path / "c")
    (source / "1.jsonl").write_text(page("http://a.example/1", "batch 1"))
    run(spark, source, store, tmp_path / "c")
    assert markups(store) == ["batch 1"] and store.done(stream_of(spark, str(tmp_path / "c"))) == 1
    left.rename(tmp_path / "store" / f"staged-{stream_of(spark, str(tmp_path / 'c'))}.{0:012d}")
    assert merge_staged(store) == 0 and not store.staged()
    assert markups(store) == ["batch 1"]


def test_a_killed_stream_starts_from_its_stage_and_merges_once(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()
    (source / "0.jsonl").write_text(page("http://a.example/1", "text"))
    run(spark, source, store, tmp_path / "c", on_stage=kill_at(0))
    staged = store.staged()[0][0]
    before = staged.generation
    seen = []
    run(spark, source, store, tmp_path / "c", on_stage=lambda b: seen.append((b, staged.generation)), on_batch=kill_at(0))
    assert seen == [(0, before)] and store.generation == 0  # merged, then killed before the stream knew
    run(spark, source, store, tmp_path / "c", on_stage=lambda b: seen.append(b))
    assert len(seen) == 1 and store.generation == 0 and not store.staged()


def test_merge_staged_brings_what_no_one_resumed(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()
    (source / "0.jsonl").write_text(page("http://a.example/1", "text"))
    run(spark, source, store, tmp_path / "c", on_stage=kill_at(0))
    store.staging(("other", 3))._create("_half", "")  # staged in part
    assert merge_staged(store) == 1 and markups(store) == ["text"] and not store.staged()
    run(spark, source, store, tmp_path / "c")  # its stream finds the batch done
    assert store.generation == 0


def test_a_batch_is_appended_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.append(urls(spark, "http://a.example/"), batch=("s", 4)) and not store.append(urls(spark, "http://b.example/"), batch=("s", 4))
    assert not store.append(urls(spark, "http://b.example/"), batch=("s", 3)) and store.append(urls(spark, "http://c.example/"), batch=("t", 0))
    store.save(store.open())  # keeps what is done
    assert store.done("s") == 4 and store.done("t") == 0 and store.done("u") == -1 and store.open()["url"].count() == 2


def test_a_crashed_writer_blocks_until_its_lease_ends(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    store.save(urls(spark, "http://a.example/"))
    store.LEASE = 1.0
    store.lock("crashed")  # never renewed
    with pytest.raises(Conflict):
        other.append(urls(spark, "http://b.example/"))
    with pytest.raises(RuntimeError):
        other.open()
    assert other.open(locked=True)["url"].count() == 1
    time.sleep(1.1)
    assert not other.locked and other.append(urls(spark, "http://b.example/")) and other.open()["url"].count() == 2
    assert other.lease() is None


def test_a_lock_file_of_another_kind_holds_for_a_lease(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save(urls(spark, "http://a.example/"))
    (tmp_path / "store" / "_lock").write_text("someone")
    assert store.locked
    store.LEASE = 0.5
    time.sleep(0.6)
    assert not store.locked and store.append(urls(spark, "http://b.example/")) is True


@pytest.mark.parametrize("commits", [1, 4])
def test_a_writer_that_paused_for_longer_than_its_lease_is_fenced(spark, tmp_path, monkeypatch, commits):
    slow, fast = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    slow.save(urls(spark, "http://a.example/"))
    reached, go, errors = threading.Event(), threading.Event(), []
    describe = slow._described

    def paused(*args):
        reached.set()
        go.wait(60)
        return describe(*args)

    slow.LEASE = 0.5
    monkeypatch.setattr(slow, "_described", paused)
    renew = slow._renew
    monkeypatch.setattr(slow, "_renew", lambda token: renew(token) if go.is_set() else True)  # its heart stopped too

    def write():
        try:
            slow.append(urls(spark, "http://slow.example/"))
        except Conflict as e:
            errors.append(e)

    thread = threading.Thread(target=write)
    thread.start()
    assert reached.wait(60)
    time.sleep(0.6)
    for k in range(commits):  # four free the slow one's number again
        fast.append(urls(spark, f"http://fast{k}.example/"))
    go.set()
    thread.join(60)
    assert len(errors) == 1
    assert {r["url"] for r in fast.open()["url"].collect()} == {"http://a.example/", *[f"http://fast{k}.example/" for k in range(commits)]}


def test_a_number_that_was_freed_is_not_taken_again(spark, tmp_path, monkeypatch):
    """Even if a fenced writer's lease looks alive to it at the commit."""
    slow, fast = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    slow.save(urls(spark, "http://a.example/"))
    describe = slow._described

    def overtaken(*args):
        out = describe(*args)
        slow.unlock()
        for k in range(4):
            fast.append(urls(spark, f"http://fast{k}.example/"))
        return out

    monkeypatch.setattr(slow, "_described", overtaken)
    monkeypatch.setattr(slow, "_renew", lambda token: True)
    with pytest.raises(Conflict):
        slow.append(urls(spark, "http://slow.example/"))
    assert fast.open()["url"].count() == 5 and fast.generation == 4


def test_the_lease_of_a_living_writer_is_renewed(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.LEASE = 0.6
    describe, seen = store._described, []

    def long(*args):
        time.sleep(1.5)
        seen.append(Store(spark, store.path).locked)
        return describe(*args)

    monkeypatch.setattr(store, "_described", long)
    assert store.append(urls(spark, "http://a.example/")) and seen == [True]


HOSTS = [[f"http://{h}.example/{i}" for i in range(200)] for h in "abc"]


@pytest.mark.parametrize("buckets", [1, 4])
def test_lookup_reads_only_folders_that_may_hold_the_keys(spark, tmp_path, buckets):
    store = Store(spark, str(tmp_path / "store"), buckets=buckets)
    for host in HOSTS:
        store.append(storage.additions(store.open() if store.generation >= 0 else Catalog(spark), urls(spark, *host)))
    folders = [p["path"] for p in store.manifest()["tables"]["url"]]
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "url string")
    read = lambda df: {f for f in folders if any(f in x for x in df.inputFiles())}
    asked = keys(*HOSTS[1][:50], "http://b.example/new")
    found = store.open().lookup("url", asked)
    assert read(found) == {folders[1]}
    assert found.join(asked, "url").count() == 50
    # within a folder's range, but not among its keys: the filter rules it out
    assert store.open().lookup("url", keys("http://a.example/1x")).inputFiles() == []
    one = store.open().lookup("url", keys(HOSTS[0][7]))
    assert one.join(keys(HOSTS[0][7]), "url").count() == 1
    if buckets > 1:
        assert len({x.split("_bucket=")[1].split("/")[0] for x in one.inputFiles()}) == 1
    everything = store.open().lookup("url", keys(*[u for h in HOSTS for u in h]))
    assert everything.count() == 600 and store.open()["url"].count() == 600


@pytest.mark.parametrize("buckets", [1, 3])
def test_upserts_by_lookup_equal_merges(spark, tmp_path, buckets):
    def batch(k):
        names = [f"http://h{(k + i) % 4}.example/{i}" for i in range(12)]
        rows = urls(spark, *names)
        links = spark.createDataFrame([(i, i, (i * k) % 12, "a") for i in range(12)], SPECS["hyperlink"].schema)
        texts = spark.createDataFrame([(i, i, f"{k}-{i}") for i in range(0, 12, 2)], SPECS["summary"].schema)
        return rows.with_tables(hyperlink=links, summary=texts)

    store, whole = Store(spark, str(tmp_path / "store"), buckets=buckets), Catalog(spark)
    store.MOST_PARTS = 3
    for k in range(4):
        store.append(storage.additions(store.open() if k else Catalog(spark), batch(k)), store.generation)
        whole = storage.merge(whole, batch(k))
        whole = whole.with_tables(**{n: spark.createDataFrame(whole[n].collect(), SPECS[n].schema) for n in ("url", "hyperlink", "summary")})
    got = store.open()
    for name in ("url", "hyperlink", "summary"):
        columns = [f.name for f in SPECS[name].schema if f.name != "id" or name != "summary"]
        assert sorted(map(tuple, got[name].select(columns).collect())) == sorted(map(tuple, whole[name].select(columns).collect())), name


def test_large_folders_stay_when_small_ones_are_joined(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.MOST_PARTS = 4
    store.append(urls(spark, *[u for h in HOSTS for u in h]))
    for k in range(6):
        store.append(urls(spark, f"http://new.example/{k}"))
    parts = store.manifest()["tables"]["url"]
    assert parts[0]["rows"] == 600 and len(parts) <= 4 and store.open()["url"].count() == 606


def test_null_keys_and_empty_tables_are_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(Catalog(spark, {"url": spark.createDataFrame([(1, None)], SPECS["url"].schema), "item": spark.createDataFrame([], SPECS["item"].schema)}))
    store.append(urls(spark, "http://a.example/"))
    assert store.manifest()["tables"]["item"] == [] and store.open()["item"].count() == 0
    asked = spark.createDataFrame([(None,)], "url string")
    assert store.open().lookup("url", asked).where(F.col("url").isNull()).count() == 1
    assert store.open().lookup("url", asked.limit(0)).count() == 0
