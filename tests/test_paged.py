import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from linkloom.sources.paged import PagedReader, page_path, paged_stream
from linkloom.sources.pages import parse_pages


def put(root, chain, mark, after, first=True, **more):
    file = root / page_path(chain, mark)
    file.parent.mkdir(parents=True, exist_ok=True)
    items = {"items": [{"title": "é" * 9}]}
    file.write_text(json.dumps({"id": f"{chain}:{mark}", **({"continuation": after, **items} if first else {**items, "continuation": after}), **more}, ensure_ascii=False))


def stream(spark, root, tmp_path, each=None):
    """Runs the stream over what is there; the pages of each batch go to ``each``."""
    q = paged_stream(spark, str(root), str(tmp_path / "marks" / "a"), pages_per_task=2).writeStream.foreachBatch(each)
    q = q.option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_pages_are_read_once_over_stops(spark, tmp_path):
    root, got = tmp_path / "pages", []
    for n in range(5):
        put(root, "long", f"m/{n} é" if n else "", f"m/{n + 1} é", first=n % 2 == 0)
    put(root, "ended", "", None)
    (root / "bad").mkdir()
    (root / "bad" / "=first.json").write_text("{ no json")
    (root / "empty").mkdir()

    def keep(batch, _):
        got.extend((r["chain"], r["mark"]) for r in batch.select("chain", "mark").collect())

    def broken(batch, _):
        raise InterruptedError

    with pytest.raises(StreamingQueryException):
        stream(spark, root, tmp_path, broken)
    put(root, "long", "m/5 é", "m/6 é")  # came while the stream was down: not of the batch that is repeated
    stream(spark, root, tmp_path, keep)
    first = [("bad", ""), ("ended", ""), *[("long", f"m/{n} é" if n else "") for n in range(5)]]
    assert sorted(got[:7]) == sorted(first) and sorted(got) == sorted([*first, ("long", "m/5 é")])
    stream(spark, root, tmp_path, keep)
    assert len(got) == 8
    put(root, "long", "m/6 é", None)
    put(root, "new", "", "x")
    os.remove(tmp_path / "marks" / "a")  # marks save reading only
    stream(spark, root, tmp_path, keep)
    assert sorted(got[8:]) == [("long", "m/6 é"), ("new", "")]


def test_pages_parse_whole(spark, tmp_path):
    put(tmp_path / "pages", "c", "", "m", title="t\n")
    put(tmp_path / "pages", "c", "m", None)
    out = []
    stream(spark, tmp_path / "pages", tmp_path, lambda b, _: out.extend(tuple(r) for r in parse_pages(b.select("value")).select("id", "continuation", "items").collect()))
    assert sorted((i, c, len(items)) for i, c, items in out) == [("c:", "m", 1), ("c:m", None, 1)]


def test_marks(tmp_path):
    reader = PagedReader(str(tmp_path), None, 3)
    assert reader.latestOffset() == {}
    put(tmp_path, "c", "", 'a"b')
    put(tmp_path, "late", "", "z", first=False, items=[{"title": "x" * 9000}])
    put(tmp_path, "number", "", 12)
    for text, want in (('{"continuation": "k"}', "k"), ('{"items": [{"continuation": "inner"}]}', None), ('{"x": "\\"continuation\\": \\"no\\"", "continuation" : "y",', "y"), ('{"continuation": ""}', None), ("[1]", None), ("", None)):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / "=first.json").write_text(text)
        assert reader._continuation("t", "") == want
    end = reader.latestOffset()
    assert end == {"c": 'a"b', "late": "z", "number": "12", "t": None}
    assert [p.pages for p in reader.partitions({}, end)] == [[("c", ""), ("late", ""), ("number", "")], [("t", "")]]
    assert reader.partitions(end, end) == []
    put(tmp_path, "c", 'a"b', 'a"b')
    with pytest.raises(ValueError, match="lead back"):
        reader.latestOffset()


def rows_of(root, chain, name, rows):
    file = root / chain / name
    file.parent.mkdir(parents=True, exist_ok=True)
    marks, after = zip(*rows)
    values = [json.dumps({"id": f"{chain}:{m or ''}", "continuation": a}) for m, a in rows]
    text = pa.string()
    pq.write_table(pa.table({"mark": pa.array(marks, text), "continuation": pa.array(after, text), "value": pa.array(values, text)}), file, row_group_size=3)


def test_pages_of_one_file_are_followed_without_opening_each(spark, tmp_path, monkeypatch):
    root, got = tmp_path / "pages", []
    even = [(None if n == 0 else f"m{n}", f"m{n + 1}") for n in range(0, 20, 2)]
    odd = [(f"m{n}", f"m{n + 1}") for n in range(1, 19, 2)]
    rows_of(root, "c", "a/1.parquet", even[::-1])  # in any order
    put(root, "mixed", "", "x")
    rows_of(root, "mixed", "1.parquet", [("y", "z"), ("x", "y")])

    def keep(batch, _):
        got.append(sorted((r["chain"], r["mark"]) for r in batch.select("chain", "mark").collect()))

    stream(spark, root, tmp_path, keep)
    assert got == [[("c", ""), ("mixed", ""), ("mixed", "x"), ("mixed", "y")]]
    rows_of(root, "c", "b/1.parquet", odd)
    put(root, "mixed", "z", None)
    stream(spark, root, tmp_path, keep)
    assert got[1] == sorted([*[("c", f"m{n}") for n in range(1, 19)], ("mixed", "z")])
    put(root, "c", "m19", "m20")
    stream(spark, root, tmp_path, keep)
    assert got[2] == [("c", "m19")]
    reader = PagedReader(str(root), None, 64)
    opened = []
    monkeypatch.setattr(PagedReader, "_continuation", lambda self, chain, mark: opened.append((chain, mark)) or PagedReader_continuation(self, chain, mark))
    end = reader.latestOffset()
    assert end == {"c": "m20", "mixed": None} and sorted(opened) == [("c", "m19"), ("c", "m20"), ("mixed", ""), ("mixed", "z")]
    opened.clear()
    tasks = reader.partitions({}, end)
    assert opened == [] and len(tasks) == 2 and tasks[0].pages == [("c", "m19"), ("mixed", ""), ("mixed", "z")]
    assert sorted(m for t in tasks for b in reader.read(t) for m in b["mark"].to_pylist()) == sorted(["", "", *[f"m{n}" for n in range(1, 20)], "x", "y", "z"])
    fresh = PagedReader(str(root), None, 64)  # a batch that is repeated
    again = fresh.partitions({"c": "m1", "mixed": "x"}, {"c": "m7", "mixed": "z"})
    assert sorted(m for t in again for b in fresh.read(t) for m in b["mark"].to_pylist()) == ["m1", "m2", "m3", "m4", "m5", "m6", "x", "y"]
    assert reader.latestOffset() == end and reader.whole["c"] == {str(root / "c/a/1.parquet"), str(root / "c/b/1.parquet")}
    rows_of(root, "back", "1.parquet", [(None, "a"), ("a", "b"), ("b", "a")])
    with pytest.raises(ValueError, match="lead back"):
        PagedReader(str(root), None, 64).latestOffset()


PagedReader_continuation = PagedReader._continuation
