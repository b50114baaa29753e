"""The Merkle manifest, streaming deduplication and whitening against plain versions, and odd rows."""

import hashlib
import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from linkloom.llm import exact, manifest, queries, whitening
from linkloom.llm.runtime import scope

from .. import oracle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
needs_tables = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i //= 2
    return out


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, siblings) of rows of FIELDS."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for k in langs}
    trees = {k: levels_of([plain_leaf(r) for r in ordered[k]]) for k in langs}
    top = levels_of([trees[k][-1][0] for k in langs]) if langs else []
    out = []
    for n, k in enumerate(langs):
        for i, r in enumerate(ordered[k]):
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], path(trees[k], i) + path(top, n)))
    return sorted(out, key=repr)


ODD = [
    (5, "a", "en", 3, "abc"), (5, "a", "en", 3, "abc"), (5, "a", "en", 3, "abd"), (None, None, None, None, None), (1, "", "", 0, ""), (2, "b", "-", 1, "x" * 100_000), (7, "é", "日本", 2, "né"),
    (-3, "a", "en", None, "n"), (2**62, "a", "en", 1, "\n"), *[(100 + i, "s", "de", i, f"t{i}") for i in range(37)],
]


@pytest.mark.parametrize(("rows", "bits"), [(ODD, 2), (ODD, 10), (ODD[:1], 2), (ODD[9:26], 2), (ODD[9:18], 3), ([], 2)])
def test_manifest_equals_a_plain_tree(spark, rows, bits):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("other"), "proof": F.lit(1), "_g": F.lit(2)})
    with scope():
        out = manifest.manifest(docs, FIELDS, "doc_id", "lang", carry={"doc_id": F.col("doc_id")}, bits=bits)
        got = out.select("doc_id", "leaf", "subroot", "root", manifest.siblings(F.col("proof"))).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
        assert out.where(manifest.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


def test_a_large_group_is_dealt_to_several_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(i, "s", "en" if i % 3 else "de", i, str(i)) for i in range(500)]
        with scope():
            out = manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(5), FIELDS, "doc_id", "lang", carry={"doc_id": F.col("doc_id")}, bits=3)
            assert sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", manifest.siblings(F.col("proof"))).collect()), key=repr) == plain_manifest(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_manifest_refuses_to_carry_its_own_columns(spark):
    with pytest.raises(ValueError, match="leaf"):
        manifest.manifest(spark.createDataFrame(ODD, DOCS), FIELDS, "doc_id", "lang", carry={"Leaf": F.col("doc_id")})


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], best[low(r[1])], len(groups[low(r[1])])) for r in rows), key=repr)


TEXTS = [
    (1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (None, "abc"), (11, "abc"), (11, "abc"), (None, "lone"), (12, "İ"), (13, "i̇"),
]


def weak(text):
    """A digest that stands for many texts."""
    return (F.crc32(text.cast("binary")) % 2).cast("string").cast("binary")


@pytest.mark.parametrize("digest", [exact.sha256, weak])
def test_stream_dedup_equals_a_plain_one(spark, tmp_path, digest):
    spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n": F.lit(1), "digest": F.lit("x"), "file": F.lit(2)}).repartition(3).write.parquet(str(tmp_path / "docs"))
    with scope():
        rows = exact.deduplicate(spark, str(tmp_path / "docs"), digest=digest, max_files=1).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), key=repr) == plain_dedup(TEXTS)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({low(t) for _, t in TEXTS}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert all((r["keep_file"], r["keep_row"]) in {(k["file"], k["row"]) for k in kept} for r in rows)


def test_state_outlives_a_run_and_reads_new_files_only(spark, tmp_path):
    docs, folder = tmp_path / "docs", str(tmp_path / "kept")
    part = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(docs))
    part([(1, "a"), (2, "b"), (3, "A")])
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact.deduplicate(spark, str(docs), folder).collect()) == [(1, 3), (2, 2), (3, 3)]
    part([(9, "a"), (8, "c")])
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.deduplicate(spark, str(docs), folder).collect()) == [(1, 9, 3), (2, 2, 1), (3, 9, 3), (8, 8, 1), (9, 9, 3)]
    again = exact.deduplicate(spark, str(docs), folder)  # nothing new
    assert again.count() == 5
    entries = spark.read.parquet(f"{folder}/entries")
    assert entries.count() == 5 and entries.select("file").distinct().count() == 2


def test_hot_digests_are_joined_where_they_are(spark, tmp_path, monkeypatch):
    rows = [(i, "copy" if i % 3 else f"t{i % 30}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact, "HOT", 5)
    with scope():
        out = exact.deduplicate(spark, str(tmp_path / "docs"))
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()), key=repr) == plain_dedup(rows)


def test_stream_dedup_of_an_empty_table_and_settings_stay(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = exact.deduplicate(spark, str(tmp_path / "docs"))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "keep_id", "group_size", "kept"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stream_dedup_has_no_python_in_its_plan(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    plan = exact.deduplicate(spark, str(tmp_path / "docs"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.StringType()), T.StructField("_id", T.StringType())])


def plain_whitening(rows, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(1), c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def check_whitening(got, rows, components):
    deviation, white, explained = plain_whitening(rows, components)
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == len(rows) * components and {r["n"] for r in got} == {len(rows)}
    mine = np.zeros((len(rows), components))
    for r in got:
        assert r["deviation"] == deviation[at[r["vec_id"]]] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        mine[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-6


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(5)
    basis = np.diag(np.linspace(3, 0.5, 9)) @ np.linalg.qr(rng.standard_normal((9, 9)))[0]
    rows = [(i, (rng.standard_normal(9) @ basis).tolist()) for i in range(400)]
    odd = [(1000, None), (1001, [1.0] * 8 + [None]), (1002, [float("nan")] * 9), (1003, [float("inf")] * 9), (1004, [1e300] * 9), (1005, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], VECTORS)
    for parts in (1, 7, 150):
        with scope():
            check_whitening(whitening.whiten(df.repartition(parts), components=4).collect(), rows, 4)
    with scope():
        check_whitening(whitening.whiten(df, components=32).collect(), rows, 9)


def test_vectors_of_each_length_are_a_space_of_their_own(spark):
    rng = np.random.default_rng(6)
    a, b = [(i, rng.standard_normal(3).tolist()) for i in range(50)], [(100 + i, (rng.standard_normal(5) * [1, 2, 3, 4, 5]).tolist()) for i in range(60)]
    with scope():
        got = whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in a + b], VECTORS), components=3).collect()
    check_whitening([r for r in got if r["vec_id"] < 100], a, 3)
    check_whitening([r for r in got if r["vec_id"] >= 100], b, 3)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]])
def test_no_variance_gives_no_row(spark, rows):
    with scope():
        assert whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in rows], VECTORS)).collect() == []


def test_a_component_without_variance_gives_no_row(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    with scope():
        got = whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in rows] + [(None, [3.0, 6.0, 7.0], "", "")], VECTORS)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 11


def test_deviation_is_exact_up_to_64_bits():
    off = np.array([[2**31, 2**31 - 1], [3, 4], [2**32, 2**32]], np.int64)
    assert whitening._deviation(off) == [2**62 + (2**31 - 1) ** 2, 25, None]


def test_jacobi_keeps_small_singular_values_accurate():
    u, v = (np.linalg.qr(np.random.default_rng(k).standard_normal((12, 12)))[0] for k in (1, 2))
    want = 10.0 ** -np.arange(12)
    scaled = np.diag(want) @ v  # rows of very different size, exactly graded
    values, basis = whitening.one_sided_jacobi(whitening.triangle(scaled))
    assert np.abs(values / want - 1).max() < 1e-10
    assert np.abs(basis.T @ basis - np.eye(12)).max() < 1e-13
    values, _ = whitening.one_sided_jacobi(whitening.triangle(u @ np.diag(want) @ v))
    assert np.abs(values - want).max() < 1e-15


def test_rounds_hold_each_pair_once():
    for d in (1, 2, 5, 8, 33):
        pairs = [(a, b) for p, q in whitening.rounds(d) for a, b in zip(p.tolist(), q.tolist())]
        assert sorted(pairs) == [(a, b) for a in range(d) for b in range(a + 1, d)]
        assert all(len(set(p.tolist()) | set(q.tolist())) == 2 * len(p) for p, q in whitening.rounds(d))


@needs_tables
def test_the_whitening_query_equals_eigh(spark):
    table = spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    with scope():
        check_whitening(queries.op13_jacobi_whitening(spark, oracle.DATA).collect(), rows, 32)
