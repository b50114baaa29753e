"""Vector operators against brute force, and connected components."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import queries, vectors
from linkloom.llm.components import connected_components, unite
from linkloom.llm.runtime import Scratch

from .. import oracle


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    out = [v / np.linalg.norm(v) for v in x]
    for k in range(60):
        out.append(out[k % 6] * 3 + rng.standard_normal(16) * 0.12)
    out += [out[0]] * 15 + [out[0] * 2]
    listed = [[float(c) for c in v] for v in out]
    bad = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15]
    return [(i, v, "label") for i, v in enumerate(listed + bad)], len(listed)


SCHEMA = "vec_id long, embedding array<double>, n_links string"


def test_embedding_duplicates(spark, rows):
    rows, n = rows
    x = np.array([v for _, v, _ in rows[:n]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    labels = unite(np.arange(n), *np.nonzero(linked))
    for tile in (1000, 60):
        got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=tile, steps=(3, 5)).collect()}
        assert len(got) == len(rows)
        assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(n)] == [(int(linked[i].sum()), int(labels[i]), labels[i] == i) for i in range(n)]
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(n, len(rows)))
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest(spark, rows):
    rows, n = rows
    x = np.array([v for _, v, _ in rows[:n]])
    got = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, k=5, block=100, share=0.7).collect()
    found = hits = 0
    for q in range(0, n, 10):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        s = x @ x[q]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        s[q] = -np.inf
        best = np.sort(s)[-5]
        found += 5
        hits += sum(s[r["vec_id"]] >= best - 1e-9 for r in mine)
    assert hits / found >= 0.9
    assert all(r["vec_id"] < n and r["query_id"] < n for r in got)
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert vectors.nearest(few, F.col("vec_id") == 0, k=5).count() == 2
    assert vectors.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7), (-5, 3)]
    names = sorted({x for e in edges for x in e})
    at = {v: k for k, v in enumerate(names)}
    labels = unite(np.arange(len(names)), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {v: names[labels[k]] for k, v in enumerate(names)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_by_tables_and_in_one_task(spark):
    """Long paths, stars, cycles and edges to itself, by jobs for each step and in one task."""
    rng = random.Random(8)
    path = list(range(3000, 3300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(9, 9), (9, 10), (1, 5), (5, 8), (8, 1)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = {**dict.fromkeys(path, 3000), 9: 9, 10: 9, 1: 1, 5: 1, 8: 1}
    for most in (1000, 0):
        assert {r["id"]: r["component"] for r in connected_components(table, Scratch(spark, "t"), small_edges=most).collect()} == want
    assert {tuple(r) for r in connected_components(spark.createDataFrame([(4, 4)], "a long, b long"), Scratch(spark, "t")).collect()} == {(4, 4)}


def test_vectors_of_several_lengths(spark):
    """Each length is compared with itself; very large and very small components are no matter."""
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [1e200, 2e200, 0.0]), (5, [1e-200, 2e-200]), (6, [-1.0, 2.0]), (7, [0.5])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (0, 6), 7: (0, 7)}
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [1.0, 0.0, 0.0]), (6, [-1.0, 2.0]), (None, [1.0, 1.0])]
    found = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(1, 3), k=2).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 2, 10.0), (1, 2, 6, 3.0), (3, 1, 4, 1.0)]
    for f in (vectors.near_duplicates, lambda v: vectors.nearest(v, F.lit(True))):
        with pytest.raises(TypeError):
            f(spark.createDataFrame([("x", [1.0])], "vec_id string, embedding array<double>"))


def test_ties_go_to_the_smaller_id(spark):
    """Equal vectors have equal scores in every block, so their ids decide."""
    rng = np.random.default_rng(4)
    base, others = rng.standard_normal(33), rng.standard_normal((400, 33)) * 0.1
    ids = rng.permutation(700)
    listed = [*[base.tolist()] * 300, *others.tolist()]
    rows = [(int(i), v) for i, v in zip(ids, listed)]
    copies = sorted(int(i) for i in ids[:300])
    found = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == copies[150], k=20, block=128).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == copies[:20] and len({r["score"] for r in found}) == 1


def test_links_at_the_threshold_do_not_depend_on_the_block():
    """Pairs at the threshold up to rounding are told alike in dense blocks, sparse ones and alone."""
    rng = np.random.default_rng(6)
    a, c = rng.standard_normal((2, 40, 24))
    a = vectors.unit(a)
    c = vectors.unit(c - (c * a).sum(1, keepdims=True) * a)
    b = vectors.unit(0.95 * a + math.sqrt(1 - 0.95**2) * c)
    basis = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    pairs = lambda x, y, **k: {(int(s), int(t)) for u, v in vectors.compare(x, y, basis, 0.95, False, **k) for s, t in zip(u, v)}
    alone = {(i, i) for i in range(40) if pairs(a[i : i + 1], b[i : i + 1], block=1)}
    assert 0 < len(alone) and pairs(a, b) == pairs(a, b, block=2) == pairs(a, b, block=40, steps=(4, 20)) == alone
    dense = np.repeat(a[:1], 40, 0)
    assert {s for s, t in pairs(dense, b) if t == 0} == (set(range(40)) if (0, 0) in alone else set())


def test_tiles_part_no_linked_pair():
    rng = np.random.default_rng(7)
    x = vectors.unit(rng.standard_normal((900, 6)) * np.array([9, 6, 3, 2, 1, 1]))
    basis = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, ::-1]
    tiles = vectors.Tiles(x[:500], basis, 30, 0.95)
    at = tiles.of(x)
    assert tiles.count == 32 and len(set(at.tolist())) > 20
    u, v = np.nonzero(x @ x.T >= 0.95)
    near = {t: set(tiles.near(t).tolist()) for t in range(32)}
    assert all(t in near[s] and s in near[t] for s, t in zip(at[u].tolist(), at[v].tolist()))
    assert sum(map(len, near.values())) < 32 * 32  # some are out of reach


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")
def test_registered_search_finds_the_nearest(spark):
    """op9 against brute force over the same table: order, ties, scores, and a recall of 0.9 or more."""
    con = oracle.connect()
    rows = [(i, v) for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall() if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in queries.op9_prefix_forest_search(spark, oracle.DATA).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == asked
    place, hits = {i: k for k, i in enumerate(ids.tolist())}, 0
    for i in asked:
        s = vectors.dot_in_order(x, np.broadcast_to(x[place[i]], x.shape))
        want = sorted((-c, j) for c, j in zip(s.tolist(), ids.tolist()) if j != i)[:20]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1)) and all(s[place[j]] == c for _, j, c in mine)
        assert [(-c, j) for _, j, c in mine] == sorted((-c, j) for _, j, c in mine)
        hits += len({j for _, j in want} & {j for _, j, _ in mine})
    assert hits / (20 * len(asked)) >= 0.9


def plain_recall(x, asked, found, k):
    hits = 0
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        hits += (s[found[i]] >= np.partition(s, -k)[-k] - 1e-12).sum()
    return hits / (k * len(asked))


SF01 = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="needs the test tables")
@pytest.mark.parametrize("longer", [1, 10, 100])
def test_search_prunes_and_finds(spark, longer):
    """2000 rows: a recall of 0.9 with fewer than all rows compared, also with one vector that is much longer than the others."""
    listed = [r["embedding"] for r in spark.read.parquet(f"{SF01}/embeddings.parquet").orderBy("vec_id").collect() if r["embedding"]]
    x = np.array([v for v in listed if all(c is not None and math.isfinite(c) for c in v) and any(v)], np.float64)
    x[1] *= longer
    asked = list(range(0, len(x), 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in vectors.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert plain_recall(x, asked, found, 20) >= 0.9
    assert longer == 1 or all(1 in found[i] for i in asked if x[1] @ x[i] > longer * 0.1)
    rest, ids = np.delete(x, 1, 0), np.arange(len(x) - 1)
    compared = [n for _, _, n in vectors.search_block(ids, rest, ids[::20], rest[::20], vectors.block_forest(rest, 80, 24, 7), 20, 0.55, 0)]
    assert np.mean(compared) < 0.8 * len(rest)


def test_norms_over_many_bands_and_at_the_ends_of_doubles(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 8)) * np.exp2(rng.integers(-30, 30, (120, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1e200] * 8), (501, [1e-200] * 8)]
    out = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 40, k=5).collect()
    assert len(out) == 40 * 5
    for q in range(40):
        s = np.array([v for _, v in rows]) @ x[q]
        mine = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        s[q] = -np.inf
        best = np.argsort(-s, kind="stable")[:5]
        assert mine == [rows[i][0] for i in best]
