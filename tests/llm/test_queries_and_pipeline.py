"""The registered queries against SQL where there is any, and the pipeline's stages against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import mixing, pii, queries, sharding

from .. import oracle
from .test_text_operators import brute_components, brute_spans, shingles


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(160):
        good = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80)))
        rows.append((i, good if i % 5 else " ".join(["##JUNK##", "$$$$", "!!!!!"][j % 3] for j in range(40)), "en", f"s{i % 3}" if i % 11 else None, 0))
    rows[7] = (7, rows[6][1], "en", "s0", 0)  # copies, also near ones
    rows[8] = (8, rows[6][1] + " word1 word2", "en", "s1", 0)
    rows[11] = (11, rows[11][1] + "\nmail me at some.one@mail.example.com or +1 (743) 555-3824", "en", "s2", 0)
    rows += [(200, None, "en", "s1", None), (201, "", "en", "s1", 0), (202, rows[12][1], "en", "s1", 0), (202, rows[12][1], "en", "s1", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    quality, near, private, mix, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = [tuple(r) for r in quality(spark, docs, folder).collect()]
    assert {r[0] for r in kept} >= {i for i in range(160) if i % 5} and not {r[0] for r in kept} & {i for i in range(160) if i % 5 == 0}

    docs = spark.createDataFrame(kept, docs.schema)
    texts = sorted({(r[0], r[1] or "") for r in kept})
    sets = [shingles(t, 5) for _, t in texts]
    component = brute_components(len(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    once = [tuple(r) for r in near(spark, docs, folder).collect()]
    assert sorted(r[0] for r in once) == [texts[k][0] for k in range(len(texts)) if component[k] == k]

    docs = spark.createDataFrame(once, docs.schema)
    clean = {r["doc_id"]: r for r in private(spark, docs, folder).collect()}
    assert len(clean) == len(once)
    for r in once:
        want = r[1]
        for s, k, e in reversed(brute_spans(r[1])):
            want = f"{want[:s]}[{['EMAIL', 'IP', 'CARD', 'PHONE'][k]}]{want[e:]}"
        assert clean[r[0]]["text"] == want and clean[r[0]]["n_chars"] == (None if want is None else len(want))

    docs = spark.createDataFrame([tuple(r) for r in clean.values()], docs.schema)
    mixed = [r.asDict() for r in mix(spark, docs, folder).collect()]
    size = {i: len((r["text"] or "").split()) for i, r in clean.items()}
    total, taken, by_source, have = sum(size.values()), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixed:
        n = len(r["text"].split())
        taken[r["doc_id"]] += n
        by_source[r["source"]] += n
        assert (clean[r["doc_id"]]["text"]).split()[:n] == r["text"].split()
    for i, r in clean.items():
        have[r["source"]] += size[i]
    assert all(taken[i] <= 2 * size[i] for i in size) and abs(sum(taken.values()) - 1.5 * total) <= len(have)
    weights = {s: n**0.8 for s, n in have.items()}
    assert all(abs(by_source[s] - min(2 * have[s], 1.5 * total * weights[s] / sum(weights.values()))) <= 1 for s in have)

    docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in mixed], docs.schema)
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for r in mixed:
        want[r["doc_id"]] += len(encoder.encode(r["text"], add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in pack(spark, docs, folder).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    by_sequence = defaultdict(int)
    for r in rows:
        by_sequence[r["sequence_id"]] += r["length"]
    assert rows and max(by_sequence.values()) <= 2048


def test_rows_that_share_an_id(spark, folder):
    """Rows are told apart by themselves: a text that is there once is never lost."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (None, a), (None, b + " more"), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(3, a), (5, b), (None, None), (5, ""), (5, "")]))


OWN = ("_score", "__score", "size", "Source_Size", "target", "taken", "_row_key", "_mixed_size", "base", "spans", "k", "c", "id", "first", "component_id")


def test_own_columns_come_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in OWN:
        docs = docs.withColumn(name, F.concat(F.lit(f"own {name} "), F.col("doc_id")))
    for stage in (f for _, f in corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == f"own {name} {r['doc_id']}" for r in rows for name in OWN)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def brute_queries(spark):
    con = oracle.connect()
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


needs_data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


@needs_data
def test_op1_finds_the_base_spans_of_all_documents(spark):
    texts = brute_queries(spark)
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_information_theoretic_pii"](spark, oracle.DATA).collect()}
    assert set(got) == set(texts)
    kinds = ["email", "ip", "card", "phone"]
    for i, t in texts.items():
        spans = [f"{kinds[k]}:{s}:{e}" for s, k, e in brute_spans(t)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x.startswith(k) for x in spans) for k in kinds]
        assert set(spans) <= set(got[i]["spans"].split(",")) if spans else not got[i]["spans"]


def brute_terms(texts, reach=200, generalise_at=0.9):
    """The method in plain words, with documents as contexts: for texts of which no two are edited copies."""
    term, occurs, beside, contexts, mentions = re.compile(r"[^\W_]+"), Counter(), Counter(), defaultdict(set), {}
    total = 0
    for i, t in enumerate(texts):
        spans = brute_spans(t)
        covered = lambda a, b: any(a < e and s < b for s, _, e in spans)  # noqa: B023, E731
        free = [(m.start(), m.end(), m.group().lower()) for m in term.finditer(t) if not covered(*m.span())]
        occurs.update(w for _, _, w in free)
        total += len(free)
        mentions[i], seen = {t[s:e].lower() for s, _, e in spans}, set()
        for s, _, e in spans:
            for a, b, w in free:
                if a >= s - reach and b <= e + reach and (t[s:e], a) not in seen:
                    seen.add((t[s:e], a))
                    beside[t[s:e].lower(), w] += 1
                    contexts[t[s:e].lower(), w].add(i)
    share = Counter()
    for (e, _), n in beside.items():
        share[e] += n
    telling = set()
    for (e, w), n in beside.items():
        c = len(contexts[e, w])
        if c > 1:
            p = min(0.5, share[e] / total)
            if 1 + math.log2(min(1, n / occurs[w]) * (c - 1) / c) / -math.log2(p) >= generalise_at:
                telling.add((e, w))
    out = {}
    for i, t in enumerate(texts):
        spans = brute_spans(t)
        out[i] = sorted((m.start(), m.end()) for m in term.finditer(t) if not any(m.start() < e and s < m.end() for s, _, e in spans) and any((x, m.group().lower()) in telling for x in mentions[i]))
    return out


def test_added_spans_equal_the_method_in_plain_words(spark):
    rng = random.Random(21)
    common = ["a1", "王", *(f"w{i}" for i in range(3000))]
    word = lambda: rng.choice(common) if rng.random() < 0.9 else f"rare{rng.randrange(60)}"
    texts = []
    for i in range(260):
        parts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 3))]
        if i % 3 == 0:
            who = rng.randrange(9)
            parts.insert(rng.randrange(len(parts) + 1), f"Name{who} Sur{who} <p{who}@x.com> N{who}")
            if rng.random() < 0.5:
                parts.append(f"{word()} name{who} Sur{(who + 1) % 9}")
        texts.append("\n".join(parts))
    want = brute_terms(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4) for r in pii.find_personal_data(docs, carry=["doc_id"]).collect()}
    assert got == want and sum(map(len, want.values())) > 100


@needs_data
def test_op5_shards_are_balanced(spark):
    texts = brute_queries(spark)
    rows = queries.QUERIES["op5_lpt_shards"](spark, oracle.DATA).collect()
    load, slots, group = defaultdict(int), defaultdict(list), {}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        assert group.setdefault(body, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) == set(range(8))
    sizes = defaultdict(int)
    for t in texts.values():
        sizes[t] += len(t.encode()) + 1
    plain = sharding.lpt(list(sizes.items()), 8)
    best = [sum(n for t, n in sizes.items() if plain[t] == s) for s in range(8)]
    assert max(load.values()) - min(load.values()) <= max(max(best) - min(best), 0.002 * sum(best))


@needs_data
def test_op6_packs_are_the_librarys_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encoder, texts = Tokenizer.from_file(public.path("word_bpe_49k.json")), brute_queries(spark)
    rows = queries.QUERIES["op6_best_fit_packs"](spark, oracle.DATA).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = [*encoder.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    used = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        used += at
    assert 2048 * len(by_sequence) - used <= 0.05 * used + 2048


@needs_data
def test_op7_tells_held_out_labels(spark):
    labels = dict(oracle.connect().execute("SELECT doc_id, max(quality) FROM labels GROUP BY 1").fetchall())
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_subword_quality"](spark, oracle.DATA).collect()}
    assert set(rows) == set(brute_queries(spark))
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] == (i in set(held)) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in rows.items())
    known = [i for i in held if i in labels]
    assert sum(rows[i]["predicted"] == labels[i] for i in known) >= 0.9 * len(known)


@needs_data
def test_op8_meets_its_targets(spark):
    con = oracle.connect()
    texts = {i: (t, s) for i, t, s in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    run = lambda: {r["doc_id"]: r for r in queries.QUERIES["op8_water_filled_mix"](spark, oracle.DATA).collect()}
    rows = run()
    assert set(rows) == set(texts) and {i: r["taken"] for i, r in rows.items()} == {i: r["taken"] for i, r in run().items()}
    size, taken = defaultdict(int), defaultdict(int)
    for i, r in rows.items():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i][0] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[texts[i][1]] += r["size"]
        taken[texts[i][1]] += r["taken"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([size[s] for s in order], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2)
    for s, t in zip(order, targets):
        assert abs(taken[s] - t) <= 1
    assert all(r["source_size"] == size[texts[i][1]] and abs(r["target"] - targets[order.index(texts[i][1])]) < 1e-6 for i, r in rows.items())
