"""Text operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats, no rows."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import hashing, licences, minhash, mixing, packing, pii, quality, sharding, substrings
from linkloom.llm.runtime import input_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept string, component_id string"
LONG = " ".join(f"w{i * 7919 % 9973}" for i in range(30_000))


def frame(spark, texts, sources=None, ids=None):
    ids = ids if ids is not None else range(len(texts))
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "x", "y", "z", "q") for i, t, s in zip(ids, texts, sources)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(40)]
    out = [" ".join(b) for b in base]
    for k in range(25):  # near copies, some beyond the threshold
        w = list(base[k % 5])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [" ".join(base[6] + base[7]), " ".join(base[8][:25] + base[9]), out[0], out[0].upper(), "Solo", "solo", "a b", "A\tb"]
    out += [None, "", "  \n\t ", " ".join(["x"] * 60), "é ü x " * 30, LONG, LONG]
    return out


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, texts, k):
    sets = [shingles(t, k) for t in texts]
    want = brute_components(len(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r for r in minhash.near_duplicate_groups(frame(spark, texts), k=k).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want))]


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicate_groups(frame(spark, [])).count() == 0
    rows = minhash.near_duplicate_groups(frame(spark, ["a b c", "a b c", "a b c", None], ids=[5, 5, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("5", "5", True), ("5", "5", True), ("None", "None", True), ("None", "None", True)]


def test_group_with_stragglers(spark):
    """A large group of edited copies, of which many are linked by none of the pivots."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    out = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 10)):
            w[rng.randrange(90)] = f"n{rng.randrange(60)}"
        out.append(" ".join(w))
    sets = [shingles(t, 2) for t in out]
    want = brute_components(len(out), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicate_groups(frame(spark, out), k=2, star_rounds=1).collect()}
    assert [got[i] for i in range(len(out))] == want


def test_block_links_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    left, right = np.arange(10), np.arange(10, 30)
    component = np.arange(30)
    u, v = minhash.block_links(sets, left, right, component, 60, width=7)
    want = {(a, b) for a in left for b in right if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(left[u], right[v])) == want


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_repeated_windows(spark, texts):
    got = {r["doc_id"]: r for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) for i in range(len(texts))] == brute_removed(texts)
    for r in got.values():  # maximal intervals
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeated_windows_odd_rows(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    t = " ".join(f"x{i}" for i in range(25))
    rows = substrings.remove_repeats(frame(spark, [t, t, t, t], ids=[3, 3, None, 1])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("1", 0), ("3", 25), ("3", 25), ("None", 25)]


def brute_spans(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group()))


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    alphabet = "ab1.2@+-() %09\né4"
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("a@b.c-d+e@f.g", "4539578763621486", "4539 5787-6362 1486", "+1 (743) 555-3824", "999.1.1.1 1.2.3.4.5.6.7.8", "0000000001.0.0.1", "x" * 200_000, "1" * 200_000 + ".1.1.1", "@" * 50_000, "1." * 50_000):
        assert pii.base_spans(t) == brute_spans(t) if len(t) < 1000 else pii.base_spans(t) is not None


def test_disclosing_terms(spark):
    """A name that stands beside one address only reveals it; words that stand everywhere don't."""
    filler = "the of and to in is it for on with as was by this that from".split()
    rng = random.Random(2)
    texts = [" ".join(rng.choice(filler) for _ in range(40)) for _ in range(200)]
    for i in range(12):
        texts.append(f"{' '.join(rng.choice(filler) for _ in range(9))} Zebulon wrote from zeb@mail.example.com {' '.join(rng.choice(filler) for _ in range(9))}")
    texts += [texts[-1]] * 50 + [f"once only Quirrel at q{i}@mail.example.com" for i in range(1)] * 20  # copies add no context
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs, carry=["doc_id"]).collect()}
    kinds = lambda i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in found[i]["spans"]]
    assert (4, "Zebulon") in kinds(205) and (0, "zeb@mail.example.com") in kinds(205)
    assert not any(w.lower() in filler for i in range(len(texts)) for k, w in kinds(i) if k == 4)
    assert not any(w in ("Quirrel", "once", "only") for k, w in kinds(len(texts) - 1))
    assert all(not found[i]["spans"] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(clean[i] == texts[i] for i in range(200))
    assert "Zebulon" not in clean[205] and "[EMAIL]" in clean[205] and "@" not in clean[205]


def test_same_line_in_different_documents(spark):
    """A signature line counts once for each different document, and an address in two documents can disclose."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    filler = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{filler(40)}\nJane Doe <jane@x.com>\n{filler(40)}" for _ in range(30)]
    texts += [f"{filler(40)}\n{filler(3)} Quixote <quix@x.com> {filler(3)}\n{filler(40)}" for _ in range(2)]
    edited = filler(100)
    texts += [f"{edited}\nOnly Here <only@x.com>\n{filler(3)}" for _ in range(2)] + [filler(100) for _ in range(3000)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts), carry=["doc_id"]).collect()}
    terms = lambda i: {(texts[i][s["start"] : s["end"]], s["remove"]) for s in found[i]["spans"] if s["kind"] == 4}
    assert all(terms(i) == {("Jane", True), ("Doe", True)} for i in range(30))
    assert all(terms(i) == {("Quixote", False)} for i in (30, 31))
    assert not terms(32) and not terms(33) and not terms(40)


def test_terms_across_lines(spark):
    """Names on the line above, short and CJK ones, and identifiers with digits."""
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    texts = [f"{filler(60)}\nJane Oz\n\u738b\u4f1f KD48213\njane@x.com\n{filler(60)}" for _ in range(12)] + [filler(100) for _ in range(600)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts), carry=["doc_id"]).collect()}
    for i in range(12):
        assert {texts[i][s["start"] : s["end"]] for s in found[i]["spans"] if s["kind"] == 4} == {"Jane", "Oz", "\u738b\u4f1f", "KD48213"}
    assert not any(found[i]["spans"] for i in range(12, len(texts)))


def test_terms_are_counted(spark):
    """All terms outside of mentions are counted, and characters that make no term change nothing."""
    docs = frame(spark, ["ab c1, \u738b\u4f1f x@y.zz", "--- " * 5000, None, "", "c1"])
    wanted = np.ones(1 << 8, bool)
    inside = spark.createDataFrame([("x",), ("y",), ("zz",)], "term string")
    assert {tuple(r) for r in pii._count_terms(docs, "text", inside, wanted, 255).collect() if r["n_term"]} == {(None, 4), ("ab", 1), ("c1", 2), ("\u738b\u4f1f", 1)}
    rng = random.Random(7)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    texts = [f"{filler(60)}\nAda {filler(3)} ada@x.com\n{filler(60)}" for _ in range(2)] + [filler(100) for _ in range(300)]
    spans = lambda t: [[(s["start"], s["end"]) for s in r["spans"]] for r in sorted(pii.find_personal_data(frame(spark, t), carry=["doc_id"]).where("doc_id < 302").collect())]
    assert spans(texts) == spans([*texts, "-" * 3_000_000])


def test_clashing_names(spark):
    docs = frame(spark, ["mail a@b.cd", "x y z", None], sources=["a", None, "a"])
    for name in ("base", "spans", "target", "taken", "source_size", "shard", "slot", "id", "key", "rep", "n", "_score"):
        docs = docs.withColumn(name, F.lit("own"))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and {r["spans"] for r in out.collect()} == {"own"} and "mail [EMAIL]" in [r["text"] for r in out.collect()]
    assert pii.find_personal_data(docs).where("size(spans) = 1").count() == 1
    mixed = mixing.mix(docs, lambda names, sizes: [1.0] * len(names), share=1.0)
    assert mixed.agg(F.sum("taken")).first()[0] == 4 and {r["key"] for r in mixing.repeat_texts(mixed).collect()} == {"own"}
    assert minhash.near_duplicate_groups(docs).count() == 3 and substrings.remove_repeats(docs).count() == 3 and licences.scan(docs).count() == 0
    assert sharding.shard_groups(docs, 2, F.lit(1), F.xxhash64("text")).count() == 3 and packing.pack(docs, length_tokenizer(), length=8).count() >= 3


def test_personal_data_odd_rows(spark):
    odd = frame(spark, [None, "", "mail a@b.cd", "mail a@b.cd", "+1 (743) 555-3824 " * 3000], ids=[1, None, 3, 3, 5])
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["text"])[:12] for r in out.collect()) == sorted(["None", "", "mail [EMAIL]", "mail [EMAIL]", "[PHONE] [PHO"])
    assert pii.sanitise(frame(spark, [])).count() == 0


def test_licences(spark):
    lines = ["x\nReleased under the MIT License.\ny", "licensed UNDER the apache license version 2.0", "Licensed under the Apache License, Version 1.1", "The license of it", None, "", "one", "a\n" * 5000 + "This work is licensed under the GNU General Public License, version 3."]
    got = sorted((r["doc_id"], r["line_no"], r["license"]) for r in licences.scan(frame(spark, lines)).collect())
    assert got == [(0, 2, "MIT"), (1, 1, "Apache-2.0"), (2, 1, "Apache-1.1"), (7, 5001, "GPL-3.0")]
    assert licences.scan(frame(spark, [])).count() == 0


def test_licence_passages(spark):
    """Notices in a line with other words, wrapped ones, and several of them; a notice is told once."""
    t = licences.TEMPLATES
    gpl, header = t["GPL-3.0"], t["Apache-2.0-header"]
    texts = [
        "Copyright 2020 Foo. Released under the MIT License.",
        "x y\n" + gpl.replace(" GNU ", "\nGNU ") + "\nz",
        "/*\n * " + t["BSD-2-Clause"].replace(" without ", "\n * without ") + "\n */\n\n" + t["ISC"].replace(" for ", "\n for ").replace(" and ", "\n and "),
        header.replace("; you ", ";\nyou "),
        "a b c " + t["MIT"] + " d e f g h i j k l m n o p " + t["CC-BY-NC-4.0"] + " q r s t u v w x y z " + t["MIT"],
        gpl + "\n" + gpl,
        "The license of it\nwas the license\nof this License. Licensed under the\nApache License, Version 1.1 of it",
    ]
    got = sorted((r["doc_id"], r["line_no"], r["license"], round(r["dice"], 2)) for r in licences.scan(frame(spark, texts)).collect())
    assert [r for r in got if r[0] != 3] == [
        (0, 1, "MIT", 1.0), (1, 2, "GPL-3.0", 1.0), (2, 2, "BSD-2-Clause", 1.0), (2, 6, "ISC", 1.0),
        (4, 1, "CC-BY-NC-4.0", 1.0), (4, 1, "MIT", 1.0), (4, 1, "MIT", 1.0), (5, 1, "GPL-3.0", 1.0), (5, 2, "GPL-3.0", 1.0), (6, 3, "Apache-1.1", 1.0),
    ]
    assert (3, 1, "Apache-2.0-header", 1.0) in got


def test_licence_words_beside_other_letters(spark):
    """Letters whose lower case is in a-z part words; short anchors are whole words of any case."""
    texts = ["\u212aNC 4.0 x Under CC BY \u212aNC\u0130 4 0", "CC BY-nC 4.0 \u212a", "CC BY once 4 0 since"]
    got = [(r["doc_id"], r["license"]) for r in licences.scan(frame(spark, texts), {"CC": "CC BY-NC 4.0"}).collect()]
    assert sorted(got) == [(0, "CC"), (1, "CC")]


def test_whole_licences(spark):
    """Whole licence texts, wrapped, commented and edited a little, between other text."""
    rng = random.Random(3)
    filler = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(n))
    texts = {}
    for i, name in enumerate(n for n in licences.TEMPLATES if n.endswith("-text")):
        words = licences.TEMPLATES[name].split()
        words[9], words[60] = "Foo", "Bar Baz"
        lines = [" * " + " ".join(words[a : a + 11]) for a in range(0, len(words), 11)]
        texts[i, name] = "\n".join([filler(30), "/*", " * Copyright 2020 Foo", *lines, " */", filler(300)])
    got = [(r["doc_id"], r["license"], r["line_no"]) for r in licences.scan(frame(spark, list(texts.values()))).where("dice > 0.9").collect()]
    whole = {(i, name) for i, name, line in got if name.endswith("-text")}
    assert whole == set(texts) and all(line == 4 for _, name, line in got if name.endswith("-text"))


def test_licence_windows_equal_brute_force(spark):
    """Notices that lost, changed and gained words, wrapped and between other words: no window of any length is better than
    what is found there."""
    rng = random.Random(11)
    names = ["MIT", "GPL-3.0", "Apache-2.0-header", "BSD-notice", "MPL-2.0", "LGPL-header", "CC-BY-NC-4.0"]
    templates = {n: licences.TEMPLATES[n] for n in names}
    grams = {n: set(licences.bigrams(t)) for n, t in templates.items()}
    common = "the of License under a software terms GNU this Public is MIT".split()
    texts = []
    for _ in range(60):
        words = []
        for name in rng.sample(names, rng.randrange(1, 4)):
            words += [rng.choice(["foo", "bar", "baz", *common]) for _ in range(rng.randrange(12))]
            for w in templates[name].split():
                change = rng.random()
                words += [] if change < 0.06 else ["x", w] if change < 0.1 else ["y"] if change < 0.14 else [w]
        texts.append("".join(w + rng.choice("     \n") for w in words))
    texts.append(" ".join([templates["MIT"]] * 3) + "\n" + templates["GPL-3.0"].removeprefix("This work is ").removesuffix(".") + " and more")
    got = {}
    for r in licences.scan(frame(spark, texts), templates).collect():
        got.setdefault(r["doc_id"], []).append(r)
    found = 0
    for i, t in enumerate(texts):
        words = licences.normal_words(t)
        lines = [k for k, line in enumerate(t.split("\n"), 1) for _ in licences.normal_words(line)]
        at = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, g in grams.items():
            best = (0, 0)
            for a in range(len(at)):
                seen, shared = set(), 0
                for b in range(a, min(len(at), a + 2 * len(licences.normal_words(templates[name])) - 2)):
                    if at[b] not in seen:
                        seen.add(at[b])
                        shared += at[b] in g
                        if 2 * shared / (len(seen) + len(g)) >= licences.THRESHOLD:
                            best = max(best, (2 * shared / (len(seen) + len(g)), shared, -a, b))
            if best[0]:
                found += 1
                _, _, a, b = best
                touching = [r for r in got.get(i, []) if r["dice"] >= best[0] - 1e-12 or r["license"] == name]
                assert any(r["line_no"] <= lines[b + 1] for r in touching), (i, name, best, t, got.get(i))
                mine = [r["dice"] for r in got.get(i, []) if r["license"] == name]
                if mine and not any(r["license"] != name for r in got[i]) and t.count("\n") == 0:
                    assert max(mine) == pytest.approx(best[0])
        assert all(r["dice"] >= licences.THRESHOLD for r in got.get(i, []))
    assert found > 60


def test_shortened_notices(spark):
    gpl = "Licensed under the GNU General Public License, version 3"
    texts = [gpl, gpl.replace(" GNU ", "\nGNU "), f"foo bar {gpl} baz", f"# {gpl.replace(' General', '\n# General')}\n# x y z"]
    got = sorted((r["doc_id"], r["license"], r["shared"]) for r in licences.scan(frame(spark, texts)).collect())
    assert got == [(i, "GPL-3.0", 8) for i in range(4)]


def test_many_licences_in_one_text(spark):
    mit = licences.TEMPLATES["MIT-text"]
    began = time.time()
    rows = licences.scan(frame(spark, ["\n\nCopyright 2020 Foo\n".join([mit] * 1000), "\n".join([" ".join(mit.split()[k : k + 12]) for k in range(0, 160, 12)] * 300)])).collect()
    assert time.time() - began < 60
    assert sum(r["license"] == "MIT-text" for r in rows if r["doc_id"] == 0) == 1000
    assert sum(r["license"] == "MIT-text" for r in rows if r["doc_id"] == 1) == 300


def test_licence_anchors_are_enough():
    grams = {n: licences.bigrams(t) for n, t in licences.TEMPLATES.items()}
    words = set(licences.anchors(grams, licences.THRESHOLD))
    for g in grams.values():
        free = sum(1 for x in g if not set(x.split()) & words)
        assert free < licences.THRESHOLD / (2 - licences.THRESHOLD) * len(g)


def test_sharding(spark, texts):
    texts = [*texts, *[texts[1]] * 40]
    docs = frame(spark, texts)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = sharding.shard_groups(docs, 8, F.octet_length(text) + 1, F.xxhash64(text)).collect()
    assert len(rows) == len(texts)
    of, slots, load = {}, defaultdict(list), defaultdict(int)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and of.setdefault(t, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # no shard is further from the mean than the largest group, and none beyond what plain longest-first gives
    groups = defaultdict(int)
    for r in rows:
        groups[texts[r["doc_id"]] or ""] += r["size"]
    plain = sharding.lpt(list(groups.items()), 8)
    sums = [sum(n for g, n in groups.items() if plain[g] == s) for s in range(8)]
    assert max(load.values()) <= max(sums) * 1.001 and sum(load.values()) == sum(sums)
    assert sharding.shard_groups(frame(spark, []), 8, F.lit(1), F.lit(1)).count() == 0


def test_lpt_is_near_equal():
    rng = random.Random(4)
    loads = [(i, rng.randint(1, 1000)) for i in range(3000)]
    placed = sharding.lpt(loads, 8)
    sums = [sum(n for i, n in loads if placed[i] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2


def test_water_filling():
    targets = mixing.water_fill([10, 1000, 20], [3, 1, 2], 900, 2)
    assert targets == [20.0, 840.0, 40.0]
    assert mixing.water_fill([5, 5], [1, 1], 100, 2) == [10.0, 10.0]
    assert mixing.water_fill([], [], 0, 2) == []


def test_mixing(spark):
    rng = random.Random(6)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    sources = [rng.choice(["b", "a", "c", None, "A"]) for _ in texts]
    docs = frame(spark, texts, sources)
    mix = lambda: mixing.mix(docs, lambda names, sizes: [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], share=1.5)
    rows = mix().collect()
    assert sorted(map(tuple, mix().select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in rows)
    order = sorted({s for s in sources if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in order}
    targets = dict(zip(order, mixing.water_fill([size[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2)))
    taken = defaultdict(int)
    for r in rows:
        s = sources[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == size[s] and abs(r["target"] - targets[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)
    repeated = mixing.repeat_texts(mix()).collect()
    words = defaultdict(int)
    for r in repeated:
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[r["doc_id"]] == r["taken"] for r in rows)
    assert mixing.mix(frame(spark, []), lambda n, s: [], share=1.5).count() == 0
    assert mixing.mix(frame(spark, ["", None]), lambda n, s: [1.0] * len(n), share=1.5).agg(F.sum("taken")).first()[0] == 0


def test_a_mix_is_the_prefix_of_a_hashed_order(spark):
    """Whatever the ranges in which the cut is looked for; with repeated and null ids at the cut, and one source of nearly all rows."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), " ".join("w" for _ in range(rng.randint(0, 9))), "hot" if rng.random() < 0.9 else "rare") for _ in range(600)]
    rows += [(7, "one two three", "copies")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 1.7):
        out = {b: sorted((r["doc_id"] is None, r["doc_id"], r["source"], r["text"], r["taken"]) for r in mixing.mix(docs, lambda names, sizes: sizes, share=share, bucket_bytes=b).collect()) for b in (1, 1 << 20)}
        assert out[1] == out[1 << 20] and len(out[1]) == len(rows)
        size, taken = Counter(), Counter()
        for _, _, source, text, n in out[1]:
            size[source] += len(text.split())
            taken[source] += n
            whole = int(share)
            assert whole * len(text.split()) <= n <= (whole + 1) * len(text.split())
        assert all(abs(taken[s] - share * size[s]) < 0.501 for s in size)
        part = [n for _, _, source, text, n in out[1] if int(share) * len(text.split()) < n < (int(share) + 1) * len(text.split())]
        assert len(part) <= len(size)


def length_tokenizer():
    """A tokenizer of words to their lengths; nested, so that it travels by value."""

    def spaces():
        def ids(raw, offsets):
            body = raw.tobytes()
            return [np.array([len(w) for w in body[a:b].split()] + [1], np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]

        return ids

    return spaces


def test_packing(spark, texts):
    docs = frame(spark, texts)
    rows = packing.pack(docs, length_tokenizer(), length=64, open_windows=4, min_cut=8, merge_parts=2).collect()
    check_packs(rows, texts)
    assert packing.pack(frame(spark, []), length_tokenizer(), length=64).count() == 0


def check_packs(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids, at = [len(w) for w in (t or "").encode().split()] + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        padding += 64 - at
    assert padding < 0.1 * sum(r["length"] for r in rows)


def test_word_tokenizer_equals_the_library(texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from linkloom.llm.runtime import slices, text_bytes
    import pyarrow as pa

    odd = [*texts, "It's... A.B, 5. x,. don't. <|endoftext|> <|EndOfText|>. ÀÉ. 12,5 e.g.,", "İı ﬁne ǅ. İ."]
    path = public.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.word_tokenizer(path, 1)
    raw, offs = text_bytes(pa.array(odd))
    got = [x.tolist() for lo, hi in slices(offs, 4000) for x in own(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])]
    assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in odd]


def test_quality(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(200)]
    bad = [" ".join(rng.choice(["ZZ##", "QQ$$", "!!!"]) for _ in range(30)) for _ in range(60)]
    texts = [*good, *bad, None, "", LONG]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)] + [(None, 1, 0), (3, None, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels.where(~quality.held_out()), max_rows=120)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(260) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((scores[i] >= 0.7) == (i < 200) for i in held)
    assert right / len(held) > 0.98
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == len(texts)
    assert sorted(quality.score(docs, model).columns) == sorted(docs.columns)  # an older score is replaced
    empty = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_scores_do_not_depend_on_neighbours():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé \n中") for _ in range(rng.randint(0, 30))).encode() for _ in range(50)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0] + [len(t) for t in texts])
    together, at = quality.features(raw, offs, 17)
    for i, t in enumerate(texts):
        alone, o = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 17)
        assert sorted(alone) == sorted(together[at[i] : at[i + 1]]), t


def thue_morse(n, a="a", b="b"):
    """A word of n letters and its complement: equal hashes where a polynomial is taken modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 65_536])
def test_hashes_of_long_words(n):
    x, y = thue_morse(n)
    raw = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    starts, ends, _ = hashing.words(raw, np.array([0, len(raw)]))
    h = hashing.word_hashes(raw, starts, ends)
    assert h[0] == h[2] != h[1] and len(h) == 3


def test_window_hashes_are_polynomials_modulo_the_prime():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400, np.uint64) * np.uint64(2) + np.uint64(1)
    h[:3] = [0, 2**64 - 1, hashing.PRIME]
    for kind, base in hashing._BASES.items():
        for k in (1, 2, 3, 7, 8, 20):
            want = []
            for i in range(len(h) - k + 1):
                x = 0
                for v in h[i : i + k].tolist():
                    x = (x * base + v) % hashing.PRIME
                want.append(x)
            assert (hashing.window_hashes(h, k, kind) == hashing.mixed(np.array(want, np.uint64))).all()


def test_operators_on_long_words(spark):
    """Different words of 1024 letters and more are different, and only equal ones equal."""
    pairs = [thue_morse(n) for n in (1024, 2048, 65_536)]
    texts = [" ".join([w] * 20) for p in pairs[:2] for w in p] + [w for p in pairs for w in p]
    texts += [pairs[0][0] + " and more", texts[0], pairs[1][1]]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) for i in range(len(texts))] == brute_removed(texts)
    sets = [shingles(t, 2) for t in texts]
    want = brute_components(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    groups = {r["doc_id"]: r for r in minhash.near_duplicate_groups(frame(spark, texts), k=2).collect()}
    assert [(groups[i]["n_shingles"], groups[i]["component_id"]) for i in range(len(texts))] == [(len(x), c) for x, c in zip(sets, want)]


@pytest.mark.parametrize("weak", [False, True])
def test_word_ids_of_long_words(monkeypatch, weak):
    """Ids are the library's, also where hashes clash."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    if weak:
        monkeypatch.setattr(packing, "word_hashes", lambda raw, a, b: (b - a).astype(np.uint64) % np.uint64(3))
    path = public.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.WordIds(path, 1)
    for _ in range(2):
        for texts in (thue_morse(2048), ["a short one, and more of it.", "", "b or c"], [" ".join(thue_morse(1024))]):
            body = [t.encode() for t in texts]
            got = own(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0] + [len(b) for b in body]))
            assert [x.tolist() for x in got] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_more_buckets_than_spark_allows(spark, texts, tmp_path):
    """The number of chunks grows with the input; Spark's limit on buckets is raised."""
    name = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        frame(spark, texts).write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        got = {r["doc_id"]: r for r in substrings.remove_repeats(docs, bucket_bytes=max(1, input_bytes(docs) // 9)).collect()}
        assert int(spark.conf.get(name)) >= 9
    finally:
        spark.conf.set(name, before)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) for i in range(len(texts))] == brute_removed(texts)


def test_text_ids_are_told_as_an_error(spark):
    docs = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    for f in (substrings.remove_repeats, minhash.near_duplicate_groups):
        with pytest.raises(TypeError, match="doc_id must be an integer"):
            f(docs)


def test_written_tables_go_with_their_scope(spark, texts):
    import glob

    from linkloom.llm.runtime import scope, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before, tables = set(glob.glob(f"{folder}/linkloom-*")), {t.name for t in spark.catalog.listTables()}
    with scope():
        n = substrings.remove_repeats(frame(spark, texts)).count()
        assert set(glob.glob(f"{folder}/linkloom-*")) > before
        with scope():
            assert minhash.near_duplicate_groups(frame(spark, texts[:5])).count() == 5
        assert n == len(texts)
    assert set(glob.glob(f"{folder}/linkloom-*")) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_disclosing_terms_in_the_whole_document(spark):
    """A revealing term goes wherever it stands in a text that mentions the entity, and stays elsewhere; it is told what it was."""
    rng = random.Random(11)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    line = lambda: f"{filler(3)} Quixote K8X <quix@x.com> 4711 {filler(3)}"
    texts = [f"Quixote {filler(200)}\n{line()}\n{filler(200)} quixote." for _ in range(2)]
    texts += [f"{filler(30)} other@x.com {filler(30)} Quixote", *[f"{filler(90)}\n{line()}" for _ in range(40)], *[filler(100) for _ in range(2000)]]
    found = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts), carry=["doc_id"]).where("doc_id < 3").collect()}
    for i in range(2):
        words = [texts[i][s["start"] : s["end"]] for s in found[i]["spans"]]
        assert sorted(words) == sorted(["Quixote", "Quixote", "K8X", "quix@x.com", "4711", "quixote"])
        assert [s["start"] for s in found[i]["spans"]] == sorted(s["start"] for s in found[i]["spans"])
    assert [texts[2][s["start"] : s["end"]] for s in found[2]["spans"]] == ["other@x.com"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, texts), remove_at=2.0).where("doc_id < 3").collect()}
    assert clean[0] == texts[0].replace("Quixote", "[NAME]").replace("quixote", "[WORD]").replace("K8X", "[CODE]").replace("4711", "[NUMBER]").replace("quix@x.com", "[EMAIL]")
    assert clean[2] == texts[2].replace("other@x.com", "[EMAIL]")
    near = pii.find_personal_data(frame(spark, texts), carry=["doc_id"], reach=1).where("doc_id < 2").collect()
    assert all(not [s for s in r["spans"] if s["kind"] == 4] for r in near)


def test_quality_sample_is_bounded(spark):
    """By rows and by bytes, also where ids repeat; rows with one id are one document."""
    texts = ["good words here " * 5, "bad ## $$ " * 5, "good " * 4000, None, ""] * 8
    docs = frame(spark, texts, ids=[i % 20 for i in range(40)])
    labels = spark.createDataFrame([(i, int(i % 5 != 1), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    a, b = (quality.fit(docs, labels, max_bytes=2000), quality.fit(docs.repartition(3), labels, max_bytes=2000))
    assert (a.weight == b.weight).all() and a.bias == b.bias
    short = [quality.fit(docs, labels, max_bytes=n) for n in (2000, 1 << 20)]
    assert not (short[0].weight == short[1].weight).all()
    nothing = quality.fit(docs, labels, max_bytes=0)
    assert {round(r["score"], 3) for r in quality.score(docs, nothing).collect()} == {0.8}


def test_scores_to_the_last_bit(spark):
    """A plain scorer over each document alone gives the same numbers, in batches of any size."""
    rng = random.Random(10)
    texts = [" ".join("".join(rng.choice("abcé#") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 50))) for _ in range(60)] + [None, "", LONG]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    model = quality.fit(docs, labels)
    want = {}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        f, _ = quality.features(np.frombuffer(body, np.uint8), np.array([0, len(body)]), quality.BITS)
        mean = model.vectors[f].sum(0, dtype=np.float64) / (len(f) + quality.SHRINK)
        z = model.softmax.astype(np.float64) @ mean
        want[i] = 1 / (1 + math.exp(-(z[1] - z[0] + model.bias)))
    got = []
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        got.append({r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and all(abs(got[0][i] - want[i]) < 1e-4 for i in want)


def test_personal_data_in_nested_mentions_is_linear():
    """One mention that holds all others, and mentions in one run of letters and digits."""
    for text in ("+".join(["10.20.30.40"] * 25_000).replace("+", "-") + "@example.com", "a4111111111111111" * 16_000 + " x"):
        assert len(text) > 270_000
        began = time.time()
        spans = pii.base_spans(text)
        contexts, inside = pii._contexts(text, spans), pii._inside(text, spans)
        assert time.time() - began < 30 and len(contexts) == len(spans) > 10_000 and inside


def test_terms_inside_and_beside_mentions_equal_plain_ones():
    rng = random.Random(7)
    parts = ["a@b.com", "10.1.2.3", "4111111111111111", "+1 234 567 890", "word", "é4", "x_y", "-", " ", " ", "\n", "@", "."]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        spans = pii.base_spans(text)
        plain = {}
        for s, _, e in spans:
            while s > 0 and text[s - 1].isalnum():
                s -= 1
            while e < len(text) and text[e].isalnum():
                e += 1
            plain.update((m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text[:e]) if m.end() > s and m.start() >= s)
        assert sorted(pii._inside(text, spans)) == sorted(plain.values())
        seen = set()
        for (s, _, e), c in zip(spans, pii._contexts(text, spans, reach=9)):
            beside = []
            for m in re.finditer(r"[^\W_]+", text):
                a, b = m.span()
                apart = not any(a < hi and lo < b for lo, _, hi in spans)
                if max(0, s - 9) <= a and b <= min(len(text), e + 9) and apart and (c["entity"], a) not in seen and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
                    seen.add((c["entity"], a))
                    beside.append(m.group().lower())
            assert c["terms"] == beside, (text, s, e)


def test_a_long_list_of_contacts_is_no_product(spark):
    names = [f"Name{i} Sur{i} <p{i}@x{i}.example>" for i in range(20_000)]
    lists = ["\n".join(names), "\n\n".join(f"- {n} -" for n in reversed(names)), "\n".join(f"{i}. {n}" for i, n in enumerate(names[::2]))]
    began = time.time()
    found = pii.find_personal_data(frame(spark, lists), carry=["doc_id"]).collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: len(r["base"]) for r in found} == {0: 20_000, 1: 20_000, 2: 10_000}
    assert all(len(r["spans"]) > 1.5 * len(r["base"]) for r in found)
