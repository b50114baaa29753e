"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax, numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import SPACE, mixed
from .runtime import slices, text_bytes

#: Lengths of character n-grams, and of word n-grams.
NGRAMS = (3, 4)
WORD_NGRAMS = (2, 3)
#: 2**BITS buckets.
BITS = 18
#: A document is averaged with so many zero vectors, in training and scoring: a short one's score stays near the prior's.
SHRINK = 100
#: Bytes of text that are worked on at once; the arrays of a slice take about a hundred times as much.
SLICE = 1 << 19
_SPACE32 = np.concatenate([SPACE, np.zeros(1, bool)])
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass
class Model:
    """The two-class model. ``weight[b]`` is vector(b) . (softmax row 1 - softmax row 0): the score's logit is
    linear in the averaged vector, so one number for each bucket gives the same softmax as the vectors."""

    vectors: np.ndarray
    softmax: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def of(cls, vectors: np.ndarray, softmax: np.ndarray, bias: float) -> Model:
        return cls(vectors, softmax, (vectors @ (softmax[1] - softmax[0])).astype(np.float32), bias)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word n-grams and character n-grams of each document, and n+1 offsets into them.

    A word n-gram has two: one for its words, and one for how they repeat (each word as the place of the first in the n-gram
    that equals it), so that repetition is learned from words that other documents haven't got.

    Characters are code points. n-grams may begin or end at white space, but have none inside; each document
    is seen with a space before and after it. Words have their own hash.
    """
    n_docs = len(offsets) - 1
    text = raw.tobytes()
    points, bounds = [], np.zeros(n_docs + 1, np.int64)
    space = np.array([32], np.uint32)
    for i in range(n_docs):
        p = np.frombuffer(text[offsets[i] : offsets[i + 1]].decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        points += [p, space]
        bounds[i + 1] = bounds[i] + len(p) + 1
    chars = np.concatenate([space, *points]) if points else space
    bounds = bounds + 1  # document i is chars[bounds[i]:bounds[i+1]-1], with spaces around
    white = _SPACE32[np.minimum(chars, 256)]
    values = mixed(chars.astype(np.uint64) + np.uint64(1))
    shift = np.uint64(64 - bits)
    found, at = [], []
    for n in NGRAMS:
        if len(chars) < n:
            continue
        m = len(chars) - n + 1
        ok = ~white[1 : 1 + m] if n == 3 else ~white[1 : 1 + m] & ~white[2 : 2 + m]
        where = np.flatnonzero(ok)
        h = np.zeros(len(where), np.uint64)
        for j in range(n):
            h += values[where + j] * _MULTIPLIERS[j]
        found.append((mixed(h + np.uint64(n)) >> shift).astype(np.int32))
        at.append(where + 1)  # an n-gram belongs to the document that its second character is in
    starts, ends = np.flatnonzero(white[:-1] & ~white[1:]) + 1, np.flatnonzero(~white[:-1] & white[1:]) + 1
    if len(starts):
        # a word's hash must not depend on its place in the text: characters are mixed with their place in the word
        inner = np.repeat(starts, ends - starts)
        place = (np.flatnonzero(~white) - inner).astype(np.uint64)
        parts = mixed(values[~white] + place * _MULTIPLIERS[0])
        cut = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
        word = mixed(np.add.reduceat(parts, cut) + np.uint64(99))
        found.append((word >> shift).astype(np.int32))
        at.append(starts)
        doc = np.searchsorted(bounds, starts, "right")
        for n in WORD_NGRAMS:
            inside = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
            h, pattern = np.full(len(inside), n, np.uint64), np.full(len(inside), 100 + n, np.uint64)
            for j in range(n):
                here = word[inside + j]
                h = mixed(h + here * _MULTIPLIERS[j])
                same = np.full(len(inside), j, np.uint64)  # the first word of the n-gram that equals the j-th
                for i in range(j - 1, -1, -1):
                    same[word[inside + i] == here] = i
                pattern = mixed(pattern + same * _MULTIPLIERS[j])
            for x in (h, pattern):
                found.append((x >> shift).astype(np.int32))
                at.append(starts[inside])
    if not found:
        return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
    # in the order of the documents
    out, offs = [], np.zeros(n_docs + 1, np.int64)
    cuts = [np.searchsorted(a, bounds) for a in at]
    order = np.argsort(np.concatenate([np.repeat(np.arange(n_docs), np.diff(c)) for c in cuts]), kind="stable") if n_docs > 1 else None
    kept = np.concatenate([f[c[0] : c[-1]] for f, c in zip(found, cuts)])
    out = kept if order is None else kept[order]
    offs[1:] = np.cumsum(sum(np.diff(c) for c in cuts))
    return out, offs


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], prior: float, bits: int, dim: int = 8, epochs: int = 8, least_steps: int = 8000, rate: float = 0.5, seed: int = 5) -> Model:
    """examples: distinct buckets, their shares of the document, label. prior: share of label 1 among all labels. Few examples are
    gone through more often, until there are ``least_steps`` steps."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    softmax = np.zeros((2, dim), np.float32)
    ones = sum(y for _, _, y in examples)
    epochs = max(epochs, -(-least_steps // max(1, len(examples))))
    total, step = epochs * len(examples), 0
    if 0 < ones < len(examples):
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                buckets, share, y = examples[i]
                step_rate = np.float32(rate * (1 - step / total))
                step += 1
                rows = vectors[buckets]
                mean = share @ rows
                z = softmax @ mean
                p = np.exp(z - z.max())
                p /= p.sum()
                error = -p
                error[y] += 1
                back = error @ softmax
                softmax += step_rate * np.outer(error, mean)
                vectors[buckets] = rows + (step_rate * share)[:, None] * back
    # the sample is balanced by class; the prior's odds are put back
    odds = lambda p: float(np.log(p / (1 - p)))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    sampled = min(max(ones / len(examples), 1e-3), 1 - 1e-3) if examples else prior
    return Model.of(vectors, softmax, odds(prior) - (odds(sampled) if examples else 0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", max_rows: int = 4000, max_bytes: int = 64 << 20, bits: int = BITS, seed: int = 5) -> Model:
    """Fits on at most ``max_rows`` labelled documents with at most ``max_bytes`` of text, half of each class as far as there are
    any, chosen by a seeded hash; a text that would go beyond the bytes is left out as a whole.

    Labels other than 0 and 1, and null ones, are ignored; of a document with several labels the largest
    counts, of rows that share an id the text with the smallest hash. Null texts count as empty, and empty ones teach nothing. The
    model is trained in one task, and nothing else comes to the driver. With one class only, or no labels, all
    documents get the prior's score (0.5 with no labels).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(max_rows // 2) for y in (0, 1)]
    named = F.broadcast(picked[0].unionByName(picked[1]))  # at most max_rows rows
    one = lambda c: F.min(F.struct(F.xxhash64(text).alias("h"), c.alias("c")))["c"]
    sizes = docs.select(id_col, text).join(named, id_col).groupBy(id_col, "_y").agg(one(F.coalesce(F.octet_length(text), F.lit(0))).alias("n"))
    rows = sizes.select(id_col, "_y", "n").orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).collect()
    chosen, left = [], {0: max_bytes // 2, 1: max_bytes // 2}
    for r in rows:
        if r["n"] <= left[r["_y"]]:
            left[r["_y"]] -= r["n"]
            chosen.append((r[id_col], r["_y"]))
    if not chosen:
        return train([], counts.get(1, 0) / sum(counts.values()) if counts else 0.5, bits, seed=seed)
    listed = docs.sparkSession.createDataFrame(chosen, f"_id {docs.schema[id_col].dataType.simpleString()}, _y int")
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(listed), "_id")
    sample = sample.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text")).select("_id", "_text", "_y")

    def to_features(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            out = []
            for lo, hi in slices(offs, SLICE):
                f, o = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], bits)
                for i in range(hi - lo):
                    b, n = np.unique(f[o[i] : o[i + 1]], return_counts=True)
                    out.append((b.astype("<i4").tobytes(), (n / (n.sum() + SHRINK)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["id", "y", "buckets", "share"])

    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5

    def to_model(batches):
        """One task: the sample is bounded, and only the model goes to the driver."""
        held = [b for b in batches if b.num_rows]
        ids, ys = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
        buckets, shares = ([np.frombuffer(x.as_buffer(), t) for b in held for x in b.column(c)] for c, t in ((2, "<i4"), (3, "<f4")))
        rows = [(buckets[i], shares[i], int(ys[i])) for i in np.lexsort((ys, ids)).tolist()]
        m = train([r for r in rows if len(r[0])], prior, bits, seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([m.vectors.tobytes()], pa.binary()), pa.array([m.softmax.tobytes()], pa.binary()), pa.array([m.bias])], ["vectors", "softmax", "bias"])

    seen = sample.mapInArrow(to_features, f"id {docs.schema[id_col].dataType.simpleString()}, y int, buckets binary, share binary")
    row = seen.repartition(1).mapInArrow(to_model, "vectors binary, softmax binary, bias double").first()
    return Model.of(np.frombuffer(row["vectors"], np.float32).reshape(1 << bits, -1), np.frombuffer(row["softmax"], np.float32).reshape(2, -1), row["bias"])


def score(docs: DataFrame, model: Model, bits: int = BITS, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability of label 1 added, from whole texts, however long; empty and null texts get the prior's. A
    document's score depends on its text alone, to the last bit: equal texts and repeated rows have equal scores, however
    rows are dealt to batches. A column of that name is replaced; all others stay; an empty table gives none."""
    from pyspark.sql import types as T

    weight, bias, at = docs.sparkSession.sparkContext.broadcast(model.weight), model.bias, docs.columns.index(text)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != column], T.StructField(column, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        w = weight.value
        for batch in batches:
            raw, offs = text_bytes(batch.column(at))
            logits = np.zeros(batch.num_rows)
            for lo, hi in slices(offs, SLICE):
                f, o = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], bits)
                n = np.diff(o)
                full = np.flatnonzero(n)  # each document is summed by itself
                if len(full):
                    logits[lo + full] = np.add.reduceat(w[f].astype(np.float64), o[full]) / (n[full] + SHRINK)
            scores = pa.array(1 / (1 + np.exp(-np.clip(logits + bias, -60, 60))))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], scores], [*names, column])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose crc32(id as text) mod 4 is 2 are kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
