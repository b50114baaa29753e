"""Exact substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt once to chunks by their id and kept as a table hashed by chunk; everything that travels after
that is hashes, packed in one binary row for a pair of chunk and hash range. Chunks, ranges and the table's buckets all
grow with the input, and a pair without hashes gives no row, so what travels is in proportion to the input:

1. Seeds. Of the 8-word hashes in a window the smallest is its seed; equal windows have equal seeds, and about one
   position in seven is one. Each chunk sends its distinct seeds; seeds of one place only go no further.
2. Windows. Each chunk sends the hashes of its windows with a repeated seed, once each, with the first
   document; who has the smallest keeps it, the others are told that the window starts earlier elsewhere. A window is told by
   two hashes at independent bases, 61 and 32 bits, wherever windows are compared.
3. Removal. Each chunk removes the words of windows that start earlier elsewhere or in itself.

A chunk sends a hash once however often it has it, so a passage that a third of all documents share makes
no range larger than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import inside, window_hashes, word_hashes, words
from .runtime import Scratch, integer_ids, partitions, slices, text_bytes

SEED_WORDS = 8
#: Chunks in each bucket of the table: what is held at once is a chunk, not a bucket.
CHUNKS_IN_BUCKET = 4
#: The two hashes of a window, as one value that sorts and compares.
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4")])


def _extreme(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i:i+width] for each i, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


class Slice:
    """Words and hashes of some documents."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, self.at = words(raw, offsets)
        self.hashes, self.window = word_hashes(raw, self.starts, self.ends), window
        n = len(self.hashes)
        self.ok = inside(self.at, window)
        k = min(SEED_WORDS, window)
        self.width = window - k + 1
        self.short = window_hashes(self.hashes, k)
        self.seed = _extreme(self.short, self.width, np.minimum) if n >= window else np.zeros(0, np.uint64)

    def seeds(self) -> np.ndarray:
        """The short hashes at all places that some window has as its seed."""
        if not self.ok.any():
            return np.zeros(0, np.uint64)
        pad = np.zeros(self.width - 1, np.uint64)
        most = _extreme(np.concatenate([pad, np.where(self.ok, self.seed, np.uint64(0)), pad]), self.width, np.maximum)
        return self.short[(most == self.short) & (most > 0)]

    def windows(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows with one of the (sorted) seeds, and their two hashes."""
        place = np.flatnonzero(self.ok)
        place = place[found(self.seed[place], seeds)]
        first, second = window_hashes(self.hashes, self.window), window_hashes(self.hashes, self.window, "word2")
        return place, first[place], (second[place] >> np.uint64(32)).astype(np.uint32)


def found(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is among the sorted known values."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _unpack(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _pack(chunk: int, ranges: int, *arrays: np.ndarray) -> list[tuple]:
    """A row for each range of the first array's hashes that has any."""
    at = _range_of(arrays[0], ranges)
    order = np.argsort(at, kind="stable")
    here, cuts = np.unique(at[order], return_index=True)
    sorted_ = [a[order] for a in arrays]
    return [(r, chunk, *[a[lo:hi].tobytes() for a in sorted_]) for r, lo, hi in zip(here.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)])]


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _WINDOW)
    out["a"], out["b"] = a, b
    return out


def _first_of_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sorted windows whether each is the first one of its kind."""
    return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", id_col: str = "doc_id", bucket_bytes: int = 32 << 20) -> DataFrame:
    """A row for each document: id, n_words, n_removed, spans (maximal removed intervals of words), text (what is kept).

    A word goes if a window of ``window`` words covers it whose word sequence also starts earlier: in a document
    with a smaller id, or in the same one. Windows are judged on the input. Words are [^\\x20\\x09-\\x0D]+, kept ones are
    joined by one space. Null text has no words. Rows that share an id are ordered by text; null ids come after
    all others, in the order of a hash of their text. Ids are integers. Very long texts are handled as a whole, in one
    task each. Other columns are ignored; an empty table gives none. ``bucket_bytes``: what a bucket of the table holds of the
    input's files; raise it with the executors' memory where buckets would be more than the cluster can schedule.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    integer_ids(docs, id_col)
    ranges = partitions(docs, bucket_bytes)
    chunks = ranges * CHUNKS_IN_BUCKET
    rank = F.coalesce(F.col(id_col), F.xxhash64(text)).cast("long")
    dealt = docs.select(F.col(id_col).alias("_id"), F.col(id_col).isNull().alias("_late"), rank.alias("_rank"), F.col(text).alias("_text"))
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_rank"), F.lit(chunks)))
    table = scratch.bucketed(dealt.select("_chunk", "_late", "_rank", "_id", "_text"), "chunks", "_chunk", ranges)

    def send_seeds(batches):
        for batch in batches:
            chunk_of, rows = batch.column(0).to_numpy(), []
            for chunk in np.unique(chunk_of):
                mine = []
                raw, offs = text_bytes(batch.column(1).filter(pa.array(chunk_of == chunk)))
                for lo, hi in slices(offs):
                    mine.append(Slice(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], window).seeds())
                seeds, n = np.unique(np.concatenate(mine), return_counts=True)
                rows += _pack(int(chunk), ranges, seeds, (n > 1).astype(np.uint8))
            yield _batch(rows, ["range", "chunk", "hashes", "more"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def repeated_seeds(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        sizes = [len(x) // 8 for x in t.column("hashes").to_pylist()]
        hashes, more = _unpack(t.column("hashes"), np.uint64), _unpack(t.column("more"), np.uint8)
        seen, n = np.unique(np.concatenate([hashes, hashes[more > 0]]), return_counts=True)
        keep = found(hashes, seen[n > 1])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        chunk = t.column("chunk").to_pylist()
        rows = [(c, 0, hashes[a:b][keep[a:b]].tobytes()) for c, a, b in zip(chunk, cuts[:-1], cuts[1:]) if keep[a:b].any()]
        yield _batch(rows, ["_chunk", "kind", "hashes"], [pa.int64(), pa.int32(), pa.binary()])

    reply = "_chunk long, kind int, hashes binary"
    seeds = table.select("_chunk", "_text").mapInArrow(send_seeds, "range int, chunk long, hashes binary, more binary")
    seeds = scratch.table(seeds.repartitionById(ranges, F.col("range")).mapInArrow(repeated_seeds, reply), "seeds")

    def known(answers: pa.Table, kind: int, dtype) -> np.ndarray:
        mine = answers.filter(pa.array(answers.column("kind").to_numpy() == kind))
        return _unpack(mine.column("hashes"), dtype)

    def send_windows(key, texts, answers):
        seeds, out = np.unique(known(answers, 0, np.uint64)), []
        raw, offs = text_bytes(texts.column("_text"))
        late, rank = texts.column("_late").to_numpy().astype(np.uint8), texts.column("_rank").to_numpy()
        for lo, hi in slices(offs):
            s = Slice(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], window)
            place, a, b = s.windows(seeds)
            doc = lo + np.searchsorted(s.at, place, "right") - 1
            out.append((a, b, late[doc], rank[doc]))
        a, b, late, rank = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint8, np.int64))
        order = np.lexsort((rank, late, b, a))
        a, b, late, rank = a[order], b[order], late[order], rank[order]
        first = _first_of_equal(a, b)
        rows = _pack(key[0].as_py(), ranges, a[first], b[first], late[first], rank[first])
        return pa.Table.from_batches([_batch(rows, ["range", "chunk", "a", "b", "late", "rank"], [pa.int32(), pa.int64(), *[pa.binary()] * 4])])

    def elsewhere(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        sizes = [len(x) for x in t.column("late").to_pylist()]
        a, b, late, rank = (_unpack(t.column(c), d) for c, d in (("a", np.uint64), ("b", np.uint32), ("late", np.uint8), ("rank", np.int64)))
        order = np.lexsort((rank, late, b, a))
        earlier = np.zeros(len(a), bool)
        earlier[order] = ~_first_of_equal(a[order], b[order])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        chunk = t.column("chunk").to_pylist()
        rows = [(c, 1, _both(a[x:y][earlier[x:y]], b[x:y][earlier[x:y]]).tobytes()) for c, x, y in zip(chunk, cuts[:-1], cuts[1:]) if earlier[x:y].any()]
        yield _batch(rows, ["_chunk", "kind", "hashes"], [pa.int64(), pa.int32(), pa.binary()])

    grouped = table.groupBy("_chunk")
    windows = grouped.cogroup(seeds.groupBy("_chunk")).applyInArrow(send_windows, "range int, chunk long, a binary, b binary, late binary, rank binary")
    first = scratch.table(windows.repartitionById(ranges, F.col("range")).mapInArrow(elsewhere, reply), "first")

    def cut(key, texts, answers):
        texts = texts.sort_by([("_late", "ascending"), ("_rank", "ascending"), ("_text", "ascending")])
        seeds, away = np.unique(known(answers, 0, np.uint64)), known(answers, 1, _WINDOW)
        raw, offs = text_bytes(texts.column("_text"))
        docs_, hashes, bounds = [], [], []
        for lo, hi in slices(offs):
            s = Slice(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], window)
            place, a, b = s.windows(seeds)
            hashes.append(_both(a, b))
            docs_.append(np.stack([lo + np.searchsorted(s.at, place, "right") - 1, place - s.at[np.searchsorted(s.at, place, "right") - 1]]))
            bounds.append(np.diff(s.at))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, _WINDOW)
        where = np.concatenate(docs_, 1) if docs_ else np.zeros((2, 0), np.int64)
        n_words = np.concatenate(bounds) if bounds else np.zeros(0, np.int64)
        # what starts earlier elsewhere comes before all of this chunk's
        a, b = (np.concatenate([away[c], hashes[c]]) for c in ("a", "b"))
        order = np.lexsort((np.arange(len(a)), b, a))
        gone = np.empty(len(a), bool)
        gone[order] = ~_first_of_equal(a[order], b[order])
        gone = gone[len(away) :]
        where = where[:, gone]
        cuts = np.searchsorted(where[0], np.arange(len(n_words) + 1))
        spans, kept = [], []
        body = raw.tobytes()
        for i in range(len(n_words)):
            parts = body[offs[i] : offs[i + 1]].split()
            if cuts[i] == cuts[i + 1]:
                spans.append([])
                kept.append(b" ".join(parts))
                continue
            at = where[1, cuts[i] : cuts[i + 1]]
            breaks = np.flatnonzero(at[1:] > at[:-1] + window)
            lo = at[np.concatenate([[0], breaks + 1])]
            hi = at[np.concatenate([breaks, [len(at) - 1]])] + window
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            left = [p for x, y in zip(np.concatenate([[0], hi]), np.concatenate([lo, [len(parts)]])) for p in parts[x:y]]
            kept.append(b" ".join(left))
        n_removed = [sum(s["end"] - s["start"] for s in x) for x in spans]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.Table.from_arrays(
            [texts.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], ["_id", "n_words", "n_removed", "spans", "text"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    answers = seeds.unionByName(first)
    out = table.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(cut, f"_id {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, text string")
    return out.withColumnRenamed("_id", id_col)
