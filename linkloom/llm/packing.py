"""Bounded-space online packing of token ids into sequences of a fixed length."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import LOWER, word_hashes, words
from .runtime import Scratch, slices, text_bytes

#: A piece: document id, its first token's number in the document, ids (uint32), the document's tokens.
Piece = tuple[object, int, np.ndarray, int]


class Windows:
    """A fixed number of open windows. A piece goes where it fits best; if it fits nowhere, the fullest window is
    emitted. A gap of at least ``min_cut`` tokens in that window is first filled with the head of the piece."""

    def __init__(self, length: int, open_windows: int, min_cut: int):
        self.length, self.min_cut = length, min_cut
        self.free = np.full(open_windows, length, np.int64)
        self.held: list[list[Piece]] = [[] for _ in range(open_windows)]

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece; yields the windows that are thereby emitted."""
        doc, start, ids, n = piece
        while len(ids) >= self.length:  # whole sequences need no place
            yield [(doc, start, ids[: self.length], n)]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = np.flatnonzero(self.free >= len(ids))
            if len(fits):
                at = int(fits[np.argmin(self.free[fits])])
                self.held[at].append((doc, start, ids, n))
                self.free[at] -= len(ids)
                if self.free[at] == 0:
                    yield self.take(at)
                return
            at = int(np.argmin(self.free))
            gap = int(self.free[at])
            if gap >= self.min_cut:
                self.held[at].append((doc, start, ids[:gap], n))
                start, ids = start + gap, ids[gap:]
            yield self.take(at)

    def take(self, at: int) -> list[Piece]:
        out, self.held[at], self.free[at] = self.held[at], [], self.length
        return out

    def left(self) -> list[list[Piece]]:
        return [w for w in self.held if w]


def filled(pieces: list[Piece], length: int) -> Iterator[list[Piece]]:
    """Sequences filled one after another, pieces cut where one ends: all but the last are full."""
    window, room = [], length
    for doc, start, ids, n in pieces:
        while len(ids):
            part = ids[:room]
            window.append((doc, start, part, n))
            start, ids, room = start + len(part), ids[len(part) :], room - len(part)
            if room == 0:
                yield window
                window, room = [], length
    if window:
        yield window


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("."), ord(",")]] = True
_KNOWN: dict[tuple, WordIds] = {}


def _before(lengths: np.ndarray) -> np.ndarray:
    """n+1 offsets of parts that lie one after another."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places in the ranges that start at starts[i] and have lengths[i] places."""
    before = _before(lengths)
    return np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])


class _Pool:
    """An array that grows."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> int:
        """Where they lie from now on."""
        at = self.used
        if at + len(more) > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(max(len(more), len(self.data) // 2) + 1, self.data.dtype)])
        self.data[at : at + len(more)] = more
        self.used += len(more)
        return at


class WordIds:
    """Ids of whole texts, for a tokenizer that lower-cases, drops white space and merges nothing across it, nor
    across the border of a letter or digit and a full stop or comma: a text's ids are its words' ids one after
    another. Each distinct word is encoded once and found again by its 64-bit hash in a sorted array, and its bytes are
    compared with those of the word that was encoded, so a clash of hashes changes no ids: texts with one are encoded by
    themselves. At most ``most`` words, about 50 bytes each, are kept in a Python worker."""

    def __init__(self, path: str, end_id: int | None, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        self.encode, self.end_id, self.most = getattr(encoder, "encode_batch_fast", encoder.encode_batch), end_id, most
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.bytes = _Pool(np.uint32), _Pool(np.uint8)
        self.spelled, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and how many each has."""
        text = raw.tobytes()
        listed = [text[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())]
        flat, lengths = array("I"), []
        for lo in range(0, len(listed), 10_000):
            for e in self.encode(listed[lo : lo + 10_000], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                lengths.append(len(ids))
        return np.frombuffer(flat, np.uint32) if len(flat) else np.zeros(0, np.uint32), np.array(lengths, np.int64)

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes words that aren't known; hashes are sorted."""
        flat, lengths = self._encoded(raw, starts, ends)
        at = self.pool.add(flat) + _before(lengths)[:-1]
        size = ends - starts
        spelled = self.bytes.add(raw[_ranges(starts, size)]) + _before(size)[:-1]
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.length = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.length, place, lengths)
        self.spelled, self.size = np.insert(self.spelled, place, spelled), np.insert(self.size, place, size)

    def _same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray) -> bool:
        """Whether each word's bytes are those of the known word that its hash found."""
        size = ends - starts
        return bool((self.size[known] == size).all()) and bool((self.bytes.data[_ranges(self.spelled[known], size)] == raw[_ranges(starts, size)]).all())

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts raw[offsets[i]:offsets[i+1]], each with the end id."""
        if b"<|" not in raw.tobytes():  # a special token's name is told by its case
            raw = LOWER[raw]
        starts, ends, _ = words(raw, offsets)
        marked = _MARK[raw[ends - 1]] & (ends - starts > 1) & _ALNUM[raw[np.maximum(ends - 2, 0)]] if len(starts) else np.zeros(0, bool)
        place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(marked)])[:-1].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        a, b = np.empty(len(starts) + int(marked.sum()), np.int64), np.empty(len(starts) + int(marked.sum()), np.int64)
        a[place], b[place] = starts, ends - marked
        a[place[marked] + 1], b[place[marked] + 1] = ends[marked] - 1, ends[marked]
        hashes, first, which = np.unique(word_hashes(raw, a, b), return_index=True, return_inverse=True)
        found = np.searchsorted(self.hashes, hashes)
        new = (found >= len(self.hashes)) | (self.hashes[np.minimum(found, len(self.hashes) - 1)] != hashes) if len(self.hashes) else np.ones(len(hashes), bool)
        if len(self.hashes) + int(new.sum()) > self.most:
            self._clear()
            new = np.ones(len(hashes), bool)
        if new.any():
            self._learn(raw, hashes[new], a[first[new]], b[first[new]])
            found = np.searchsorted(self.hashes, hashes)
        known = found[which]
        if self._same(raw, a, b, known):
            length = self.length[known].astype(np.int64)
            flat = self.pool.data[_ranges(self.at[known], length)]
        else:
            flat, length = self._encoded(raw, a, b)
        before = _before(length)
        bounds = before[np.searchsorted(a, offsets)]
        tail = np.array([] if self.end_id is None else [self.end_id], np.uint32)
        return [np.concatenate([flat[lo:hi], tail]) for lo, hi in zip(bounds[:-1], bounds[1:])]


def word_tokenizer(path: str, end_id: int | None) -> WordIds:
    """Kept for all tasks of a Python worker."""
    if (path, end_id) not in _KNOWN:
        _KNOWN[path, end_id] = WordIds(path, end_id)
    return _KNOWN[path, end_id]


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("closed", pa.bool_())]
_SQL = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part int, closed boolean"


class _Rows:
    """Collects pieces as rows and gives them as Arrow batches."""

    def __init__(self, id_col: str, id_type: pa.DataType):
        self.names, self.types = [id_col, *[n for n, _ in _FIELDS]], [id_type, *[t for _, t in _FIELDS]]
        self.rows: list[tuple] = []

    def window(self, window: list[Piece], sequence: int, part: int, closed: bool) -> None:
        offset = 0
        for doc, start, ids, n in window:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset, part, closed))
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in self.names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], self.names)


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[np.ndarray, np.ndarray], list[np.ndarray]]], length: int = 2048, open_windows: int = 32, min_cut: int = 64, text: str = "text", id_col: str = "doc_id", merge_parts: int = 8) -> DataFrame:
    """A row for each piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    ``tokenizer()`` is called in each task and gives what turns UTF-8 bytes and offsets into ids. Each input partition packs its documents with ``open_windows``
    open windows. What is open at its end, at most open_windows * length tokens, is merged over groups of
    ``merge_parts`` partitions, so no task or driver gathers more than a fixed amount, and each group leaves one
    sequence that isn't full. Null text is an empty one; a document without ids gives no row; repeated ids and
    rows are packed one by one; other columns are ignored.
    """
    from pyspark import TaskContext

    scratch = Scratch(docs.sparkSession, "pack")
    id_field = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part, sequence, ids_of, windows, rows = TaskContext.get().partitionId(), 0, tokenizer(), Windows(length, open_windows, min_cut), None
        for batch in batches:
            rows = rows or _Rows(id_col, batch.column(0).type)
            ids, (raw, offs) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for lo, hi in slices(offs, 1 << 20):
                for doc, found in zip(ids[lo:hi], ids_of(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])):
                    for window in windows.add((doc, 0, found, len(found))):
                        rows.window(window, (part << 32) + sequence, part, True)
                        sequence += 1
                yield rows.batch()
        if rows:
            for window in windows.left():
                rows.window(window, (part << 32) + sequence, part, False)
                sequence += 1
            yield rows.batch()

    packed = scratch.table(docs.select(id_col, text).mapInArrow(run, f"{id_col} {id_field}, {_SQL}"), "packed")

    def merge(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = _Rows(id_col, table.schema.field(id_col).type)
        names = [id_col, "start", "ids", "doc_tokens"]
        pieces = [(d, s, np.frombuffer(b, "<u4"), n) for d, s, b, n in zip(*[table.column(c).to_pylist() for c in names])]
        for k, window in enumerate(filled(pieces, length)):
            rows.window(window, (1 << 62) + (key[0].as_py() << 32) + k, -1, True)
        return pa.Table.from_batches([rows.batch()])

    closed = packed.where("closed").drop("part", "closed")
    group = F.floor(F.col("part") / merge_parts).cast("long")
    left = packed.where(~F.col("closed")).groupBy(group.alias("_group")).applyInArrow(merge, f"{id_col} {id_field}, {_SQL}").drop("part", "closed")
    return closed.unionByName(left)
