"""Chains of feed pages as a stream source, whose offsets are the pages' continuation marks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sinks import _file_system

SCHEMA = "chain string, mark string, value string"
#: The first page of a chain; a mark has no = after quoting.
FIRST = "=first.json"
_HEAD_BYTES = 4096
#: Texts of Parquet files that a task reads.
_TASK_BYTES = 64 << 20
_ROWS_EACH = 512
#: A page's continuation, where only fields with plain values come before it.
_HEAD = re.compile(r'\s*\{(?:\s*"(?:[^"\\]|\\.)*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^\s"\[{,}]+)\s*,)*?\s*"continuation"\s*:\s*("(?:[^"\\]|\\.)*"|null)\s*[,}]')


def page_path(chain: str, mark: str) -> str:
    """Where the page of a mark is, below the folder of all chains; the mark '' is that of a chain's first page."""
    return f"{chain}/{quote(mark, safe='')}.json" if mark else f"{chain}/{FIRST}"


def paged_stream(spark: SparkSession, path: str, marks: str | None = None, pages_per_task: int = 64) -> DataFrame:
    """(chain, mark, value): pages as they come, each one once.

    path/CHAIN holds the pages of a chain, one JSON object in each file: first ``=first.json``, then the page that ``continuation`` of
    the one before names, URL-quoted, with ``.json``. A chain may be a feed, or a list of feeds that are fetched one after another. Its offset is the mark
    of the page that comes next, so a stream that was stopped goes on there, also if that page isn't there yet. A page without continuation ends its
    chain, as does one that is no JSON (``parse_pages`` gives no row for it); a page that names one that its batch has read is an error. Pages don't change.

    Many pages of a chain, in any order, may be rows of one Parquet file (mark, continuation, value) anywhere below path/CHAIN; the mark of the first
    one is '' or null. A chain's pages may be in files of both kinds; of a page that is in several files one counts.

    The driver reads two columns of the Parquet files, and the first 4 KB of each new page that is a file of its own for its mark (the whole page, if lists
    come before its continuation), chains side by side; the pages themselves are read by tasks of up to ``pages_per_task`` such files, or of 64 MB of
    row groups, so a long chain is many tasks. Files all of whose pages have been reached are not read for their marks again. An
    offset has one mark for each chain. ``marks`` names a file of the stream's own where the marks it has reached are kept, else it follows all chains
    from their first page when it starts again (the result is the same).
    """
    spark.dataSource.register(PagedFiles)
    reader = spark.readStream.format(PagedFiles.name()).option("path", path).option("pages", pages_per_task)
    return (reader.option("marks", marks) if marks else reader).load()


class PagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linkloom_paged"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options["path"].rstrip("/"), self.options.get("marks"), int(self.options["pages"]))


@dataclass
class Pages(InputPartition):
    """(chain, mark) of the pages of a task that are files; (chain, file, row group, its rows or None for all) of the others."""

    pages: list[tuple[str, str]]
    rows: list[tuple[str, str, int, np.ndarray | None]] = field(default_factory=list)


@dataclass
class Bundles:
    """The pages of a chain's Parquet files: marks, the place of the page that each one names (-1: not in these files), what it names, file and row."""

    marks: pa.Array
    after: np.ndarray
    names: pa.Array
    file: np.ndarray
    row: np.ndarray
    files: list[str]


class PagedReader(DataSourceStreamReader):
    """Offsets: for each chain the mark of its next page, null at its end; chains that an offset lacks haven't begun."""

    def __init__(self, root: str, marks: str | None, pages: int):
        self.root, self.marks, self.pages = root, marks, pages
        self.reached: dict[str, str | None] | None = None
        self.whole: dict[str, set[str]] = {}
        self.last: dict[tuple[str, str | None], tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The chains are followed from what was reached before, which is no later than where the stream is."""
        known = self._kept() if self.reached is None else self.reached
        chains = self._chains()
        found = self._each(lambda chain: self._follow(chain, known.get(chain, "")), chains)
        self.last = {(c, known.get(c, "")): f for c, f in zip(chains, found)}
        self.reached = {**known, **{c: f[2] for c, f in zip(chains, found)}}
        return self.reached

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        moved = [c for c in sorted(end) if end[c] != start.get(c, "")]

        def between(chain: str) -> tuple:
            kept = self.last.get((chain, start.get(chain, "")))
            return kept if kept and kept[2] == end[chain] else self._follow(chain, start.get(chain, ""), end[chain])

        found = self._each(between, moved)
        pages = [(chain, mark) for chain, (marks, _, _) in zip(moved, found) for mark in marks]
        out, size = [Pages(pages[i : i + self.pages]) for i in range(0, len(pages), self.pages)], _TASK_BYTES
        for chain, (_, files, _) in zip(moved, found):
            for file, rows in files:
                for group, n_bytes, own in self._groups(file, rows):
                    if size >= _TASK_BYTES:
                        out.append(Pages([], []))
                        size = 0
                    out[-1].rows.append((chain, file, group, own))
                    size += n_bytes
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(self.root)
        for chain, mark in partition.pages:
            with fs.open_input_stream(f"{base}/{page_path(chain, mark)}", compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.record_batch([pa.array([v], pa.string()) for v in (chain, mark, text)], names=["chain", "mark", "value"])
        for chain, file, group, rows in partition.rows:
            with fs.open_input_file(file) as f:
                table = pq.ParquetFile(f).read_row_group(group, columns=["mark", "value"])
            table = table if rows is None else table.take(pa.array(rows))
            for batch in table.to_batches(max_chunksize=_ROWS_EACH):
                mark, value = batch["mark"].cast(pa.string()).fill_null(""), batch["value"].cast(pa.string())
                yield pa.record_batch([pa.array([chain] * len(batch), pa.string()), mark, value], names=["chain", "mark", "value"])

    def commit(self, end: dict) -> None:
        if self.marks:
            fs, at = _file_system(self.marks)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{at}.new") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{at}.new", at)

    def _kept(self) -> dict:
        if self.marks:
            fs, at = _file_system(self.marks)
            try:
                with fs.open_input_stream(at, compression=None) as f:
                    return json.loads(f.read())
            except FileNotFoundError:
                pass
        return {}

    def _chains(self) -> list[str]:
        import pyarrow.fs as pafs

        fs, base = _file_system(self.root)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory and not i.base_name.startswith(("_", ".")))

    def _each(self, what, chains: list[str]) -> list:
        if not chains:
            return []
        with ThreadPoolExecutor(min(32, len(chains))) as pool:
            return list(pool.map(what, chains))

    def _follow(self, chain: str, mark: str | None, end: str | None = "") -> tuple[list[str], list[tuple[str, np.ndarray]], str | None]:
        """(marks of the pages that are files, rows of the Parquet files, the mark after them) from mark up to end; without an end up to a page that
        isn't there. '' is no end, as no page leads to a chain's first one."""
        found: list[str] = []
        if mark is None or (mark == end and mark != ""):
            return found, [], mark
        held = self._bundles(chain, skip=self.whole.setdefault(chain, set()) if end == "" else set())
        at, taken, seen = self._place(held, mark), np.zeros(len(held.after), bool), set()
        stop = self._place(held, end) if end else -1
        after = held.after.tolist()
        while True:
            while at >= 0 and (at != stop or stop < 0):
                if taken[at]:
                    raise ValueError(f"the pages of chain {chain} lead back to {held.marks[at].as_py() or 'the first one'}")
                taken[at], last, at = True, at, after[at]
                mark = None if at >= 0 else held.names[last].as_py() or None
            mark = held.marks[at].as_py() if at >= 0 else mark
            if mark is None or (mark == end and mark != ""):
                break
            if mark in seen:
                raise ValueError(f"the pages of chain {chain} lead back to {mark or 'the first one'}")
            try:
                following = self._continuation(chain, mark)
            except FileNotFoundError:
                if end != "":
                    raise
                break
            seen.add(mark)
            found.append(mark)
            mark = following
            if mark is None or mark == end:
                break
            at = self._place(held, mark)
            if at >= 0 and taken[at]:
                raise ValueError(f"the pages of chain {chain} lead back to {mark}")
        files = []
        for i, file in enumerate(held.files):
            own = held.file == i
            if (taken & own).any():
                files.append((file, np.sort(held.row[taken & own])))
        if end == "":
            self.whole[chain] |= {file for i, file in enumerate(held.files) if taken[held.file == i].all()}
        return found, files, mark

    def _place(self, held: Bundles, mark: str) -> int:
        return pc.index(held.marks, pa.scalar(mark, pa.string())).as_py()

    def _bundles(self, chain: str, skip: set[str]) -> Bundles:
        import pyarrow.fs as pafs

        fs, base = _file_system(self.root)
        listed = fs.get_file_info(pafs.FileSelector(f"{base}/{chain}", allow_not_found=True, recursive=True))
        files = sorted(i.path for i in listed if i.path.endswith(".parquet") and not i.base_name.startswith(("_", ".")) and i.path not in skip)
        tables = []
        for file in files:
            with fs.open_input_file(file) as f:
                tables.append(pq.read_table(f, columns=["mark", "continuation"]))
        text = lambda name: pa.chunked_array([c for t in tables for c in t[name].cast(pa.string()).chunks], pa.string()).combine_chunks()
        marks, names = text("mark").fill_null(""), text("continuation").fill_null("")
        after = pc.index_in(names, value_set=marks)  # the first one of equal marks
        after = pc.if_else(pc.equal(names, ""), -1, after.fill_null(-1)).to_numpy(zero_copy_only=False)
        number = [t.num_rows for t in tables]
        row = np.concatenate([np.arange(n) for n in number]) if number else np.zeros(0, int)
        return Bundles(marks, after, names, np.repeat(np.arange(len(files)), number), row, files)

    def _groups(self, file: str, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(row group, bytes, rows of it, None for all) of the rows of a file."""
        with _file_system(self.root)[0].open_input_file(file) as f:
            found = pq.ParquetFile(f).metadata
        first = 0
        for group in range(found.num_row_groups):
            shape = found.row_group(group)
            own = rows[np.searchsorted(rows, first) : np.searchsorted(rows, first + shape.num_rows)] - first
            if len(own):
                yield group, shape.total_byte_size, None if len(own) == shape.num_rows else own
            first += shape.num_rows

    def _continuation(self, chain: str, mark: str) -> str | None:
        fs, base = _file_system(self.root)
        with fs.open_input_stream(f"{base}/{page_path(chain, mark)}", compression=None) as f:
            head = f.read(_HEAD_BYTES)
            if m := _HEAD.match(head.decode("utf-8", "ignore")):
                return json.loads(m[1], strict=False) or None
            try:
                page = json.loads(head + f.read(), strict=False)
            except ValueError:
                return None
        after = page.get("continuation") if isinstance(page, dict) else None
        return str(after) if after else None
