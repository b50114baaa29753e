"""Files: template-routed lines, CSV and JSON; GraphML; compressed JSON lines."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .folders import new_folder, written


def _file_system(root: str):
    """(file system, its path of root): a local or mounted folder, or any store by pyarrow's file systems."""
    import pyarrow.fs as pafs

    if "://" in root and not root.startswith("file://"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root.removeprefix("file://")


def _csv_line(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if pd.isna(v) else v for v in values])
    return out.getvalue()


def numbered_path(path: Column, part: Column) -> Column:
    """a/b.txt, 3 -> a/b.3.txt; part 0 is the file itself."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    at = F.when(F.locate(".", name, 2) > 0, F.length(path) - F.length(name) + F.locate(".", name, 2) - 1).otherwise(F.length(path))
    numbered = F.concat(F.substring(path, F.lit(1), at), F.lit("."), part.cast("string"), F.substring(path, at + 1, F.length(path)))
    return F.when(part == 0, path).otherwise(numbered)


def write_by_path(rows: DataFrame, root: str, format: str = "lines", partitions: int | None = None, parts: int = 1) -> DataFrame:
    """Writes rows to the file in their ``_path`` under root; gives (_path, n_rows) of the files.

    All rows of a file are in one task, sorted, so a file is written once and has one CSV header. Tasks write to a folder of the run,
    each attempt to names of its own; the files get their names when all tasks have ended, so what failed, or ran twice, leaves
    nothing, and a run that fails as a whole changes no file. A file that would be too large for a task is dealt by a hash of its rows to ``parts``
    files, each of them a whole file of its own: all.csv, all.1.csv, all.2.csv. lines: the first column; csv: all columns; json: one object per
    file, keyed by the first column and written as it comes; of rows with one key the last counts. Root is a folder that executors share.
    """
    columns = [c for c in rows.columns if c != "_path"]
    if parts > 1:
        dealt_by = [F.col(f"`{columns[0]}`")] if format == "json" else [F.col(f"`{c}`") for c in columns]
        rows = rows.withColumn("_path", numbered_path(F.col("_path"), F.pmod(F.xxhash64(*dealt_by), F.lit(parts))))
    dealt = rows.repartition(partitions, "_path") if partitions else rows.repartition("_path")
    ready = dealt.sortWithinPartitions("_path", *[f"`{c}`" for c in columns]).select(*[f"`{c}`" for c in columns], "_path")
    spark, listed = rows.sparkSession, new_folder(rows.sparkSession, "files")
    spark.dataSource.register(RoutedFiles)
    ready.write.format(RoutedFiles.name()).mode("append").options(root=root, listed=listed, form=format).save()
    return spark.read.schema("_path string, n_rows long").parquet(listed)


class RoutedFiles(DataSource):
    """A sink of files whose names are in the last column; options: root, form, and listed, where the list of files goes."""

    @classmethod
    def name(cls) -> str:
        return "linkloom_routed"

    def writer(self, schema: T.StructType, overwrite: bool) -> RoutedWriter:
        return RoutedWriter(self.options["root"], self.options["listed"], self.options["form"], [f.name for f in schema][:-1])


@dataclass
class Routed(WriterCommitMessage):
    """(name, the attempt's file, rows) of a task."""

    files: list[tuple[str, str, int]]


class RoutedWriter(DataSourceArrowWriter):
    def __init__(self, root: str, listed: str, form: str, columns: list[str]):
        self.root, self.listed, self.form, self.columns, self.run = root, listed, form, columns, f"_attempts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Routed:
        fs, base = _file_system(self.root)
        folder, form, columns = f"{base}/{self.run}/{uuid.uuid4().hex}", self.form, self.columns
        fs.create_dir(folder, recursive=True)
        at, out, n, done, held = None, None, 0, [], None

        def put(last):
            """The object of the key before, when the next key comes or the file ends."""
            if held is not None:
                out.write(f"{json.dumps(held[0], ensure_ascii=False)}: {json.dumps(held[1], ensure_ascii=False)}{'' if last else ', '}")

        def finish():
            if out is not None:
                if form == "json":
                    put(True)
                    out.write("}")
                out.close()
                done.append((at, f"{folder}/{len(done)}", n))

        for batch in iterator:
            for record in batch.to_pandas().astype(object).itertuples(index=False, name=None):
                values, path = record[:-1], record[-1]
                if path != at:
                    finish()
                    at, n, held = path, 0, None
                    out = io.TextIOWrapper(fs.open_output_stream(f"{folder}/{len(done)}"), encoding="utf-8", newline="")
                    if form == "csv":
                        out.write(_csv_line(columns))
                    elif form == "json":
                        out.write("{")
                if form == "lines":
                    out.write(f"{values[0]}\n")
                elif form == "csv":
                    out.write(_csv_line(list(values)))
                else:
                    if held is not None and held[0] != str(values[0]):
                        put(False)
                    held = (str(values[0]), dict(zip(columns[1:], [None if pd.isna(v) else v for v in values[1:]])))
                n += 1
        finish()
        return Routed(done)

    def commit(self, messages: list[Routed | None]) -> None:
        """Gives the files of the attempts that count their names; the others go with the run's folder."""
        fs, base = _file_system(self.root)
        files = [f for m in messages if m for f in m.files]
        for folder in sorted({f"{base}/{name}".rsplit("/", 1)[0] for name, _, _ in files}):
            fs.create_dir(folder, recursive=True)
        for name, attempt, _ in files:
            fs.move(attempt, f"{base}/{name}")
        self._clean(fs, base)
        to, folder = _file_system(self.listed)
        to.create_dir(folder, recursive=True)
        pq.write_table(pa.table({"_path": pa.array([f[0] for f in files], pa.string()), "n_rows": pa.array([f[2] for f in files], pa.int64())}), f"{folder}/files.parquet", filesystem=to)

    def abort(self, messages: list[Routed | None]) -> None:
        self._clean(*_file_system(self.root))

    def _clean(self, fs, base: str) -> None:
        import pyarrow.fs as pafs

        if fs.get_file_info(f"{base}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.run}")


def hand_on(spark: SparkSession, written: str, root: str) -> None:
    """Moves each folder below ``written`` into the folder of the same name below root, as a whole and under a name of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{written}/*")) or []:
        if status.isDirectory():
            to = path(f"{root}/{status.getPath().getName()}")
            fs.mkdirs(to)
            fs.rename(status.getPath(), path(to, uuid.uuid4().hex[:12]))


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) of a GraphML document, built by expressions: keys, nodes by name, edges. Attribute columns of vertices are all
    but name; of edges all but source and target."""
    spark = vertices.sparkSession
    kind = lambda t: {"bigint": "long", "int": "int", "double": "double", "boolean": "boolean"}.get(t, "string")
    keys = [(f"v_{n}", "node", n, kind(t)) for n, t in vertices.dtypes if n != "name"] + [(f"e_{n}", "edge", n, kind(t)) for n, t in edges.dtypes if n not in ("source", "target")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f"<key id={quoteattr(i)} for={quoteattr(f)} attr.name={quoteattr(n)} attr.type={quoteattr(t)}/>" for i, f, n, t in keys]
    head.append('<graph id="G" edgedefault="directed">')

    def xml(c):
        out = c.cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    def data(prefix, names):
        return F.concat(F.lit(""), *[F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(f'<data key="{escape(prefix + n)}">'), xml(F.col(f"`{n}`")), F.lit("</data>"))).otherwise("") for n in names])

    nodes = vertices.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml(F.col("name")), F.lit('">'), data("v_", [n for n in vertices.columns if n != "name"]), F.lit("</node>")).alias("line"))
    links = edges.select(
        F.lit(2).alias("part"),
        F.concat(F.lit('<edge source="'), xml(F.col("source")), F.lit('" target="'), xml(F.col("target")), F.lit('">'), data("e_", [n for n in edges.columns if n not in ("source", "target")]), F.lit("</edge>")).alias("line"),
    )
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph></graphml>")], "part int, n int, line string")
    return frame.select("part", F.format_string("%04d%s", "n", "line").alias("line")).unionByName(nodes).unionByName(links)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text parts that are one GraphML document when read in the order of their names."""
    lines = graphml_lines(vertices, edges).repartitionByRange("part", "line").sortWithinPartitions("part", "line")
    lines.select(F.when(F.col("part").isin(0, 3), F.substring("line", 5, 1 << 30)).otherwise(F.col("line")).alias("value")).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON lines, compressed."""
    rows.write.mode("overwrite").json(path, compression=compression)


def report_lines(report: DataFrame) -> DataFrame:
    """(part, name, line) of the uncharted report as one JSON object by domain; the first domain's line has no comma before it."""
    first = report.agg(F.min("name").alias("_first"))
    body = F.concat(F.to_json(F.struct(F.col("name").alias("k"))), F.lit(""))
    key = F.regexp_extract(body, r'^\{"k":(.*)\}$', 1)
    value = F.to_json(F.struct("page_count", "keywords", "referrers"))
    comma = F.when(F.col("name") == F.col("_first"), "").otherwise(",")
    lines = report.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "name", F.concat(comma, key, F.lit(":"), value).alias("line"))  # one row
    ends = report.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, name string, line string")
    return ends.unionByName(lines)


def write_report(report: DataFrame, path: str) -> None:
    """The uncharted report: a folder of text parts that are one JSON document when read in the order of their names."""
    ready = report_lines(report).repartitionByRange("part", "name").sortWithinPartitions("part", "name")
    ready.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def uncharted_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, name, section, key, line) of the uncharted report from its long tables (``plans.exports.uncharted``): read in that
    order, the lines are one JSON object by domain. Each keyword and referrer is a line, so no domain is a row."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    named = lambda df: df.select(F.concat(F.lit("http://"), F.col("domain")).alias("name"), *[c for c in df.columns if c != "domain"])
    pages = named(parts["pages"])
    first = pages.agg(F.min("name").alias("_first"))  # one row
    begin = F.concat(F.when(F.col("name") == F.col("_first"), "").otherwise(","), text(F.col("name")), F.lit(':{"page_count":'), F.col("page_count").cast("string"), F.lit(',"keywords":{'))
    fixed = lambda section, line: pages.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "name", F.lit(section).alias("section"), F.lit("").alias("key"), line.alias("line"))

    def entries(table, column, section, prefix):
        rows = named(table).select("name", F.concat(F.lit(prefix), F.col(column)).alias("key"), "n")
        least = rows.groupBy("name").agg(F.min("key").alias("_least"))
        line = F.concat(F.when(F.col("key") == F.col("_least"), "").otherwise(","), text(F.col("key")), F.lit(":"), F.col("n").cast("string"))
        return rows.join(least, "name").select(F.lit(1).alias("part"), "name", F.lit(section).alias("section"), "key", line.alias("line"))

    ends = pages.sparkSession.createDataFrame([(0, "", 0, "", "{"), (2, "", 0, "", "}")], "part int, name string, section int, key string, line string")
    bodies = (fixed(0, begin), entries(parts["keywords"], "keyword", 1, ""), fixed(2, F.lit('},"referrers":{')), entries(parts["referrers"], "referrer", 3, "http://"), fixed(4, F.lit("}}")))
    for body in bodies:
        ends = ends.unionByName(body)
    return ends


def write_uncharted(parts: dict[str, DataFrame], path: str) -> None:
    """The uncharted report: a folder of text parts that are one JSON document when read in the order of their names."""
    order = ["part", "name", "section", "key"]
    # counts by domain are worked out once: the lines read each table several times, and ranges take a pass of their own
    parts = {name: written(df, name) for name, df in parts.items()}
    uncharted_lines(parts).repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
