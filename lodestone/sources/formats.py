"""Workbooks, documents and report files as Spark data sources: ``spark.read.format("workbooks")``, ``"word_documents"``, ``df.write.format("report_file")``.

``register`` makes them known. Files are opened where pyarrow can open them by address, and only the parts that a task needs are read: a
task has one sheet of a workbook, so a workbook of many sheets is spread. For stores that only Spark can open there are the readers of ``office``.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from lodestone.plans.numbering import numbered
from lodestone.plans.tables import written
from lodestone.sources import ooxml

#: Rows of a batch, and workbooks up to which the driver lists sheets; of more, each is one task.
BATCH_ROWS, LISTED = 10_000, 1000
CELLS = "path string, sheet_no long, sheet string, row long, col long, value string, error string"
PARAGRAPHS = "path string, ord long, kind string, table long, row long, col long, paragraph long, list_style boolean, text string, error string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def files_at(path: str, extension: str) -> list[str]:
    """Addresses of the files with an extension at or below a path, hidden ones left out."""
    fs, base = _opened(path)
    start = path[: len(path) - len(base)] if path.endswith(base) else "file://"
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
    return [start + f.path for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.base_name.lower().endswith("." + extension) and f.base_name[0] != "."]


@dataclass
class _Part(InputPartition):
    path: str
    sheet: int | None = None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def cell_rows(path: str, file, sheet: int | None = None) -> Iterator[tuple]:
    """Rows of CELLS of a workbook, or of one of its sheets; a workbook that can't be read ends with a row with ``error``."""
    try:
        with zipfile.ZipFile(file) as z:
            shared = ooxml.shared_strings(z)
            for no, name, part in ooxml.sheets(z):
                if sheet is None or no == sheet:
                    for row, col, value in ooxml.cells(z, part, shared):
                        yield path, no, name, row, col, value, None
    except ooxml.BROKEN as e:
        yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"


def paragraph_rows(path: str, file) -> Iterator[tuple]:
    """Rows of PARAGRAPHS of a document; one that can't be read ends with a row with ``error``."""
    try:
        with zipfile.ZipFile(file) as z:
            for n, p in enumerate(ooxml.paragraphs(z)):
                yield path, n, *p, None
    except ooxml.BROKEN as e:
        yield path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


class _Cells(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.sheet_no, self.sheet = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet_no",):
                self.sheet_no = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("sheet",):
                self.sheet = f.value
            else:
                yield f

    def _wanted(self, no: int, name: str) -> bool:
        return (self.sheet_no is None or no == self.sheet_no) and (self.sheet is None or name == self.sheet)

    def partitions(self) -> list[_Part]:
        files = files_at(self.path, "xlsx")
        if len(files) > LISTED and self.sheet_no is None and self.sheet is None:
            return [_Part(f) for f in files]
        out = []
        for path in files:
            fs, base = _opened(path)
            try:
                with fs.open_input_file(base) as f, zipfile.ZipFile(f) as z:
                    out += [_Part(path, no) for no, name, _ in ooxml.sheets(z) if self._wanted(no, name)]
            except ooxml.BROKEN:
                if self.sheet_no is None and self.sheet is None:
                    out.append(_Part(path))
        return out or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            fs, base = _opened(partition.path)
            with fs.open_input_file(base) as f:
                yield from _batches(cell_rows(partition.path, f, partition.sheet), _arrow(CELLS))


class _Paragraphs(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in files_at(self.path, "docx")] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            fs, base = _opened(partition.path)
            with fs.open_input_file(base) as f:
                yield from _batches(paragraph_rows(partition.path, f), _arrow(PARAGRAPHS))


class Workbooks(DataSource):
    """path, sheet_no, sheet, row, col, value, error of the .xlsx files at ``path``; a filter on one sheet reads no other."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Cells(self.options["path"])


class WordDocuments(DataSource):
    """path, ord, kind, table, row, col, paragraph, list_style, text, error of the .docx files at ``path``."""

    @classmethod
    def name(cls) -> str:
        return "word_documents"

    def schema(self) -> str:
        return PARAGRAPHS

    def reader(self, schema) -> DataSourceReader:
        return _Paragraphs(self.options["path"])


# --- one ordered file --------------------------------------------------------------------------------------------------


@dataclass
class _Wrote(WriterCommitMessage):
    size: int


class _Report(DataSourceWriter):
    """Tasks write their rows(at, line) at their places in a hidden file, so a task that runs twice writes the same bytes; the file gets its name when all are done."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.draft = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(self.draft, "wb") as f:
            f.truncate(size)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        size = 0
        with open(self.draft, "r+b") as f:
            for row in iterator:
                raw = row["line"].encode() + b"\n"
                f.seek(row["at"])
                f.write(raw)
                size += len(raw)
            f.flush()
            os.fsync(f.fileno())
        return _Wrote(size)

    def commit(self, messages: list) -> None:
        wrote = sum(m.size for m in messages if m is not None)
        if wrote != self.size:
            self.abort(messages)
            raise OSError(f"{wrote} of {self.size} bytes of the report were written")
        try:
            os.link(self.draft, self.path)  # fails where there is such a file
        finally:
            os.unlink(self.draft)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.draft):
            os.unlink(self.draft)


class ReportFile(DataSource):
    """Lines as one file in a folder that all executors have: rows(at, line), ``at`` being the line's first byte; options path and size."""

    @classmethod
    def name(cls) -> str:
        return "report_file"

    def schema(self) -> str:
        return "at long, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Report(self.options["path"], int(self.options["size"]))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Workbooks, WordDocuments, ReportFile):
        spark.dataSource.register(source)


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = ("position",)) -> str:
    """Writes lines(line, …) in an order as one UTF-8 file at ``path`` (a folder that all executors have); one that exists is an error.

    Places are prefix sums of the lines' bytes; tasks write their own ranges, and what a failed job leaves is a hidden file that is deleted.
    """
    path = path.removeprefix("file://")
    if os.path.exists(path):
        raise FileExistsError(path)
    spark = lines.sparkSession
    rows = lines.select(*order, F.coalesce("line", F.lit("")).alias("line")).withColumn("_bytes", F.octet_length("line").cast("long") + 1)
    placed = written(numbered(rows, list(order), name="_end", of=F.col("_bytes")), "lines")
    size = placed.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    register(spark)
    placed.select((F.col("_end") - F.col("_bytes")).alias("at"), "line").write.format("report_file").option("size", size).mode("append").save(path)
    return path
