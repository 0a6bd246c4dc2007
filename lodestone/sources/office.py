"""Requirements out of workbooks (.xlsx) and documents (.docx), as Spark reads their bytes.

Files are read by Spark's ``binaryFile`` source and streamed inside tasks (``ooxml``), one file per row, so any number of files is
spread over the executors; ``formats`` reads sheets of large workbooks apart. A file that can't be opened gives a row with ``error``.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.numbering import numbered
from lodestone.plans.scans import Run, scan
from lodestone.sources import formats
from lodestone.sources.files import demanded

MIN_LENGTH = 5
UPLOAD_BYTES = 10 * 1024 * 1024
# Column names, inline marks, and marks of lists and of breaks.
COLUMN_NAMES = ("Требование", "требование", "Requirement", "requirement", "Текст требования", "Описание", "Поля, обязательные для заполнения", "Суть", "Наименование", "Description")
INLINE_MARKS = ("(без комментария БА)", "[STATUS:", "[CITATION:", "[COMMENT:", "[RUN_ID:", "[CONFIDENCE:", "[Ref:")
LIST_MARKS = (r"^\s*[-–—•]\s+", r"^\s*\d+[.)]\s+", r"^\s*[a-zа-я][.)]\s+")
LIST_MARK = r"^\s*([-–—•]|\d+[.)]|[A-Za-zА-Яа-я][.)])\s+"
BREAKS = (r"^\s*$", r"^\f+$", r"^[-–—\s]+$")


def accepted(files: DataFrame, extensions=("xlsx", "docx"), limit: int = UPLOAD_BYTES) -> DataFrame:
    """Of binaryFile rows those with an extension and size that are taken."""
    return files.where(tx.extension("path").isin(*extensions) & (F.col("length") <= limit))


def _streamed(spark: SparkSession, path: str, extension: str, schema: str, rows: Callable) -> DataFrame:
    """Rows of the files at a path, as Spark's own reader gives their bytes, so from any store that Spark reads."""
    files = accepted(spark.read.format("binaryFile").load(path), (extension,))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from formats._batches(rows(name, io.BytesIO(raw.as_py())), formats._arrow(schema))

    return files.select("path", "content").mapInArrow(parse, schema)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_no, sheet, row, col, value, error of all workbooks at ``path``, row by row."""
    return _streamed(spark, path, "xlsx", formats.CELLS, formats.cell_rows)


def detect_columns(cells: DataFrame, names=COLUMN_NAMES) -> DataFrame:
    """path, sheet_no, col, header, by: the column of requirements in each sheet.

    The first known name among the headers (row 1) decides; else the column with the most values of five characters
    or more, then the longest on average, then the leftmost.
    """
    known = F.array_position(F.array(*[F.lit(n) for n in names]), tx.strip("value"))
    by_name = cells.where("row = 1").withColumn("_at", known).where("_at > 0").groupBy("path", "sheet_no").agg(F.min_by(F.struct("col", tx.strip("value").alias("header")), F.struct("_at", "col")).alias("n"))
    value = tx.strip("value")
    fit = (F.length(value) >= MIN_LENGTH) & (F.lower(value) != "nan")
    columns = cells.where("row > 1").where(fit).groupBy("path", "sheet_no", "col").agg(F.count("*").alias("_n"), F.avg(F.length(value)).alias("_mean"))
    best = columns.groupBy("path", "sheet_no").agg(F.max_by("col", F.struct("_n", "_mean", (-F.col("col")).alias("c"))).alias("col"))
    headers = cells.where("row = 1").select("path", "sheet_no", "col", tx.strip("value").alias("header"))
    best = best.join(headers, ["path", "sheet_no", "col"], "left")
    out = best.alias("b").join(by_name.alias("k"), ["path", "sheet_no"], "full_outer")
    return out.select("path", "sheet_no", F.coalesce("n.col", "b.col").alias("col"), F.coalesce("n.header", "b.header").alias("header"), F.when(F.col("n").isNotNull(), "name").otherwise("profile").alias("by"))


def requirements_of_cells(cells: DataFrame, names=COLUMN_NAMES) -> DataFrame:
    """path, id, text, locator: trimmed requirements of at least five characters, numbered over a file's sheets in order."""
    column = detect_columns(cells, names)
    text = tx.strip("value")
    kept = cells.where("row > 1").join(column.select("path", "sheet_no", "col", "header"), ["path", "sheet_no", "col"]).withColumn("text", text).where((F.length("text") >= MIN_LENGTH) & (F.lower("text") != "nan"))
    locator = F.struct(F.lit("cell").alias("type"), F.col("sheet").alias("sheet_name"), F.col("row").cast("int").alias("row"), F.col("header").alias("column"))
    # A workbook may hold any share of the rows.
    return numbered(kept.select("path", "sheet_no", "row", "text", locator.alias("locator")), ["sheet_no", "row"], by=["path"], name="id").select("path", "id", "text", "locator")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, kind, table, row, col, paragraph, list_style, text, error of all documents at ``path``: body paragraphs first, then all tables' cells."""
    return _streamed(spark, path, "docx", formats.PARAGRAPHS, formats.paragraph_rows)


def clean(text: Column) -> Column:
    """Trimmed, without inline marks, and without each kind of list mark once, in order."""
    c = tx.strip(text)
    for mark in INLINE_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    for p in LIST_MARKS:
        c = F.regexp_replace(c, "(?U)" + p, "")
    return tx.strip(c)


def is_break(text: Column) -> Column:
    out = F.lit(False)
    for p in BREAKS:
        out = out | text.rlike("(?U)" + p)
    return out


def requirements_of_paragraphs(rows: DataFrame) -> DataFrame:
    """path, id, text, locator: lines of the paragraphs, cleaned, without breaks and texts below five characters, numbered in order."""
    lines = rows.where("error is null").select("*", F.posexplode(F.split(tx.text_or_empty("text"), r"\R")).alias("_line", "_raw"))
    mark = F.regexp_replace(F.regexp_extract("_raw", "(?U)" + LIST_MARK, 1), r"[.)]+\z", "")
    lines = lines.withColumn("fragment", (F.col("_line") + 1).cast("int")).withColumn("_mark", mark).withColumn("_clean", clean(F.col("_raw")))
    lines = lines.where(~is_break(F.col("_clean")) & (F.length("_clean") >= MIN_LENGTH))
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), c.cast("string"))
    where = F.when(F.col("kind") == "table", F.array(tag("table", F.col("table")), tag("row", F.col("row")), tag("col", F.col("col")), tag("paragraph", F.col("paragraph")))).otherwise(F.array(tag("paragraph", F.col("paragraph"))))
    path = F.array_compact(F.concat(where, F.array(F.when(F.col("fragment") > 1, tag("fragment", F.col("fragment"))), tag("item", F.coalesce(F.nullif("_mark", F.lit("")), F.col("fragment").cast("string"))))))
    locator = F.struct(
        F.col("kind").alias("type"), F.when(F.col("kind") == "paragraph", F.col("paragraph")).cast("int").alias("index"), F.when(F.col("kind") == "table", F.col("table")).alias("table"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        F.when(F.col("kind") == "table", F.col("paragraph")).cast("int").alias("paragraph"), F.when(F.col("fragment") > 1, F.col("fragment")).alias("fragment"), F.when(F.col("list_style") | (F.col("_mark") != ""), path).alias("list_path"),
    )
    kept = lines.select("path", "ord", "_line", F.col("_clean").alias("text"), locator.alias("locator"))
    # A document may hold any share of the rows.
    return scan(kept, ["path"], ["ord", "_line"], {"id": Run("count")}).select("path", "id", "text", "locator")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """path, id, text and locator of a workbook's or a document's requirements, by its extension; other files, and files without any, are an error."""
    kind = path.rpartition(".")[2].lower() if "." in path else ""
    if kind == "xlsx":
        found = requirements_of_cells(read_cells(spark, path).where("error is null"))
    elif kind == "docx":
        found = requirements_of_paragraphs(read_paragraphs(spark, path))
    else:
        raise NotImplementedError(f"no reader for {kind or 'files without an extension'!r}")
    return demanded(found, f"requirements in {path}")
