"""Document folders, source registries, golden sets and predictions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.quality import last_wins, normal_id

REGISTRY = "filename string, version string, sha256_hash string, indexed_date string, status string, coverage string"


def read_folder(spark: SparkSession, path: str, extensions=("txt", "md", "json")) -> DataFrame:
    """source, page_number, text, sha256_hash, valid of the text files below a folder; each is one page. Dotfiles, blank files and broken JSON are skipped.

    Bytes that are no UTF-8 are left out of the text, and ``valid`` is false; JSON is written anew, indented by two.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    taken = files.withColumn("source", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).where(~F.col("source").startswith(".") & tx.extension("source").isin(*extensions))
    raw = F.col("content").cast("string")
    readable = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    text = F.when(tx.extension("source") == "json", indented("_t")).otherwise(F.col("_t"))
    out = taken.select("source", F.lit(1).alias("page_number"), readable.alias("_t"), F.sha2("content", 256).alias("sha256_hash"), F.is_valid_utf8(raw).alias("valid"))
    return out.withColumn("text", text).where(~tx.blank("text")).select("source", "page_number", "text", "sha256_hash", "valid")


def indented(texts: Column | str) -> Column:
    """JSON texts with an indent of two, keys as they are; null where a text is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def all_of(values: pd.Series) -> pd.Series:
        return values.map(one)

    return all_of(texts)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry; of rows with one filename the last one counts: by the file's name, its block there, and the row's place in the block."""
    rows = spark.read.schema(REGISTRY).option("header", "true").csv(path)
    # Within a block rows are numbered as they are read; between blocks these numbers say nothing.
    place = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    return last_wins(rows.withColumn("_ord", place), "filename", "_ord").drop("_ord")


def with_registry(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``files`` with their registry's columns where they are known."""
    known = registry.select(F.col("filename").alias("source"), "version", "indexed_date", "status", "coverage")
    return files.join(known, "source", "left")


def _field(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object("_item", f"$['{n}']"), F.lit("")) for n in names])


def _strings(name: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object("_item", f"$.{name}"), "array<string>"), F.array().cast("array<string>"))


def _items(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """_n (from 1) and _item of a JSON list, of a list under one of ``keys``, or of JSON lines; files are taken one by one."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.col("value").alias("_raw"))
    array = F.coalesce(F.from_json("_raw", "array<string>"), *[F.from_json(F.get_json_object("_raw", f"$.{k}"), "array<string>") for k in keys])
    lines = F.filter(F.split("_raw", r"\R"), lambda x: F.try_parse_json(x).isNotNull())
    is_lines = tx.extension("_file") == "jsonl"
    rows = whole.select(is_lines.alias("_lines"), F.when(is_lines, F.split("_raw", r"\R")).otherwise(F.coalesce(array, lines)).alias("_all"))
    return rows.select("_lines", F.posexplode("_all").alias("_p", "_item")).where(F.try_parse_json("_item").isNotNull() & (F.trim("_item") != "")).select("_lines", (F.col("_p") + 1).alias("_n"), "_item")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, expected_sources, expected_substrings, expected_pages, subset of a retrieval set; blank questions are left out."""
    rows = _items(spark, path, "items", "questions")
    fallback = F.concat(F.when(F.col("_lines"), "JSONL-").otherwise("JSON-"), F.lpad(F.col("_n").cast("string"), 3, "0"))
    pages = F.coalesce(F.from_json(F.get_json_object("_item", "$.expected_pages"), "array<int>"), F.array().cast("array<int>"))
    out = rows.select(F.coalesce(_field("id"), fallback).alias("query_id"), _field("question", "query").alias("text"), _strings("expected_sources").alias("expected_sources"), _strings("expected_substrings").alias("expected_substrings"), pages.alias("expected_pages"), _field("subset").alias("subset"))
    return out.where(~tx.blank("text"))


def subset(golden: DataFrame, name: str | None) -> DataFrame:
    return golden if not name else golden.where(F.col("subset") == name)


def demanded(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, unless there are none: that is an error."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def synthetic_requirements(spark: SparkSession, n: int) -> DataFrame:
    """id, text of ``n`` numbered requirements, to measure a pipeline with."""
    number = F.col("id").cast("string")
    return spark.range(1, n + 1).select("id", F.concat(F.lit("Требование #"), number, F.lit(": проверить поддержку функции "), number, F.lit(" (синтетическое).")).alias("text"))


def read_gold_standard(spark: SparkSession, path: str) -> DataFrame:
    """id, requirement, status, ord of a classification set."""
    return _items(spark, path, "items").select(F.col("_n").alias("ord"), _field("id", "ID").alias("id"), _field("requirement").alias("requirement"), _field("expected_status", "status").alias("status"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """id, status, ord of predictions, by any of their names; rows without an id get their number only if none has one."""
    rows = _items(spark, path, "predictions", "items", "results").select("_n", _field("id", "ID").alias("id"), _field("[Статус]", "Статус", "status", "classification", "expected_status").alias("status"))
    some = F.broadcast(rows.agg(F.count("id").alias("_some")))  # one row
    return rows.crossJoin(some).select(F.when(F.col("_some") > 0, F.col("id")).otherwise(F.col("_n").cast("string")).alias("id"), "status", F.col("_n").alias("ord")).where("id is not null")


# Names of the columns of a set of predictions.
ID_COLUMNS = ("id", "ID", "Id", "№", "Номер")
STATUS_COLUMNS = ("[Статус]", "Статус", "status", "Status", "classification", "expected_status")


def predictions_of_cells(cells: DataFrame) -> DataFrame:
    """id, status, ord of predictions in the first sheet of a workbook, of cells(sheet_no, row, col, value); row 1 names the columns.

    Without an id column rows go by their number, and without a status column there is an error.
    """
    first = cells.where("sheet_no = 0")
    head = {r.value.strip(): r.col for r in first.where("row = 1 and value is not null").select("col", "value").collect()}  # a sheet's columns
    ident, status = pick_column(list(head), list(ID_COLUMNS)), pick_column(list(head), list(STATUS_COLUMNS))
    if status is None:
        raise ValueError(f"no status column; there are {', '.join(head)}")
    value = lambda name: F.max(F.when(F.col("col") == head[name], F.col("value")))
    rows = first.where("row > 1").groupBy("row").agg(*([value(ident).alias("id")] if ident else []), value(status).alias("status"))
    ident = normal_id("id") if ident else (F.col("row") - 1).cast("string")
    return rows.select(ident.alias("id"), tx.strip(tx.text_or_empty("status")).alias("status"), F.col("row").alias("ord"))


def read_prompt(spark: SparkSession, folder: str, name: str, version: str = "v1.0", extensions: Sequence[str] = ("md", "txt")) -> tuple[str, str]:
    """Text and SHA-256 of ``name_version.md``, else ``.txt``; examples are read with ``extensions=("json",)``."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{name}_{version}.*").select(F.col("value"), tx.extension(F.input_file_name()).alias("kind"))
    by_kind = {r.kind: r.value for r in found.where(F.col("kind").isin(*extensions)).collect()}  # at most one file an extension
    for kind in extensions:
        if kind in by_kind:
            return by_kind[kind], hashlib.sha256(by_kind[kind].encode("utf-8")).hexdigest()
    raise FileNotFoundError(f"no prompt {name}_{version} in {folder}")


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, exactly, else without regard to case."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((c for c in candidates if c in columns), None) or next((low[c.lower()] for c in candidates if c.lower() in low), None)
