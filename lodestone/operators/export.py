"""Report rows: normalising, references, checks, merging into source sheets, Markdown."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import masking
from lodestone.functions import text as tx
from lodestone.operators.classify import ERROR
from lodestone.operators.quality import STATUSES
from lodestone.plans.numbering import numbered
from lodestone.sources import formats

SCHEMA_VERSION = "1.0"
# Column names of reports.
RESULT_COLUMNS = ("[Статус]", "[Комментарий]", "[Confidence]", "[RunID]")
REPORT_COLUMNS = ("№", "Ref", "Исходное требование", *RESULT_COLUMNS)
LOCATOR = "type string, sheet_name string, row int, `column` string, index int, fragment int, `table` int, col int, paragraph int, list_path array<string>"
UUID4 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z"


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def ref_text(loc: Column) -> Column:
    """A locator as text, its keys in a fixed order by type, or in order of name for other types; ``''`` without a locator."""
    num = lambda key, c=None: F.when(loc[c or key].isNotNull(), F.concat(F.lit(f"{key}="), loc[c or key].cast("string")))
    path = F.when(F.size(loc["list_path"]) > 0, F.concat(F.lit("list_path="), quoted(F.array_join(loc["list_path"], "/"))))
    sheet = F.when(~tx.blank(loc["sheet_name"]), F.concat(F.lit("sheet="), quoted(loc["sheet_name"])))
    column = F.coalesce(F.nullif(loc["column"], F.lit("")), loc["col"].cast("string"))
    cell = F.concat_ws(", ", sheet, num("row"), F.when(column.isNotNull(), F.concat(F.lit("col="), quoted(column))))
    paragraph = F.concat_ws(", ", F.coalesce(num("paragraph", "index"), F.lit("paragraph")), num("fragment"), path)
    table = F.concat_ws(", ", num("table"), num("row"), num("col"), num("paragraph"), num("fragment"), path)
    kind = F.lower(tx.strip(tx.text_or_empty(loc["type"])))
    text = lambda key: F.when(loc[key].isNotNull(), F.concat(F.lit(f"{key}="), quoted(loc[key])))
    other = F.concat_ws(", ", num("col"), text("column"), num("fragment"), num("index"), F.when(loc["list_path"].isNotNull(), F.concat(F.lit("list_path=['"), F.array_join(loc["list_path"], "', '"), F.lit("']"))), num("paragraph"), num("row"), text("sheet_name"), num("table"), text("type"))
    return F.when(loc.isNull(), "").when(kind == "cell", cell).when(kind == "paragraph", paragraph).when(kind == "table", table).otherwise(other)


def rows(results: DataFrame, run_id: str) -> DataFrame:
    """results(id, text, status, comment, confidence, error, locator?) as export rows.

    A missing status is ``НД``, or ``Ошибка`` where there is an error; the confidence is rounded to two digits, 0 where it is no number.
    """
    failed = ~tx.blank("error") & tx.blank("status")
    status = F.when(failed, ERROR).otherwise(F.coalesce(F.nullif(tx.strip("status"), F.lit("")), F.lit("НД")))
    comment = F.when(failed, F.concat(F.lit("Ошибка обработки: "), F.col("error"))).otherwise(F.coalesce("comment", F.lit("")))
    confidence = F.bround(F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.0)), 2)
    ref = ref_text(F.col("locator")) if "locator" in results.columns else F.lit("")
    return results.select("id", ref.alias("ref"), F.coalesce("text", F.lit("")).alias("source_text"), status.alias("status"), comment.alias("comment"), confidence.alias("confidence"), F.lit(run_id).alias("run_id"))


def passed_through(table: DataFrame, run_id: str) -> DataFrame:
    """A table that has the columns of export rows already, by either set of names, as export rows; any other is an error.

    What is there stays; a run_id or ref that is missing is filled in, and statuses are not judged here.
    """
    marked = {"id", *RESULT_COLUMNS} <= set(table.columns)
    if not marked and not {"id", "status", "comment", "confidence", "run_id"} <= set(table.columns):
        raise ValueError("not a table of export rows")
    names = dict(zip(("status", "comment", "confidence", "run_id"), RESULT_COLUMNS if marked else ("status", "comment", "confidence", "run_id"), strict=True))
    ref = ref_text(F.col("locator")) if "locator" in table.columns else F.lit("")
    ref = F.coalesce(F.nullif(F.col("ref"), F.lit("")), ref) if "ref" in table.columns else ref
    text = F.coalesce("source_text", F.lit("")) if "source_text" in table.columns else F.lit("")
    confidence = F.bround(F.coalesce(F.col(f"`{names['confidence']}`").cast("string").try_cast("double"), F.lit(0.0)), 2)
    own = F.col(f"`{names['run_id']}`")
    return table.select(
        "id", ref.alias("ref"), text.alias("source_text"), F.col(f"`{names['status']}`").alias("status"), F.coalesce(F.col(f"`{names['comment']}`"), F.lit("")).alias("comment"), confidence.alias("confidence"),
        F.when(tx.blank(own), F.lit(run_id)).otherwise(own).alias("run_id"),
    )


def violations(export: DataFrame) -> DataFrame:
    """``export`` plus violations: id below 1, unknown status, confidence outside 0 to 1, blank text, run_id that is no UUID4."""
    checks = [
        (F.col("id").isNull() | (F.col("id") < 1), "id"),
        (~F.coalesce(F.col("status").isin(*STATUSES, ERROR), F.lit(False)), "status"),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
        (tx.blank("source_text"), "text"),
        (~F.coalesce(F.col("run_id").rlike(UUID4), F.lit(False)), "run_id"),
    ]
    return export.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])))


def ref_violations(ref: Column) -> Column:
    """Codes of a reference(type, table, row, col, paragraph): unknown type, negative or missing coordinates."""
    kind = ref["type"]
    checks = [
        (~F.coalesce(kind.isin("table_cell_list", "paragraph", "list_item"), F.lit(False)), "type"),
        *((F.coalesce(ref[c] < 0, F.lit(False)), f"negative_{c}") for c in ("table", "row", "col", "paragraph")),
        ((kind == "table_cell_list") & (ref["row"].isNull() | ref["col"].isNull()), "cell_without_coordinates"),
        (kind.isin("paragraph", "list_item") & ref["paragraph"].isNull(), "no_paragraph"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))


def assert_one_run(export: DataFrame) -> DataFrame:
    """``export`` plus schema_version; reading it fails if there is more than one run_id."""
    runs = export.agg(F.count_distinct("run_id").alias("_runs"))
    fine = F.when(F.col("_runs") > 1, F.raise_error(F.lit("more than one run_id"))).otherwise(F.lit(SCHEMA_VERSION))
    return export.crossJoin(F.broadcast(runs)).withColumn("schema_version", fine).drop("_runs")  # one row


def merge_into_source(source: DataFrame, export: DataFrame, run_id: str) -> DataFrame:
    """source(sheet, row_idx, …) plus status, comment, confidence, run_id of export(sheet, row, ord, id?, …): sheet row r is row_idx r - 2.

    A row that names no sheet belongs to row_idx id - 1, if the source has one sheet only. The last of doubles counts; ``''`` and 0 where there is none.
    """
    mine = export.withColumn("row_idx", F.col("row") - 2)
    if "id" in export.columns:
        sheets = source.agg(F.min("sheet").alias("_one"), (F.min("sheet") == F.max("sheet")).alias("_single"))  # one row
        mine = mine.crossJoin(F.broadcast(sheets)).withColumn("_bare", F.col("sheet").isNull() | (F.col("sheet").cast("string") == ""))
        mine = mine.where(~F.col("_bare") | F.col("_single")).withColumns({"row_idx": F.when(F.col("_bare"), F.col("id") - 1).otherwise(F.col("row_idx")), "sheet": F.when(F.col("_bare"), F.col("_one")).otherwise(F.col("sheet"))})
    mine = mine.groupBy("sheet", "row_idx").agg(F.max_by(F.struct("status", "comment", "confidence"), "ord").alias("_r")).select("sheet", "row_idx", "_r.*")
    out = source.join(mine, ["sheet", "row_idx"], "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("")), "comment": F.coalesce("comment", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "run_id": F.lit(run_id)})


def escaped(c: Column | str) -> Column:
    """For a Markdown cell: backslash, pipe and asterisk escaped, line ends as ``<br>``, no white space at the ends."""
    c = tx.text_or_empty(c)
    for mark in ("\\", "|", "*"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return tx.strip(F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>")), F.lit("\r"), F.lit("<br>")))


def markdown_rows(export: DataFrame) -> DataFrame:
    """id, line: a row of the report's table."""
    cells = [F.col("id").cast("string"), escaped("ref"), escaped("source_text"), escaped("status"), escaped("comment"), F.format_string("%.2f", F.col("confidence").cast("double")), escaped("run_id")]
    return export.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_report(export: DataFrame, run_id: str, date: str, source: str = "") -> DataFrame:
    """position, line of a whole report: front matter, heading, table head, and the rows by id."""
    name = source.rstrip("/").rpartition("/")[2] or "report"
    plain = lambda v: v if re.fullmatch(r"[\w./ -]*[\w/-]", v) and not re.fullmatch(r"[\d.:TZ-]*", v) else "'" + v.replace("'", "''") + "'"
    head = ["---", f"run_id: {plain(run_id)}", f"date: {plain(date)}", f"source: {plain(source)}", f"schema_version: {plain(SCHEMA_VERSION)}", "---", "", f"# Результат анализа ТЗ — {name}", "", "| " + " | ".join(REPORT_COLUMNS) + " |", "|---:|---|---|---|---|---:|---|"]
    top = export.sparkSession.createDataFrame([(k, line) for k, line in enumerate(head)], "position long, line string")
    rows = numbered(markdown_rows(export), ["id"], name="position")
    return top.unionByName(rows.select((F.col("position") + len(head) - 1).alias("position"), "line"))


FORMATS = ("csv", "json", "md")


def report_format(output_format: str | None = None, output_file: str | None = None, default: str = "md") -> str:
    """The explicit format, else the file's suffix, else the default; an unknown one is an error."""
    name = (output_format or (os.path.splitext(output_file)[1] if output_file else "") or default).strip().lower().lstrip(".")
    if name not in FORMATS:
        raise ValueError(f"unsupported output format {name!r}; there are {', '.join(FORMATS)}")
    return name


def report_path(kind: str, run_id: str, output_file: str | None = None, output_dir: str | None = None, source_file: str | None = None, template: str = "{basename}_report_{run_id_8}.{ext}") -> str:
    """The file that was asked for, if it has a suffix; else a name of the source's stem and the run, in the folder asked for or the source's."""
    if output_file and os.path.splitext(output_file)[1]:
        return output_file
    folder = output_file or output_dir or (os.path.dirname(source_file) if source_file else "")
    stem = os.path.splitext(os.path.basename(source_file))[0] if source_file else "report"
    return os.path.join(folder, template.format(basename=stem, run_id_8=run_id[:8], ext=kind))


def write_report(export: DataFrame, run_id: str, date: str = "", output_file: str | None = None, output_format: str | None = None, output_dir: str | None = None, source_file: str | None = None, output_mode: str = "create_new", one_file: bool = False) -> str:
    """Writes export rows as Markdown, CSV or JSON, masked by nobody but the caller, and returns the folder written; one that exists is an error.

    A report is a folder of part files in order, so that no task writes it whole; with ``one_file`` a Markdown report is one file
    that tasks fill in at their places, in a folder that all executors have.
    """
    if output_mode != "create_new":
        raise ValueError(f"unsupported output mode {output_mode!r}: only create_new")
    kind = report_format(output_format, output_file)
    path = report_path(kind, run_id, output_file, output_dir, source_file)
    if kind == "md":
        lines = markdown_report(export, run_id, date, source_file or "")
        if one_file:
            return formats.write_lines(lines, path)
        lines.repartitionByRange("position").sortWithinPartitions("position").select("line").write.text(path)
    else:
        named = export.select(*[F.col(c).alias(n) for c, n in zip(("id", "ref", "source_text", "status", "comment", "confidence", "run_id"), REPORT_COLUMNS, strict=True)])
        named = named.repartitionByRange(REPORT_COLUMNS[0]).sortWithinPartitions(REPORT_COLUMNS[0])
        (named.write.option("header", "true").option("escape", '"').csv if kind == "csv" else named.write.json)(path)
    return path


def masked(table: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns, every text masked; a column that is missing is null."""
    return table.select(*[masking.mask(F.col(c).cast("string")).alias(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in allowed])


def error_report(errors: DataFrame, providers: int, timestamp: str) -> DataFrame:
    """errors(run_id, query, provider, error_type, message) -> one masked report per run: query, reason, errors, recommendation, and the whole as text."""
    clean = lambda c: masking.mask(tx.text_or_empty(c))
    each = F.struct(clean("provider").alias("provider"), clean("error_type").alias("error_type"), clean("message").alias("message"))
    out = errors.groupBy("run_id").agg(clean(F.min("query")).alias("query"), F.array_sort(F.collect_list(each)).alias("errors"))
    out = out.withColumn("reason", F.concat(F.lit("Все провайдеры недоступны ("), F.size("errors").cast("string"), F.lit(f" из {providers})")))
    out = out.withColumn("recommendation", recommendation(F.array_join(F.transform("errors", lambda e: e["message"]), " ")))
    lines = F.transform("errors", lambda e: F.concat(F.lit("- provider="), e["provider"], F.lit(" type="), e["error_type"], F.lit(" message="), e["message"]))
    text = F.concat_ws("\n", F.concat(F.lit("run_id: "), F.col("run_id")), F.lit(f"timestamp: {timestamp}"), F.concat(F.lit("reason: "), F.col("reason")), F.lit(""), F.lit("query:"), F.col("query"), F.lit(""), F.lit("errors:"), F.array_join(lines, "\n"), F.lit(""), F.lit("recommendations:"), F.concat(F.lit("- "), F.col("recommendation")))
    return out.select("run_id", "query", "reason", "errors", "recommendation", text.alias("text"))


def recommendation(error: Column | str) -> Column:
    """What to do about an error: the first class that fits."""
    low = F.lower(tx.text_or_empty(error))
    return (
        F.when(low.rlike("401|auth|token"), "auth").when(low.rlike("timeout|connection"), "network")
        .when(low.contains("400"), "request").otherwise("default")
    )
