"""Cross-references between sections, mined from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

# Fixed values.
MARKER = r"(?iuU)(?:\bсм\.?\b|\bсмотрите\b|\bсм\.\s*также\b|\bпредварительн\w*\b|\bтребуется\b|\bнеобходимо\b|\bнужно\b|\bзависит\b|\bзависим\w*\b)"
SEE = r"\b(?:см\.?|смотрите)\s*(?:также\s*)?(?:в\s*)?(?:раздел(?:е)?|пункт(?:е)?|п\.?)?"
SECTION_NUMBER = r"(?U)\b\d+(?:\.\d+)+\b"
PREREQUISITES = (
    r"(?iuU)(?:требуется|необходимо|нужно)\s+((?:предварительн\w+\s+)?[^.;\n]{3,160})",
    r"(?iuU)предварительн\w+\s+((?:настройка|подключение|конфигурация)[^.;\n]{3,160})",
    r"(?iuU)перед\s+[^.;\n]{3,80}\s+(?:требуется|необходимо|нужно)\s+([^.;\n]{3,160})",
)
REACH = 220


def has_marker(text: Column | str) -> Column:
    return tx.text_or_empty(text).rlike(MARKER)


def reference_numbers(text: Column | str) -> Column:
    """Dotted numbers within 220 characters after a "see" marker, in order, each once. The reaches of markers may overlap."""
    reach = F.regexp_extract_all(tx.text_or_empty(text), F.lit(f"(?siuU){SEE}(?=(.{{0,{REACH}}}))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(reach, lambda r: F.regexp_extract_all(r, F.lit(SECTION_NUMBER), F.lit(0)))))


def clean(value: Column) -> Column:
    """Collapsed, without punctuation at the ends, ``;`` as ``,``."""
    return F.regexp_replace(F.regexp_replace(tx.collapse(value), r"(?U)^[\s.,;:]+|[\s.,;:]+\z", ""), ";", ",")


def prerequisites(text: Column | str) -> Column:
    found = F.concat(*[F.regexp_extract_all(tx.text_or_empty(text), F.lit(p), F.lit(1)) for p in PREREQUISITES])
    return F.array_distinct(F.filter(F.transform(found, clean), lambda v: v != ""))


def extract(chunks: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """chunks(source, chunk_idx, text) plus has_marker, related (``source::number``), see_also, prerequisites and method:
    ``regex`` where there is a marker, whatever is found near it.

    ``more``(source, chunk_idx, related, prerequisites) are another extractor's findings; they follow ours, each value once.
    """
    qualified = F.transform(reference_numbers("text"), lambda n: F.concat(F.col("source"), F.lit("::"), n))
    out = chunks.withColumn("has_marker", has_marker("text"))
    out = out.withColumns({"related": F.when(F.col("has_marker"), qualified).otherwise(F.array().cast("array<string>")), "prerequisites": F.when(F.col("has_marker"), prerequisites("text")).otherwise(F.array().cast("array<string>"))})
    method = F.when(F.col("has_marker"), F.lit("regex")).otherwise(F.lit("none"))
    if more is not None:
        extra = more.select("source", "chunk_idx", F.col("related").alias("_related"), F.col("prerequisites").alias("_prerequisites"))
        none = F.array().cast("array<string>")
        out = out.join(extra, ["source", "chunk_idx"], "left")
        asked = F.col("_related").isNotNull() | F.col("_prerequisites").isNotNull()
        method = F.when(F.col("has_marker") & asked, F.lit("regex+model")).when(asked, F.lit("model")).otherwise(method)
        out = out.withColumn("method", method).withColumns({c: F.array_distinct(F.concat(F.col(c), F.coalesce(F.col(f"_{c}"), none))) for c in ("related", "prerequisites")}).drop("_related", "_prerequisites")
    else:
        out = out.withColumn("method", method)
    return out.withColumn("see_also", F.col("related"))


def encode(values: Column) -> Column:
    """Values joined by ``;``, as stores of scalars keep them."""
    return F.array_join(F.transform(values, clean), ";")


def stats(extracted: DataFrame) -> DataFrame:
    """chunks, markers, with_related, and coverage: related over markers, 1 without markers."""
    marked, related = F.count_if("has_marker"), F.count_if(F.col("has_marker") & (F.size("related") > 0))
    return extracted.agg(F.count("*").alias("chunks"), marked.alias("markers"), related.alias("with_related"), F.round(F.coalesce(F.try_divide(related, marked), F.lit(1.0)), 6).alias("coverage"))


def update_store(store: DataFrame, extracted: DataFrame, force: bool = False) -> DataFrame:
    """``store`` with encoded dependency fields from ``extracted``; rows that were done before stay unless ``force``."""
    new = extracted.select("source", "chunk_idx", encode(F.col("related")).alias("_related"), encode(F.col("prerequisites")).alias("_pre"), F.col("method").alias("_method"))
    todo = (~F.coalesce("dependencies_extracted", F.lit(False)) | F.lit(force)) & F.col("_method").isNotNull()
    out = store.join(new, ["source", "chunk_idx"], "left").withColumn("_todo", todo)
    pick = lambda new, old: F.when(F.col("_todo"), F.col(new)).otherwise(F.col(old)).alias(old)
    changed = {"related_sections": pick("_related", "related_sections"), "see_also": pick("_related", "see_also"), "prerequisites": pick("_pre", "prerequisites"), "dependency_method": pick("_method", "dependency_method"), "dependencies_extracted": (F.col("_todo") | F.coalesce("dependencies_extracted", F.lit(False))).alias("dependencies_extracted")}
    return out.select(*[changed.get(c, F.col(c)) for c in store.columns])
