"""Sections, token windows, section propagation and chunk metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.scans import Run, scan

# Where a section may begin; (?d) makes \n the only line end, (?iu) folds Cyrillic case.
HEADING_STARTS = (
    r"#{1,6}[ \t]+\S",
    r"(?U:\s*\d+(?:\.\d+){0,4}\.?\s+[^\n]{1,200}$)",
    r"(?iuU:\s*(?:Раздел|Section)\s+\d+(?:\.\d+){0,4}\s+[^\n]{1,200}$)",
    r"(?U:\s*[A-ZА-ЯЁ][A-ZА-ЯЁ0-9 \-]{4,}$)",
)
# Number and title of a heading; the first pattern that is found anywhere counts.
HEADINGS = (
    r"(?dm)^(?U:\s*)#{1,6}(?U:\s*)(\d+(?:\.\d+){0,4})\.?(?U:\s+)([A-ZА-ЯЁ][^\n]{0,200})",
    r"(?dm)^(?U:\s*)(\d+(?:\.\d+){0,4})\.?(?U:\s+)([A-ZА-ЯЁ][^\n]{0,200})",
    r"(?dmiu)^(?U:\s*)Раздел(?U:\s+)(\d+(?:\.\d+){0,4})(?U:\s+)([^\n]{0,200})",
    r"(?dmiu)^(?U:\s*)Section(?U:\s+)(\d+(?:\.\d+){0,4})(?U:\s+)([^\n]{0,200})",
)
MIN_SIZE, MAX_SIZE = 384, 768
METADATA_KEYS = ("source", "page_number", "chunk_idx", "section_number", "section_title", "product")


def split_sections(text: Column | str) -> Column:
    """Sections of a text: cut where a heading begins, trimmed, blank ones dropped; what precedes the first heading is one too."""
    parts = F.split(tx.text_or_empty(text), "(?dm)(?=^(?:" + "|".join(HEADING_STARTS) + "))")
    return F.filter(F.transform(parts, tx.strip), lambda s: s != "")


def windows(words: Column | str, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each beginning size - overlap words after the one before; the last ends with the words."""
    words = F.col(words) if isinstance(words, str) else words
    step = max(1, size - overlap)
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


_IN_SOURCE = ["page_number", "section_pos", "window_pos"]


def _cut(pages: DataFrame, size: int, overlap: int, check: bool) -> DataFrame:
    """Chunks of pages, not numbered yet."""
    if check and not MIN_SIZE <= size <= MAX_SIZE:
        raise ValueError(f"size must be from {MIN_SIZE} to {MAX_SIZE}")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    sections = pages.select("source", "page_number", F.posexplode(split_sections("text")).alias("section_pos", "section_text"))
    return sections.select("*", F.posexplode(windows(tx.whitespace_tokens("section_text"), size, overlap)).alias("window_pos", "text"))


def _numbered(n: Column) -> Column:
    return (n - 1).cast("int").alias("chunk_idx")


def chunk(pages: DataFrame, size: int = 512, overlap: int = 64, check: bool = True) -> DataFrame:
    """pages(source, page_number, text) -> source, page_number, section_pos, window_pos, section_text, text, chunk_idx.

    Chunks never cross a section or page; chunk_idx counts from 0 over a source's pages. A source of any size is spread over tasks.
    """
    cut = _cut(pages, size, overlap, check)
    return scan(cut, ["source"], _IN_SOURCE, {"_n": Run("count")}).select(*cut.columns, _numbered(F.col("_n")))


def chunk_with_sections(pages: DataFrame, size: int = 512, overlap: int = 64, max_pages: int = 6, enabled: bool = True) -> DataFrame:
    """``chunk`` and ``propagate`` in one run over the chunks: source, chunk_idx, page_number, text, number, title, and what ``propagate`` adds.

    A heading is read from its section's text before white space is collapsed, and belongs to the section's first window.
    """
    cut, first = _cut(pages, size, overlap, True).withColumn("_h", heading("section_text")), F.col("window_pos") == 0
    cut = cut.select("source", *_IN_SOURCE, "text", F.when(first, F.col("_h.number")).alias("number"), F.when(first, F.col("_h.title")).alias("title"))
    seen = scan(_marked(cut), ["source"], _IN_SOURCE, _HELD | {"_n": Run("count")}, reset="_heads").withColumn("chunk_idx", _numbered(F.col("_n")))
    return _with_states(seen, ["source", "chunk_idx", "page_number", "text", "number", "title"], max_pages, enabled)


def heading(text: Column | str) -> Column:
    """(number, title) of a text's heading; null fields where there is none."""
    text = tx.text_or_empty(text)
    found = [F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("number"), F.left(F.regexp_replace(tx.collapse(F.regexp_extract(text, p, 2)), r"\.+\z", ""), F.lit(200)).alias("title"))) for p in HEADINGS]
    return F.coalesce(*found, F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title")))


#: The last heading, and the last page that a chunk without one has reached behind it.
_HELD = {"_last": Run("first", "_head", restarts=True), "_worst": Run("max", "_plain", restarts=True)}


def _marked(chunks: DataFrame) -> DataFrame:
    heads = F.col("number").isNotNull()
    return chunks.withColumns({"_heads": heads, "_head": F.when(heads, F.struct("number", "title", F.col("page_number").alias("page"))), "_plain": F.when(~heads, F.col("page_number").cast("long"))})


def propagate(chunks: DataFrame, max_pages: int = 6, enabled: bool = True) -> DataFrame:
    """chunks(source, chunk_idx, page_number, number, title) plus section_number, section_title, section_inherited, section_fallback and state.

    A heading holds for later chunks while they are at most ``max_pages`` pages behind it (no limit if negative); after that, and
    before the first one, a chunk falls back to ``document`` with the source's title. state: heading, inherited, stale, unassigned or none.
    The last heading is carried over ranges of chunks, so a source of any size is spread over tasks.
    """
    return _with_states(scan(_marked(chunks), ["source"], ["chunk_idx"], _HELD, reset="_heads"), chunks.columns, max_pages, enabled)


def _with_states(seen: DataFrame, columns: Sequence[str], max_pages: int, enabled: bool) -> DataFrame:
    page = F.col("page_number")
    # Once a section is stale it stays so until the next heading.
    held = F.col("_last").isNotNull() & (F.lit(max_pages < 0) | ((page - F.col("_last.page") <= max_pages) & (F.coalesce("_worst", page) - F.col("_last.page") <= max_pages)))
    state = (
        F.when(F.col("number").isNotNull(), "heading").when(F.lit(not enabled), "none")
        .when(held, "inherited").when(F.col("_last").isNotNull(), "stale").otherwise("unassigned")
    )
    inherited, fallback = F.col("state") == "inherited", F.col("state").isin("stale", "unassigned")
    return seen.withColumn("state", state).select(
        *columns,
        F.when(F.col("state") == "heading", F.col("number")).when(inherited, F.col("_last.number")).when(fallback, F.lit("document")).otherwise("").alias("section_number"),
        F.when(F.col("state") == "heading", F.col("title")).when(inherited, F.col("_last.title")).when(fallback, tx.title_from_source("source")).otherwise("").alias("section_title"),
        inherited.alias("section_inherited"),
        fallback.alias("section_fallback"),
        "state",
    )


def section_stats(propagated: DataFrame) -> DataFrame:
    return propagated.agg(
        F.count("*").alias("chunks"),
        *[F.count_if(F.col("state") == s).alias(name) for s, name in (("heading", "headings"), ("inherited", "inherited"), ("stale", "stale"), ("unassigned", "unassigned"))],
        F.count_if("section_fallback").alias("fallback"),
    )


def parent_id(source: Column, number: Column, title: Column) -> Column:
    """``source::number::title``, or ``source::document`` without a section."""
    return F.when(tx.blank(number) & tx.blank(title), F.concat(source, F.lit("::document"))).otherwise(F.concat_ws("::", source, F.coalesce(number, F.lit("")), F.coalesce(title, F.lit(""))))


def infer_product(sources: DataFrame, products: DataFrame, source: str = "source") -> DataFrame:
    """``sources`` with product: that of the longest prefix(prefix, product) of the lower-cased file stem, else ``unknown``.

    Prefixes are met by equality: the stem's own prefixes, as long as some rule is, are exploded and joined.
    """
    lengths = [r[0] for r in products.select(F.length("prefix")).distinct().collect()]
    stem = F.lower(F.regexp_replace(F.col(source), r"(?<=.)\.[^.]*\z", ""))
    each = sources.select(source).distinct()
    cut = F.filter(F.array(*[F.when(F.length(stem) >= n, F.left(stem, F.lit(n))) for n in sorted(lengths)] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    held = each.select(source, F.explode(cut).alias("_prefix")).join(products.select(F.lower("prefix").alias("_prefix"), "product"), "_prefix")
    best = held.groupBy(source).agg(F.max_by("product", F.struct(F.length("_prefix"), "product")).alias("product"))
    return sources.join(best, source, "left").withColumn("product", F.coalesce("product", F.lit("unknown")))


def metadata(chunks: DataFrame) -> DataFrame:
    """The full set of a chunk's metadata, missing texts as ``''`` and missing pages as 1; dependency fields start empty."""
    empty = F.lit("")
    return chunks.select(
        F.concat_ws("__", F.regexp_replace("source", r"(?<=.)\.[^.]*\z", ""), F.col("chunk_idx").cast("string")).alias("chunk_id"),
        "source",
        F.when(F.col("page_number") > 0, F.col("page_number")).otherwise(1).alias("page_number"),
        "chunk_idx",
        *[F.coalesce(c, empty).alias(c) for c in ("section_number", "section_title", "product")],
        "section_inherited",
        "section_fallback",
        parent_id(F.col("source"), F.col("section_number"), F.col("section_title")).alias("parent_id"),
        empty.alias("see_also"),
        empty.alias("related_sections"),
        empty.alias("prerequisites"),
        F.lit(False).alias("dependencies_extracted"),
        F.lit("none").alias("dependency_method"),
        "text",
    )


def present(name: str) -> Column:
    """Whether a metadata value is there; chunk 0 is, page 0 is not."""
    if name == "chunk_idx":
        return F.col(name).isNotNull()
    if name == "page_number":
        return F.coalesce(F.col(name) > 0, F.lit(False))
    return ~tx.blank(F.col(name).cast("string"))


def coverage(chunks: DataFrame, keys=METADATA_KEYS) -> DataFrame:
    """chunks, complete and coverage, the share of chunks with all keys; 0 without chunks."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & present(k)
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(whole).alias("complete"), F.round(F.coalesce(F.avg(whole.cast("double")), F.lit(0.0)), 6).alias("coverage"))


def parent_texts(chunks: DataFrame) -> DataFrame:
    """(source, parent_id) -> parent_text: its chunks in order, with a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_idx", "text")))
    return chunks.groupBy("source", "parent_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("parent_text"))


def upsert_registry(registry: DataFrame, files: DataFrame, today: str, status: str = "Indexed") -> DataFrame:
    """registry and files(filename, sha256_hash, version?, coverage?) merged: new values win, version and coverage stay unless given, ``1.0`` for new files."""
    opt = lambda c: F.col(f"n.{c}") if c in files.columns else F.lit(None).cast("string")
    merged = registry.alias("o").join(files.alias("n"), F.col("o.filename") == F.col("n.filename"), "full_outer")
    new = F.col("n.filename").isNotNull()
    return merged.select(
        F.coalesce("n.filename", "o.filename").alias("filename"),
        F.coalesce(opt("version"), F.col("o.version"), F.lit("1.0")).alias("version"),
        F.when(new, F.col("n.sha256_hash")).otherwise(F.col("o.sha256_hash")).alias("sha256_hash"),
        F.when(new, F.lit(today)).otherwise(F.col("o.indexed_date")).alias("indexed_date"),
        F.when(new, F.lit(status)).otherwise(F.col("o.status")).alias("status"),
        F.coalesce(opt("coverage"), F.col("o.coverage"), F.lit("")).alias("coverage"),
    )
