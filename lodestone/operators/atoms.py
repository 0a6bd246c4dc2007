"""Requirement blocks cut into atoms, their types, and links to the atoms that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

# List markers at the start of a line, and words that give a type.
MARKER = r"(?:\d+(?:\.[A-Za-zА-Яа-я0-9]+)+\.?|\d+[.)]|[A-Za-zА-Яа-я][.)]|[ivxlcdm]+[.)]|[-–—•])(?=\s)"
TYPES = (
    ("security", r"персональн|152-фз|фз\s*№?\s*152|шифр|безопас|защит"),
    ("integration", r"интеграц|api|вебсервис|web[- ]?service|sip|h\.323|crm|мис"),
    ("non-functional", r"отказоустойчив|доступност|производительн|sla|круглосуточ|n\+1|уровн[ья] защищенности"),
)
VALID_TYPES = ("functional", "integration", "security", "non-functional")
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
REVIEW_BELOW = 0.85


def requirement_type(text: Column | str) -> Column:
    low = F.lower(tx.text_or_empty(text))
    out = None
    for name, pattern in TYPES:
        hit = low.rlike("(?U)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("functional")


def normal_type(value: Column | str) -> Column:
    v = F.replace(F.lower(tx.strip(tx.text_or_empty(value))), F.lit("_"), F.lit("-"))
    v = F.when(v.isin("nonfunctional", "non functional"), "non-functional").otherwise(F.regexp_replace(v, "^(integration|security|functional)-requirement$", "$1"))
    return F.when(v.isin(*VALID_TYPES), v).otherwise("functional")


def normal_marker(marker: Column | str) -> Column:
    m = tx.strip(tx.text_or_empty(marker))
    return F.when(m.isin("-", "–", "—", "•"), m).otherwise(F.regexp_replace(m, r"[.)]+\z", ""))


def spans(blocks: DataFrame) -> DataFrame:
    """blocks(block_id, text) -> block_id, span_no, start, end, marker, text, type, confidence.

    A span goes from its marker to the next marker; text before the first one is a span without a marker. Offsets count
    characters of the block; white space at the ends belongs to no span, and the text is exactly text[start:end].
    """
    cut = F.split(tx.text_or_empty("text"), r"(?dm)(?U)(?=^\s*" + MARKER + ")")
    parts = blocks.select("block_id", F.posexplode(cut).alias("_no", "_part"))
    before = F.coalesce(F.sum(F.length("_part")).over(Window.partitionBy("block_id").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("_part") - F.length(F.regexp_replace("_part", r"(?U)^\s+", ""))
    out = parts.withColumn("start", (before + lead).cast("int")).withColumn("text", tx.strip("_part")).where("text <> ''")
    marker = F.regexp_extract("text", "(?U)^(" + MARKER + ")", 1)
    no = F.row_number().over(Window.partitionBy("block_id").orderBy("start"))
    return out.select(
        "block_id", no.alias("span_no"), "start", (F.col("start") + F.length("text")).alias("end"), F.nullif(normal_marker(marker), F.lit("")).alias("marker"), "text",
        requirement_type("text").alias("type"), F.when(marker == "", 0.9).otherwise(0.78).alias("confidence"),
    )


def checked_spans(blocks: DataFrame, proposed: DataFrame) -> DataFrame:
    """proposed(block_id, start, end, marker, parent_marker, type, confidence) where a block's spans are in bounds, not blank and apart; else our own spans. ``source`` tells which."""
    w = Window.partitionBy("block_id").orderBy("start", "end")
    rows = proposed.join(blocks, "block_id").withColumn("_before", F.lag("end").over(w)).withColumn("_span", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    wrong = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text")) | F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | tx.blank("_span")
    bad = rows.groupBy("block_id").agg(F.max(F.coalesce(wrong, F.lit(True)).cast("int")).alias("_bad"))
    good = rows.join(bad.where("_bad = 0").select("block_id"), "block_id", "left_semi")
    clamp = F.round(F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 4)
    good = good.select("block_id", F.row_number().over(w).alias("span_no"), "start", "end", F.nullif(normal_marker("marker"), F.lit("")).alias("marker"), F.nullif(normal_marker("parent_marker"), F.lit("")).alias("parent_marker"), F.col("_span").alias("text"), normal_type("type").alias("type"), clamp.alias("confidence"), F.lit("model").alias("source"))
    own = spans(blocks.join(good.select("block_id").distinct(), "block_id", "left_anti"))
    return good.unionByName(own.withColumn("parent_marker", F.lit(None).cast("string")).withColumn("source", F.lit("heuristic")))


def with_parents(rows: DataFrame) -> DataFrame:
    """rows(block_id, span_no, marker, parent_marker) plus atom_id and parent_id.

    The parent is the row with the explicit parent marker, or else with the marker's own prefix (``1.a`` of ``1.a.i``), in the block
    and then anywhere, the last such row counting; or else the row just before in the block if both have markers.
    """
    ident = tx.uuid5(URL_NAMESPACE, F.concat_ws("::", F.col("block_id").cast("string"), F.col("span_no").cast("string"), F.coalesce("marker", F.lit(""))))
    rows = rows.withColumn("atom_id", ident)
    order = F.struct("block_id", "span_no")
    marked = rows.where("marker is not null")
    here = marked.groupBy("block_id", F.col("marker").alias("_m")).agg(F.max_by("atom_id", "span_no").alias("_here"))
    anywhere = marked.groupBy(F.col("marker").alias("_m")).agg(F.max_by("atom_id", order).alias("_any"))
    dotted = F.when(F.col("marker").contains("."), F.regexp_replace("marker", r"\.[^.]*\z", ""))
    before = F.lag(F.struct("atom_id", "marker")).over(Window.partitionBy("block_id").orderBy("span_no"))
    rows = rows.withColumn("_m", F.coalesce("parent_marker", dotted)).withColumn("_before", before)
    rows = rows.join(here, ["block_id", "_m"], "left").join(anywhere, "_m", "left")
    found = F.coalesce("_here", "_any")
    back = F.when(F.col("marker").isNotNull() & F.col("_before.marker").isNotNull(), F.col("_before.atom_id"))
    return rows.withColumn("parent_id", F.coalesce(F.when(found != F.col("atom_id"), found), back)).withColumn("requires_review", F.col("confidence") < REVIEW_BELOW).drop("_m", "_here", "_any", "_before")


def ref_of(locator: Column) -> Column:
    """A parser's locator as reference: type (paragraph, list_item or table_cell_list) and coordinates."""
    path = locator["list_path"]
    listed = F.coalesce(F.size(path) > 0, F.lit(False))
    kind = F.when(locator["type"].isin("table", "cell"), "table_cell_list").when(listed, "list_item").otherwise("paragraph")
    return F.struct(
        kind.alias("type"), locator["table"].alias("table"), locator["row"].alias("row"), F.coalesce(locator["col"], locator["column"].try_cast("int")).alias("col"),
        F.coalesce(locator["paragraph"], locator["index"]).alias("paragraph"), path.alias("list_path"),
    )


def enrichment_document(rows: DataFrame) -> DataFrame:
    """One row: numbers of blocks, atoms, atoms to review, and of each type."""
    return rows.agg(F.countDistinct("block_id").alias("blocks"), F.count("*").alias("atoms"), F.count_if("requires_review").alias("to_review"), *[F.count_if(F.col("type") == t).alias(t.replace("-", "_")) for t in VALID_TYPES])
