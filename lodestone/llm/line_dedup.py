"""Line de-duplication with DataFrame functions only.

Every text is split at ``\n``. A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z
lower-cased. A key of at least ``min_chars`` code points that is found in at least ``min_docs`` documents stays in
the smallest doc_id that holds it, with all its lines there, and loses its lines everywhere else.

Defined results: a null or empty text is one empty line and comes back as ``''``; rows with a null doc_id are never
matched and keep all lines; rows that share a doc_id count as one document for the keys, and each of these rows is cut
by itself; extra columns of the input are carried through untouched, whatever their names, but for ``n_lines`` and
``n_dropped``, in whose place the operator's own come; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The key under which equal lines meet. Where every character is one byte, ``lower`` changes A-Z alone."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` cut as described above, plus ``n_lines`` and ``n_dropped`` (long).

    Only two 64-bit hashes of a key, the doc_id and the line's number are shuffled for the search; the hashes that
    repeat are joined back by key, where a hot key is split by the adaptive skew join, and the positions to drop meet
    the text in one join on the document.
    """
    keyed = (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.posexplode(_lines(F.col("text"))).alias("_pos", "_line"))
        .select("_doc", "_text", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_doc", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    if min_docs <= 2:
        repeated = keyed.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).where("_first < _last")
    else:
        repeated = (
            keyed.groupBy("_h1", "_h2", "_doc").agg(F.lit(1).alias("_one"))
            .groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.sum("_one").alias("_docs")).where(F.col("_docs") >= min_docs)
        )
    # Read from a table, both sides of the join are plain exchanges, and a key with a large share of the lines can be split.
    repeated = Scratch(docs.sparkSession, "line-dedup").table(repeated, "repeated")
    dropped = (
        keyed.join(repeated.select("_h1", "_h2", "_first"), ["_h1", "_h2"])
        .where("_doc <> _first")
        .groupBy("_doc", "_text")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))
    )
    text = F.col("_in.text")
    lines, n = F.col("_lines"), F.size("_lines")
    edges = F.concat(F.array(F.lit(-1)), F.coalesce("_drop", F.array().cast("array<int>")), F.array(n))
    spans = F.zip_with(F.slice("_edges", 1, F.size("_edges") - 1), F.slice("_edges", 2, F.size("_edges") - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
        .withColumns({"_doc": F.col("_in.doc_id"), "_text": F.xxhash64("_in.text")})
        .join(dropped, ["_doc", "_text"], "left")
        .withColumn("_lines", _lines(text))
        .withColumn("_edges", edges)
        .select(
            *[F.col(f"_in.`{c}`").alias(c) for c in own],
            F.when(F.col("_drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(spans), "\n")).alias("text"),
            n.cast("long").alias("n_lines"),
            (F.size("_edges") - 2).cast("long").alias("n_dropped"),
        )
    )
