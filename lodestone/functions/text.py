"""Text expressions. Patterns carry the flags under which Java classes are Unicode-aware and only ``\\n`` ends a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)\s+\z", "")


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def blank(c: Column | str) -> Column:
    """Whether a text is null or white space only."""
    return F.coalesce(~_col(c).rlike(r"(?U)\S"), F.lit(True))


def tokens(c: Column | str) -> Column:
    """Runs of word characters, lower-cased after matching; null has none."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"(?U)\w+"), F.lit(0)), F.lower)


def whitespace_tokens(c: Column | str) -> Column:
    return F.array_remove(F.split(text_or_empty(c), r"(?U)\s+"), "")


def bounded(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters without trailing white space; a limit of 0 or less means none."""
    return _col(c) if limit <= 0 else F.when(F.length(_col(c)) > limit, rstrip(F.left(_col(c), F.lit(limit)))).otherwise(_col(c))


def preview(c: Column | str, limit: int = 600) -> Column:
    return F.when(F.length(_col(c)) > limit, F.concat(rstrip(F.left(_col(c), F.lit(limit))), F.lit("..."))).otherwise(_col(c))


def title_from_source(c: Column | str) -> Column:
    """File stem with ``-`` and ``_`` as spaces, at most 200 characters."""
    stem = F.regexp_replace(_col(c), r"(?<=.)\.[^.]*\z", "")
    return F.left(strip(F.regexp_replace(stem, "[_-]+", " ")), F.lit(200))


def extension(c: Column | str) -> Column:
    return F.when(F.instr(_col(c), ".") > 0, F.lower(F.substring_index(_col(c), ".", -1))).otherwise("")


def estimate_tokens_floor(c: Column | str) -> Column:
    """A quarter of the characters, rounded down; at least 1 for text, 0 for none."""
    n = F.length(text_or_empty(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def estimate_tokens_ceil(c: Column | str) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text_or_empty(c)) / 4)).cast("long")


def sha256(c: Column | str) -> Column:
    return F.sha2(F.encode(text_or_empty(c), "utf-8"), 256)


def uuid5(namespace_hex: str, name: Column | str) -> Column:
    """Name-based UUID: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(_col(name), "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def ordered_distinct(c: Column | str) -> Column:
    return F.array_distinct(_col(c))


def page_number(c: Column | str) -> Column:
    """A positive page, else null."""
    n = F.expr(f"try_cast({c} AS INT)") if isinstance(c, str) else c.try_cast("int")
    return F.when(n > 0, n)
