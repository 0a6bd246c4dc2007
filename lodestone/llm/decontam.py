"""Passages of a benchmark inside documents, with DataFrame functions only.

A document's windows are as many words long as the item that they are held against. Both get a weighted 128-bit SimHash of
their five-word shingles (a shingle weighs as much as it has letters). The fingerprint is cut into 16 blocks of 8 bits,
and a window meets the items of its size that differ in at most two bits of a block: fingerprints that differ in at most 47
bits do so in one, so no fingerprint within that radius is missed. Candidates are then verified by exact weighted Jaccard similarity.

A window at ``similarity`` or more shares shingles of at least that part of its own weight and of the item's. So the weights
of the shingles that a document shares with items of a size are summed over every place where a window of that size can
begin, and only windows whose sum reaches that part of the lightest such item, and of the window itself, are fingerprinted. The
sum is no less than what is shared with any one item, so none is left out. The shingles of a document with such windows are
hashed once; its windows are slices of their codes. A code has room for 1022 letters; those of longer shingles travel beside
the codes (``heavy``), so that no weight is cut.

Defined results: null and empty texts and items have no words and match nothing; an item with fewer than five words is one
shingle; a document shorter than an item is one window; rows with a null doc_id or item_id match nothing and are
kept; equal rows give equal matches once; extra columns are carried by ``drop_leaks`` and ignored by ``leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

WIDTH, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCK_BITS = 128, 47, 8
#: Bits by which two fingerprints within the radius differ, at most, in one of the blocks.
APART = RADIUS // (BITS // BLOCK_BITS)
#: What a block is changed by to give every value within that distance.
_FLIPS = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= APART]
#: Characters of all items, and rows of their fingerprints' blocks, up to which such a side of a join is broadcast; beyond it the
#: joins shuffle by key.
BROADCAST_CHARS, BROADCAST_ROWS = 4_000_000, 1_000_000
_LANES = 0x0000000100000001
#: The low bits of a code: a shingle's letters, or all set for this many or more, which are then in ``heavy``.
_WEIGHT = 1023


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(w: Column, width: int | Column) -> Column:
    """The hash of each run of ``width`` words; none for fewer words."""
    k = F.lit(width) if isinstance(width, int) else width
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.slice(w, i + 1, k)))).otherwise(none)


def _weights(w: Column, width: int | Column) -> Column:
    """The letters of each run of ``width`` words; none for fewer words."""
    letters = lambda i: F.length(F.array_join(F.slice(w, i + 1, width), "")).cast("long")
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), letters)).otherwise(F.array().cast("array<bigint>"))


def _codes(w: Column, width: Column) -> Column:
    """The runs of ``width`` words in order, each as one number: 54 bits of a hash, and in the low 10 bits its letters (1023 at most)."""
    letters = lambda i: F.least(F.length(F.array_join(F.slice(w, i + 1, width), "")), F.lit(_WEIGHT)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(F.slice(w, i + 1, width)).bitwiseAND(F.lit(~_WEIGHT)).bitwiseOR(letters(i)))


def _letters(w: Column, width: Column) -> Column:
    """The letters of each run of ``width`` words if a run can have ``_WEIGHT`` of them or more, else null."""
    return F.when(F.exists(w, lambda x: F.length(x) * width >= _WEIGHT), _weights(w, width))


def _heavy(codes: Column, letters: Column) -> Column:
    """Code c and letters x of each distinct shingle with ``_WEIGHT`` letters or more."""
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("c"), F.get(letters, i).alias("x")))
    none = F.array().cast("array<struct<c:bigint,x:bigint>>")
    return F.when(letters.isNotNull(), F.array_distinct(F.filter(pairs, lambda s: s.x >= _WEIGHT))).otherwise(none)


def _total(codes: Column, heavy: Column) -> Column:
    """Letters of distinct codes; ``heavy`` may hold others too."""
    zero = F.lit(0).cast("long")
    rest = F.aggregate(heavy, zero, lambda acc, s: acc + F.when(F.array_contains(codes, s.c), s.x - _WEIGHT).otherwise(zero))
    return F.aggregate(codes, zero, lambda acc, x: acc + x.bitwiseAND(F.lit(_WEIGHT))) + rest


def _fingerprints(df: DataFrame, *keys: str) -> DataFrame:
    """keys, total and the fingerprint's halves f1 and f2 of rows(keys, codes, heavy).

    Bit b of a half is set where the shingles with that bit weigh more than half. The shingles become rows, and the weights of two bits
    are summed at once, in the lanes of a number, so the sums are made by plain partial aggregation.
    """
    rows = df.select(*keys, "heavy", F.explode("codes").alias("_c"))
    low = F.col("_c").bitwiseAND(F.lit(_WEIGHT))
    weight = F.when(low < _WEIGHT, low).otherwise(_total(F.array("_c"), F.col("heavy")))
    rows = rows.select(*keys, weight.alias("_w"), F.xxhash64("_c").alias("_h1"), F.xxhash64(F.lit(1), "_c").alias("_h2"))
    lanes = [F.sum(F.col("_w") * F.shiftright(f"_h{half}", b).bitwiseAND(F.lit(_LANES))).alias(f"_s{half}_{b}") for half in (1, 2) for b in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("total"), *lanes)

    def half(number: int) -> Column:
        # A loop over the lanes: a term for each bit would be an expression that is copied at every step of planning.
        bit = lambda part, at: F.call_function("shiftleft", (part * 2 > F.col("total")).cast("long"), at)
        pair = lambda lane, b: bit(lane.bitwiseAND(F.lit(0xFFFFFFFF)), b).bitwiseOR(bit(F.shiftrightunsigned(lane, 32), b + 32))
        return F.aggregate(F.transform(F.array(*[f"_s{number}_{b}" for b in range(32)]), pair), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    return sums.select(*keys, "total", half(1).alias("f1"), half(2).alias("f2"))


def _blocks(f1: Column, f2: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(f, b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for f in (f1, f2) for b in range(0, 64, BLOCK_BITS)])


def _first_near(x1: Column, x2: Column) -> Column:
    """The first block with at most ``APART`` bits set in the difference of two fingerprints, so that a pair is made once."""
    parts = [F.shiftrightunsigned(x, b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for x in (x1, x2) for b in range(0, 64, BLOCK_BITS)]
    return F.coalesce(*[F.when(F.bit_count(p) <= APART, F.lit(k)) for k, p in enumerate(parts)])


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity and the window (start, n_words, in words) of the best match of each such pair."""
    scratch = Scratch(docs.sparkSession, "decontam")
    item = (
        items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
        .where(F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
        .withColumn("n", F.size("w"))
    )
    n_items, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    small = F.broadcast if chars <= BROADCAST_CHARS and n_items <= BROADCAST_ROWS else lambda df: df
    small_blocks = F.broadcast if n_items * len(_FLIPS) * (BITS // BLOCK_BITS) <= BROADCAST_ROWS else lambda df: df
    doc = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    split = doc.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    width = F.least(F.lit(WIDTH), F.col("n"))
    item = item.withColumn("codes", _codes(F.col("w"), width)).withColumn("heavy", _heavy(F.col("codes"), _letters(F.col("w"), width)))
    item = item.withColumn("codes", F.array_distinct("codes")).withColumn("weight", _total(F.col("codes"), F.col("heavy")))
    # What is read more than once is written, and each of the plans below stays small: the driver's memory holds plans, not rows.
    item = scratch.table(item, "items")
    widths = sorted(r[0] for r in item.select(F.least(F.lit(WIDTH), F.col("n"))).distinct().collect())  # at most five numbers
    lightest = item.groupBy("n").agg(F.min("weight").alias("lightest"))
    key = ["doc_id", "text_hash", "n"]
    shared = None
    for k in widths or [WIDTH]:
        some = item.where(F.least(F.lit(WIDTH), F.col("n")) == k)
        own = some.select("n", F.explode(F.arrays_zip(_hashes(F.col("w"), k).alias("h"), _weights(F.col("w"), k).alias("x"))).alias("s")).select("s.h", "n", "s.x").distinct()
        at = split.select("doc_id", "text_hash", F.size("w").alias("size"), F.posexplode(_hashes(F.col("w"), k)).alias("at", "h"))
        # The first and last window that hold the shingle.
        first = F.greatest(F.lit(0), F.col("at") - F.col("n") + k)
        last = F.greatest(F.lit(0), F.least(F.col("at"), F.col("size") - F.col("n")))
        held = at.join(small(own), "h").select(*key, "x", first.alias("first"), last.alias("last"))
        shared = held if shared is None else shared.unionByName(held)
    # Going over a document, each shared shingle is added where its first window begins and taken off behind its last.
    steps = shared.select(*key, F.explode(F.array(F.struct(F.col("first").alias("start"), F.col("x")), F.struct((F.col("last") + 1).alias("start"), (-F.col("x")).alias("x")))).alias("s"))
    over = Window.partitionBy(*key).orderBy("s.start")
    sums = steps.select(*key, F.col("s.start").alias("start"), F.sum("s.x").over(over).alias("shared"), F.lead("s.start").over(over).alias("next"))
    runs = sums.where((F.col("next") > F.col("start")) & (F.col("shared") > 0)).join(small(lightest), "n").where(F.col("shared") >= F.col("lightest") * similarity - 1e-6)
    begins = runs.groupBy("doc_id", "text_hash", F.least(F.lit(WIDTH), F.col("n")).alias("width")).agg(F.collect_list(F.struct("start", "next", "n", "shared")).alias("runs"))
    # Documents with such windows, with the code of each of their shingles in order; all that follows reads this table.
    hit = doc.join(begins, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "width"])
    hit = hit.select("doc_id", "text_hash", words(F.col("text")).alias("w"), "width", "runs")
    hit = hit.select("doc_id", "text_hash", "width", "runs", _codes(F.col("w"), F.col("width")).alias("codes"), _letters(F.col("w"), F.col("width")).alias("letters"))
    hit = scratch.table(hit, "hit-documents")
    # A run has its own piece of the codes, and a window its own piece of the run's.
    piece = lambda c: F.slice(c, F.col("r.start") + 1, F.col("r.next") - F.col("r.start") + F.col("r.n") - F.col("width")).alias(c)
    runs = hit.select("doc_id", "text_hash", "width", "codes", "letters", F.explode("runs").alias("r")).select("doc_id", "text_hash", "r.*", "width", piece("codes"), piece("letters"))
    window = lambda c: F.slice(c, F.col("start") - F.col("first") + 1, F.col("n") - F.col("width") + 1)
    key = ["doc_id", "text_hash", "start", "n"]
    coded = (
        runs.repartition("doc_id", "start", "n").withColumnRenamed("start", "first")
        .select("doc_id", "text_hash", "first", "n", "width", "shared", "codes", "letters", F.explode(F.sequence(F.col("first"), F.col("next") - 1)).alias("start"))
        .select(*key, "shared", F.array_distinct(window("codes")).alias("codes"), _heavy(window("codes"), window("letters")).alias("heavy"))
        .where(F.col("shared") >= _total(F.col("codes"), F.col("heavy")) * similarity - 1e-6).select(*key, "codes", "heavy")
    )
    coded = scratch.table(coded, "windows")
    prints = scratch.table(_fingerprints(coded, *key), "fingerprints")
    made = prints.select(*key, "f1", "f2", F.posexplode(_blocks(F.col("f1"), F.col("f2"))).alias("block", "value"))
    items_coded = item.select("item_id", "n", "codes", "heavy", "weight")
    item_prints = scratch.table(_fingerprints(items_coded, "item_id", "n").select("item_id", "n", F.col("f1").alias("g1"), F.col("f2").alias("g2")), "item-fingerprints")
    held = item_prints.select("*", F.posexplode(_blocks(F.col("g1"), F.col("g2"))).alias("block", "value"))
    held = held.withColumn("value", F.explode(F.transform(F.array(*map(F.lit, _FLIPS)), lambda x: F.col("value").bitwiseXOR(x))))
    x1, x2 = F.col("f1").bitwiseXOR(F.col("g1")), F.col("f2").bitwiseXOR(F.col("g2"))
    near = (
        made.join(small_blocks(held), ["n", "block", "value"])
        .where((F.bit_count(x1) + F.bit_count(x2) <= RADIUS) & (F.col("block") == _first_near(x1, x2)))
        .select(*key, "item_id")
    )
    two = items_coded.select("item_id", F.col("codes").alias("codes2"), F.col("weight").alias("weight2"))
    found = (
        near.join(coded, key).join(small(two), "item_id")
        .select("doc_id", "item_id", "start", "n", _total(F.col("codes"), F.col("heavy")).alias("weight"), "weight2", _total(F.array_intersect("codes", "codes2"), F.col("heavy")).alias("both"))
        .withColumn("similarity", F.col("both") / (F.col("weight") + F.col("weight2") - F.col("both")))
    )
    best = (
        found.where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n")).alias("best"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), F.col("best.n").alias("n_words"))
    )
    best = scratch.table(best, "leaks")
    scratch.drop(item, hit, coded, prints, item_prints)
    return best


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item. All columns are carried."""
    gone = leaks(docs.select("doc_id", "text"), items, similarity).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
