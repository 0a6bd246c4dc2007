"""Conversations rebuilt on shared openings, and the trie of their prefixes.

A node of depth d is a distinct sequence of the first d turns (role, text). Turns are hashed together with their place, and a
prefix's digest is the exclusive or of its turns' hashes, 128 bits, so prefixes are digested by a running value over ranges
(``plans.scans``) whatever the length of a conversation, and a node's parent is known from the node.

A count-min sketch of all prefixes is kept as the cells that were hit twice or more. A prefix with a cell that was hit once has the
estimate one, which proves that a single conversation has it, and so with all that follows it: such tails become rows where
they are read. Only prefixes that may be shared are shuffled, and counted exactly; the sketch's width decides how many single
prefixes go with them and never the result.

What a subtree holds is summed without walking the trie. A node is named by its smallest member c; along c's path the nodes that c
names are the last ones, from depth r(c) on. So sums over a subtree's nodes are sums over its members of what lies below r(c).

Defined results: rows with a null conv_id are ignored; a null role or text is empty; turns that share a place (or have none) are taken in the
order of a digest of role and text, and rows that repeat are turns each; of a negative conv_id c the remainder c % 5 is negative
or zero, as in SQL; a rebuilt conversation without turns is a member of the root alone; an empty table gives no rows, and any other has
a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, open_files
from lodestone.plans.scans import Run, scan
from lodestone.plans.tables import written

GROUP, HEADS = 5, 9
#: Halves of the digest that choose a cell in each row of the sketch; a row has a power of two of cells, at least LOAD times the prefixes, between these bounds.
ROWS, LOAD, LEAST_CELLS, MOST_CELLS = ("a", "b"), 4, 1 << 16, 1 << 29
#: Bytes of ids that are hashed at once.
ID_BYTES = 1 << 16
TAIL, LAST, FIRST, MAYBE = range(4)
EMPTY = hashlib.sha256(b"").hexdigest()


# --- rebuilding ----------------------------------------------------------------------------------------------------------


def _head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _own_turns(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """conv, n (from 1, by turn), t1, t2 (digests of role and text), size (bytes of the text), and if asked for role and text themselves."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("size"),
        *([role.alias("role"), text.alias("text")] if texts else []),
    )
    return scan(turns, ["conv"], ["at", "t1", "t2"], {"n": Run("count")}).drop("at")


def _openings(convs: DataFrame) -> DataFrame:
    """convs(conv, own turns) plus base, opened (turns that come from the group's first conversation) and short (turns that it lacks)."""
    base = (F.col("conv") - F.col("conv") % GROUP).alias("base")
    bases = convs.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("own").alias("_there"))
    info = convs.select("conv", "own", base, _head(F.col("conv")).alias("h")).join(bases, "base", "left")
    opened = F.least(F.col("h").cast("long"), F.coalesce("_there", F.lit(0)))
    return info.select("conv", "own", "base", "h", opened.alias("opened"), (F.col("h") - opened).alias("short"))


def _convs(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.max("n").alias("own"))


def rebuilt(conversations: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv, pos (from 1), t1, t2, size of every rebuilt conversation's turns, and conv, len of every one, those without turns too.

    Only conversations whose group opens with fewer turns than they should take need that length; all else is known from the row.
    """
    scratch = scratch or Scratch(conversations.sparkSession, "prefix-trie")
    turns = scratch.table(_own_turns(conversations), "turns")
    convs = scratch.table(_convs(turns), "conversations")
    info = _openings(convs)
    short = info.where("short > 0").select("conv", "short")
    tails = turns.where(F.col("n") > _head(F.col("conv"))).join(short, "conv", "left").select("conv", (F.col("n") - F.coalesce("short", F.lit(0))).alias("pos"), "t1", "t2", "size")
    opens = turns.where((F.col("conv") % GROUP == 0) & (F.col("n") < HEADS))
    reach = F.sequence(F.when(F.col("conv") <= 0, 1 - GROUP).otherwise(0), F.when(F.col("conv") >= 0, GROUP - 1).otherwise(0))
    opens = opens.select(F.explode(reach).alias("_k"), F.col("conv").alias("base"), "n", "t1", "t2", "size").select(F.try_add("base", F.col("_k").cast("long")).alias("conv"), F.col("n").alias("pos"), "t1", "t2", "size")
    opens = opens.where(F.col("pos") <= _head(F.col("conv"))).join(convs.select("conv"), "conv", "left_semi")
    return tails.unionByName(opens), info.select("conv", (F.col("opened") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of ``prefix_trie`` plus role and text of each node's last turn; null for the root."""
    turns = written(_own_turns(conversations, texts=True), "turns")
    info = _openings(_convs(turns)).select(F.col("conv").alias("conv_id"), "base", "opened", "short")
    held = F.col("depth") <= F.col("opened")
    at = nodes.join(info, "conv_id").withColumns({"_conv": F.when(held, F.col("base")).otherwise(F.col("conv_id")), "_n": F.when(held, F.col("depth")).otherwise(F.col("depth") + F.col("short"))})
    texts = turns.select(F.col("conv").alias("_conv"), F.col("n").alias("_n"), "role", "text")
    return at.join(texts, ["_conv", "_n"], "left").select(*nodes.columns, "role", "text")


# --- sketch ----------------------------------------------------------------------------------------------------------------


def _sketch(prefixes: DataFrame, cells: int, scratch: Scratch) -> str:
    """Folder of the cells that two or more prefixes hit, as bitmaps. Cells are counted by tasks before they are shuffled."""
    hit = F.array(*[F.col(c).bitwiseAND(F.lit(cells - 1)) + F.lit(k * cells) for k, c in enumerate(ROWS)])
    twice = prefixes.select(F.explode(hit).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Spark's bitmaps hold the numbers from 1 on.
    bits = twice.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    path = scratch.path("sketch")
    bits.write.parquet(path)
    return path


def _loaded(path: str, cells: int) -> np.ndarray:
    """The bitmaps of a sketch as one array of bits, inside a task."""
    fs, base = open_files(path)
    bits = np.zeros(len(ROWS) * cells // 8, np.uint8)
    schema = pa.schema([("bucket", pa.int64()), ("bits", pa.binary())])
    for batch in ds.dataset(base, filesystem=fs, format="parquet", schema=schema).to_batches():
        for bucket, raw in zip(batch["bucket"].to_pylist(), batch["bits"].to_pylist(), strict=True):
            bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(raw, np.uint8)
    return bits


def _estimated_once(digests: list[np.ndarray], cells: int, bits: np.ndarray) -> np.ndarray:
    """Whether the least of a prefix's cells was hit once."""
    once = np.zeros(len(digests[0]), bool)
    for k, d in enumerate(digests):
        cell = (d & np.int64(cells - 1)) + np.int64(k * cells)
        once |= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
    return once


# --- the trie --------------------------------------------------------------------------------------------------------------


_PREFIX = ["conv", "depth", "t1", "t2", "a", "b", "size", "upto"]


def _screened(prefixes: DataFrame, path: str, cells: int) -> DataFrame:
    """prefixes plus kind: MAYBE shared; FIRST of the single ones in a run of a conversation's turns; TAIL behind it, and the run's LAST of these.

    In a run every prefix behind a single one is single, whatever its own estimate.
    """

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _loaded(path, cells)
        held, last, in_single = None, (None, 0), False

        def judged(table: pa.Table, more: bool):
            nonlocal last, in_single
            n = table.num_rows
            conv, depth = (table.column(c).to_numpy() for c in ("conv", "depth"))
            once = _estimated_once([table.column(c).to_numpy() for c in ROWS], cells, bits)
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)
            new[0] = last != (conv[0], depth[0] - 1)
            singles = np.cumsum(once)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            earlier = (singles - once > np.r_[0, singles][start]) | ((np.cumsum(new) == 0) & in_single)
            kind = np.where(earlier, TAIL, np.where(once, FIRST, MAYBE)).astype(np.int8)
            kind[np.r_[new[1:], not more] & (kind == TAIL)] = LAST
            keep = n - 1 if more else n  # the last row's successor comes with the next batch
            if keep:
                last, in_single = (conv[keep - 1], depth[keep - 1]), bool(kind[keep - 1] != MAYBE)
            return table.slice(0, keep).append_column("kind", pa.array(kind[:keep])), table.slice(keep)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:
                out, held = judged(table, True)
                yield from out.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from judged(held, False)[0].combine_chunks().to_batches()

    return prefixes.select(*_PREFIX).mapInArrow(screen, ", ".join(f"{c} long" for c in _PREFIX) + ", kind byte")


def _ends(rows: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of rows(depth, a, b, conv): the hash of a node's ids in order.

    Ids are sorted over ranges and written out as pieces of text, so that of a node that very many conversations end in only the
    hashing of these pieces, which goes from one to the next, is left to one task, which holds one piece.
    """
    node = ["depth", "a", "b"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in node], axis=1)
            ids = batch.column("conv").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            parts = [(a, min(b, a + ID_BYTES // 8)) for lo, b in zip(cuts, cuts[1:]) for a in range(lo, b, ID_BYTES // 8)]
            text = [",".join(map(str, ids[a:b])) for a, b in parts]
            first = [a for a, _ in parts]
            yield pa.RecordBatch.from_arrays([*[pa.array(keys[first, k]) for k in range(3)], pa.array([ids[a] for a in first], pa.int64()), pa.array(text, pa.string())], [*node, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in [*node, "ids"]), strict=True):
                if key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([*[pa.array([d[k] for d in done], pa.int64()) for k in range(3)], pa.array([d[3] for d in done])], [*node, "ends_sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in now], pa.array([state.hexdigest()])], [*node, "ends_sha256"])

    cut = rows.select(*node, "conv").repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").mapInArrow(pieces, "depth long, a long, b long, first long, ids string")
    return cut.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    (conv_id, depth) names a node: its turns are the first ``depth`` ones of that conversation in ``rebuilt``.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    turns, lengths = rebuilt(conversations, scratch)
    lengths = scratch.table(lengths, "lengths")
    placed = turns.select("conv", F.col("pos").alias("depth"), "size", F.xxhash64("pos", "t1", "t2").alias("t1"), F.xxhash64(F.lit(2), "t2", "pos", "t1").alias("t2"))
    prefixes = scan(placed, ["conv"], ["depth"], {"a": Run("xor", "t1"), "b": Run("xor", "t2"), "upto": Run("sum", "size")})
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.coalesce(F.sum("len"), F.lit(0)).alias("prefixes")).first()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (LOAD * int(whole["prefixes"]) - 1).bit_length()))
    screened = scratch.table(_screened(prefixes, _sketch(prefixes, cells, scratch), cells), "screened")

    # Of a conversation's first single prefix the parent may be shared; a run of turns that another task read may have its own first.
    once = screened.where(F.col("kind") == FIRST)
    once = once.groupBy("conv").agg(F.min_by(F.struct("depth", "t1", "t2", "a", "b", "size", "upto"), "depth").alias("s")).select("conv", "s.*")
    once = scratch.table(once, "first-single")
    rest = screened.where(F.col("kind") != TAIL).join(lengths.join(once.select("conv", F.col("depth").alias("_from")), "conv", "left"), "conv")
    rest = scratch.table(rest, "not-tails")
    maybe = rest.where((F.col("kind") == MAYBE) & (F.col("_from").isNull() | (F.col("depth") < F.col("_from"))))
    behind = rest.where((F.col("kind") == LAST) | (F.col("depth") > F.col("_from")))

    node = ["depth", "a", "b"]
    known = maybe.groupBy(*node).agg(
        F.min("conv").alias("rep"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("len")).alias("ends"),
        F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first(F.col("upto") - F.col("size")).alias("before"),
    )
    known = scratch.table(known, "nodes")
    shape = F.struct("depth", F.col("a").bitwiseXOR(F.col("t1")).alias("pa"), F.col("b").bitwiseXOR(F.col("t2")).alias("pb"), "before")
    named = known.groupBy("rep").agg(F.min_by(shape, "depth").alias("top"), F.max_by(F.struct("depth", (F.col("n") == F.col("ends")).alias("bare")), "depth").alias("low"))
    tail = once.select("conv", F.struct("depth", F.col("a").bitwiseXOR(F.col("t1")).alias("pa"), F.col("b").bitwiseXOR(F.col("t2")).alias("pb"), (F.col("upto") - F.col("size")).alias("before")).alias("tail"))
    # Of a conversation that names no node the whole length is shared with smaller ones.
    total = maybe.where("depth = len").select("conv", "upto")
    convs = (
        lengths.join(named, lengths["conv"] == named["rep"], "left").drop("rep").join(tail, "conv", "left").join(total, "conv", "left")
        .withColumn("own", F.coalesce("top", "tail"))
        .select(
            "conv", "len", F.coalesce("own.depth", F.col("len") + 1).alias("r"), F.coalesce("own.before", "upto", F.lit(0)).alias("shared"),
            (F.col("tail").isNotNull() | ((F.col("low.depth") == F.col("len")) & F.col("low.bare"))).alias("leaf"),
            F.col("own.depth").alias("_d"), (F.col("own.depth") - 1).alias("depth"), F.col("own.pa").alias("a"), F.col("own.pb").alias("b"), F.col("tail.depth").alias("single"),
        )
        .withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    )
    above = known.select(*node, F.col("rep").alias("_rep"))
    root = F.lit(whole["least"]).cast("long")
    convs = convs.join(above, node, "left").select("conv", "len", "r", "shared", "leaf", "single", F.when(F.col("r") == 1, root).otherwise(F.col("_rep")).alias("parent"))
    convs = scratch.table(convs, "named")

    each = maybe.drop("len", "_from", "kind").join(convs, "conv")
    members = each.groupBy(*node).agg(
        F.min(F.struct(F.col("conv").alias("conv_id"), F.when(F.col("depth") > F.col("r"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"))).alias("m"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("r") <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("r"), F.col("shared") - F.col("upto") + F.col("size")).otherwise(0)).alias("saved_tokens"),
    )
    ended = maybe.where("depth = len").select(*node, "conv")
    none = F.lit(None).cast("long")
    nodes = members.join(_ends(ended), node, "left").select("m.conv_id", "depth", "m.parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    top = convs.agg(
        F.count("*").alias("n_convs"), F.count_if((F.col("r") <= 1) & (F.col("len") > 0)).alias("n_children"), F.greatest(F.count_if("leaf"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("shared"), F.lit(0)).alias("saved_tokens"),
    ).where("n_convs > 0")
    bare = lengths.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv")
    top = top.withColumn("depth", F.lit(0).cast("long")).join(_ends(bare).select("depth", "ends_sha256"), "depth", "left")
    top = top.select(root.alias("conv_id"), "depth", none.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    def alone(rows: DataFrame, parent: Column, more: Column) -> DataFrame:
        """Nodes of single prefixes; ``more`` tells whether the conversation goes on."""
        ends = F.when(more, F.lit(EMPTY)).otherwise(F.sha2(F.col("conv").cast("string").cast("binary"), 256))
        one = F.lit(1).cast("long")
        return rows.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), more.cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))

    goes_on = F.col("depth") < F.col("len")
    begun = convs.where("single is not null").withColumn("depth", F.col("single"))
    begun = alone(begun, F.when(F.col("r") < F.col("single"), F.col("conv")).otherwise(F.col("parent")), goes_on)
    tails = alone(screened.where(F.col("kind") == TAIL), F.col("conv"), F.lit(True))
    return top.unionByName(nodes).unionByName(begun).unionByName(tails).unionByName(alone(behind, F.col("conv"), goes_on))
