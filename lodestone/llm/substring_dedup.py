"""Substring de-duplication by content-defined chunks.

A gear rolling hash over the UTF-8 bytes cuts a text where some of the hash's bits are zero, after at least ``LEAST_BYTES`` and
at most ``MOST_BYTES`` of a chunk. The hash sees the last ``WINDOW`` bytes only, so after an insertion the cuts fall into step
again, and a passage has the same chunks wherever it stands. Chunks are compared by 96 bits of a digest; each stays where it
is first: in the smallest doc_id that holds it, at its first place there. Chance repeats of a few common words are no
passages: other copies are removed only in runs of repeated chunks that are at least ``RUN_BYTES`` long together.

Defined results: a null or empty text has no chunks and comes back empty; rows with a null doc_id are never matched and
stay whole; rows that share a doc_id are one holder of their chunks, and each is cut by itself, so equal rows are cut alike;
an empty table gives an empty table; extra columns are carried by ``drop_repeated_passages``, but for those named as its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

LEAST_BYTES, MOST_BYTES, RUN_BYTES = 16, 512, 128
#: A cut is possible after one byte in 2**CUT_BITS.
CUT_BITS, WINDOW = 4, 16
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """For each byte the sum of gear[byte k back] << k over the last WINDOW bytes, by doubling."""
    h = _GEAR[raw]
    k = 1
    while k < WINDOW:
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h, k = more, 2 * k
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some UTF-8 bytes; no character is split."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    # The upper of the window's bits depend on most of its bytes.
    zero = (gear_hashes(raw) >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1) == 0
    ends = np.ones(n, bool)
    ends[:-1] = (raw[1:] & 0xC0) != 0x80
    maybe = (np.flatnonzero(zero & ends) + 1).tolist()
    out, at = [], 0
    for c in [*maybe, n]:
        while c - at > MOST_BYTES:
            cut = at + MOST_BYTES
            while not ends[cut - 1]:
                cut -= 1
            out.append(cut)
            at = cut
        if c - at >= LEAST_BYTES and c < n:
            out.append(c)
            at = c
    if at < n:
        out.append(n)
    return np.array(out, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """doc, text_hash, pos (number of the chunk) and digest (d1, d2) of documents(doc, text_hash, text); of a text's equal chunks the first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy(), batch.column("text").cast(pa.binary())
            a = 0
            while a < len(ids):
                counts, places, digests, n, b = [], [], [], 0, a
                while b < len(ids) and n < 4_000_000:
                    raw = texts[b].as_py()
                    n += len(raw)
                    own: dict[bytes, int] = {}
                    begin = 0
                    for k, end in enumerate(cuts(np.frombuffer(raw, np.uint8)).tolist()):
                        own.setdefault(xxhash.xxh3_128_digest(raw[begin:end]), k)
                        begin = end
                    counts.append(len(own))
                    places += own.values()
                    digests += own
                    b += 1
                at = np.repeat(np.arange(a, b), counts)
                a = b
                half = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(hashes[at], pa.int32()), pa.array(places, pa.int32()), pa.array(half[:, 0]), pa.array((half[:, 1] & 0x7FFFFFFF).astype(np.int32))], ["doc", "text_hash", "pos", "d1", "d2"])

    return docs.mapInArrow(cut, "doc long, text_hash int, pos int, d1 long, d2 int")


def _keep(text: bytes, places: list[int]) -> tuple[str, list[tuple[int, int]], int]:
    """Text without the runs of repeated chunks that are long enough, the runs (start, end in bytes), and the number of chunks."""
    ends = cuts(np.frombuffer(text, np.uint8)).tolist()
    starts = [0, *ends[:-1]]
    elsewhere = {text[starts[p] : ends[p]] for p in places}
    seen: set[bytes] = set()
    runs: list[tuple[int, int]] = []
    for p in range(len(ends)):
        chunk = text[starts[p] : ends[p]]
        if chunk not in elsewhere and chunk not in seen:
            seen.add(chunk)
            continue
        if runs and runs[-1][1] == starts[p]:
            runs[-1] = (runs[-1][0], ends[p])
        else:
            runs.append((starts[p], ends[p]))
    runs = [(a, b) for a, b in runs if b - a >= RUN_BYTES]
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out).decode("utf-8"), runs, len(ends)


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut, plus n_chunks, n_dropped_bytes, dropped (start, end in bytes of the old text) and copy_of, the doc_ids that keep what other documents hold too."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.hash("text"))
    parts = chunks(rows)
    first = parts.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("d1", "d2", "first")
    first = scratch.table(first, "first")
    again = parts.join(first, ["d1", "d2"]).where("doc <> first")
    marked = again.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("pos", F.col("first").alias("of"))).alias("places"))
    marked = scratch.table(marked, "repeated")
    own = [c for c in docs.columns if c not in ("text", "n_chunks", "n_dropped_bytes", "dropped", "copy_of")]
    joined = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("text_hash", F.hash("text")).join(marked, ["doc", "text_hash"], "left")
        .select("row", F.col("doc").isNotNull().alias("known"), "text", "places")
    )
    schema = "row " + joined.schema["row"].dataType.simpleString() + ", text string, n_chunks long, n_dropped_bytes long, dropped array<struct<start:int,end:int>>, copy_of array<long>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, sizes, runs, origins = [], [], [], [], []
            for raw, places, known in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), batch.column("known").to_pylist(), strict=True):
                places = places or []
                # A row without an id holds no chunk that another place could lose against.
                text, cut, n = _keep(raw, [p["pos"] for p in places]) if known else (raw.decode(), [], len(cuts(np.frombuffer(raw, np.uint8))))
                texts.append(text)
                counts.append(n)
                sizes.append(sum(b - a for a, b in cut))
                runs.append([{"start": a, "end": b} for a, b in cut])
                origins.append(sorted({p["of"] for p in places}) if cut else [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, spans), pa.array(origins, pa.list_(pa.int64()))], ["row", "text", "n_chunks", "n_dropped_bytes", "dropped", "copy_of"])

    out = joined.mapInArrow(keep, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "text", "n_chunks", "n_dropped_bytes", "dropped", "copy_of")
