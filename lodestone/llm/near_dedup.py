"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, bands, weighted Jaccard similarity.

1. A pass over all texts counts in how many documents each shingle is found, in ``CELLS`` hashed cells: a table of fixed
   size (4 MB) whatever the corpus. A shingle in less than ``RARE`` of the documents weighs as if it were in that share, and so does
   one in less than twice the mean of the cells. So what a cell's other shingles add to a rare one's count changes nothing, at any size
   of the corpus, and a frequent one's count is much larger than that.
2. A second pass draws, for every text, improved consistent weighted samples of its distinct shingles, weighted by
   count times inverse document frequency, and packs them into bands. Texts of the same words become one.
3. Texts that agree in a band share a bucket. Each bucket has a hub, the member with the most company over all
   its bands, and every member is compared with its hubs by exact weighted Jaccard similarity: so a bucket costs as many
   comparisons as it has members. Members that reach no hub at all are then compared with the bucket's other members that
   they are not yet connected to, block by block inside tasks, so that no link in a bucket is lost.
4. Links are merged to classes; a class is named by its smallest doc_id.

Texts, not documents, are compared: a text goes by 64 bits of its 128-bit key, and doc_ids come in again at the end.

Defined results: a null or empty text, and one without letters and digits, is a class of its own; a text shorter than
five words is one shingle of all its words; rows with a null doc_id have a null class; rows that share a doc_id share a
class, and so do the copies of any of their texts; an empty table gives an empty table; extra columns are carried by ``drop_near_duplicates`` and ignored by ``near_classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shingles as sh
from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Cells of the table of document frequencies, and rows of it that travel together.
CELLS, CELL_ROWS = 1 << 20, 1 << 14
#: Share of the documents below which all shingles weigh alike.
RARE = 1 / 500
#: Rows of each table of random draws; a shingle picks a row of three tables independently.
DRAWS = 1 << 13
#: Members of a bucket that meet in one task when those without a hub are compared.
BLOCK = 256
_tables: dict[int, tuple[np.ndarray, ...]] = {}


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _texts(batch: pa.RecordBatch, *columns: str, words: int = 1 << 20) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(values of the columns, word hashes) of a batch, in parts of about a million words."""
    ids, texts = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)) if columns else [None] * batch.num_rows, batch.column("text")
    who: list = []
    own: list[np.ndarray] = []
    n = 0
    for k, i in enumerate(ids):
        who.append(i)
        own.append(sh.words(texts[k].as_py()))
        n += len(own[-1])
        if n >= words:
            yield who, own
            who, own, n = [], [], 0
    if who:
        yield who, own


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each cell: ln((N + 1) / (n + 1)) + 1 for n of N documents with a shingle there, n being no less than rare shingles'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(CELLS, np.int32), 0
        for batch in batches:
            for _, own in _texts(batch):
                for h in own:
                    if len(h):
                        seen[np.unique(_cells(sh.shingles(h, WIDTH)))] += 1
                        n += 1
        if n:
            parts = seen.reshape(-1, CELL_ROWS)
            at = [k for k in range(len(parts)) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([parts[k].tobytes() for k in at], pa.binary()), pa.array([n if k == at[0] else 0 for k in at], pa.int64())], ["part", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for k, c, m in zip(*(batch.column(x).to_pylist() for x in ("part", "counts", "n")), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32).astype(np.int64)
                n += m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array([n, *[0] * (len(sums) - 1)], pa.int64())], ["part", "counts", "n"])

    schema = "part int, counts binary, n long"
    # The rows of a part are summed as they arrive; the result is CELLS numbers.
    found = docs.mapInArrow(count, schema).repartition(CELLS // CELL_ROWS, "part").mapInArrow(add, schema).collect()
    total, seen = sum(r.n for r in found), np.zeros(CELLS, np.int64)
    for r in found:
        seen[r.part * CELL_ROWS : (r.part + 1) * CELL_ROWS] += np.frombuffer(r.counts, np.int64)
    least = min(max(RARE * total, 2 * seen.sum() / CELLS), total)
    return (np.log((total + 1) / (np.clip(seen, least, total) + 1)) + 1).astype(np.float32)


def _draws(k: int) -> tuple[np.ndarray, ...]:
    if k not in _tables:
        rng = np.random.default_rng(20_101)
        r = rng.gamma(2.0, 1.0, (DRAWS, k)).astype(np.float32) + np.float32(1e-6)
        log_c = np.log(rng.gamma(2.0, 1.0, (DRAWS, k)) + 1e-12).astype(np.float32)
        beta = rng.random((DRAWS, k)).astype(np.float32)
        _tables[k] = (r, 1 / r, log_c, beta)
    return _tables[k]


def samples(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each document ``k`` values, of which two documents share as many, in expectation, as their weighted Jaccard similarity says.

    For shingle and sample, r and c are Gamma(2, 1) and beta is uniform: t = floor(ln w / r + beta), ln y = r (t - beta),
    ln a = ln c - ln y - r. The sample is the shingle and t of the least a, here named by that least ln a itself.
    """
    r, inverse, log_c, beta = _draws(k)
    low = np.uint64(DRAWS - 1)
    one, two, three = (h & low).astype(np.int32), ((h >> np.uint64(13)) & low).astype(np.int32), ((h >> np.uint64(26)) & low).astype(np.int32)
    log_w = np.log(weight).astype(np.float32)[:, None]
    least = np.full((n_docs, k), np.inf, np.float32)
    for a in range(0, len(h), 4096):
        b = min(a + 4096, len(h))
        rr, bb = r[one[a:b]], beta[three[a:b]]
        t = inverse[one[a:b]]
        t *= log_w[a:b]
        t += bb
        np.floor(t, out=t)
        t -= bb
        t += 1
        t *= rr
        log_a = log_c[two[a:b]]
        log_a -= t
        own = doc[a:b]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        at = own[starts]
        least[at] = np.minimum(least[at], np.minimum.reduceat(log_a, starts, axis=0))
    return least


def _weighted(own: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, weights and document numbers of some texts, one after another."""
    sets = [sh.counted(sh.shingles(h, WIDTH)) for h in own]
    h = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, np.uint64)
    tf = np.concatenate([c for _, c in sets]) if sets else np.zeros(0)
    return h, tf.astype(np.float32) * idf[_cells(h)], np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, text_hash, text_key (128 bits), rep (64 of them) and the bands' keys of docs(doc_id, text_hash, text); texts without words have none."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, own in _texts(batch, "doc_id", "text_hash"):
                who, own = [w for w, h in zip(who, own, strict=True) if len(h)], [h for h in own if len(h)]
                texts = [sh.text_key(h) for h in own]
                least = samples(*_weighted(own, idf.value), len(own), BANDS * ROWS)
                rows = least.view(np.uint32).astype(np.uint64).reshape(len(own), BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(own), BANDS))
                for k in range(ROWS):
                    keys = sh.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(own) + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(pa.array([w[k] for w in who], pa.int64()) for k in (0, 1)), pa.array(texts, pa.binary()), pa.array(_reps(texts)), bands], ["doc_id", "text_hash", "text_key", "rep", "bands"])

    return docs.mapInArrow(sign, "doc_id long, text_hash long, text_key binary, rep long, bands array<long>")


def _reps(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t[:8] for t in texts), np.int64)


def _sets(docs: DataFrame, idf) -> DataFrame:
    """rep, its shingles, their weights, and the weights' sum."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in _texts(batch):
                h, w, doc = _weighted(own, idf.value)
                cuts = np.searchsorted(doc, np.arange(len(own) + 1))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_reps([sh.text_key(x) for x in own])), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([w[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([float(w[a:b].sum(dtype=np.float64)) for a, b in spans])], ["rep", "h", "w", "total"])

    return docs.mapInArrow(make, "rep long, h binary, w binary, total double")


def _shared(a: tuple[np.ndarray, np.ndarray], h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of smaller weights for each shingle of h that is in a; 0 for the others."""
    at = np.minimum(np.searchsorted(a[0], h), len(a[0]) - 1)
    return np.where(a[0][at] == h, np.minimum(a[1][at], w), 0).astype(np.float64)


def _similar(pairs: DataFrame) -> DataFrame:
    """pairs with sets (h, w, total; h2, w2, total2) -> a, b, similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("h", "w", "total", "h2", "w2", "total2")]
            out = []
            for h, w, t, h2, w2, t2 in zip(*rows, strict=True):
                if min(t, t2) < SIMILARITY * max(t, t2):
                    out.append(min(t, t2) / max(t, t2))
                    continue
                both = _shared((np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)), np.frombuffer(h2, np.uint64), np.frombuffer(w2, np.float32)).sum()
                out.append(both / (t + t2 - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.mapInArrow(compare, "a long, b long, similarity double")


def _compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the members without a hub (side 0) and the others (side 1) of a part of a bucket."""
    left, right = rows[rows.side == 0], rows[rows.side == 1].reset_index(drop=True)
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        totals, comps, reps = right.total.to_numpy(), right["comp"].to_numpy(), right.rep.to_numpy()
        hs, ws = [np.frombuffer(x, np.uint64) for x in right.h], [np.frombuffer(x, np.float32) for x in right.w]
        for y in left.itertuples():
            near = np.flatnonzero((np.minimum(totals, y.total) >= SIMILARITY * np.maximum(totals, y.total)) & (comps != y.comp))
            if not len(near):
                continue
            cuts = np.r_[0, np.cumsum([len(hs[k]) for k in near])]
            both = np.add.reduceat(_shared((np.frombuffer(y.h, np.uint64), np.frombuffer(y.w, np.float32)), np.concatenate([hs[k] for k in near]), np.concatenate([ws[k] for k in near])), cuts[:-1])
            links += [(y.rep, reps[near[k]]) for k in np.flatnonzero(both >= SIMILARITY * (totals[near] + y.total - both))]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with an id: doc_id, class_id, same_text_as (the smallest doc_id with the same words), hubs_linked."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts.select("text")))
    signed = scratch.table(signatures(texts.where("doc_id is not null"), idf), "signatures")
    same = signed.groupBy("text_key").agg(F.min(F.struct("doc_id", "text_hash", "rep", "bands")).alias("r"))
    same = scratch.table(same.select("text_key", "r.*"), "same-text")
    banded = same.select("rep", F.explode("bands").alias("key")).distinct()
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    banded = scratch.table(banded.join(shared, "key"), "buckets")
    company = banded.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = banded.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", "rep")).alias("hub")).select("key", F.col("hub.rep").alias("hub"))
    hubs = scratch.table(hubs, "hubs")
    members = banded.join(hubs, "key").select("key", "n", "rep", "hub")
    # Each text that is in a bucket is read once, from the row that it was first found in.
    carriers = same.join(company, "rep", "left_semi").select("doc_id", "text_hash")
    first = texts.join(carriers, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    sets = scratch.table(_sets(first.select("text"), idf), "sets")
    pairs = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), "h", "w", "total"), "a")
    second = sets.select(F.col("rep").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2"), F.col("total").alias("total2"))
    compared = scratch.table(_similar(with_a.join(second, "b")), "compared")
    links = compared.where(F.col("similarity") >= SIMILARITY).select("a", "b")
    # Texts of one doc_id go together, as those that are alike do.
    ids = signed.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("_most")).where("b < _most")
    together = scratch.table(signed.join(ids, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "same-id")
    comp = scratch.table(components(links.unionByName(together), scratch), "components")
    named = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    hub_comp = comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    apart = named.join(hub_comp, "hub", "left").withColumn("alone", F.col("comp") != F.coalesce("hub_comp", "hub"))
    apart = scratch.table(apart.select("key", "n", "rep", "hub", "comp", "alone"), "apart")
    left = apart.where("alone").groupBy("key").agg(F.count("*").alias("n_alone"), F.first("n").alias("n"))
    left = left.where("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_right"), F.ceil(F.col("n_alone") / BLOCK).cast("int").alias("n_left"))
    meet = apart.where("rep <> hub").join(left, "key")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = meet.where("alone").select("key", "rep", "comp", F.lit(0).alias("side"), block("n_left").alias("x"), upto("n_right").alias("y"))
    two = meet.select("key", "rep", "comp", F.lit(1).alias("side"), block("n_right").alias("y"), upto("n_left").alias("x"))
    met = one.unionByName(two).join(sets, "rep")
    more = scratch.table(met.groupBy("key", "x", "y").applyInPandas(_compare_block, "a long, b long").distinct(), "more-links")
    if not more.isEmpty():
        comp = scratch.table(components(links.unionByName(together).unionByName(more), scratch), "all-components")
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("hubs_linked"))
    of = comp.withColumnRenamed("node", "rep").join(same.select("rep", "doc_id"), "rep")
    classes = of.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    of = of.join(classes, "comp").select("rep", "class_id")
    named = (
        same.select("text_key", "rep", F.col("doc_id").alias("same_text_as")).join(of, "rep", "left").join(degree, "rep", "left")
        .select("text_key", "same_text_as", F.coalesce("class_id", "same_text_as").alias("class_id"), F.coalesce("hubs_linked", F.lit(0)).alias("hubs_linked"))
    )
    named = signed.select("doc_id", "text_key").join(named, "text_key")
    found = scratch.table(named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("same_text_as").alias("same_text_as"), F.max("hubs_linked").alias("hubs_linked")), "classes")
    scratch.drop(signed, same, banded, hubs, sets, compared, together, comp, apart, more)
    return (
        texts.select("doc_id").join(found, "doc_id", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("same_text_as", "doc_id").alias("same_text_as"), F.coalesce("hubs_linked", F.lit(0)).cast("long").alias("hubs_linked"))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class, and rows with a null doc_id. All columns are carried."""
    gone = near_classes(docs.select("doc_id", "text")).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
