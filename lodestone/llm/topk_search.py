"""Exact BM25 top-k by an inverted index in shards, with block-max WAND pruning.

Every document is indexed. A shard is at most ``SHARD_DOCS`` documents and about ``SHARD_POSTINGS`` postings, kept as a
written row of arrays: terms, where their postings begin, documents and counts. Statistics (number of documents, mean length,
document frequencies) are summed over all shards, so a score does not depend on the shard, and the shards' best are merged
exactly. Queries are written in blocks of about ``BLOCK_TERMS`` terms by executors, and a task streams them past its shards:
neither queries nor documents pass through the driver.

In a shard documents of like words stand together, so that blocks of ``BLOCK`` documents differ. The most frequent lists, those in
over ``COMMON`` of the documents, have a value for each of them, and one matrix product in single precision, widened by its greatest
rounding error, bounds every document's sum over these lists, for many queries of like words at once. Every other list knows where
each of its blocks begins and the block's greatest impact. A query's bound for a block is the greatest such sum in it plus these
maxima. The pivots are the blocks of the greatest bounds: the lists' cursors jump to them, which bounds their documents one by one,
and those that can still reach the threshold are scored in full, in double precision. The threshold, the
k-th best score over all shards that the task has gone through, grows. What is bounded below the threshold is never read.
Pivots are whole blocks, and several queries take several of them in one step, because here a step costs as much as hundreds of postings.

Ties: the smaller doc_id first, at scores rounded to 6 digits. Defined results: documents without words match nothing and queries
without words find nothing; rows with a null id are not indexed; rows that share a doc_id are indexed one by one and the best
of them counts, in thresholds and cuts too; of queries that share an id each word counts as often as in the query that has
it most; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import shingles as sh
from lodestone.llm.scratch import Scratch, open_files

K1, B = 1.5, 0.75
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Documents in a block, and blocks that a query without a threshold takes first; then all that are above it.
BLOCK, FIRST = 64, 8
#: A list in over this share of a shard's documents is dense, as long as the matrix has no more cells than this.
COMMON, DENSE_CELLS = 0.04, 1 << 24
#: Terms and queries in a written block of queries, and shards that a task holds at once.
BLOCK_TERMS, BLOCK_QUERIES, TOGETHER = 1 << 17, 256, 2
#: Queries of a matrix product, and queries times documents that are bounded together.
ALIKE, STEP = 256, 1 << 16
#: Shards that give queries their first thresholds.
SEEDS = 4
_INDEX = "doc_ids binary, lengths binary, terms binary, begins binary, docs binary, counts binary, n_docs long, n_words long"
_BLOCKS = "queries binary, begins binary, terms binary, weights binary"
_SEEDED = f"{_BLOCKS}, floors binary"


def build_index(docs: DataFrame) -> DataFrame:
    """Shards of documents(doc_id, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lengths: list[int] = []
        terms: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        n = 0

        def shard() -> pa.RecordBatch:
            # Documents of one language or subject have the same most frequent word.
            top = np.array([t[np.argmax(c)] if len(t) else 0 for t, c in zip(terms, counts, strict=True)], np.uint64)
            place = np.lexsort((lengths, top))
            flat, tf = np.concatenate([terms[k] for k in place]), np.concatenate([counts[k] for k in place])
            own = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(terms[k]) for k in place])  # a shard has at most 2**16 documents
            order = np.argsort(flat, kind="stable")
            flat, tf, own = flat[order], tf[order], own[order]
            begins = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
            raw = [np.array(ids, np.int64)[place], np.array(lengths, np.int32)[place], flat[begins], np.r_[begins, len(flat)].astype(np.int32), own, tf.astype(np.uint16 if not len(tf) or tf.max() < 1 << 16 else np.uint32)]
            return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in raw), pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["doc_ids", "lengths", "terms", "begins", "docs", "counts", "n_docs", "n_words"])

        for batch in batches:
            who, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for k, i in enumerate(who):
                h = sh.words(texts[k].as_py())
                ids.append(i)
                lengths.append(len(h))
                t, c = sh.counted(h)
                terms.append(t)
                counts.append(c)
                n += len(t)
                if len(ids) == SHARD_DOCS or n >= SHARD_POSTINGS:
                    yield shard()
                    ids, lengths, terms, counts, n = [], [], [], [], 0
        if ids:
            yield shard()

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, _INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """term, df over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, begins in zip(batch.column("terms").to_pylist(), batch.column("begins").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(begins, np.int32)).astype(np.int64))], ["term", "df"])

    return index.select("terms", "begins").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n of queries(query_id, text); a repeated word counts as often as it is there."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("query_id").to_pylist(), batch.column("text")
            for k, i in enumerate(ids):
                t, c = sh.counted(sh.words(texts[k].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i, np.int64)), pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], ["query_id", "term", "n"])

    return queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(split, "query_id long, term long, n long")


def query_blocks(weighted: DataFrame) -> DataFrame:
    """Blocks of whole queries, as rows of arrays, of weighted(query_id, term, w)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def block(q: np.ndarray, t: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((t.view(np.uint64), q))
            begins = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0])
            raw = [q[order][begins], np.r_[begins, len(q)].astype(np.int64), t[order], w[order]]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in raw], ["queries", "begins", "terms", "weights"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("query_id", "term", "w")))
            n += batch.num_rows
            if n >= BLOCK_TERMS:  # the last query may go on in the next batch
                q, t, w = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = np.searchsorted(q, q[-1]) if q[0] != q[-1] else 0
                cuts = np.flatnonzero(np.r_[True, np.diff(q[:whole]) != 0]) if whole else np.zeros(0, np.int64)
                a = 0
                for k in range(1, len(cuts) + 1):
                    b = cuts[k] if k < len(cuts) else whole
                    if k == len(cuts) or b - cuts[a] >= BLOCK_TERMS or k - a == BLOCK_QUERIES:
                        yield block(q[cuts[a] : b], t[cuts[a] : b], w[cuts[a] : b])
                        a = k
                held, n = [(q[whole:], t[whole:], w[whole:])], len(q) - whole
        if n:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return weighted.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(pack, _BLOCKS)


class Best:
    """The k best doc_ids of a query so far, by rounded score and then by id; ``least`` is the k-th score, or what is known of it before there are k."""

    __slots__ = ("ids", "k", "least", "scores")

    def __init__(self, k: int, least: float = 0.0):
        self.k, self.least = k, least
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, np.round(scores, 6)])
        order = np.lexsort((ids, -scores))
        if len(set(ids.tolist())) < len(ids):
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        order = order[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


class Shard:
    """A shard's posting lists. A dense one is a row of ``dense``, and a column of ``times``, its counts by document; the others are cut at the blocks, and ``cell`` c is one list's postings in one block."""

    def __init__(self, row: dict, mean: float):
        self.ids, lengths = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["lengths"], np.int32)
        self.terms, self.begins = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["begins"], np.int32)
        self.docs = np.frombuffer(row["docs"], np.uint16).astype(np.int32)
        tf = np.frombuffer(row["counts"], np.uint16 if len(row["counts"]) == len(row["docs"]) else np.uint32)
        self.norms = K1 * (1 - B + B * lengths / mean)
        self.impacts = self.norms[self.docs]
        self.impacts += tf
        np.divide(tf * (K1 + 1), self.impacts, out=self.impacts)
        n, self.often = len(self.ids), np.diff(self.begins)
        self.blocks = -(-n // BLOCK)
        self.distinct = len(np.unique(self.ids)) == n
        common = np.flatnonzero(self.often > max(BLOCK, COMMON * n))
        common = common[np.argsort(-self.often[common], kind="stable")][: DENSE_CELLS // max(1, n)]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[common] = np.arange(len(common), dtype=np.int32)
        self.dense, self.times = np.zeros((len(common), self.blocks * BLOCK), np.float32), np.zeros((n, len(common)), tf.dtype)
        for c, t in enumerate(common):
            a, b = self.begins[t], self.begins[t + 1]
            self.dense[c, self.docs[a:b]] = self.impacts[a:b]
            self.times[self.docs[a:b], c] = tf[a:b]
        block = self.docs // np.int32(BLOCK)
        new = np.r_[True, block[1:] != block[:-1]][: len(block)]
        new[self.begins[:-1]] = True
        starts = np.flatnonzero(new)
        self.cell_begins, self.cell_block = np.r_[starts, len(block)].astype(np.int32), block[starts]
        self.cell_most = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.zeros(0)
        self.cells = np.searchsorted(starts, self.begins)
        self.step = max(1, STEP // (self.blocks * BLOCK))
        self.read = self.held = 0  # postings read one by one, and postings of all the lists that were asked for

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], found: list[Best]) -> None:
        """Adds this shard's documents to the best of each query; a query is its terms (ascending) and their weights."""
        if not len(self.terms):
            return
        query = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        terms, weight = (np.concatenate(x) for x in zip(*queries, strict=True))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        query, at, weight = query[there], at[there], weight[there]
        self.held += int(self.often[at].sum())
        column = self.column[at]
        common = np.zeros((len(queries), len(self.dense)))
        common[query[column >= 0], column[column >= 0]] = weight[column >= 0]
        begins = np.searchsorted(query, np.arange(len(queries) + 1))
        # Queries of one language or subject have the same most frequent word, and few of the others' words; columns are by frequency.
        top = (common > 0).argmax(axis=1) if len(self.dense) else np.zeros(len(queries), np.int64)
        for key in np.unique(top):
            alike = np.flatnonzero(top == key)
            for a in range(0, len(alike), ALIKE):
                chosen = alike[a : a + ALIKE]
                columns = np.flatnonzero(common[chosen].any(axis=0))
                sums = common[np.ix_(chosen, columns)].astype(np.float32) @ self.dense[columns]
                sums *= 1 + (len(columns) + 8) * 2.0**-23  # at least the true sums: rounding adds less
                for b in range(0, len(chosen), self.step):
                    part = chosen[b : b + self.step]
                    entry, n = _ranges(begins[part], begins[part + 1])
                    of, cut = np.repeat(np.arange(len(part)), n), column[entry] < 0
                    self._walk(of[cut], at[entry[cut]], weight[entry[cut]], sums[b : b + self.step], common[part], [found[q] for q in part])

    def _walk(self, query: np.ndarray, at: np.ndarray, weight: np.ndarray, sums: np.ndarray, common: np.ndarray, found: list[Best]) -> None:
        """The pivots of some queries, given their cut lists, their weights of the dense ones, and bounds of every document's sum over these."""
        cell, n = _ranges(self.cells[at], self.cells[at + 1])
        place = np.repeat(query * self.blocks, n) + self.cell_block[cell]
        most = np.bincount(place, self.cell_most[cell] * np.repeat(weight, n), len(found) * self.blocks)
        bound = sums.reshape(-1, BLOCK).max(axis=1).astype(np.float64).reshape(len(found), -1) + most.reshape(len(found), -1)
        # A document's rounded score is less than the threshold if its bound is, by more than rounding.
        floor = np.maximum(np.array([best.least for best in found]) - 1e-6, 0.0)
        done = np.zeros(bound.shape, bool)
        new = np.flatnonzero(floor == 0)
        if len(new):
            first = np.argpartition(-bound[new], min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]
            done[new[:, None], first] = bound[new[:, None], first] > 0
        for pivots in (done, None):
            if pivots is None:
                floor = np.maximum(np.array([best.least for best in found]) - 1e-6, 0.0)
                pivots = (bound > floor[:, None]) & ~done
            if not pivots.any():
                continue
            if pivots.mean() > 0.4:
                where, m = _ranges(self.begins[at], self.begins[at + 1])
                value, line = np.repeat(weight, m), np.repeat(query * sums.shape[1], m)
            else:
                jump = np.flatnonzero(pivots.ravel()[place])
                where, m = _ranges(self.cell_begins[cell[jump]], self.cell_begins[cell[jump] + 1])
                value, line = np.repeat(np.repeat(weight, n)[jump], m), np.repeat(np.repeat(query * sums.shape[1], n)[jump], m)
            self.read += len(where)
            value *= self.impacts[where]
            line += self.docs[where]
            rare = np.bincount(line, value, sums.size).reshape(sums.shape)
            able = sums + rare
            least = floor
            if self.distinct and (floor == 0).any():
                least = self._kth(able, pivots, floor, found[0].k)
            q, d = np.nonzero((able > least[:, None]) & np.repeat(pivots, BLOCK, axis=1))
            # What can still reach the threshold is scored in full, in double precision.
            times = self.times[d].astype(np.float64)
            self.read += int(np.count_nonzero(times))
            scores = np.einsum("ij,ij->i", common[q], times * (K1 + 1) / (times + self.norms[d][:, None])) + rare[q, d]
            ends = np.searchsorted(q, np.arange(len(found) + 1))
            for k in np.unique(q):
                own = slice(ends[k], ends[k + 1])
                above = scores[own] > 0
                found[k].add(self.ids[d[own][above]], scores[own][above])

    def _kth(self, able: np.ndarray, pivots: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
        """Thresholds with those of the queries that have none yet: just below the k-th best of the pivots' bounds, as bounds are above scores by rounding alone."""
        out = floor.copy()
        for q in np.flatnonzero(floor == 0):
            inside = able[q].reshape(-1, BLOCK)[pivots[q]].ravel()
            if len(inside) > k:
                out[q] = max(0.0, np.partition(inside, len(inside) - k)[len(inside) - k] * (1 - (len(self.dense) + 8) * 2.0**-21) - 1e-6)
        return out


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, one range after another, and how many each has."""
    n = end - begin
    total = np.cumsum(n)
    return np.repeat(begin - total + n, n) + np.arange(total[-1] if len(n) else 0), n


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score (6 digits), rank of the k best of docs(doc_id, text) for each of queries(query_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "top-k")
    index = scratch.table(build_index(docs), "index")
    shards, n, words = index.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    mean = max(words / n, 1e-9) if n else 1.0
    df = frequencies(index)
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries).groupBy("query_id", "term").agg(F.max("n").alias("n")).join(df, "term").select("query_id", "term", (F.col("n") * idf).alias("w"))
    asked = scratch.path("query-blocks")
    query_blocks(weighted).write.parquet(asked)

    def shards_of(rows: pa.RecordBatch, a: int, n: int) -> list[Shard]:
        return [Shard(rows.slice(r, 1).to_pylist()[0], mean) for r in range(a, min(a + n, rows.num_rows))]

    def asked_of(row: dict) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        begins, terms, weights = np.frombuffer(row["begins"], np.int64), np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["weights"], np.float64)
        return np.frombuffer(row["queries"], np.int64), [(terms[a:b], weights[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]

    # A k-th best score over any documents is a threshold for all: a few shards give every query its first one.
    seeds = scratch.path("seeds")
    index.limit(SEEDS).write.parquet(seeds)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, path = open_files(seeds)
        for batch in batches:
            each = [asked_of(row) for row in batch.to_pylist()]
            found = [[Best(k) for _ in qs] for qs, _ in each]
            for rows in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=1):
                for shard in shards_of(rows, 0, rows.num_rows):
                    for (_, queries), best in zip(each, found, strict=True):
                        shard.search(queries, best)
            floors = [np.array([b.least for b in best]).tobytes() for best in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary())], [*batch.schema.names, "floors"])

    blocks = scratch.path("seeded-blocks")
    spark.read.schema(_BLOCKS).parquet(asked).repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(seed, _SEEDED).write.parquet(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, path = open_files(blocks)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                held = shards_of(batch, a, TOGETHER)
                for rows in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=1):
                    for row in rows.to_pylist():
                        qs, each = asked_of(row)
                        found = [Best(k, least) for least in np.frombuffer(row["floors"], np.float64).tolist()]
                        for shard in held:
                            shard.search(each, found)
                        n = [len(best.ids) for best in found]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, n)), pa.array(np.concatenate([b.ids for b in found])), pa.array(np.concatenate([b.scores for b in found]))], ["query_id", "doc_id", "score"])

    tasks = max(1, -(-shards // TOGETHER), min(shards, 2 * spark.sparkContext.defaultParallelism))
    found = scratch.table(index.repartition(tasks).mapInArrow(search, "query_id long, doc_id long, score double"), "found")
    best = found.where("score > 0").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
