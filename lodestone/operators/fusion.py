"""Reciprocal-rank fusion of whole ranked lists, without ranking them.

A document that is not among the first t of either list scores at most 2 / (rrf_k + t + 1), and the first k of either list have k documents of at
least 1 / (rrf_k + k). So t = rrf_k + 2 k ends the threshold algorithm for any query: the best k of the fusion are among the first t of the two
lists, of whatever length these are. Where such a candidate stands further down in the other list its place is counted, as the number of
documents ahead of it: tasks add up counts, and no list is sorted or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.plans.tables import new_path, read_part, written

#: Scores that a task compares with the candidates at once.
COUNT_ROWS = 500_000


def depth(k: int, rrf_k: int = ranking.RRF_K) -> int:
    """How many of each list's first rows hold the best k of the fusion."""
    return rrf_k + 2 * k


def _ahead(q: np.ndarray, s: np.ndarray, d: np.ndarray, tq: np.ndarray, ts: np.ndarray, td: np.ndarray) -> np.ndarray:
    """For each candidate (query, score, document) how many of the rows (q, s, d) of its query come before it."""
    row = np.r_[np.zeros(len(tq), np.int8), np.ones(len(q), np.int8)]
    query = np.r_[tq, q]
    order = np.lexsort((row, np.r_[td, d], -np.r_[ts, s], query))
    before = np.cumsum(row[order])
    at = np.empty(len(order), np.int64)
    at[order] = before
    first = np.r_[True, query[order][1:] != query[order][:-1]]
    base = np.maximum.accumulate(np.where(first, before - row[order], 0))
    start = np.empty(len(order), np.int64)
    start[order] = base
    return (at - start)[: len(tq)]


def _blocked(candidates: DataFrame, blocks: int, label: str) -> str:
    path = new_path(candidates.sparkSession, label)
    candidates.withColumn("block", _block(blocks)).repartition("block").write.partitionBy("block").parquet(path)
    return path


def _block(blocks: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")


_COUNTS = "query_id long, doc_id long, ahead long"


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg((F.sum("ahead") + 1).cast("int").alias("rank"))


def places_in(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, doc_id, rank of candidates(query_id, doc_id, score) among scored(query_id, doc_id, score): by score, of equal ones the smaller document first."""
    blocks = max(1, -(-candidates.select("query_id").distinct().count() // ranking.QUERY_BLOCK))
    path = _blocked(candidates.select("query_id", "doc_id", "score"), blocks, "candidates")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in ranking.held_rows(batches, COUNT_ROWS):
            q, d, s, b = (rows[c].to_numpy() for c in ("query_id", "doc_id", "score", "block"))
            for block in np.unique(b).tolist():
                part = read_part(path, f"block={block}", ["query_id", "doc_id", "score"])
                if part is None:
                    continue
                own = b == block
                tq, td, ts = (part[c].to_numpy() for c in ("query_id", "doc_id", "score"))
                ahead = _ahead(q[own], s[own], d[own], tq, ts, td)
                yield pa.RecordBatch.from_arrays([pa.array(tq), pa.array(td), pa.array(ahead)], ["query_id", "doc_id", "ahead"])

    rows = scored.select("query_id", "doc_id", "score", _block(blocks).alias("block")).sortWithinPartitions("block")
    return _summed(rows.mapInArrow(count, _COUNTS))


def places_among(vectors: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, doc_id, rank of candidates(query_id, doc_id) among all vectors(doc_id, embedding) by similarity to queries(query_id, embedding); those without a vector have no row.

    Two scans of the vectors: one for the candidates' own similarities, one that counts what is ahead of them.
    """
    kind = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), kind)
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), kind)
    pairs = candidates.select("query_id", "doc_id").join(rows, "doc_id").join(asked.withColumnRenamed("embedding", "asked"), "query_id")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ranking._unit_rows(batch.column("asked")), ranking._unit_rows(batch.column("embedding"))
            w = min(one.shape[1], two.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("doc_id"), pa.array(np.round((one[:, :w] * two[:, :w]).sum(axis=1), 6))], ["query_id", "doc_id", "score"])

    known = written(pairs.mapInArrow(similar, "query_id long, doc_id long, score double"), "similarities")
    asked = asked.join(known.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "score")).alias("candidates")), "query_id")  # at most 2 t of a query
    path, blocks = ranking.query_blocks(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in ranking.held_rows(batches, ranking.HELD_ROWS):
            who = held["doc_id"].to_numpy()
            for block in range(blocks):
                part = read_part(path, f"block={block}", ["query_id", "embedding", "candidates"])
                if part is None:
                    continue
                ids, unit = part["query_id"].to_numpy(), ranking._unit_rows(part["embedding"])
                each = [(np.array([c["doc_id"] for c in own]), np.array([c["score"] for c in own])) for own in part["candidates"].to_pylist()]
                ahead = [np.zeros(len(d), np.int64) for d, _ in each]
                for a in range(0, held.num_rows, ranking.DENSE_ROWS):
                    sims = np.round(ranking._unit_rows(held["embedding"].slice(a, ranking.DENSE_ROWS), unit.shape[1]) @ unit.T, 6)
                    inside = who[a : a + ranking.DENSE_ROWS]
                    order = np.sort(sims, axis=0)
                    for j, (d, s) in enumerate(each):
                        over, least = np.searchsorted(order[:, j], s, "right"), np.searchsorted(order[:, j], s, "left")
                        ahead[j] += len(inside) - over
                        for x in np.flatnonzero(over > least).tolist():
                            ahead[j][x] += ((sims[:, j] == s[x]) & (inside < d[x])).sum()
                if each:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(d) for d, _ in each])), pa.array(np.concatenate([d for d, _ in each])), pa.array(np.concatenate(ahead))], ["query_id", "doc_id", "ahead"])

    return _summed(rows.mapInArrow(count, _COUNTS)).join(known.withColumnRenamed("score", "similarity"), ["query_id", "doc_id"])


def uncut(docs: DataFrame | None, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 5, rrf_k: int = ranking.RRF_K, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, work): the fusion of all that BM25 finds with all vectors, cut to k, with similarity; and query_id, rows, how many rows of the two lists were looked at."""
    t = depth(k, rrf_k)
    scored = written(ranking.bm25_scores(docs, queries, index), "scores")
    lexical = written(ranking.ranked(scored, t, "doc_id"), "lexical")
    near = written(ranking.dense(vectors, query_vectors, t), "near")
    asks = query_vectors.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    far = written(places_among(vectors, asks, lexical.join(near, ["query_id", "doc_id"], "left_anti")), "far-vectors")
    low = near.join(lexical, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id").join(scored, ["query_id", "doc_id"])
    low = written(places_in(scored, low), "far-words")
    lists = [lexical.select("query_id", "doc_id", "rank").unionByName(low), near.select("query_id", "doc_id", "rank").unionByName(far.select("query_id", "doc_id", "rank"))]
    similar = near.select("query_id", "doc_id", F.col("score").alias("similarity")).unionByName(far.select("query_id", "doc_id", "similarity"))
    hits = ranking.fuse(lists, "doc_id", rrf_k, k).join(similar, ["query_id", "doc_id"], "left")
    work = lists[0].select("query_id").unionByName(lists[1].select("query_id")).groupBy("query_id").agg(F.count("*").alias("rows"))
    return hits, work
