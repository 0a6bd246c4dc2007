"""An index of vectors in cells, for exact nearest neighbours by cosine similarity.

Unit vectors are dealt to the nearest of some centres (k-means on a bounded sample) and lie in order of their angle to it. A search first
gives each query a threshold, the k-th best of some vectors of its own cell. Then a query is compared with a run of vectors
only if it can pass the threshold there: two directions at angles a and b to a centre are at least |a - b| apart, so a whole run
of angles is skipped by the angle of the query. The result is that of ``ranking.dense``; how much is skipped depends on how the vectors
cluster (directions that are spread evenly over many dimensions allow nothing to be skipped), and is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ranking import DENSE_ROWS, HELD_ROWS, _unit_rows, best_pairs, held_rows, query_blocks, ranked
from lodestone.plans.tables import new_path, read_part, written

#: Vectors that the centres are found on, most centres, rounds of k-means, and vectors of a cell that give thresholds.
SAMPLE, CELLS, ROUNDS, SEEDS = 20_000, 1024, 8, 256
#: Vectors of one cell that are skipped or compared together, and what rounding may change.
RUN, SLACK = 256, 2e-6


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of directions, by k-means from evenly spaced rows; one of zeros, at right angles to all, where there are no directions."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


class Cells:
    """An index of vectors(doc_id, embedding) in the folder ``path``. Rows with a null doc_id or embedding are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(vectors: DataFrame, path: str | None = None, cells: int | None = None) -> Cells:
        """Writes the centres, the vectors by cell and angle, and each cell's seeds."""
        spark = vectors.sparkSession
        self = Cells(spark, path or new_path(spark, "cells"))
        rows = vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        cells = cells or max(1, min(CELLS, int(n**0.5) // 2))
        share = min(1.0, 2.0 * SAMPLE / max(1, n))
        sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [_unit_rows(b.column("embedding"), width) for b in batches]
            found = _centres(np.concatenate([np.zeros((0, width)), *held]), cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found.tolist(), pa.list_(pa.float64()))], ["cell", "centre"])

        sample.select("embedding").repartition(1).mapInArrow(fit, "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres/all")
        at = self.path

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = _read_centres(at)
            for batch in batches:
                for a in range(0, batch.num_rows, DENSE_ROWS):
                    part = batch.slice(a, DENSE_ROWS)
                    unit = _unit_rows(part.column("embedding"), width)
                    cell, angle = _placed(unit, centres)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array([u.tobytes() for u in unit], pa.binary())], ["doc_id", "cell", "angle", "unit"])

        placed = rows.mapInArrow(deal, "doc_id long, cell int, angle double, unit binary")
        # Ranges of cell and angle: a cell of any size is spread over tasks.
        placed.repartitionByRange("cell", "angle", "doc_id").sortWithinPartitions("cell", "angle", "doc_id").write.parquet(f"{self.path}/vectors")
        stored = spark.read.parquet(f"{self.path}/vectors")
        counts = stored.groupBy("cell").agg(F.count("*").alias("n"))  # one row per cell
        seeds = stored.join(F.broadcast(counts), "cell").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(2.0 * SEEDS) / F.col("n") * (1 << 30))
        seeds.select("cell", "unit").repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/seeds")
        return self

    def search(self, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
        """(hits, work): query_id, doc_id, score, rank of the k nearest for each of queries(query_id, embedding); pairs there are and pairs that were compared."""
        at = self.path

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = _read_centres(at)
            now, seeds = None, None
            for batch in batches:
                unit = _unit_rows(batch.column("embedding"), centres.shape[1])
                least = np.full(len(unit), -np.inf)
                cell, _ = _placed(unit, centres)
                for c in np.unique(cell).tolist():
                    if c != now:
                        found = read_part(f"{at}/seeds", f"cell={c}", ["unit"])
                        now, seeds = c, None if found is None else np.frombuffer(b"".join(found["unit"].to_pylist()), np.float64).reshape(found.num_rows, centres.shape[1])
                    if seeds is not None and len(seeds) >= k:
                        own = np.flatnonzero(cell == c)
                        least[own] = np.partition(np.round(unit[own] @ seeds.T, 6), -k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(least), pa.array([u.tobytes() for u in unit], pa.binary())], ["query_id", "least", "unit"])

        asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        begun = written(asked.mapInArrow(begin, "query_id long, least double, unit binary"), "thresholds")
        path, blocks = query_blocks(begun)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = _read_centres(at)
            for rows in held_rows(batches, HELD_ROWS):
                who, cell, angle = (rows[c].to_numpy() for c in ("doc_id", "cell", "angle"))
                unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), np.float64).reshape(len(who), centres.shape[1])
                cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                runs = [(a, min(b, a + RUN)) for lo, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(who)]) for a in range(lo, b, RUN)]
                for block in range(blocks):
                    part = read_part(path, f"block={block}", ["query_id", "least", "unit"])
                    if part is None:
                        continue
                    ids, least = part["query_id"].to_numpy(), part["least"].to_numpy().copy()
                    asks = np.frombuffer(b"".join(part["unit"].to_pylist()), np.float64).reshape(len(ids), centres.shape[1])
                    size = np.linalg.norm(asks, axis=1)
                    q, d, s, compared, now = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0, None
                    for a, b in runs:
                        c = cell[a]
                        if c != now and c >= 0:
                            now, turn = c, np.arccos(np.clip(asks @ centres[c] / np.where(size > 0, size, 1), -1, 1))
                        low, high = angle[a:b].min(), angle[a:b].max()
                        bound = size * np.cos(np.maximum(0, np.maximum(low - turn, turn - high))) if c >= 0 else np.zeros(len(ids))
                        able = np.flatnonzero(bound + SLACK >= least)
                        compared += len(able) * (b - a)
                        if not len(able):
                            continue
                        sims = np.round(unit[a:b] @ asks[able].T, 6)
                        i, j = np.nonzero(sims >= least[able])
                        if not len(i):
                            continue
                        q, d, s = best_pairs(np.concatenate([q, able[j]]), np.concatenate([d, who[a + i]]), np.concatenate([s, sims[i, j]]), k)
                        full = np.flatnonzero(np.bincount(q, minlength=len(ids)) >= k)
                        if len(full):
                            last = np.searchsorted(q, full, "right") - 1
                            least[full] = np.maximum(least[full], s[last])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(s)], ["query_id", "doc_id", "score"])
                    work = [pa.array([None], pa.int64()), pa.array([compared]), pa.array([float(len(who) * len(ids))])]
                    yield pa.RecordBatch.from_arrays(work, ["query_id", "doc_id", "score"])

        found = written(self.spark.read.parquet(f"{self.path}/vectors").mapInArrow(nearest, "query_id long, doc_id long, score double"), "nearest")
        work = found.where("query_id is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).cast("long").alias("pairs"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("compared"))
        return ranked(found.where("query_id is not null"), k, "doc_id"), work


def _read_centres(path: str) -> np.ndarray:
    """Centres, in order of their cells, inside a task."""
    held = read_part(f"{path}/centres", "all", ["cell", "centre"]).sort_by("cell")
    return np.array(held["centre"].to_pylist(), float).reshape(held.num_rows, -1) if held.num_rows else np.zeros((1, 0))


def _placed(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each direction's cell and angle to its centre; zero vectors are in cell -1."""
    near = unit @ centres.T
    cell = near.argmax(axis=1)
    size = np.linalg.norm(unit, axis=1)
    angle = np.arccos(np.clip(near[np.arange(len(unit)), cell] / np.where(size > 0, size, 1), -1, 1))
    return np.where(size > 0, cell, -1), np.where(size > 0, angle, 0.0)
