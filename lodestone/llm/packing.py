"""Best-fit packing of tokenised documents into sequences of a fixed length, by bin completion.

There are at most ``capacity`` different lengths, so the whole corpus is packed as a histogram of lengths: the search runs
over counters whose number does not grow with the data, and its plan says which occurrence of a length goes to which
sequence and offset. Occurrences are numbered in Spark, with a salt, so that one length may hold any share of the rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch
from lodestone.llm.tokens import VOCABULARY, crc32, encoded

#: Groups into which the rows of one length are dealt, at most.
MOST_SALTS = 10_000
#: A plan's row: so many sequences of the same make-up.
Plan = list[tuple[tuple[int, ...], int]]


@dataclass
class _Level:
    """A step of the search: the fillings still to try, those tried here or above, and the one in use with its sequences."""

    options: Iterator[tuple[int, ...] | None]
    tried: set[tuple[int, ...]]
    makeup: tuple[int, ...] = ()
    n: int = 0
    own: list[tuple[int, ...]] = field(default_factory=list)


def _best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over the histogram; sequences of one make-up are filled together."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> make-up -> sequences
    rooms: list[int] = []

    def put(room: int, makeup: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = {}
            rooms.insert(bisect_right(rooms, room), room)
        groups[room][makeup] = groups[room].get(makeup, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                many = capacity // size
                full, rest = divmod(left, many)
                if full:
                    put(capacity - many * size, (size,) * many, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[at]
            makeup, n = groups[room].popitem()
            if not groups[room]:
                del groups[room], rooms[at]
            fit = min(room // size, left)
            use = min(n, left // fit)
            if n > use:
                put(room, makeup, n - use)
            put(room - fit * size, makeup + (size,) * fit, use)
            left -= fit * use
    return [(m, n) for g in groups.values() for m, n in g.items()]


def _completions(sizes: list[int], counts: dict[int, int], capacity: int, steps: int) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of a sequence that holds the largest piece of ``sizes`` (negative, ascending).

    None can take one more piece, and where only one more piece fits it is the largest: a smaller one would be dominated.
    Fillings come by parts of ``steps`` steps, or up to one without waste, fullest first; None stands for a part that has none.
    ``sizes`` and ``counts`` may change while a filling is held, and are as before when the next is asked for.
    """
    top = -sizes[0]
    used = Counter([top])
    left = capacity - top
    taken: list[int] = [top]
    frames: list[list[int]] = [[0, 0]]  # the next place in ``sizes``, and whether a piece was taken here
    found: list[tuple[int, tuple[int, ...]]] = []
    n = 0

    def free(k: int) -> bool:
        return counts[-sizes[k]] > used[-sizes[k]]

    def two_fit() -> bool:
        pair: list[int] = []
        for k in range(len(sizes) - 1, -1, -1):
            pair += [-sizes[k]] * min(2, counts[-sizes[k]] - used[-sizes[k]])
            if len(pair) > 1:
                return pair[0] + pair[1] <= left
        return False

    while frames:
        at, had = frames[-1]
        fits = bisect_left(sizes, -left)
        k = max(at, fits)
        while k < len(sizes) and not free(k):
            k += 1
        if k < len(sizes) and (not had or two_fit()):
            size = -sizes[k]
            frames[-1] = [k + 1, 1]
            frames.append([k, 0])
            taken.append(size)
            used[size] += 1
            left -= size
            n += 1
            continue
        perfect = False
        if not had and not any(free(k) for k in range(fits, min(at, len(sizes)))):
            found.append((left, tuple(taken)))
            perfect = left == 0
        frames.pop()
        if frames:
            size = taken.pop()
            used[size] -= 1
            left += size
        if perfect or n >= steps or not frames:
            found.sort(key=lambda x: x[0])
            yield from (makeup for _, makeup in found) if found else (None,)
            found, n = [], 0


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by the room that lengths of a common divisor can use, and, for every limit, by the long pieces that share no sequence and what the short ones need beside them."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    shared = int(np.gcd.reduce(sizes))
    best = -(-int((sizes * n).sum()) // (capacity // shared * shared))
    many, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * sizes)]
    half = int(np.searchsorted(sizes, capacity // 2, "right"))
    for limit in [0, *sizes[:half].tolist()]:
        low, high = int(np.searchsorted(sizes, limit)), int(np.searchsorted(sizes, capacity - limit, "right"))
        alone, pairs = int(many[-1] - many[high]), int(many[high] - many[half])
        short = int(total[half] - total[low]) - (pairs * capacity - int(total[high] - total[half]))
        best = max(best, alone + pairs + max(0, -(-short // capacity)))
    return best


def plan_sequences(counts: dict[int, int], capacity: int, nodes: int = 30_000) -> Plan:
    """Make-ups and how often each is used, for pieces of ``counts[length]``.

    The incumbent is best-fit decreasing. Where it needs more sequences than ``least_sequences`` says, bin completion
    looks for better, depth first: the largest piece left is completed by undominated fillings, a filling is used for as many
    sequences at once as the counters allow, then for one less and so on, and a branch ends when its waste leaves no room to
    beat the incumbent. A filling that a branch has tried is not tried again for the same largest piece further down. No
    branch is dropped: the plan is optimal unless the search ends by ``nodes``, its only bound; the best packing found by then
    is returned, and it is complete.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    best = _best_fit(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    lower = least_sequences(counts, capacity)
    used = sum(n for _, n in best)
    left, sizes = dict(counts), sorted(-s for s in counts)
    n_used = waste = 0
    levels: list[_Level] = []

    def use(makeup: tuple[int, ...], n: int) -> None:
        """Takes the pieces of ``n`` sequences, or puts them back for a negative ``n``."""
        nonlocal n_used, waste
        for s, k in Counter(makeup).items():
            if s not in left:
                left[s] = 0
                insort(sizes, -s)
            left[s] -= n * k
            if not left[s]:
                del left[s], sizes[bisect_left(sizes, -s)]
        n_used, waste = n_used + n, waste + n * (capacity - sum(makeup))

    down = True
    while nodes > 0 and used > lower:
        if down:
            if not left and n_used < used:
                best, used = [(level.makeup, level.n) for level in levels], n_used
            if left and waste <= (used - 1) * capacity - total:
                tried = levels[-1].tried if levels and levels[-1].makeup[0] == -sizes[0] else set()
                levels.append(_Level(_completions(sizes, left, capacity, 200), tried))
        if not levels:
            break
        level = levels[-1]
        nodes -= 1
        if level.n:
            use(level.makeup, -1)
            level.n -= 1
            down = level.n > 0
            if down:
                continue
        makeup = next(level.options, ())
        if makeup == ():
            level.tried.difference_update(level.own)
            levels.pop()
            down = False
        elif makeup is not None and makeup not in level.tried:
            level.tried.add(makeup)
            level.own.append(makeup)
            level.makeup, level.n = makeup, min(left[s] // k for s, k in Counter(makeup).items())
            use(makeup, level.n)
            down = True
        else:
            down = False
    return best


def _slots(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows (first occurrence, first sequence, offset), where occurrence r goes to sequence first + (r - first occurrence)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for makeup, n in plan:
        at = 0
        for s in makeup:
            out.setdefault(s, []).append((seen.get(s, 0), base, at))
            seen[s] = seen.get(s, 0) + n
            at += s
        base += n
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pieces_of(docs: DataFrame, capacity: int, end_id: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents longer than ``capacity`` are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in encoded(batch, vocabulary):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(part) // 4, crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str = VOCABULARY, nodes: int = 30_000, rows_per_salt: int = 1_000) -> DataFrame:
    """Where each piece of each document goes: the rows of ``pieces_of`` plus sequence_id and offset.

    Null or empty text: one piece with the end id alone. Null doc_id: packed like any other. Repeated doc_ids: each
    row has its own pieces. No rows: no pieces. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(pieces_of(docs, capacity, end_id, vocabulary), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    # A length's rows are dealt by a salt, as many as its own count asks for.
    salts = spark.createDataFrame([(s, min(-(-n // rows_per_salt), MOST_SALTS)) for s, n in counts.items()], "length long, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_salt.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    slots = spark.sparkContext.broadcast(_slots(plan_sequences(counts, capacity, nodes)))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("within", within.cast("long")).join(bases, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                rows = slots.value[int(length[own[0]])]
                k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                seq[own], off[own] = rows[k, 1] + rank[own] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
