"""Whitening of embeddings along the leading eigenvectors of their covariance, found by spectrum slicing.

Entries become integers, ``x = floor(scale * c)``. The fit list is each distinct x vector once; its covariance is summed by tasks,
centred before multiplying. Leading eigenvalues are isolated one by one: the signs of D in an LDL^T factorisation of the shifted
covariance count the eigenvalues above the shift, Rayleigh quotient iteration converges inside the isolated interval, and
counts on both sides of what it found certify the component's number.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are rows with an x of 2**62
or more in size; of what is left, rows of another length than the most frequent one (of ties the longest) are dropped. Rows that
repeat each get their result and count once in the fit list. Components whose eigenvalue is zero to double precision can't be
scaled to variance one and are left out, so a fit list of one vector gives no rows, and neither does an empty table. Equal
eigenvalues have any orthogonal basis of their space. A deviation beyond the range of a long is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: Bytes of a partial sum that travel together, and groups in which the tasks' partial sums are added first.
BLOCK_BYTES, GROUPS = 1 << 20, 64
_LOW = (1 << 31) - 1


# --- vectors as integers ---------------------------------------------------------------------------------------------


def quantised(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the valid rows of a list array, their lengths, and all their entries as integers, end to end."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    c = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * c)
        bad = holes | ~(np.abs(x) < 2.0**62)
    row = np.repeat(np.arange(len(sizes)), sizes)
    valid = sizes > 0
    valid[row[bad]] = False
    return np.flatnonzero(valid), sizes[valid], np.where(bad, 0, x)[valid[row]].astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of integers as bytes, in the smallest width that holds the row, which the first byte tells."""
    least, most = x.min(axis=1), x.max(axis=1)
    width = np.where((least >= -128) & (most < 128), 1, np.where((least >= -(1 << 15)) & (most < 1 << 15), 2, np.where((least >= -(1 << 31)) & (most < 1 << 31), 4, 8)))
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw, step = x[at].astype(f"<i{w}").tobytes(), x.shape[1] * w
        for k, i in enumerate(at.tolist()):
            out[i] = bytes((w,)) + raw[k * step : (k + 1) * step]
    return out


def unpacked(keys: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(keys), d), np.int64)
    widths = np.array([k[0] for k in keys])
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at.tolist()), f"<i{w}").reshape(-1, d)
    return out


# --- sums over tasks ---------------------------------------------------------------------------------------------------


def _added(parts: DataFrame, kind: str) -> DataFrame:
    """part, salt, sums of arrays of one type, added by (part, salt) and then by part: no task adds more than a share of the tasks' sums."""
    schema = "part int, salt int, sums binary"

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = total = None
        for batch in rows:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if p != part and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "salt", "sums"])
                    total = None
                x = np.frombuffer(raw, kind)
                part, total = p, x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "salt", "sums"])

    once = parts.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(add, schema)
    return once.repartition("part").sortWithinPartitions("part").mapInArrow(add, schema)


def _total(fit: DataFrame, each, d: int, width: int, kind: str) -> np.ndarray:
    """The sum over ``fit`` of ``each(x)``, a matrix of ``width`` columns, added by tasks; the driver gets one matrix."""
    step = max(1, BLOCK_BYTES // (8 * width))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for a in range(0, len(keys), 4096):
                found = each(unpacked(keys[a : a + 4096], d))
                total = found if total is None else total + found
        if total is not None:
            cuts = range(0, len(total), step)
            salt = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([salt] * len(cuts), pa.int32()), pa.array([total[a : a + step].tobytes() for a in cuts], pa.binary())], ["part", "salt", "sums"])

    rows = _added(fit.select("key").mapInArrow(partial, "part int, salt int, sums binary"), kind).collect()
    return np.concatenate([np.frombuffer(bytes(r.sums), kind).reshape(-1, width) for r in sorted(rows, key=lambda r: r.part)])


# --- spectrum slicing --------------------------------------------------------------------------------------------------


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are positive, negative and zero: the signs of D in P A P^T = L D L^T.

    D has blocks of 1 or 2, chosen by the size of the entries that elimination would bring about (Bunch and Kaufman's rule).
    """
    a = np.array(a, float)
    n, k = len(a), 0
    up = down = zero = 0
    alpha = (1 + np.sqrt(17)) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        size = 1
        if k < n - 1:
            r = k + 1 + int(np.argmax(np.abs(a[k + 1 :, k])))
            most = abs(a[r, k])
            if abs(a[k, k]) < alpha * most:
                rest = np.abs(a[r, k:])
                rest[r - k] = 0
                wide = rest.max()
                if abs(a[k, k]) * wide >= alpha * most**2:
                    pass
                elif abs(a[r, r]) >= alpha * wide:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            p = a[k, k]
            up, down, zero = up + (p > 0), down + (p < 0), zero + (p == 0)
            if p != 0:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / p)
        else:
            up, down = up + 1, down + 1  # such a block has a negative determinant
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
        k += size
    return up, down, zero


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than the shift."""
    return inertia(v - shift * np.eye(len(v)))[0]


def _iterate(v: np.ndarray, low: float, high: float, found: list[np.ndarray], start: np.ndarray, tiny: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration within (low, high), with one step more once it has settled; None where it leaves the interval or doesn't settle."""
    basis, shift = np.array(found).reshape(-1, len(v)), (low + high) / 2
    y, settled = start, False
    for _ in range(30):
        try:
            z = np.linalg.solve(v - shift * np.eye(len(v)), y)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(v - (shift + tiny) * np.eye(len(v)), y)
        z = z / np.abs(z).max()
        for _ in range(2):
            z = z - basis.T @ (basis @ z)
        y = z / np.linalg.norm(z)
        value = float(y @ v @ y)
        if settled:
            return (value, y) if low - 64 * tiny <= value <= high + 64 * tiny else None
        settled = np.linalg.norm(v @ y - value * y) <= len(v) * tiny
        shift = value if settled or low < value < high else (low + high) / 2
    return None


def leading(v: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """The ``most`` largest eigenvalues of a covariance that aren't zero to double precision, with unit eigenvectors, largest first."""
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    tiny = size * np.finfo(float).eps
    floor = d * tiny
    if size == 0 or not np.isfinite(size):
        return []
    rng = np.random.default_rng(5)
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    out: list[tuple[float, np.ndarray]] = []
    for k in range(1, min(most, count(floor)) + 1):
        # The k-th largest is in (low, high]: at least k are above low, fewer than k above high.
        count(2 * size)
        low, high = max(s for s, n in counts.items() if n >= k), min(s for s, n in counts.items() if n < k)
        hit = None
        while hit is None:
            if high - low > 4 * floor and count(low) - count(high) > 1:
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= k else (low, middle)
                continue
            # Alone in the interval, or equal to its neighbours to double precision.
            for _ in range(3 if high - low <= 4 * floor else 1):
                hit = hit or _iterate(v, low, high, [y for _, y in out], rng.normal(size=d), tiny)
            if hit is not None:
                near = 64 * floor
                if not (count(hit[0] + near) < k <= count(hit[0] - near)):
                    hit = None
            if hit is None:
                middle = (low + high) / 2
                if high - low <= 4 * floor:
                    raise ArithmeticError("an eigenvalue couldn't be certified")
                low, high = (middle, high) if count(middle) >= k else (low, middle)
        out.append(hit)
    return out


# --- the operator ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitener:
    """What is fitted: n vectors of the fit list, their sums by dimension, and components (columns) with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float
    scale: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) ** 2, exact."""
        most = self.n * int(max(x.max(initial=0), -x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if most**2 * max(1, len(self.sums)) < 1 << 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x minus the mean: the mean's whole part is taken off as integers, so large entries lose no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n / n for s in sums])
    return (x - whole).astype(float) - part


def fit(vectors: DataFrame, components: int = 4, scale: int = 256, column: str = "embedding") -> Whitener | None:
    """Fits over each distinct x vector of ``vectors``; None where none is valid.

    Distinct vectors are found by a shuffle of their packed bytes, which are less than the input's, after tasks have dropped their
    own repeats, so a vector that many rows share is shuffled once per task. The table of distinct vectors is written and read
    three times: for the sums, for the covariance, and for the covariance of the result.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, flat = quantised(batch.column("vector"), scale)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                at = starts[sizes == d]
                keys = list(dict.fromkeys(packed(flat[at[:, None] + np.arange(d)])))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(keys), pa.int32()), pa.array([int((sizes == d).sum())] + [0] * (len(keys) - 1), pa.int64()), pa.array(keys, pa.binary())], ["d", "rows", "key"])

    keys = vectors.select(F.col(f"`{column}`").alias("vector")).mapInArrow(pack, "d int, rows long, key binary")
    distinct = scratch.table(keys.groupBy("d", "key").agg(F.sum("rows").alias("rows")), "distinct")
    # One row for each length of a vector.
    chosen = distinct.groupBy("d").agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), F.desc("d")).first()
    if chosen is None:
        scratch.drop(distinct)
        return None
    d, n = int(chosen["d"]), int(chosen["n"])
    fitted = distinct.where(F.col("d") == d)

    def halves(x: np.ndarray) -> np.ndarray:
        return np.stack([(x & _LOW).sum(axis=0), (x >> 31).sum(axis=0)], axis=1)

    sums = tuple(int(low) + (int(high) << 31) for low, high in _total(fitted, halves, d, 2, "<i8").tolist())

    def products(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums)
        return y.T @ y

    v = _total(fitted, products, d, d, "<f8") / n
    v = (v + v.T) / 2
    found = leading(v, components)
    if not found:
        scratch.drop(distinct)
        return Whitener(n, sums, np.zeros((d, 0)), np.zeros(0), float(np.trace(v)), 0.0, scale)
    values, basis = np.array([e for e, _ in found]), np.stack([y for _, y in found], axis=1)
    draft = Whitener(n, sums, basis, values, float(np.trace(v)), 0.0, scale)

    def squares(x: np.ndarray) -> np.ndarray:
        w = draft.project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = len(values)
    moments = _total(fitted, squares, d, m, "<f8") / n
    error = float(np.abs(moments[:m] - np.outer(moments[m], moments[m]) - np.eye(m)).max())
    scratch.drop(distinct)
    return Whitener(n, sums, basis, values, float(np.trace(v)), error, scale)


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each valid row and component: key, component, n, deviation, whitened, explained, identity_error, as the module says."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components, scale, column)
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("vector"))
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    d, m = len(model.sums), len(model.values)
    # Components, sums and eigenvalues: as much as the vectors' length alone makes it.
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    share = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            places, sizes, flat = quantised(batch.column("vector"), scale)
            at = np.flatnonzero(sizes == d)
            if not len(at):
                continue
            x = flat[(np.cumsum(sizes) - sizes)[at][:, None] + np.arange(d)]
            r = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(places[at], m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), r)), pa.array(np.full(r * m, f.n, np.int64)),
                    pa.array([v for v in f.deviation(x) for _ in range(m)], pa.int64()), pa.array(f.project(x).ravel()), pa.array(np.tile(share, r)), pa.array(np.full(r * m, f.error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
