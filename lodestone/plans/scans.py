"""Running values of rows in an order, by key, where one key may hold most rows.

``scan`` deals rows by ranges of (key, order). Each task runs over its range once; what a range adds to a key that goes on in the next
one is a state of fixed size, and the states of all ranges, one each, are combined in order into one carry per range. So a key of
any size is spread over tasks, and nothing but the states passes from one range to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.tables import written

_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Run:
    """One running value. kind: ``count`` of rows, ``sum``, ``xor`` or ``max`` of a long column (nulls count as nothing), or the ``first`` value of a column of any type.

    It runs from the key's first row, or if ``restarts`` from the last row at which the scan's reset column is true, that row included.
    """

    kind: str
    column: str | None = None
    restarts: bool = False


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last start at or before it; -1 where there is none."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where neighbours' values are; nulls are equal."""
    coded = column.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _running(kind: str, x: np.ndarray, start: np.ndarray, before: int) -> np.ndarray:
    """The value since each row's start; where that is before the first row, ``before`` is what the rows before it gave."""
    inside = start >= 0
    if kind in ("count", "sum"):
        total = np.cumsum(x)
        return total - np.where(inside, np.r_[0, total][np.maximum(start, 0)], -before)
    if kind == "xor":
        total = np.bitwise_xor.accumulate(x)
        return total ^ np.where(inside, np.r_[np.int64(0), total][np.maximum(start, 0)], np.int64(before))
    values, rank = np.unique(np.r_[before, x], return_inverse=True)
    return values[np.maximum.accumulate((start + 1) * len(values) + np.maximum(rank[1:], np.where(inside, 0, rank[0]))) - (start + 1) * len(values)]


def _local(by: Sequence[str], runs: Mapping[str, Run], reset: str | None, columns: list[str]):
    """Runs over one range: rows plus _range, _at, whether the range's first key is theirs, whether a reset came before in it, and the values as of the range's start."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        last_key, in_first, was_reset = None, True, False
        state: dict[str, object] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            batch = pa.Table.from_batches([batch]).combine_chunks().to_batches()[0]
            keys = [batch.column(c) for c in by]
            new = np.zeros(n, bool)
            for k in keys:
                codes = _codes(k)
                new[1:] |= codes[1:] != codes[:-1]
            own = [k[0].as_py() for k in keys]
            new[0] = at == 0 or own != last_key
            flag = batch.column(reset).fill_null(False).to_numpy(zero_copy_only=False) if reset else np.zeros(n, bool)
            key_start, part_start = _starts(new), _starts(new | flag)
            changed = np.cumsum(new) - (1 if at == 0 else 0)
            first = (changed == 0) & in_first
            hit = _starts(flag)
            seen = (hit >= np.maximum(key_start, 0)) & (hit >= 0) | ((key_start < 0) & was_reset)
            out = []
            for name, run in runs.items():
                start = part_start if run.restarts else key_start
                if run.kind == "first":
                    column = batch.column(run.column)
                    value = column.take(pa.array(np.maximum(start, 0)))
                    if start[0] < 0:
                        k = int((start < 0).sum())
                        value = pa.concat_arrays([pa.array([state[name]] * k, column.type), value.slice(k)])
                    out.append(value)
                    state[name] = value[n - 1].as_py()
                    continue
                if run.kind == "count":
                    x = np.ones(n, np.int64)
                else:
                    x = batch.column(run.column).cast(pa.int64()).fill_null(_NONE if run.kind == "max" else 0).to_numpy(zero_copy_only=False)
                value = _running(run.kind, x, start, int(state.get(name, 0)))
                state[name] = int(value[-1])
                out.append(pa.array(value, mask=value == _NONE if run.kind == "max" else None))
            last_key, in_first, was_reset = [k[n - 1].as_py() for k in keys], bool(first[-1]), bool(seen[-1])
            extra = [pa.array(np.full(n, number, np.int32)), pa.array(np.arange(at, at + n)), pa.array(first), pa.array(seen), *out]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *extra], [*columns, "_range", "_at", "_first", "_reset", *[f"_run_{r}" for r in runs]])
            at += n

    return go


def _joined(kind: str, before, own):
    """What two pieces of one run give together; None is nothing."""
    if kind == "first" or before is None:
        return before if kind == "first" else own
    if own is None:
        return before
    return before ^ own if kind == "xor" else max(before, own) if kind == "max" else before + own


def scan(rows: DataFrame, by: Sequence[str], order: Sequence[str], runs: Mapping[str, Run], reset: str | None = None) -> DataFrame:
    """``rows`` plus the running values ``runs`` (by name) in ``order`` within each key of the columns ``by``.

    Rows that are equal in ``by`` and ``order`` come in any order. The driver sees one row per range: its first and last key and the last row's values.
    """
    by, columns = list(by), rows.columns
    kinds = {name: rows.schema[run.column].dataType if run.kind == "first" else T.LongType() for name, run in runs.items()}
    extra = [T.StructField("_range", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_first", T.BooleanType()), T.StructField("_reset", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields, *extra, *[T.StructField(f"_run_{n}", k) for n, k in kinds.items()]])
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = written(dealt.mapInArrow(_local(by, runs, reset, columns), schema), "scan")
    key = F.struct(*by)
    ends = dealt.groupBy("_range").agg(F.min_by(key, "_at").alias("first"), F.max_by(F.struct(key.alias("key"), "_first", "_reset", *[f"_run_{r}" for r in runs]), "_at").alias("last")).orderBy("_range").collect()

    carries, open_key, open_state = [], None, {}
    for end in ends:
        goes_on = open_key is not None and tuple(end["first"]) == open_key
        before = open_state if goes_on else dict.fromkeys(runs)
        carries.append((end["_range"], goes_on, *before.values()))
        last, state = end["last"], {}
        for name, run in runs.items():
            own = last[f"_run_{name}"]
            whole = goes_on and last["_first"] and not (run.restarts and last["_reset"])
            state[name] = _joined(run.kind, before[name], own) if whole else own
        open_key, open_state = tuple(last["key"]), state
    carried = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_goes_on", T.BooleanType()), *[T.StructField(f"_before_{n}", k) for n, k in kinds.items()]])
    bases = rows.sparkSession.createDataFrame(carries, carried)

    def value(name: str, run: Run) -> Column:
        own, before = F.col(f"_run_{name}"), F.col(f"_before_{name}")
        whole = F.col("_goes_on") & F.col("_first") & (~F.col("_reset") if run.restarts else F.lit(True))
        both = {"first": before, "max": F.greatest(before, own), "xor": F.coalesce(before, F.lit(0)).bitwiseXOR(own)}.get(run.kind, F.coalesce(before, F.lit(0)) + own)
        return F.when(whole, both).otherwise(own).alias(name)

    # One row per range.
    return dealt.join(F.broadcast(bases), "_range").select(*columns, *[value(n, r) for n, r in runs.items()])
