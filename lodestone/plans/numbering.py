"""Numbers of rows in an order, without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.tables import written


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "n", of: Column | None = None) -> DataFrame:
    """``rows`` plus their number (from 1) in ``order``, over all rows or within each key of ``by``; or with ``of`` the sum of that up to the row.

    Rows are dealt by ranges of (by, order), so a key of any size is spread over tasks. A row's number is its number within its range
    plus the rows of its key in the ranges before; only one count per range and key is summed. Equal rows get numbers in any order.
    """
    by, order = list(by), list(order)
    dealt = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "numbered")
    keys: list[str | Column] = [*by] or [F.lit(0)]
    each = F.lit(1) if of is None else of
    counts = dealt.groupBy("_range", *by).agg(F.sum(each).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_range", *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum(each).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = dealt.withColumn("_within", within).alias("o")
    same = F.col("o._range") == F.col("b._range")
    for c in by:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"b._by_{c}"))
    out = own.join(bases.alias("b"), same)
    return out.select(*[F.col(f"o.{c}").alias(c) for c in rows.columns], (F.col("o._within") + F.col("b._base")).cast("long").alias(name))
