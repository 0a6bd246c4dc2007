from pyspark.sql import functions as F

from lodestone.plans.numbering import numbered
from lodestone.plans.sizing import broadcast_if_small, is_small


def test_numbers_over_all_rows_and_by_key(spark):
    rows = [(k % 3 if k % 3 else None, (k * 37) % 101, k) for k in range(101)] + [(1, 500 + k, 0) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(7)
    every = {(r.g, r.o): r.n for r in numbered(df, ["o"]).collect()}
    assert [every[g, o] for g, o in sorted(every, key=lambda x: x[1])] == list(range(1, len(rows) + 1))
    by = {}
    for r in sorted(numbered(df, ["o"], by=["g"], name="no").collect(), key=lambda r: r.o):
        by.setdefault(r.g, []).append(r.no)
    assert all(v == list(range(1, len(v) + 1)) for v in by.values()) and len(by) == 3
    total = 0
    for r in sorted(numbered(df, ["o"], of=F.col("v").cast("long")).collect(), key=lambda r: r.o):
        total += r.v
        assert r.n == total
    assert numbered(df.limit(0), ["o"], by=["g"]).count() == 0


def test_sizes(spark):
    assert is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)
    assert broadcast_if_small(spark.range(5)).count() == 5
