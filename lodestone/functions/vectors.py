"""Vector expressions, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the shorter vector's length."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n != 0, n))


def distance_similarity(d: Column | str) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + (F.col(d) if isinstance(d, str) else d))


def hashed_counts(rows: DataFrame, row_id: str, token_array: str, buckets: int = 256) -> DataFrame:
    """row id, bucket, weight: token counts by the first 7 hex digits of md5, each row scaled to length 1.

    One row per bucket that is not zero; rows without tokens have none.
    """
    bucket = F.conv(F.substring(F.md5(F.encode("_token", "utf-8")), 1, 7), 16, 10).cast("long") % buckets
    counts = (
        rows.select(F.col(row_id), F.explode(token_array).alias("_token"))
        .select(row_id, bucket.cast("int").alias("bucket")).groupBy(row_id, "bucket").agg(F.count("*").alias("n"))
    )
    # The squares are summed by row over at most ``buckets`` rows.
    length = counts.groupBy(row_id).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_length"))
    return counts.join(length, row_id).select(row_id, "bucket", (F.col("n") / F.col("_length")).alias("weight"))


def to_vector(sparse: DataFrame, row_id: str, buckets: int = 256) -> DataFrame:
    """row id, embedding (dense array) of ``hashed_counts``."""
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    return sparse.groupBy(row_id).agg(held.alias("_held")).select(row_id, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(F.col("_held")[k], F.lit(0.0))).alias("embedding"))


# The weight of a word and of three characters in a row.
TOKEN_WEIGHT, TRIGRAM_WEIGHT = 1.0, 0.35


def feature_hashed(query: Column | str, dimensions: int = 256) -> Column:
    """A unit vector of a normal query's words and character trigrams, each with a sign and a bucket by its blake2b digest; zeros for none.

    Spark has no blake2b, so this is a Pandas UDF.
    """
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            words = (text or "").split()
            line = " ".join(words)
            found = [(f"tok:{w}", TOKEN_WEIGHT) for w in words]
            found += [(f"tri:{line[k : k + 3]}", TRIGRAM_WEIGHT) for k in range(max(0, len(line) - 2)) if line[k : k + 3].strip()]
            out = np.zeros(dimensions)
            for name, weight in found:
                d = hashlib.blake2b(name.encode("utf-8"), digest_size=8).digest()
                out[int.from_bytes(d[:4], "little") % dimensions] += weight if d[4] % 2 else -weight
            return (out / (np.linalg.norm(out) or 1.0)).tolist()

        return texts.map(one)

    return embed(F.col(query) if isinstance(query, str) else query)
