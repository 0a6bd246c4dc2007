"""The best documents by BM25 without adding up every posting of every query word.

The most that a word can add to a score is known from its greatest count in a document and its shortest document. The rarest words of a query give
a threshold, the k-th best of what they alone add up to. Words that together can't reach it then need not bring documents forward:
only the other words' postings are added up, documents that can't reach the threshold any more are left out, and the frequent
words' postings are looked up for the documents that are left. The rows are those of ``ranking.bm25``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.plans.sizing import broadcast_if_small
from lodestone.plans.tables import written

#: Postings of a query's rarest words that give its threshold, as a multiple of k, and what rounding may change.
SEED, SLACK = 20, 2e-6


def _part(mean: float, tf, dl, k1: float, b: float):
    return F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean if mean else F.lit(1.0)))


def statistics(postings: DataFrame) -> DataFrame:
    """term, df, top (greatest tf), least (smallest dl) of postings(term, doc_id, tf, dl)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("top"), F.min("dl").alias("least"))


def best(postings: DataFrame, wanted: DataFrame, stats: DataFrame, n: int, words: int, k: int, k1: float = ranking.K1, b: float = ranking.B) -> tuple[DataFrame, DataFrame]:
    """(hits, work) of postings(term, doc_id, tf, dl) for wanted(query_id, term, qtf), given stats(term, df, top, least) and how many documents and words there are.

    work: query_id, postings (of all its words) and added (those that were added up for it or looked up).
    """
    mean = words / max(1, n)
    # Dealt by document once a sum is taken, so that pairs of queries and documents are added up where the postings are.
    by_document = postings.repartition("doc_id")
    weigh = F.col("qtf") * F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = wanted.join(stats, "term").withColumn("w", weigh).withColumn("bound", _part(mean, F.col("top"), F.col("least"), k1, b))
    own = Window.partitionBy("query_id")
    rarer = F.coalesce(F.sum("df").over(own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeded = (rarer < k) | (rarer + F.col("df") < SEED * k)
    terms = written(terms.withColumn("seed", seeded).select("query_id", "term", "w", "df", "bound", "seed"), "query-terms")

    def added(chosen: DataFrame) -> DataFrame:
        part = _part(mean, F.col("tf"), F.col("dl"), k1, b)
        return by_document.join(broadcast_if_small(chosen.select("query_id", "term", "w")), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("part"), F.count("*").alias("_n"))

    def kth(scores: DataFrame, name: str) -> DataFrame:
        """The k-th best part of a query; none where there are fewer."""
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
        return scores.withColumn("_k", place).where(F.col("_k") == k).select("query_id", F.col("part").alias(name))

    least = written(kth(added(terms.where("seed")), "least"), "thresholds")
    # Of a query's words those that can add least, as long as all of them together stay below the threshold.
    together = F.sum("bound").over(own.orderBy("bound", "term"))
    terms = terms.join(least, "query_id", "left").withColumn("idle", ~F.col("seed") & (F.coalesce(F.col("least"), F.lit(0.0)) > together + SLACK))
    terms = written(terms, "chosen-terms")
    rest = terms.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("idle"), F.col("bound"))), F.lit(0.0)).alias("rest"), F.first("least").alias("least"), F.sum("df").alias("postings"))
    found = written(added(terms.where("not idle")), "parts")
    better = kth(found, "better")
    bar = rest.join(better, "query_id", "left").withColumn("bar", F.greatest(F.coalesce("least", F.lit(0.0)), F.coalesce("better", F.lit(0.0))))
    left = found.join(broadcast_if_small(bar.select("query_id", "rest", "bar")), "query_id").where(F.col("part") + F.col("rest") + SLACK >= F.col("bar")).select("query_id", "doc_id", "part")
    left = written(left, "candidates")
    idle = terms.where("idle").select("query_id", "term", "w")
    asked = left.select("query_id", "doc_id").join(broadcast_if_small(idle), "query_id")
    looked = postings.join(broadcast_if_small(idle.select("term").distinct()), "term", "left_semi").join(broadcast_if_small(asked), ["term", "doc_id"])
    more = looked.select("query_id", "doc_id", _part(mean, F.col("tf"), F.col("dl"), k1, b).alias("part"))
    more = written(more, "looked-up")
    scores = left.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    counts = found.groupBy("query_id").agg(F.sum("_n").alias("_added")).unionByName(more.groupBy("query_id").agg(F.count("*").alias("_added"))).groupBy("query_id").agg(F.sum("_added").alias("added"))
    return ranking.ranked(scores, k, "doc_id"), rest.select("query_id", "postings").join(counts, "query_id", "left").select("query_id", "postings", F.coalesce("added", F.lit(0)).alias("added"))


def bm25(docs: DataFrame | None, queries: DataFrame, k: int = 5, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``ranking.bm25`` of documents(doc_id, text), or of a kept ``index`` of them, with less added up: (hits, work)."""
    wanted = written(ranking.query_terms(queries), "wanted")
    index = ranking.postings_of(docs, wanted) if index is None else index
    n, words = index.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    held = index.join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
    return best(held, wanted, statistics(held), n, words, k)
