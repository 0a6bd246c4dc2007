import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import growing, ranking
from lodestone.plans import snapshots


def texts(rng, n, start=0):
    words = [f"w{k}" for k in range(200)]
    return [(start + k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(200)], k=rng.randint(1, 40)))) for k in range(n)]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def same(spark, index, held):
    docs = spark.createDataFrame(sorted(held.items()), "doc_id long, text string")
    fresh = ranking.postings_of(docs)
    want = sorted(map(tuple, fresh.where("term <> ''").select("term", "doc_id", "tf", "dl").collect()))
    assert sorted(map(tuple, index.postings().collect())) == want
    stats = sorted((r.term, r.df, r.cf) for r in ranking.term_statistics(docs).collect())
    assert sorted((r.term, r.df, r.cf) for r in index.term_counts().collect()) == stats
    queries = spark.createDataFrame([(1, "w1 w1 w50"), (2, "w3 w120 w199"), (3, "none"), (4, "")], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(index.search(queries)) == rows(ranking.bm25(docs, queries))


def test_equal_to_a_fresh_index(spark, tmp_path):
    rng = random.Random(1)
    index = growing.GrowingIndex(spark, str(tmp_path / "i"), fanout=3)
    held = {}

    def add(rows):
        index.add(spark.createDataFrame(rows, "doc_id long, text string"))
        held.update({k: t for k, t in rows if k is not None and t})

    add(texts(rng, 40))
    same(spark, index, held)
    add([*texts(rng, 10, 35), (900, ""), (None, "w1"), (901, None)])  # five are replaced
    index.remove(spark.createDataFrame([(2,), (3,), (777,), (38,)], "doc_id long"))
    for k in (2, 3, 38):
        del held[k]
    same(spark, index, held)
    for k in range(4):  # enough for a merge
        add(texts(rng, 9, 100 + 9 * k - k))
    assert len(index.store.version().segments) < 6
    same(spark, index, held)
    index.merge(everything=True)
    assert len(index.store.version().segments) == 1 and index.store.version().dead == ()
    same(spark, index, held)
    before = index.store.version()
    assert index.remove(spark.createDataFrame([(777,)], "doc_id long")).number == before.number
    index.remove(spark.createDataFrame([(k,) for k in held], "doc_id long"))
    assert index.totals() == (0, 0) and index.search(spark.createDataFrame([(1, "w1")], "query_id long, text string")).count() == 0


def test_an_empty_text_replaces_a_document(spark, tmp_path):
    index = growing.GrowingIndex(spark, str(tmp_path / "i"))
    add = lambda *rows: index.add(spark.createDataFrame(list(rows), "doc_id long, text string"), merge=False)
    add((1, "alpha beta"), (2, "beta"), (3, "gamma"), (4, "gamma delta"))
    add((1, ""), (2, None), (5, "delta"), (9, ""))
    same(spark, index, {3: "gamma", 4: "gamma delta", 5: "delta"})
    add((3, ""), (9, None))  # nothing but empty texts
    same(spark, index, {4: "gamma delta", 5: "delta"})
    known = index.store.version()
    add((9, ""))
    assert index.store.version() == known


def test_a_hundredth_writes_a_hundredth(spark, tmp_path):
    rng = random.Random(2)
    index = growing.GrowingIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame([(k, t + f" u{k} v{k}" * 200) for k, t in texts(rng, 4000)], "doc_id long, text string").coalesce(2))
    first = size(tmp_path)
    index.add(spark.createDataFrame([(k, t + f" u{k} v{k}" * 200) for k, t in texts(rng, 40, 3980)], "doc_id long, text string").coalesce(1))
    assert size(tmp_path) - first < 0.05 * first
    assert index.totals()[0] == 4020


def test_readers_keep_their_version_and_writers_conflict(spark, tmp_path):
    index = growing.GrowingIndex(spark, str(tmp_path / "i"))
    assert index.totals() == (0, 0) and index.store.version().number == 0
    one = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string")
    index.add(one)
    seen = index.store.version()
    index.add(spark.createDataFrame([(1, "gamma")], "doc_id long, text string"))
    index.merge(everything=True)
    assert sorted(r.term for r in index.postings(seen).collect()) == ["alpha", "beta"]
    assert sorted(r.term for r in index.postings().collect()) == ["beta", "gamma"]
    with pytest.raises(snapshots.Conflict):
        index.store.commit(seen, seen)
    assert index.store.vacuum() > 0
    assert sorted(r.term for r in index.postings().collect()) == ["beta", "gamma"]
    with pytest.raises(ValueError):
        index.add(one.unionByName(one))
    assert sorted(r.term for r in index.postings().collect()) == ["beta", "gamma"]
    assert snapshots.retried(lambda: 7) == 7


def test_only_the_words_of_queries_are_read(spark, tmp_path):
    index = growing.GrowingIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(texts(random.Random(3), 50), "doc_id long, text string"))
    plan = index.postings().where(F.col("term") == "w1")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan
