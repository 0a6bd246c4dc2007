import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import growing, lexical, ranking


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())


def texts(seed, n, words=300):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices([f"w{j}" for j in range(words)], weights=[1 / (j + 1) for j in range(words)], k=rng.randint(1, 60)))) for k in range(n)]


def shuffled(spark, run):
    """Records that stages write to shuffles during ``run``."""
    sc = spark._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("search", ["bm25", "kept", "overlap"])
def test_pairs_of_queries_and_documents_are_not_shuffled(spark, search):
    docs = spark.createDataFrame(texts(1, 3000), "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame(texts(2, 60), "query_id long, text string")
    found = {
        "bm25": lambda: ranking.bm25(docs, queries, 5),
        "kept": lambda: ranking.bm25(None, queries, 5, index=lexical.kept(docs)),
        "overlap": lambda: ranking.overlap_search(docs, queries, 5),
    }[search]
    assert shuffled(spark, lambda: found().collect()) < 20_000  # of 180,000 pairs


def test_same_rows_as_by_terms(spark):
    docs = spark.createDataFrame([*texts(3, 800), (9000, ""), (9001, None), (-7, "w0 w0 w1"), (-8, "w0 w0 w1")], "doc_id long, text string").repartition(3)
    asked = [*texts(4, 300), (1000, "w0 w0"), (1001, ""), (1002, None), (1003, "none"), (1004, "w299 none w0")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = rows(ranking.ranked(ranking.bm25_scores(None, queries, ranking.postings_of(docs)), 7, "doc_id"))
    assert rows(ranking.bm25(docs, queries, 7)) == want
    index = lexical.kept(docs)
    assert rows(ranking.bm25(None, queries, 7, index=index)) == want
    assert rows(ranking.ranked(ranking.bm25_scores(docs, queries), 7, "doc_id")) == want
    assert ranking.by_terms(index).count() == ranking.postings_of(docs).count()
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%06d", F.col("doc_id") + 10)))
    assert ranking.bm25(named, queries, 7).count() == len(want)  # other ids take the way by terms


@pytest.mark.parametrize(("dense", "together", "docs", "postings"), [(0.02, 256, 16_384, 4_000_000), (0.0, 3, 7, 40), (2.0, 256, 1, 1)])
def test_pieces_and_products(monkeypatch, dense, together, docs, postings):
    for name, value in (("DENSE", dense), ("TOGETHER", together), ("HELD_DOCS", docs), ("HELD_POSTINGS", postings)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(5)
    known = pa.array(sorted(f"w{j}" for j in range(20)))
    held = [sorted(rng.choice(20, rng.integers(0, 9), replace=False).tolist()) for _ in range(60)]
    table = pa.table({"doc_id": pa.array(range(60)), "dl": pa.array([len(h) for h in held], pa.int32()), "terms": pa.array([[f"w{j}" for j in h] for h in held], pa.list_(pa.string())), "counts": pa.array([[1] * len(h) for h in held], pa.list_(pa.int32()))})
    entries = [(q, int(t), float(rng.integers(1, 4))) for q in range(5) for t in rng.choice(20, 6, replace=False)]
    asked = lexical._Asked(pa.table({"query_id": [e[0] for e in entries], "term": [f"w{e[1]}" for e in entries], "w": [e[2] for e in entries]}), known)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for piece in lexical._pieces(iter(table.to_batches(max_chunksize=13))):
        own = lexical._Postings(piece, known, None, 1.5, 0.75)
        found = lexical._better(own.scores(asked), asked, own.ids, found, 4)
    want = []
    for q in range(5):
        scores = sorted((-sum(w for p, t, w in entries if p == q and t in h), d) for d, h in enumerate(held))
        want += [(q, d, -s) for s, d in scores[:4] if s < 0]
    assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def test_growing_index_and_whole_lists_shuffle_no_pairs(spark, tmp_path):
    docs = spark.createDataFrame(texts(6, 1500), "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame(texts(7, 60), "query_id long, text string")
    index = growing.GrowingIndex(spark, str(tmp_path / "i"))
    index.add(docs.where("doc_id % 3 > 0").unionByName(docs.where("doc_id % 9 = 0").withColumn("text", F.lit("w0 old"))))
    index.add(docs.where("doc_id % 3 = 0"))
    found = []
    assert shuffled(spark, lambda: found.extend(rows(index.search(queries, 5)))) < 30_000  # of 90,000 pairs
    assert found == rows(ranking.bm25(docs, queries, 5))
    assert shuffled(spark, lambda: ranking.bm25_scores(docs, queries).count()) < 20_000
