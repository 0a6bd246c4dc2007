import random

import pytest

from lodestone.operators import growing, pruned, ranking


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (j + 1) ** 1.3 for j in range(300)]
    return [(k, " ".join(rng.choices(words, weights=weights, k=rng.randint(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("k", [1, 5])
def test_same_rows_and_fewer_postings(spark, k):
    docs = spark.createDataFrame([*texts(1, 1500), (5000, ""), (5001, None)], "doc_id long, text string")
    asked = [(j, t) for j, t in texts(2, 25)] + [(100, "w0"), (101, "w0 w1 w2"), (102, "none w299"), (103, ""), (104, "w0 w0 w0 w290 w280"), (105, "w1 w1")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    hits, work = pruned.bm25(docs, queries, k)
    assert rows(hits) == rows(ranking.bm25(docs, queries, k))
    total = work.groupBy().sum("postings", "added").first()
    assert total["sum(added)"] < total["sum(postings)"]
    own = {r.query_id: r for r in work.collect()}
    assert own[104].added < own[104].postings / 2  # the frequent word brings no document forward
    assert pruned.bm25(docs, queries.limit(0), k)[0].count() == 0 and pruned.bm25(docs.limit(0), queries, k)[0].count() == 0


def test_over_segments(spark, tmp_path):
    index = growing.GrowingIndex(spark, str(tmp_path / "i"))
    for part in (texts(3, 200), [(k + 150, t) for k, t in texts(4, 100)]):
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
    index.remove(spark.createDataFrame([(k,) for k in range(0, 200, 9)], "doc_id long"))
    queries = spark.createDataFrame(texts(5, 10), "query_id long, text string")
    assert rows(index.search_pruned(queries, 4)[0]) == rows(index.search(queries, 4))
