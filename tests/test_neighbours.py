import numpy as np
import pytest

from lodestone.operators import neighbours, ranking


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def clustered(rng, n, d=16, groups=12):
    middles = rng.normal(size=(groups, d))
    return (middles[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.05).tolist()


@pytest.mark.parametrize("block", [4096, 7])
def test_same_as_a_full_scan(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    rng = np.random.default_rng(block)
    vectors = [(k, v) for k, v in enumerate(clustered(rng, 600))]
    vectors += [(1000 + k, vectors[3][1]) for k in range(200)]  # a large group of copies, with ties
    vectors += [(2000, [0.0] * 16), (2001, [1.0, None] + [0.5] * 14), (2002, [1.0, 2.0]), (2003, None), (2004, []), (2005, [0.5] * 20)]
    v = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, e) for k, e in vectors[::40]] + [(5000, [0.0] * 16), (5001, [1.0] * 30), (5002, None), (5003, [3.0]), (5004, (-np.array(vectors[0][1])).tolist())], "query_id long, embedding array<double>")
    index = neighbours.Cells.build(v, cells=10)
    hits, work = index.search(q, 4)
    want = rows(ranking.dense(v, q, 4))
    got = rows(hits)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)
    w = work.first()
    assert 0 < w.compared < w.pairs == (len(vectors) - 1) * (q.count() - 1)


def test_clusters_are_skipped_and_spread_directions_are_not(spark):
    rng = np.random.default_rng(8)
    schema = "doc_id long, embedding array<double>"
    near = spark.createDataFrame(list(enumerate(clustered(rng, 3000, groups=30))), schema)
    w = neighbours.Cells.build(near).search(near.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 5)[1].first()
    assert w.compared < 0.2 * w.pairs
    spread = spark.createDataFrame(list(enumerate(rng.normal(size=(800, 64)).tolist())), schema)
    asked = spread.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    hits, work = neighbours.Cells.build(spread).search(asked, 5)
    assert rows(hits) == rows(ranking.dense(spread, asked, 5)) and work.first().compared > 0.5 * work.first().pairs


def test_nothing_to_find(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "doc_id long, embedding array<double>")
    q = v.withColumnRenamed("doc_id", "query_id")
    assert neighbours.Cells.build(v.limit(0)).search(q, 3)[0].count() == 0
    assert neighbours.Cells.build(v).search(q.limit(0), 3)[0].count() == 0
    assert rows(neighbours.Cells.build(v.where("doc_id = 2")).search(q, 3)[0]) == [(1, 1, 2, 0.0), (2, 1, 2, 0.0)]
