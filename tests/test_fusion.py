import numpy as np
import pytest

from lodestone.operators import fusion, ranking


def brute(lexical, near, k, rrf_k):
    fused = {}
    for number, (scores) in enumerate((lexical, near)):
        for rank, (_, d) in enumerate(sorted((-s, d) for d, s in scores.items()), 1):
            score, first = fused.get(d, (0.0, (number, rank)))
            fused[d] = (score + 1 / (rrf_k + rank), min(first, (number, rank)))
    best = sorted((-round(s, 6), *f, d) for d, (s, f) in fused.items())[:k]
    return [(n + 1, d, -s) for n, (s, _, _, d) in enumerate(best)]


@pytest.mark.parametrize("rrf_k,block", [(60, 4096), (3, 2)])
def test_equal_to_fusing_whole_lists(spark, monkeypatch, rrf_k, block):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    rng = np.random.default_rng(rrf_k)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 12)))) for k in range(400)]
    vectors = [(k, rng.integers(-1, 2, 4).astype(float).tolist()) for k in range(50, 450)]  # many ties
    asked = [(k, " ".join(rng.choice(words, 3)) if k < 5 else "none", rng.integers(-1, 2, 4).astype(float).tolist()) for k in range(7)]
    d, v = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    q, e = spark.createDataFrame([a[:2] for a in asked], "query_id long, text string"), spark.createDataFrame([(a[0], a[2]) for a in asked if a[0] != 3], "query_id long, embedding array<double>")
    hits, work = fusion.uncut(d, v, q, e, 4, rrf_k)
    got, rows = hits.collect(), {r.query_id: r.rows for r in work.collect()}
    lexical = {}
    for r in ranking.bm25_scores(d, q).collect():
        lexical.setdefault(r.query_id, {})[r.doc_id] = r.score
    near = {}
    for r in ranking.dense(v, e, 1000).collect():
        near.setdefault(r.query_id, {})[r.doc_id] = r.score
    for qid, _, _ in asked:
        own = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == qid)
        want = brute(lexical.get(qid, {}), near.get(qid, {}), 4, rrf_k)
        assert own == [(a, b, pytest.approx(c, abs=1e-9)) for a, b, c in want]
        assert rows.get(qid, 0) <= 4 * fusion.depth(4, rrf_k)
    assert all(r.similarity == near[r.query_id].get(r.doc_id) for r in got if r.query_id in near)
    assert ranking.hybrid(d, v, q.limit(0), e.limit(0), 4, candidates=None).count() == 0


def test_places_ahead():
    q, s, d = np.array([1, 1, 1, 2]), np.array([0.5, 0.5, 0.9, 0.7]), np.array([4, 9, 1, 3])
    assert fusion._ahead(q, s, d, np.array([1, 1, 2, 3]), np.array([0.5, 0.4, 0.7, 0.1]), np.array([9, 2, 3, 1])).tolist() == [2, 3, 0, 0]
