import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int")


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "Битрикс24 синхронизация контактов"), (1, "SOAP и REST интеграция контактов системы"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "SOAP soap"), (2, "нет такого"), (3, "")], "query_id long, text string")
    got = ranking.bm25(docs, q).collect()
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 6 / (9 / 3)))
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(1, 1, 1)] and abs(got[0].score - want) < 1e-6


def test_bm25_ties_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b"), (3, "a b"), (4, "c c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert [r.doc_id for r in ranking.bm25(docs, q, 1).collect()] == [3]
    assert ranking.bm25(docs.limit(0), q).count() == 0 and ranking.bm25(docs, q.limit(0)).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (0, [2.0, 0.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.doc_id, r.score) for r in ranking.dense(v, q, 3).orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, round(1 / math.sqrt(2), 6))]
    assert ranking.dense(v, q.limit(0), 3).count() == 0


def test_dense_against_numpy(spark):
    """Many vectors of unlike lengths, with nulls inside, ties, and more queries than a block."""
    rng = np.random.default_rng(4)
    rows = [(k, [None if rng.random() < 0.05 else float(x) for x in rng.integers(-2, 3, 6 if k % 7 else 4)]) for k in range(300)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    asked = v.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    unit = lambda e: np.nan_to_num(np.array(e, float)) / (np.linalg.norm(np.nan_to_num(np.array(e, float))) or 1.0)
    was, ranking.QUERY_BLOCK = ranking.QUERY_BLOCK, 7
    try:
        got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in ranking.dense(v, asked, 4).collect())
    finally:
        ranking.QUERY_BLOCK = was
    want = []
    for q, e in rows[::10]:
        scored = sorted((-round(float(sum(a * b for a, b in zip(unit(e), unit(w), strict=False))), 6), d) for d, w in rows)[:4]
        want += [(q, k + 1, d, s) for k, (s, d) in enumerate(scored)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] + b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    few = sorted((r.query_id, r.doc_id) for r in ranking.nearest_of_few(v.where("doc_id < 50"), asked).collect())
    best = {q: min((-round(float(sum(a * b for a, b in zip(unit(e), unit(w), strict=False))), 6), d) for d, w in rows[:50])[1] for q, e in rows[::10]}
    assert dict(few) == best


def test_kept_index(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    index = ranking.with_documents(ranking.postings_of(docs), spark.createDataFrame([(2, "alpha"), (4, "beta"), (5, " ")], "doc_id long, text string"))
    now = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, ""), (4, "beta")], "doc_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert rows(ranking.bm25(None, q, 5, index=index)) == rows(ranking.bm25(now, q, 5))


def test_page_labels(spark):
    df = spark.sql("SELECT '' p, 's' s, 'c' c UNION ALL SELECT null, null, 'c' UNION ALL SELECT '3', 's', '' UNION ALL SELECT null, '', null")
    assert sorted(r.x for r in df.select(ranking.page_label(F.col("p"), F.col("s"), F.col("c")).alias("x")).collect()) == ["", "3", "c", "s"]


def test_fusion(spark):
    a, b = hits(spark, [(1, 10, 1), (1, 11, 2)]), hits(spark, [(1, 11, 1), (1, 12, 2)])
    got = ranking.fuse([a, b]).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [11, 10, 12]
    assert got[0].score == round(1 / 61 + 1 / 62, 6) and all(r.score <= 2 / 61 for r in got)
    tie = ranking.fuse([hits(spark, [(1, 7, 1)]), hits(spark, [(1, 3, 1)])]).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == [7, 3]
    assert ranking.fuse([a.limit(0), b.limit(0)]).count() == 0
    with pytest.raises(ValueError):
        ranking.fuse([a, b], k=0)


def test_parents(spark):
    rows = spark.createDataFrame([(1, 1, "p", "child a", "parent", 0.2, 2), (1, 2, "p", "child b", None, 0.9, 3), (1, 3, "q", "x" * 7000, None, 0.5, 1)], "query_id long, doc_id long, parent_id string, text string, parent_text string, score double, rank int")
    got = ranking.collapse_parents(rows).orderBy("rank").collect()
    assert [(r.parent_id, r.score, r.doc_id, r.children) for r in got] == [("q", 0.5, 3, [3]), ("p", 0.9, 1, [1, 2])]
    assert len(got[0].text) == 6000 and got[1].text == "parent"


def test_append_new_keeps_what_is_known(spark):
    known = hits(spark, [(1, 1, 1), (1, 1, 2)]).withColumn("hop", F.lit(1))
    more = hits(spark, [(1, 1, 1), (1, 2, 2), (1, 2, 3)]).withColumn("hop", F.lit(2))
    assert sorted((r.doc_id, r["rank"], r.hop) for r in ranking.append_new(known, more).collect()) == [(1, 1, 1), (1, 2, 1), (2, 2, 2)]


def test_multi_hop_stops(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "alpha"), (4, "alpha")], "query_id long, text string")
    said = spark.createDataFrame([(1, True, 0.9, "beta"), (2, False, 0.9, "beta"), (3, True, 0.5, " "), (4, False, 0.1, "ALPHA ")], "query_id long, sufficient boolean, confidence double, follow_up string")
    got = ranking.multi_hop(lambda x: ranking.bm25(docs, x, 3), q, lambda x, h: said.join(x.select("query_id"), "query_id"), 3).collect()
    assert sorted((r.query_id, r.doc_id, r.hop) for r in got) == [(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 1, 1), (4, 1, 1)]


def test_rewrites(spark):
    rows = [(1, "Как настроить?", '```json\n["как  настроить?", "A b", {"query": "c"}, "a B", "", "d", "e", "f"]\n```'), (2, "q", '{"rewrites": ["x"]}'), (3, "q", "no json")]
    got = ranking.parse_rewrites(spark.createDataFrame(rows, "query_id long, text string, answer string")).collect()
    assert sorted((r.query_id, r.variant, r.text) for r in got) == [(1, 1, "A b"), (1, 2, "c"), (1, 3, "d"), (1, 4, "e"), (2, 1, "x")]


def test_expansion_leaves_queries_without_rewrites_alone(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "query_id long, text string")
    rewrites = spark.createDataFrame([(1, 1, "beta")], "query_id long, variant int, text string")
    search = lambda x: ranking.bm25(docs, x, 5)
    got = {(r.query_id, r.doc_id): r.score for r in ranking.expanded(search, q, rewrites).collect()}
    plain = {(r.query_id, r.doc_id): r.score for r in search(q).collect()}
    assert got[2, 3] == plain[2, 3] and got[1, 1] == round(1 / 61 + 1 / 62, 6) and (1, 2) in got


def test_keys(spark):
    r = spark.sql("SELECT 'x' i, 's' s, '1' p, 't' t, cast(null as string) n").select(ranking.result_key(F.col("i"), F.col("s"), F.col("p"), F.col("t")).alias("a"), ranking.result_key(F.col("n"), F.col("s"), F.col("n"), F.col("t")).alias("b")).first()
    assert (r.a, r.b) == ("id::x", "sp::s::::t")
