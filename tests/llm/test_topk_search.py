import math
import random

import numpy as np
import pytest

from lodestone.llm import shingles as sh
from lodestone.llm import topk_search as ts


def brute(docs, queries, k):
    words = [(d, [w for w in sh.words(t).tolist()]) for d, t in docs if d is not None]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        best = {}
        for d, w in words:
            s = 0.0
            for t in sh.words(text).tolist():
                tf = w.count(t)
                if tf:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
            if s > 0:
                best[d] = max(best.get(d, 0), s)
        out[q] = [(d, -s) for s, d in sorted((-round(s, 6), d) for d, s in best.items())[:k]]
    return {q: rows for q, rows in out.items() if rows}


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return got


@pytest.mark.parametrize("shard", [16, 64])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ts, "SHARD_DOCS", shard)
    rng = random.Random(shard)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(12_000)]
    docs, at = [], 0
    for d in range(150):
        n = rng.randint(0, 70)
        docs.append((d, " ".join(words[at : at + n])))
        at += n
    docs += [(150, docs[3][1]), (151, None), (None, docs[5][1]), (152, docs[7][1]), (152, docs[8][1])]
    queries = [(q, docs[q][1]) for q in range(0, 150, 10)] + [(900, ""), (901, None), (902, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = found(ts.top_k(df, spark.createDataFrame(queries, "query_id long, text string"), k=7))
    assert got == brute(docs, queries, 7)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ts.top_k(none, none.withColumnRenamed("doc_id", "query_id")).count() == 0


@pytest.mark.parametrize("shard", [64, 1000])
def test_a_repeated_doc_id_leaves_room_for_others(spark, monkeypatch, shard):
    monkeypatch.setattr(ts, "SHARD_DOCS", shard)
    rng = random.Random(shard)
    docs = [(7, "red fox " * 3 + f"n{k}") for k in range(30)] + [(8, f"red fox red fox n{k % 3}") for k in range(25)]
    docs += [(100 + d, " ".join(rng.choice(["red", "fox", "the", *(f"w{x}" for x in range(30))]) for _ in range(rng.randint(3, 40)))) for d in range(200)]
    queries = [(1, "red fox"), (2, "fox w3 w4 n1"), (3, "n2 n5")]
    got = found(ts.top_k(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(queries, "query_id long, text string"), 5))
    assert got == brute(docs, queries, 5)


def test_ties_long_texts_clashing_columns_and_blocks_of_queries(spark, monkeypatch):
    """Scores that tie go by doc_id, in any block or shard; texts of 30,000 words; columns named like the operator's own."""
    monkeypatch.setattr(ts, "BLOCK", 4)
    monkeypatch.setattr(ts, "FIRST", 1)
    monkeypatch.setattr(ts, "BLOCK_TERMS", 40)
    monkeypatch.setattr(ts, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(ts, "SHARD_DOCS", 40)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    docs = [(d, f"same words here {d % 3}") for d in range(60)] + [(100 + d, " ".join(rng.choices(words, k=30))) for d in range(90)]
    docs += [(500 + d, " ".join(rng.choices(words + ["rare"] * d, k=30_000))) for d in range(2)]
    queries = [(0, "same words"), (1, "here 2"), (2, "w1 w2 w3 w3"), (3, " ".join(words)), (4, "rare w1 w5"), (5, "w7")]
    df = spark.createDataFrame([(d, t, 1.5, 0, "x") for d, t in docs], "doc_id long, text string, score double, rank int, query_id string").repartition(3)
    assert found(ts.top_k(df, spark.createDataFrame(queries, "query_id long, text string"), 6)) == brute(docs, queries, 6)


def test_blocks_that_can_not_reach_the_threshold_are_not_read():
    rng = np.random.default_rng(1)
    n, terms = 4096, 40
    docs = [np.flatnonzero(rng.random(n) < np.where(np.arange(n) // 64 == 7, 0.5, 0.05)) for _ in range(terms)]
    tf = [np.where(d // 64 == 7, 5, 1) for d in docs]
    begins = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int32)
    shard = ts.Shard({"doc_ids": np.arange(n).tobytes(), "lengths": np.full(n, 50, np.int32).tobytes(), "terms": np.arange(terms, dtype=np.uint64).tobytes(), "begins": begins.tobytes(), "docs": np.concatenate(docs).astype(np.uint16).tobytes(), "counts": np.concatenate(tf).astype(np.uint16).tobytes()}, 50.0)
    best = ts.Best(5)
    asked = np.arange(3, dtype=np.uint64)
    shard.search([(asked, np.ones(3))], [best])
    scores = np.zeros(n)
    for t in range(3):
        np.add.at(scores, docs[t], tf[t] * 2.5 / (tf[t] + 1.5))
    order = np.lexsort((np.arange(n), -np.round(scores, 6)))[:5]
    assert best.ids.tolist() == order.tolist()
    assert shard.read < shard.held / 2


def test_a_known_threshold_spares_reading_and_loses_nothing():
    rng = np.random.default_rng(3)
    n, terms = 3000, 400
    docs = [np.flatnonzero(rng.random(n) < share) for share in 0.9 / np.arange(1, terms + 1) ** 0.7]
    tf = [rng.integers(1, 5, len(d)) for d in docs]
    lengths = np.bincount(np.concatenate(docs), np.concatenate(tf), n).astype(np.int32)
    begins = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int32)
    shard = ts.Shard({"doc_ids": np.arange(n).tobytes(), "lengths": lengths.tobytes(), "terms": np.arange(terms, dtype=np.uint64).tobytes(), "begins": begins.tobytes(), "docs": np.concatenate(docs).astype(np.uint16).tobytes(), "counts": np.concatenate(tf).astype(np.uint16).tobytes()}, lengths.mean())
    queries = [(np.sort(rng.choice(terms, size, replace=False)).astype(np.uint64), rng.random(size) * 9) for size in (1, 3, 20, 90, 300) * 4]
    first, again = [ts.Best(6) for _ in queries], []
    shard.search(queries, first)
    read, shard.read = shard.read, 0
    for (asked, weights), best in zip(queries, first, strict=True):
        scores = np.zeros(n)
        for t, w in zip(asked.tolist(), weights, strict=True):
            np.add.at(scores, docs[t], w * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * lengths[docs[t]] / lengths.mean())))
        order = np.lexsort((np.arange(n), -np.round(scores, 6)))[:6]
        assert best.ids.tolist() == order.tolist() and np.allclose(best.scores, scores[order], atol=1e-6)
        again.append(ts.Best(6, best.least))
    shard.search(queries, again)
    assert [b.ids.tolist() for b in again] == [b.ids.tolist() for b in first]
    assert shard.read < 0.9 * read
