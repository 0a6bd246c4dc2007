import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import near_dedup as nd
from lodestone.llm import shingles as sh


def classes_of(docs):
    """Brute force: exact document frequencies, all pairs, then transitive closure."""
    counted = [dict(zip(*(x.tolist() for x in sh.counted(sh.shingles(sh.words(text)))), strict=True)) for _, text in docs]
    n = sum(bool(c) for c in counted)
    df = Counter(h for c in counted for h in c)
    sets = [{h: k * (math.log((n + 1) / (max(df[h], nd.RARE * n) + 1)) + 1) for h, k in c.items()} for c in counted]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = sum(min(w, sets[j][x]) for x, w in sets[i].items() if x in sets[j])
            total = sum(sets[i].values()) + sum(sets[j].values()) - both
            if both and both >= nd.SIMILARITY * total:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    docs, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((n, " ".join(words)))
            n += 1
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):  # one large group, edited more and less
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((n, " ".join(words)))
        n += 1
    return docs


@pytest.mark.parametrize("seed", [3, 11])
def test_classes_match_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes_of(docs)
    got = {r.doc_id: r.class_id for r in nd.near_classes(df).collect()}
    assert got == want


def test_samples_agree_as_weighted_jaccard_says():
    rng = np.random.default_rng(5)
    h = sh.mixed(np.arange(1, 400, dtype=np.uint64))
    w = rng.random((2, 399)).astype(np.float32) + 0.1
    w[1, 100:] = w[0, 100:]
    k = 4000
    nd._tables.clear()
    s = nd.samples(np.tile(h, 2), w.ravel(), np.repeat([0, 1], 399), 2, k)
    nd._tables.clear()
    want = np.minimum(w[0], w[1]).sum() / np.maximum(w[0], w[1]).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


def test_edge_cases(spark):
    rows = [(5, "One two, three four five six seven", "a"), (3, "one two three FOUR five six seven!", "b"), (7, None, "c"), (8, "", "d"), (9, "...", "e"), (10, "...", "f"), (11, "hi you", "g"), (12, "Hi you", "h"), (None, "hi you", "i"), (12, "Hi you", "j"), (20, "lorem " * 5000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted((r.doc_id or 0, r.class_id) for r in nd.near_classes(docs).collect())
    assert got == [(0, None), (3, 3), (5, 3), (7, 7), (8, 8), (9, 9), (10, 10), (11, 11), (12, 11), (12, 11), (20, 20)]
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.class_id for r in kept.collect()) == ["b", "c", "d", "e", "f", "g", "i", "k"]


def test_empty(spark):
    assert nd.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_bring_all_their_texts(spark):
    rng = random.Random(2)
    a, b, c = ([rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(80)] for _ in range(3))
    near = [*b[:40], "other", *b[41:]]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join(near)), (6, " ".join(c)), (7, " ".join(a)), (4, " ".join(c[:79])), (9, " ".join(b) + "!"), (9, "alone"), (8, "Alone.")]
    got = {(r.doc_id, r.class_id) for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (9, 1), (8, 1), (6, 4), (4, 4)}


def test_rare_shingles_weigh_alike_whatever_shares_their_cell(spark):
    """Weights don't depend on how many shingles meet in a cell, as long as a cell's mean stays below the floor."""
    docs = spark.range(3000).selectExpr("concat_ws(' ', transform(sequence(1, 60), k -> concat('w', cast(hash(id, k) as string))), 'this is said in every one of them') as text")
    idf = nd.inverse_frequencies(docs)
    rare = math.log(3001 / (nd.RARE * 3000 + 1)) + 1
    common = {int(nd._cells(x[None])[0]) for x in sh.shingles(sh.words("this is said in every one of them"))}
    assert (abs(np.delete(idf, sorted(common)) - rare) < 1e-5).all()
    assert all(abs(idf[c] - 1) < 1e-5 for c in common)
