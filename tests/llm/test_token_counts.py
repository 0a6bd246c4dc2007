import random

import pytest
from tokenizers import Tokenizer, models

from lodestone.llm import token_counts as tc


def best(scores, unknown, text):
    """Every segmentation: best score, then fewest tokens."""
    found = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        options = [(found[end - 1][0] + unknown, -(found[end - 1][1] - len(text[end - 1].encode())))]
        options = [(found[end - 1][0] + unknown, -(-found[end - 1][1] + len(text[end - 1].encode())))]
        for begin in range(end):
            if text[begin:end] in scores:
                options.append((found[begin][0] + scores[text[begin:end]], found[begin][1] - 1))
        found[end] = max(options)
    return -found[len(text)][1]


def test_small_vocabulary_against_brute_force():
    rng = random.Random(3)
    pieces = list(dict.fromkeys("▁" * rng.randint(0, 1) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)))
    counts = tc.Counts(tc.zipf_scores(pieces))
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(300)}
    counts.insert(words)
    assert {w: counts[w] for w in words} == {w: best(counts.scores, counts.unknown, tc.MARK + w) for w in words}
    assert counts.nodes < sum(len(w) + 1 for w in words)


def test_public_vocabulary_against_the_library():
    pieces = tc.load_pieces(tc.VOCABULARY)
    scores = tc.zipf_scores(pieces)
    library = Tokenizer(models.Unigram([("<unk>", min(scores.values())), *((p, scores[p]) for p in pieces)], unk_id=0))
    words = "Hello world thinternational straße naïve unbelievable 12345 co-operate the ndreaonthe".split()
    counts = tc.Counts(scores)
    counts.insert(set(words))
    for w in words:
        assert counts[w] == len(library.encode(tc.MARK + w).tokens)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", 3), (1, "hello world", 3), (None, "hello", 3), (2, None, 3), (3, "  ", 3), (4, "hello " * 3000, 3), (5, "日本\U0001f600", 3)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in tc.token_counts(docs).collect())
    one = got[0][2]
    assert [g[:2] for g in got] == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (4, 3000), (5, 1)]
    assert got[5][2] == 3000 * one and got[3][2] == 0 and got[6][2] >= 3
    assert tc.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [3, 10])
def test_a_full_table_changes_nothing(spark, monkeypatch, cap):
    monkeypatch.setattr(tc, "CACHE_WORDS", cap)
    known = tc.Counts(tc.zipf_scores(["▁a", "b", "c", "▁ab"]))
    for words in ({"abc", "ab"}, {"b", "cc", "a"}, {"abcabc", "x"}):
        known.insert(words)
        assert all(w in known for w in words)
