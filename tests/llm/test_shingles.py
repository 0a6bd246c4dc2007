import random

import numpy as np

from lodestone.llm import shingles as sh

ODD = ["İstanbul — “Quote” ﬁ x́y z", "  ", "", None, "...", "😀 x😀y 日本語 テスト", "ΟΔΟΣ. Α ΣΑΣ σας", "a\x1cb\x85c​d a-b ab AB", "a" * 5000 + " b " + "a" * 5000, "one, ONE one! (one) o.n.e two"]


def plain(text):
    return [w for w in ("".join(c for c in t.lower() if c.isalnum()) for t in (text or "").split()) if w]


def test_equal_words_have_equal_hashes_and_others_have_not():
    rng = random.Random(1)
    texts = ODD + [" ".join("".join(rng.choice("abcéßÑ12.,-") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(40)]
    words, hashes = [], []
    for t in texts:
        own, h = plain(t), sh.words(t)
        assert len(own) == len(h)
        words += own
        hashes += h.tolist()
    assert 0 not in hashes and len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes, strict=True)))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    whole = [sh.words(t) for t in ODD]
    for part in (1, 7, 50):
        monkeypatch.setattr(sh, "PART", part)
        assert all(np.array_equal(a, sh.words(t)) for a, t in zip(whole, ODD, strict=True))
