import itertools
import random
import zlib

import numpy as np

from lodestone.llm import language_id as li

SOUNDS = {"aa": ["ka", "lo", "mi", "ta", "ru"], "bb": ["scht", "ein", "lich", "ung", "ta"], "cc": ["eaux", "oir", "ent", "mi", "que"]}


def word(rng, lang):
    return "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4)))


def fixture(n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SOUNDS))
        rows.append((k, " ".join(word(rng, lang).capitalize() + rng.choice(["", ",", "."]) for _ in range(rng.randint(3, 80))), lang))
    return rows


def test_chances_against_all_paths():
    rng = np.random.default_rng(2)
    k = 3
    trans, start = rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    lengths = [1, 5, 2, 6, 1, 4]
    e = rng.normal(0, 2, (sum(lengths), k))
    first = np.zeros(len(e), bool)
    first[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    want, at = [], 0
    for n in lengths:
        total = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            p = start[path[0]] * np.prod([np.exp(e[at + j, s]) for j, s in enumerate(path)]) * np.prod([trans[path[j - 1], path[j]] for j in range(1, n)])
            for j, s in enumerate(path):
                total[j, s] += p
        want += (total / total.sum(axis=1, keepdims=True)).tolist()
        at += n
    assert np.allclose(li.chances(e, first, trans, start)[0], want)


def test_slopes_against_differences():
    rng = np.random.default_rng(3)
    k, n = 3, 12
    e, trans, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    labels, first = rng.integers(0, k, n), np.zeros(n, bool)
    first[[0, 5, 6]] = True

    def likelihood(e, trans, start):
        total, bounds = 0.0, [0, 5, 6, n]
        for a, b in zip(bounds, bounds[1:]):
            score = lambda path: start[path[0]] + sum(e[a + j, s] for j, s in enumerate(path)) + sum(trans[path[j - 1], path[j]] for j in range(1, len(path)))  # noqa: B023, E731
            total += score(labels[a:b]) - np.logaddexp.reduce([score(p) for p in itertools.product(range(k), repeat=b - a)])
        return total

    for got, x in zip(li.slopes(e, labels, first, trans, start), (e, trans, start), strict=True):
        want = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            keep = x[at]
            x[at] = keep + 1e-5
            up = likelihood(e, trans, start)
            x[at] = keep - 1e-5
            want[at] = (up - likelihood(e, trans, start)) / 2e-5
            x[at] = keep
        assert np.allclose(got, want, atol=1e-6)


def test_words_against_a_loop():
    texts = ["Ärger, 12 x1y!  a-b", "", "́ ́e 日本", "one two", "IİI"]
    w = li.words_of(texts)
    want = []
    for k, t in enumerate(texts):
        at = 0
        for token in t.replace(" ", " ").split(" "):
            if any(c.isalpha() for c in token):
                inside = [j for j, c in enumerate(token) if c.isalpha() or c == "́"]
                want.append((k, at + inside[0], at + inside[-1]))
            at += len(token) + 1
    assert list(zip(w.text.tolist(), w.first.tolist(), w.last.tolist())) == want
    again = li.words_of(["ÄRGER A(b)"])
    assert again.hashes[again.which].tolist() == w.hashes[w.which][[0, 2]].tolist()


def test_features_against_a_loop():
    w = li.words_of(["abcde ab a abcde"])
    rows, columns = li.features(w)
    found = {k: sorted(columns[rows == k].tolist()) for k in range(3)}
    count = lambda n: 1 + 2 * min(n, 4) + max(0, n - 1) + max(0, n - 2)  # word, prefixes and suffixes, pairs, triples
    assert sorted(map(len, found.values())) == sorted(map(count, (5, 2, 1)))
    one, two = li.words_of(["xab"]), li.words_of(["yyab"])
    shared = set(li.features(one)[1].tolist()) & set(li.features(two)[1].tolist())
    assert len(shared) == 3  # the suffixes b and ab, the pair ab


def test_held_out_accuracy_and_clashing_columns(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, segments string")
    got = {r.doc_id: r for r in li.identified(docs).collect()}
    held = [got[k].lang_pred == lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 40 and sum(held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)


def test_languages_of_held_out_documents_change_nothing(spark):
    rows = fixture(120)
    other = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 5 == 0 else lang) for k, t, lang in rows]
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in li.identified(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()} for x in (rows, other))
    assert one == two


def test_code_switched_text_needs_the_chain():
    rng = random.Random(9)
    field = li.train([(lang, text) for _, text, lang in fixture()])
    texts, labels = [], []
    for _ in range(60):
        words, own = [], []
        for lang in rng.sample(list(SOUNDS), 3):
            n = rng.randint(5, 25)
            words += [rng.choice(["ta", "mi", word(rng, lang)]) if lang != "bb" else rng.choice(["ta", word(rng, lang)]) for _ in range(n)]  # "ta" and "mi" are in two languages
            own += [field.languages.index(lang)] * n
        texts.append(" ".join(words))
        labels += own
    right = (field.tag(texts)[1].argmax(axis=1) == labels).mean()
    trans, start = field.trans, field.start
    field.trans, field.start = np.ones_like(trans), np.ones_like(start)
    flat = (field.tag(texts)[1].argmax(axis=1) == labels).mean()
    assert right > 0.8 and right > flat + 0.15


def test_segments_and_long_texts(spark, monkeypatch):
    field = li.train([(lang, text) for _, text, lang in fixture()])
    text = "kalo mika ruka loka karu. " * 5 + "scht einlich lichung ungein " * 5
    long = "einlich ungein scht " * 40_000
    docs = spark.createDataFrame([(1, text), (2, long), (3, None), (4, ""), (5, "12 !? \n"), (None, "eauxoir queent"), (2, "karu"), (6, "x" * 300_000)], "doc_id long, text string")
    got = {(r.doc_id, r.segments[-1].end if r.segments else 0): r for r in li.predict(docs, field).collect()}
    assert [(s.start, s.end, s.lang) for s in got[1, len(text) - 1].segments] == [(0, 128, "aa"), (130, len(text) - 1, "bb")]
    assert got[2, len(long) - 1].lang_pred == "bb" and len(got[2, len(long) - 1].segments) == 1
    assert [(got[k, 0].lang_pred, got[k, 0].score) for k in (3, 4, 5)] == [("und", 0.0)] * 3
    assert got[None, 14].lang_pred == "cc" and got[2, 4].lang_pred == "aa" and got[6, 300_000].lang_pred in SOUNDS
    monkeypatch.setattr(li, "PART", 1000)
    assert all(len(p) <= 1000 for p in li._parts(long)) and "".join(li._parts(long)) == long and "".join(li._parts("y" * 2500)) == "y" * 2500


def test_nothing_to_learn(spark):
    rows = [(1, "some words", None), (None, "some words", "en"), (2, None, "en")]
    assert [(r.lang_pred, r.score) for r in li.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()] == [("und", 0.0)] * 3
    assert li.identified(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
