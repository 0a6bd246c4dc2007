import itertools
import math
import random
import zlib

import numpy as np

from lodestone.llm import toxicity as tox


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    trans, start = rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    lengths = [1, 5, 2, 7, 1, 6]
    e = rng.normal(0, 2, sum(lengths))
    first = np.zeros(len(e), bool)
    first[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    want, at = [], 0
    for n in lengths:
        total = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = start[path[0]] * np.prod([np.exp(e[at + k]) for k in range(n) if path[k]]) * np.prod([trans[path[k - 1], path[k]] for k in range(1, n)])
            for k, s in enumerate(path):
                total[k, s] += p
        want += (total[:, 1] / total.sum(axis=1)).tolist()
        at += n
    assert np.allclose(tox.marginals(e, first, trans, start)[0], want)


def fixture(n=600, seed=8):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorkish", "Blimf!", "frumpen"]))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = fixture()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.scored(docs, known).collect()}
    held = [(got[k].predicted, t) for k, _, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in labels)
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) >= 0.98
    k = next(k for k, _, t in labels if t)
    found = {rows[k][1][s.start : s.end] for s in got[k].spans}
    assert found and found <= {"zorkish", "Blimf!", "frumpen"}


def test_labels_of_held_out_documents_change_nothing(spark):
    rows, labels = fixture(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    one, two = ({r.doc_id: r.score for r in tox.scored(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, other))
    assert one == two


def test_nulls_empty_texts_and_no_labels(spark):
    rows, labels = fixture(200)
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (None, "zorkish frumpen", "x"), (1002, "calm", "x"), (1002, "calm", "x")], "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    got = tox.scored(docs, known).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id in (1000, 1001, 1002)] == [0, 0, 0, 0]
    none = tox.scored(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in none.collect()} == {0.0}
    assert tox.drop_toxic(docs, known).columns == docs.columns
    assert tox.scored(docs.limit(0), known).count() == 0


def test_labels_without_a_text_take_no_place_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(tox, "SAMPLE_CLEAN", 5)
    docs = spark.createDataFrame([(k, None if k % 4 else f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k // 4 % 2) for k in range(400)], "doc_id long, toxic int")
    got = tox.training_sample(docs, labels).collect()
    assert [sum(r.toxic == c for r in got) for c in (0, 1)] == [5, 5]


def test_a_long_document_is_not_passed_over_for_shorter_ones(monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE_TOKENS", 10)
    words, _, first, toxic = tox._labelled([("a b c", 0), ("d " * 20, 1), ("e", 0)])
    assert (len(words), first.sum(), toxic.tolist()) == (23, 2, [0, 1])


def likelihood(e, labels, first, log_trans, log_start):
    """log p(labels), every document's labelling summed one by one."""
    total = 0.0
    starts = [*np.flatnonzero(first), len(e)]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        score = lambda y: log_start[y[0]] + sum(log_trans[i, j] for i, j in zip(y[:-1], y[1:], strict=True)) + sum(v for v, k in zip(e[a:b], y, strict=True) if k)  # noqa: B023, E731
        total += score(labels[a:b]) - np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=b - a)))
    return total


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(8)
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0], bool)
    e, labels = rng.normal(size=8), rng.integers(0, 2, 8).astype(np.int8)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    miss, moved, begun = tox.slopes(e, labels, first, trans, start)
    step = 1e-6
    for values, slope, at in ((e, miss, 0), (trans, moved, 3), (start, begun, 4)):
        for k in np.ndindex(values.shape):
            ends = []
            for d in (step, -step):
                args = [e.copy(), labels, first, trans.copy(), start.copy()]
                args[at][k] += d
                ends.append(likelihood(*args))
            assert abs((ends[0] - ends[1]) / (2 * step) - slope[k]) < 1e-6


def test_calibration_is_the_penalised_best_and_scores_are_its_logistic():
    rng = np.random.default_rng(3)
    sums = np.stack([np.ones(200), rng.random(200) * 5, rng.random(200)], axis=1)
    toxic = (sums[:, 1] + rng.normal(size=200) > 2.5).astype(int)
    field = tox.Field(np.zeros(tox.DIMENSIONS, np.float32), 0.0, np.full((2, 2), 0.25), np.full(2, 0.5))
    field.calibrate(sums, toxic)
    q = 1 / (1 + np.exp(-sums @ field.logit))
    assert np.abs(sums.T @ (toxic - q) - 0.05 * field.logit).max() < 1e-6
    p = np.array([0.9, 0.2, *[0.01] * 30])
    top = sorted(p)[-tox.TOP:]
    assert abs(field.chance(p) - 1 / (1 + np.exp(-(field.logit @ [1, sum(top), 0.9])))) < 1e-12


def test_very_long_texts_and_clashing_columns(spark):
    """A toxic word in the middle of 30,000, under columns named like the operator's own."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(120):
        own = rng.choice(words, 40).tolist()
        if k % 3 == 0:
            own[int(rng.integers(40))] = "vileness"
            own[int(rng.integers(40))] = "vileness"
        rows.append((k, " ".join(own), 0.5, True))
        labels.append((k, int(k % 3 == 0)))
    long = rng.choice(words, 30_000).tolist()
    rows += [(900, " ".join(long), 0.1, False), (901, " ".join([*long[:15_000], "vileness", "vileness", *long[15_000:]]), 0.1, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")
    field = tox.train([(text, t) for (_, text, _, _), (_, t) in zip(rows, labels, strict=False)])
    got = {r.doc_id: r for r in tox.score(docs, field).collect()}
    assert len(got) == len(rows) and got[901].score > got[900].score and [s.start for s in got[901].spans] == [len(" ".join(long[:15_000])) + 1, len(" ".join(long[:15_000])) + 10]


def test_marks_are_those_of_the_definition():
    """Against counts made stem by stem, on documents with strong, weak, rare and chance stems."""
    rng = random.Random(5)
    docs = []
    for _ in range(300):
        toxic = int(rng.random() < 0.25)
        stems = {f"s{rng.randrange(3000)}" for _ in range(30)}
        if toxic:
            stems |= {rng.choice(["strong", "weak", "rare1", "rare2", "none"]), rng.choice(["strong", "none"])}
        elif rng.random() < 0.02:
            stems.add("weak")
        docs.append((stems, toxic))
    sizes = [sum(t == c for _, t in docs) for c in (0, 1)]
    every = set().union(*(s for s, _ in docs))
    count = {s: [sum(s in own for own, t in docs if t == c) for c in (0, 1)] for s in every}
    share = sizes[1] / len(docs)
    able, sure = set(), set()
    for s, (m, n) in count.items():
        if n < tox.LEAST_DOCS or (n + 0.1) / (sizes[1] + 1) < tox.LIKELIER * (m + 0.1) / (sizes[0] + 1):
            continue
        able.add(s)
        q = n / (n + m)
        surprise = n * math.log(q / share) + (m * math.log((1 - q) / (1 - share)) if m else 0)
        # The chance of such a surprise among all stems leaves no more than the allowed number.
        if (len(every) / tox.BY_CHANCE + 1) * math.exp(-surprise) <= 1:
            sure.add(s)
    marks = tox.marks_of(docs)
    assert {"strong", "none"} <= sure <= marks <= able
    # Beyond the sure ones, each mark covers documents that have none, and no stem that could cover enough is left.
    bare = [own for own, t in docs if t and not own & sure]
    assert all(sum(s in own for own in bare) >= tox.LEAST_DOCS for s in marks - sure)
    left = [own for own in bare if not own & marks]
    assert all(sum(s in own for own in left) < tox.LEAST_DOCS for s in able - marks)


def test_stems_longer_than_six_letters_mark_words_that_share_their_beginning():
    """Toxic words begin as clean ones do, for six letters; each form is in few documents."""
    rng = random.Random(3)
    rows = []
    for k in range(500):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(4)) for _ in range(30)] + ["bomen" + rng.choice("tz") + rng.choice("aou") for _ in range(2)]
        if k % 6 == 0:
            words[rng.randrange(30)] = "bomentex" + "".join(rng.choice("abcdefgh") for _ in range(2))
        rows.append((" ".join(words), int(k % 6 == 0)))
    field = tox.train(rows)
    assert field.evidence("bomentexzz") > 0 > field.evidence("bomenta")


def test_sample_is_held_as_codes_and_fitted_in_pieces(monkeypatch):
    import tracemalloc

    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(400)]
    rows = [(" ".join(rng.choice(words) for _ in range(400)) + " zorkish" * (k % 5 == 0), int(k % 5 == 0)) for k in range(500)]
    tracemalloc.start()
    field = tox.train(iter(rows), epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 * 200_000  # bytes a token; some 240 while all tokens' vectors were held at once
    monkeypatch.setattr(tox, "PIECE_TOKENS", 1 << 40)
    whole = tox.train(rows, epochs=2)
    assert np.allclose(field.weights, whole.weights, atol=1e-6) and np.allclose(field.logit, whole.logit, atol=1e-6)


def test_no_text_is_read_once_the_sample_is_full(monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE_TOKENS", 10)
    left = iter([("zorkish a b c d", 1), ("e f g h i", 0), ("never", 0)])
    assert len(tox._labelled(left)[0]) == 10 and next(left) == ("never", 0)
