import random
import re

from lodestone.llm import decontam


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def weighted(w):
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = {}
    weight = lambda s: sum(len(x) for g in s for x in g)
    for doc, text in docs:
        w = words(text)
        for item, said in items:
            n = len(words(said))
            if not n or not w or doc is None or item is None:
                continue
            s = weighted(words(said))
            for a in range(max(1, len(w) - n + 1)):
                own = weighted(w[a : a + n])
                both = weight(own & s)
                if both and (sim := both / (weight(own) + weight(s) - both)) >= 0.8:
                    out[doc, item] = max(out.get((doc, item), 0), sim)
    return out


def test_against_all_windows(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(rng.randint(6, 60)))) for k in range(20)] + [(20, "only three words"), (21, None), (22, "one")]
    docs = []
    for d in range(60):
        body = some(rng.randint(0, 150))
        if d % 2:
            leak = words(items[rng.randrange(20)][1])
            for _ in range(rng.choice([0, 0, 1])):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            at = rng.randint(0, len(body))
            body = body[:at] + leak + body[at:]
        docs.append((d, " ".join(body)))
    docs += [(60, "x, Only THREE words y"), (61, None), (62, ""), (None, items[0][1]), (63, items[1][1]), (64, "one")]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(128)
        b = a
        for bit in rng.sample(range(128), rng.choice([0, 5, 31, 40, decontam.RADIUS])):
            b ^= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((*(signed(x & (2**64 - 1)) for x in (a, a >> 64, b, b >> 64)),))
    df = spark.createDataFrame(rows, "f1 long, f2 long, g1 long, g2 long")
    one = df.select("*", F.posexplode(decontam._blocks(F.col("f1"), F.col("f2"))).alias("block", "v"), F.monotonically_increasing_id().alias("i"))
    two = df.select(F.posexplode(decontam._blocks(F.col("g1"), F.col("g2"))).alias("block2", "v2"), F.monotonically_increasing_id().alias("j"))
    near = F.bit_count(F.col("v").bitwiseXOR(F.col("v2"))) <= decontam.APART
    met = one.join(two, (F.col("i") == F.col("j")) & (F.col("block") == F.col("block2")) & near)
    first = met.where(F.col("block") == decontam._first_near(F.col("f1").bitwiseXOR(F.col("g1")), F.col("f2").bitwiseXOR(F.col("g2"))))
    assert first.count() == len(rows)
    assert first.select("i").distinct().count() == len(rows)


def test_rows_and_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 1), (1, "alpha beta gamma delta epsilon zeta", 1), (2, "something else", 2), (None, "alpha beta gamma delta epsilon zeta", 3)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, "Alpha beta; gamma delta epsilon zeta", 5)], "item_id long, text string, w long")
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.drop_leaks(docs, none).count() == 4
    assert decontam.leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0


def test_native_plan(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    plan = decontam.leaks(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("PythonUDF", "ArrowEval", "MapInArrow", "MapInPandas"))


def test_leaks_with_other_words_at_either_end_and_long_or_short_words_around(spark):
    rng = random.Random(6)
    word = lambda a, b: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(a, b)))
    items, docs = [], []
    for k in range(14):
        said = [word(4, 6) for _ in range(14 + 2 * k)]
        items.append((k, " ".join(said)))
        for j, (head, tail) in enumerate([(1, 0), (0, 1), (2, 0), (1, 1), (3, 0)]):
            leak = [word(1, 3) for _ in range(head)] + said[head : len(said) - tail] + [word(1, 3) for _ in range(tail)]
            around = (15, 25) if (k + j) % 3 else (1, 2)
            docs.append((10 * k + j, " ".join([*(word(*around) for _ in range(rng.choice([0, 8]))), *leak, *(word(*around) for _ in range(rng.choice([0, 8])))])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert len(want) > 30
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_a_long_token_behind_a_leak_and_very_long_texts(spark):
    """An item whose first word was replaced, before a token of 200 letters; and one in the middle of 30,000 words."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    said = [word(4) for _ in range(30)]
    long = [word(6) for _ in range(30_000)]
    items = [(7, " ".join(said)), (8, " ".join(said[:29])), (9, " ".join(long[15_000:15_040]))]
    docs = [(1, " ".join([*(word(6) for _ in range(40)), "other", *said[1:], word(200), word(5)])), (2, " ".join(long)), (2, " ".join(long[:20_000])), (3, " ".join(long[:10_000]))]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {k: round(v, 9) for k, v in brute(docs[:1], items).items()}
    assert (1, 7) in want
    assert got == {**want, (2, 9): 1.0}


def test_shingles_of_any_length_weigh_their_letters(spark):
    """Words of 150 to 2,000 letters: whole, with one word changed, and beside short ones; joined with and without broadcasts."""
    rng = random.Random(12)
    word = lambda a, b: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(a, b)))
    items, docs = [], []
    for k in range(12):
        said = [word(*rng.choice([(150, 2000), (3, 8), (3, 8)])) for _ in range(24)]
        items.append((k, " ".join(said)))
        for j in range(4):
            leak = list(said)
            if j:
                leak[rng.choice([0, 1, -1, -2])] = word(3, 8)
            docs.append((10 * k + j, " ".join([word(3, 1200), *leak, word(3, 8), *leak[:9]])))
    items += [(50, word(3000, 3000)), (51, f"{word(600, 600)} {word(600, 600)}")]
    docs += [(500, f"x {items[-2][1]} y"), (501, items[-1][1]), (502, items[-1][1] + " z")]
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len({v for v in want.values() if v < 1}) > 5
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.leaks(*frames).collect()} == want


def test_joins_that_shuffle_give_the_same(spark, monkeypatch):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 30)))) for k in range(10)]
    docs = [(d, " ".join([rng.choice(vocabulary), *words(items[d % 10][1])[d % 2 :], rng.choice(vocabulary)])) for d in range(30)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.leaks(*frames).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_CHARS", -1)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.leaks(*frames).collect()} == got
    assert got == {k: round(v, 9) for k, v in brute(docs, items).items()}


def test_plans_stay_small(spark):
    """The driver holds plans: what is read again is written, and fingerprints' bits are a loop, not a term each."""
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one alpha beta gamma delta epsilon zeta eta theta two"), (2, "nothing of it"), (None, None)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    kept = decontam.drop_leaks(docs, items)
    assert sorted(r.text or "" for r in kept.collect()) == ["", "nothing of it"]
    assert not re.search("Generate|Window|xxhash64", plan(kept))
    coded = spark.createDataFrame([(1, [5 << 10 | 7], [])], "k long, codes array<long>, heavy array<struct<c:bigint,x:bigint>>")
    assert plan(decontam._fingerprints(coded, "k")).count("shiftleft") <= 4


def test_fingerprints_against_their_definition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(k, sorted({rng.getrandbits(53) << 10 | rng.randint(1, 1022) for _ in range(rng.randint(1, 30))}), []) for k in range(20)]
    coded = spark.createDataFrame(rows, "k long, codes array<long>, heavy array<struct<c:bigint,x:bigint>>")
    flat = coded.select("k", F.explode("codes").alias("c"))
    hashed = flat.select("k", F.col("c").bitwiseAND(F.lit(1023)).alias("w"), F.xxhash64("c").alias("h1"), F.xxhash64(F.lit(1), "c").alias("h2")).collect()
    for r in decontam._fingerprints(coded, "k").collect():
        own = [x for x in hashed if x.k == r.k]
        total = sum(x.w for x in own)
        assert r.total == total
        for f, name in ((r.f1, "h1"), (r.f2, "h2")):
            assert f % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x.w for x in own if x[name] >> b & 1) > total)
