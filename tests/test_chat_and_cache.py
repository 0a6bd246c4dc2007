import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import cache, chat, ranking


def test_history_and_blocks(spark):
    rows = [("c", k, r, t) for k, (r, t) in enumerate([("system", "s"), ("user", " q1 "), ("user", "q2 a@b.ru"), ("assistant", "a1"), ("assistant", " "), ("user", "q3")])]
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(r.turn for r in chat.tail(m, 2).collect()) == [4, 5] and chat.tail(m, 0).count() == 0
    assert chat.rendered(m).first().history == "Пользователь: s\nПользователь: q1\nПользователь: q2 a@b.ru\nАссистент: a1\nПользователь: q3"
    assert chat.markdown(m).first().markdown == "### Вопрос\nq1\n\n### Вопрос\nq2 [EMAIL]\n\n### Ответ\na1\n\n### Вопрос\nq3"
    assert chat.latest_assistant(m).first().turn == 4 and chat.latest_assistant(m.where("role = 'user'")).first().turn is None


def test_citations(spark):
    hits = spark.createDataFrame([(1, 1, "a b.pdf", None, "§1 T"), (1, 2, "a b.pdf", 7, "x"), (1, 3, "c.md", 0, ""), (2, 1, "c.md", 5, "")], "query_id long, rank int, source string, page int, signature string")
    assert {(r.query_id, r.source): r.page for r in chat.first_per_source(hits).collect()} == {(1, "a b.pdf"): None, (1, "c.md"): None, (2, "c.md"): 5}
    assert {(r.query_id, r.source): r.page for r in chat.first_page_per_source(hits).collect()} == {(1, "a b.pdf"): 7, (2, "c.md"): 5}
    answers = spark.createDataFrame([(1, "[a b.pdf] и [c.md](u) [z.txt] [c.md]."), (2, "[ c.md]"), (3, "[c.md]"), (1, None)], "query_id long, answer string")
    got = sorted((r.query_id, r.answer or "") for r in chat.linkify(answers, chat.first_per_source(hits), "http://kb/").collect())
    assert got == [(1, ""), (1, "[a b.pdf, §1 T](http://kb/a%20b.pdf) и [c.md](u) [z.txt] [c.md](http://kb/c.md)."), (2, "[c.md, стр. 5](http://kb/c.md#page=5)"), (3, "[c.md]")]
    assert {r.query_id: r.sources for r in chat.export_row(hits).collect()} == {1: "a b.pdf; c.md", 2: "c.md"}


def replay(rows, seeds, threshold, fill=True):
    held, out = [], []
    for n, (seq, v, intent) in enumerate(rows):
        v = np.array(v) / (np.linalg.norm(v) or 1)
        best, score = None, -1.0
        if n >= seeds:
            for e in held:
                s = round(float(e[1] @ v), 6)
                if s > score:
                    best, score = e, s
        hit = best is not None and score >= threshold
        if n >= seeds:
            out.append((seq, best and best[0], hit, bool(hit and best[2] == intent)))
        if n < seeds or not hit and fill:
            held.append((seq, v, intent))
    return out


def test_replay_against_a_loop(spark):
    """One cache over blocks of any size, and a cache that only its seeds fill; equal vectors, zero vectors and a record without one."""
    rng = np.random.default_rng(3)
    rows = [(3 * k, rng.normal(size=4).tolist(), int(rng.integers(3))) for k in range(60)]
    rows += [(200, [0.0] * 4, 1), (201, rows[50][1], 1), (202, rows[50][1], 2), (203, None, 1), (204, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "seq long, embedding array<double>, intent int").repartition(5)
    asked = [r for r in rows if r[1] is not None]
    for t in (0.5, 0.9):
        want = replay(asked, 3, t, True)
        for block in (7, 100):
            got = cache.online_replay(df, 3, (t,), block).collect()
            assert sorted((r.seq, r.entry_seq, r.hit, r.accurate) for r in got) == want
            sizes = {}
            for r in sorted(got, key=lambda r: r.seq):
                sizes[r.entry_seq] = sizes.get(r.entry_seq, 1) + r.hit
                assert r.cluster_size == sizes[r.entry_seq]
        fixed = cache.seeded_replay(df, 3, (t,)).collect()
        assert sorted((r.seq, r.entry_seq, r.hit, r.accurate) for r in fixed) == replay(asked, 3, t, False)
        sizes = {}
        for r in sorted(fixed, key=lambda r: r.seq):
            sizes[r.entry_seq] = sizes.get(r.entry_seq, 1) + r.hit
            assert r.cluster_size == sizes[r.entry_seq]


def test_a_replayed_block_joins_nothing_to_the_blocks_before_it(spark, monkeypatch):
    """What a search has for its plan is as long for a late block as for the second one."""
    plans, dense = [], ranking.dense

    def seen(vectors, queries, k):
        plans.append(vectors._jdf.queryExecution().optimizedPlan().toString())
        return dense(vectors, queries, k)

    monkeypatch.setattr(ranking, "dense", seen)
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0], k % 3) for k in range(40)], "seq long, embedding array<double>, intent int")
    assert cache.online_replay(rows, 4, (0.999,), 6).count() == 36
    assert len(plans) == 6 and not any("Join" in p for p in plans) and len(plans[1].splitlines()) == len(plans[-1].splitlines())


def test_wrong_intent_is_a_false_hit(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], "seq long, embedding array<double>, intent int")
    m = cache.metrics(cache.online_replay(rows, 1, (0.99,))).first()
    assert (m.hits, m.false_positive_hits, m.hit_precision, m.accuracy_impact, m.latency_savings_rate) == (1, 1, 0.0, 1.0, round(1165 / 1200, 6))
    assert cache.online_replay(rows.limit(0), 1, (0.99,)).count() == 0


def test_decision_and_stub_answers(spark):
    cols = "threshold double, hit_precision double, accuracy_impact double, effective_hit_rate double"
    gate = lambda *r: cache.decision(spark.createDataFrame([r], cols)).first().decision_gate
    assert gate(0.95, 1.0, 0.0, 0.5) == "candidate" and gate(0.95, 1.0, 0.0, 0.2) == "reject" and gate(0.95, 0.9, 0.0, 0.5) == "reject" and gate(0.95, 1.0, 0.1, 0.5) == "reject"
    df = spark.createDataFrame([(["a.md", "b.md"], ["1", "2", "3", "4"]), ([], None)], "s array<string>, m array<string>")
    assert [r.x for r in df.select(cache.stub_answer(F.col("s"), F.col("m")).alias("x")).collect()] == ["Stub answer grounded in a.md, b.md; expected markers: 1, 2, 3.", "Stub answer grounded in unknown source; expected markers: no markers."]


def test_thresholds(spark):
    cols = "threshold double, hit_precision double, accuracy_impact double, effective_hit_rate double"
    pick = lambda rows: cache.recommended(spark.createDataFrame(rows, cols)).first().threshold
    assert pick([(0.9, 1.0, 0.0, 0.9), (0.95, 1.0, 0.0, 0.5), (0.97, 1.0, 0.0, 0.4)]) == 0.95
    assert pick([(0.9, 1.0, 0.0, 0.4), (0.95, 0.5, 0.0, 0.5), (0.97, 1.0, 0.0, 0.4)]) == 0.97
    assert pick([(0.9, 0.2, 0.3, 0.4), (0.95, 0.5, 0.4, 0.5), (0.97, 0.5, 0.3, 0.4)]) == 0.97


def test_queries_are_normalised(spark):
    rows = [("Подскажите, как настроить Ёлку? Нужны краткие шаги.",), ("Пожалуйста: x-1",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(cache.normal_query("t").alias("x")).collect()]
    assert got == ["как настроить елку", "x 1", ""]


def test_variants(spark):
    items = spark.createDataFrame([(1, "q1", "a"), (2, "q2", "b")], "item_id long, question string, intent string")
    got = sorted((r.seq, r.item_id, r.query) for r in cache.replay_records(items, 5, 1).collect())
    assert got == [(0, 1, "q1"), (1, 2, "q2"), (2, 1, "Подскажите, q1"), (3, 2, "Подскажите, q2"), (4, 1, "Пожалуйста, q1")]
