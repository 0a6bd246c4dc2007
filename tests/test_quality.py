from lodestone.operators import quality


def pairs(spark, gold, said):
    return quality.matched(spark.createDataFrame(gold, "id string, status string"), spark.createDataFrame(said, "id string, status string"))


def test_metrics(spark):
    p = pairs(spark, [("1", "Да"), ("2", "Нет"), ("3", "Частично")], [("1.0", "Да"), ("2", "Да"), ("99", "НД")])
    got = {r["class"]: r for r in quality.class_metrics(p).collect()}
    assert (got["Да"].precision, got["Да"].recall, got["Да"].f1) == (0.5, 1.0, round(2 / 3, 6))
    assert (got["Частично"].support, got["Частично"].f1) == (0, 0.0)
    q = quality.quality(p).first()
    assert (q.gold_total, q.matched, q.missing, q.extra, q.invalid, q.accuracy, q.macro_f1) == (3, 2, 1, 1, 0, 0.5, round(2 / 3 / 4, 6))
    s = quality.quality(p, strict=True).first()
    assert s.accuracy == round(1 / 3, 6)
    assert {r["class"]: r.fn for r in quality.class_metrics(p, strict=True).collect()}["Частично"] == 1
    assert {(r.actual, r.predicted): r.n for r in quality.confusion(p).collect() if r.n} == {("Да", "Да"): 1, ("Нет", "Да"): 1}


def test_unknown_status_and_empty(spark):
    p = pairs(spark, [("1", "Да"), ("2", "?")], [("1", "maybe"), ("2", "Да")])
    assert quality.quality(p).first().invalid == 2
    e = quality.quality(p.limit(0)).first()
    assert (e.gold_total, e.accuracy, e.macro_f1) == (0, 0.0, 0.0)


def test_of_repeated_ids_the_last_counts(spark):
    gold = spark.createDataFrame([("1", "Нет", 1), ("1", " Да ", 2), ("2", "Нет", 1), (" ", "Да", 1), (None, "Да", 1)], "id string, status string, ord int")
    said = spark.createDataFrame([("2", "Да", 1), ("2.0", "Нет", 2), ("1", "Да", 1)], "id string, status string, ord int")
    q = quality.quality(quality.matched(gold, said)).first()
    assert (q.gold_total, q.matched, q.missing, q.extra, q.accuracy) == (2, 2, 0, 0, 1.0)
    as_read = quality.matched(gold.drop("ord").coalesce(1), said.drop("ord").coalesce(1))
    assert quality.quality(as_read).first().accuracy == 1.0


def test_summary_and_gates(spark):
    p = pairs(spark, [("1", "Да"), ("2", "Нет"), ("3", "?"), *((str(k), "Да") for k in range(10, 22))], [("1.0", "Да"), ("2", "Да"), ("3", "Да"), ("99", "НД")])
    text = quality.summary(p)
    assert "Matched records: 2 / 15" in text and "  Да: F1=0.67 (P=0.50, R=1.00, support=1)" in text and "… (+2)" in text and "Unknown in predictions: 99" in text and text.endswith("Unknown statuses: 1")
    gates = {r.gate: (r.value, r.passed) for r in quality.missed_gates(quality.quality(p), {"accuracy": 0.5, "macro_f1": 0.9}).collect()}
    assert gates["accuracy"] == (0.5, True) and not gates["macro_f1"][1]


def test_evaluation_flow(spark):
    from lodestone.plans import flows

    gold = spark.createDataFrame([("1", "Да"), ("2", "Нет")], "id string, status string")
    totals, classes, grid, text = flows.evaluate_quality(gold, spark.createDataFrame([("1", "Да"), ("2", "Да")], "id string, status string"))
    assert totals.first().accuracy == 0.5 and classes.count() == 4 and grid.count() == 16 and "Accuracy: 0.500" in text


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(r.v for r in quality.last_wins(rows, "k", "n").collect()) == ["y", "z"]


def test_retrieval(spark):
    golden = spark.createDataFrame([(1, ["A.pdf"], ["needle"]), (2, ["b"], []), (3, [], ["x", "y"])], "query_id long, expected_sources array<string>, expected_substrings array<string>")
    hits = spark.createDataFrame([(1, 1, "z", "no"), (1, 2, "a.PDF", "the NEEDLE"), (2, 1, "b", "t"), (3, 1, "c", "just X"), (3, 3, "c", "y")], "query_id long, rank int, source string, text string")
    r = quality.retrieval(quality.hit_ranks(golden, hits, 2)).first()
    assert (r.questions, r.hits, r.hit_rate, r.mrr) == (3, 2, round(2 / 3, 6), 0.5)
    assert {x.query_id: x.recall for x in quality.context_recall(golden, hits, 2).collect()} == {1: 1.0, 2: 1.0, 3: 0.5}
    none = quality.retrieval(quality.hit_ranks(golden.limit(0), hits)).first()
    assert (none.questions, none.hit_rate, none.mrr) == (0, 0.0, 0.0)
