from pyspark.sql import functions as F

from lodestone.operators import atoms, dependencies


def test_dependencies(spark):
    rows = [("s", 0, "Настройка. См. раздел 7.3.6 и далее. См. также пункт 4.2. См. раздел 7.3.6"), ("s", 1, "Требуется предварительная настройка ключа; необходимо x"), ("s", 2, "текст 1.2"), ("s", 3, None), ("s", 4, "СМ. п. 1.1 " + "а" * 230 + " 9.9")]
    d = dependencies.extract(spark.createDataFrame(rows, "source string, chunk_idx int, text string"))
    got = {r.chunk_idx: r for r in d.collect()}
    assert got[0].related == ["s::7.3.6", "s::4.2"] and got[0].see_also == got[0].related and got[0].method == "regex"
    assert got[1].prerequisites[0] == "предварительная настройка ключа" and got[1].related == []
    assert (got[2].has_marker, got[2].related, got[2].method) == (False, [], "none") and not got[3].has_marker
    assert got[4].related == ["s::1.1"]
    s = dependencies.stats(d).first()
    assert (s.chunks, s.markers, s.with_related, s.coverage) == (5, 3, 2, round(2 / 3, 6))
    assert dependencies.stats(d.limit(0)).first().coverage == 1.0


def test_merge_and_store(spark):
    c = spark.createDataFrame([("s", 0, "См. раздел 1.1"), ("s", 1, "нет")], "source string, chunk_idx int, text string")
    more = spark.createDataFrame([("s", 0, ["s::2.2", "s::1.1"], ["a; b"]), ("s", 1, ["s::3.3"], [])], "source string, chunk_idx int, related array<string>, prerequisites array<string>")
    d = dependencies.extract(c, more)
    got = {r.chunk_idx: (r.related, r.method) for r in d.collect()}
    assert got == {0: (["s::1.1", "s::2.2"], "regex+model"), 1: (["s::3.3"], "model")}
    store = spark.createDataFrame([("s", 0, "old", "", "", "none", True), ("s", 1, "", "", "", "none", False), ("t", 0, "", "", "", "none", False)], "source string, chunk_idx int, related_sections string, see_also string, prerequisites string, dependency_method string, dependencies_extracted boolean")
    kept = {(r.source, r.chunk_idx): r for r in dependencies.update_store(store, d).collect()}
    assert kept["s", 0].related_sections == "old" and kept["s", 1].related_sections == "s::3.3" and not kept["t", 0].dependencies_extracted
    forced = {(r.source, r.chunk_idx): r for r in dependencies.update_store(store, d, force=True).collect()}
    assert forced["s", 0].related_sections == "s::1.1;s::2.2" and forced["s", 0].prerequisites == "a, b"


def test_atoms(spark):
    text = "Общие положения\n1.a.i Система поддерживает API.\n 1.a.ii) x\n1.a.iii Шифрование данных"
    blocks = spark.createDataFrame([(1, text), (2, "без маркеров"), (3, None), (4, "- один\n- два")], "block_id long, text string")
    got = [r for r in atoms.spans(blocks).orderBy("block_id", "span_no").collect()]
    mine = [r for r in got if r.block_id == 1]
    assert all(text[r.start : r.end] == r.text for r in mine)
    assert [r.marker for r in mine][:2] == [None, "1.a.i"] and mine[0].confidence == 0.9 and mine[1].type == "integration" and mine[-1].type == "security"
    assert [(r.marker, r.text) for r in got if r.block_id == 4] == [("-", "- один"), ("-", "- два")]
    assert [r.block_id for r in got if r.block_id in (2, 3)] == [2]


def test_a_marker_is_enough_for_the_method(spark):
    rows = spark.createDataFrame([("a", 1, "Зависит от модуля."), ("a", 2, "ничего"), ("a", 3, "см. раздел 1.2"), ("a", 4, "ничего")], "source string, chunk_idx int, text string")
    assert [r.method for r in dependencies.extract(rows).orderBy("chunk_idx").collect()] == ["regex", "none", "regex", "none"]
    more = spark.createDataFrame([("a", 1, [], []), ("a", 4, ["a::9"], [])], "source string, chunk_idx int, related array<string>, prerequisites array<string>")
    assert [r.method for r in dependencies.extract(rows, more).orderBy("chunk_idx").collect()] == ["regex+model", "none", "regex", "model"]


def test_parents(spark):
    rows = spark.createDataFrame([(1, 1, "1", None, 0.78), (1, 2, "1.a", None, 0.9), (1, 3, "2", "1", 0.9), (1, 4, "x", None, 0.9), (2, 1, "1.a.i", None, 0.9), (2, 2, None, None, 0.9)], "block_id long, span_no int, marker string, parent_marker string, confidence double")
    got = {(r.block_id, r.span_no): r for r in atoms.with_parents(rows).collect()}
    at = {k: r.atom_id for k, r in got.items()}
    assert got[1, 1].parent_id is None and got[1, 1].requires_review
    assert got[1, 2].parent_id == at[1, 1] and got[1, 3].parent_id == at[1, 1] and got[1, 4].parent_id == at[1, 3]
    assert got[2, 1].parent_id == at[1, 2] and got[2, 2].parent_id is None


def test_proposed_spans_are_checked(spark):
    blocks = spark.createDataFrame([(1, "ab cd"), (2, "ab cd")], "block_id long, text string")
    said = spark.createDataFrame([(1, 3, 5, "2)", None, "Security_requirement", 1.7), (1, 0, 2, "1.", None, "x", None), (2, 0, 4, "1", None, "x", 0.5), (2, 2, 5, "2", None, "x", 0.5)], "block_id long, start int, end int, marker string, parent_marker string, type string, confidence double")
    got = sorted((r.block_id, r.span_no, r.text, r.marker, r.type, r.confidence, r.source) for r in atoms.checked_spans(blocks, said).collect())
    assert got == [(1, 1, "ab", "1", "functional", 0.0, "model"), (1, 2, "cd", "2", "security", 1.0, "model"), (2, 1, "ab cd", None, "functional", 0.9, "heuristic")]


def test_types(spark):
    df = spark.createDataFrame([("защита через API",), ("SLA 99",), (None,), ("sip",)], "t string").select(atoms.requirement_type("t").alias("x"))
    assert [r.x for r in df.collect()] == ["security", "non-functional", "functional", "integration"]
    df = spark.createDataFrame([("NonFunctional",), ("Security_Requirement",), ("?",)], "t string").select(atoms.normal_type("t").alias("x"))
    assert [r.x for r in df.collect()] == ["non-functional", "security", "functional"]
    assert F is not None
