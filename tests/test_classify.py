import json

import pytest

from pyspark.sql import functions as F

from lodestone.operators import classify, export
from lodestone.plans import flows

CHUNKS = "query_id long, text string, chunks array<struct<source:string,page:string,text:string,score:double>>"


def test_gate(spark):
    c = lambda *scores: [("s", "1", "t", x) for x in scores]
    df = spark.createDataFrame([(1, "r", []), (2, "r", c(0.0328)), (3, "r", c(0.3, 0.1)), (4, "r", c(None)), (5, "r", None)], CHUNKS)
    got = {r.query_id: r.gate for r in classify.gate(df).collect()}
    assert got == {1: "empty_context", 2: "low_score(max=0.033 < 0.300)", 3: None, 4: None, 5: "empty_context"}
    assert {r.gate for r in classify.gate(df, enabled=False).collect()} == {None}


def good(**more):
    return json.dumps({"classification": "Да", "confidence": 0.5, "reasoning": "r", "citations": [{"source": "a"}]} | more, ensure_ascii=False)


def test_validation(spark):
    cases = {
        "ok": good(), "prose": f"Ответ: {good()} всё", "broken": "{", "none": None, "class": good(classification="x"), "reason": good(reasoning=" "), "confidence": good(confidence=1.2), "text": good(confidence="much"),
        "cited": good(citations=[]), "nd": good(classification="НД", citations=[]), "source": good(citations=[{"source": " "}]), "review": good(confidence=0.9, requires_ba_review=True),
    }
    got = {r.k: r for r in classify.validate(spark.createDataFrame(list(cases.items()), "k string, raw string")).collect()}
    assert {k: r.violations for k, r in got.items()} == {
        "ok": [], "prose": [], "broken": ["invalid_json"], "none": ["invalid_json"], "class": ["invalid_classification"], "reason": ["empty_reasoning"], "confidence": ["invalid_confidence"], "text": ["invalid_confidence"],
        "cited": ["no_citations"], "nd": [], "source": ["citation_without_source"], "review": [],
    }
    assert got["ok"].payload.requires_ba_review and got["review"].payload.requires_ba_review and got["class"].payload is None


def test_reflection(spark):
    rows = [('{"sufficient": true, "follow_up": " ", "confidence": 0.8}',), ('{"sufficient": "true", "confidence": 0.8}',), ('{"sufficient": false, "follow_up": "x", "confidence": 2}',), ("no",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(classify.validate_reflection("t").alias("x")).collect()]
    assert tuple(got[0]) == (True, None, 0.8) and got[1:] == [None, None, None]


def test_providers(spark):
    rows = spark.createDataFrame([(1, "mail a@b.ru", [("s", "1", "x", 1.0)]), (2, " ", [("s", "1", "x", 1.0)]), (3, "r", []), (4, "boom", [("s", "", "x", 1.0)])], CHUNKS)

    def first(system, user):
        assert "a@b.ru" not in user
        if "boom" in user:
            raise TimeoutError("slow")
        return "nothing"

    def second(system, user):
        if "boom" in user:
            raise ValueError("bad")
        return good(confidence=0.8)

    out = classify.classify(classify.gate(rows), {"first": first, "second": second}, ["absent", "first", "second"], retries=2)
    got = {r.query_id: r for r in out.collect()}
    assert {k: (r.status, r.provider) for k, r in got.items()} == {1: ("Да", "second"), 2: ("Ошибка", "none"), 3: ("НД", "strict_mode"), 4: ("Ошибка", "none")}
    assert "slow" in got[4].error and "bad" in got[4].error and got[4].requires_ba_review
    s = classify.pipeline_stats(out).first()
    assert (s.total, s.success, s.errors, s.nd, s.by_provider) == (4, 2, 2, 1, {"second": 1, "none": 2, "strict_mode": 1})
    assert classify.pipeline_stats(out.limit(0)).first().total == 0


def test_prompt(spark):
    df = spark.createDataFrame([(1, "need", [("a.md", "3", " body ", 1.0), (None, "", "b", 1.0)])], CHUNKS)
    assert df.select(classify.context_text("chunks").alias("x")).first().x == "[a.md — 3]\nbody\n\n[unknown]\nb"
    assert df.select(classify.user_message(F.col("text"), F.lit("c"), F.lit("")).alias("x")).first().x == "<requirement>need</requirement>\n<context>\nc\n</context>\nRespond with the JSON object only."


def test_retry(spark):
    rows = spark.createDataFrame([("s", 2, "Ошибка", "e", 0.0, "r"), ("s", 3, "Да", "c", 0.5, "r"), ("t", 2, "Ошибка", "e", 0.0, "r")], "sheet string, row int, status string, comment string, confidence double, run_id string")
    got = flows.retry(rows, lambda bad: bad.where("sheet = 's'").withColumns({"status": F.lit("Нет"), "comment": F.lit("new")})).orderBy("sheet", "row").collect()
    assert [(r.status, r.comment) for r in got] == [("Нет", "new"), ("Да", "c"), ("Ошибка", "e")]


def test_export_rows(spark):
    rows = spark.createDataFrame([(1, "t|x\ny", None, "a*b\\", 0.125, None), (2, "t", None, None, None, "down"), (3, "t", "Да", "c", 1.005, "x")], "id long, text string, status string, comment string, confidence double, error string")
    run = "6f1c2b1e-3a4d-4c55-9a77-0b5c9f1e2d3a"
    out = export.rows(rows, run)
    got = {r.id: r for r in out.collect()}
    assert [(got[k].status, got[k].comment, got[k].confidence) for k in (1, 2, 3)] == [("НД", "a*b\\", 0.12), ("Ошибка", "Ошибка обработки: down", 0.0), ("Да", "c", 1.0)]
    assert {r.id: r.line for r in export.markdown_rows(out).collect()}[1] == f"| 1 |  | t\\|x<br>y | НД | a\\*b\\\\ | 0.12 | {run} |"
    assert {tuple(r.violations) for r in export.violations(out).collect()} == {()}
    assert {tuple(r.violations) for r in export.violations(export.rows(rows, "x")).collect()} == {("run_id",)}
    assert {r.schema_version for r in export.assert_one_run(out).collect()} == {"1.0"}


def test_locators(spark):
    cases = ['{"type": "cell", "sheet_name": "Л\\"1", "row": 3, "column": "A"}', '{"type": "paragraph", "index": 4, "fragment": 2, "list_path": ["paragraph:4", "item:a"]}', '{"type": "paragraph"}', '{"type": "table", "table": 0, "row": 1, "col": 2}', None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, j string").select("k", export.ref_text(F.from_json("j", export.LOCATOR)).alias("x"))
    assert [r.x for r in df.orderBy("k").collect()] == ['sheet="Л\\"1", row=3, col="A"', 'paragraph=4, fragment=2, list_path="paragraph:4/item:a"', "paragraph", "table=0, row=1, col=2", ""]
    other = spark.sql("SELECT from_json('{\"type\": \"page\", \"row\": 3, \"column\": \"x\"}', '" + export.LOCATOR + "') AS l").select(export.ref_text(F.col("l")).alias("x"))
    assert other.first().x == 'column="x", row=3, type="page"'


def test_rows_that_are_export_rows_already(spark):
    rows = spark.createDataFrame([(1, "Да", "c", "0.555", ""), (2, "?", None, None, "r2")], ["id", *export.RESULT_COLUMNS])
    got = [tuple(r) for r in export.passed_through(rows, "run").orderBy("id").collect()]
    assert got == [(1, "", "", "Да", "c", 0.56, "run"), (2, "", "", "?", "", 0.0, "r2")]
    with pytest.raises(ValueError):
        export.passed_through(rows.drop("[RunID]"), "run")


def test_rows_without_a_sheet_go_by_id_where_there_is_one_sheet(spark):
    source = spark.createDataFrame([("L", 0), ("L", 1)], "sheet string, row_idx int")
    rows = spark.createDataFrame([(None, None, 1, 2, "Да", "a", 0.5), ("L", 3, 2, 1, "Нет", "b", 0.1), ("", None, 3, 2, "НД", "c", 0.2)], "sheet string, row int, ord int, id int, status string, comment string, confidence double")
    assert [(r.row_idx, r.status) for r in export.merge_into_source(source, rows, "r").orderBy("row_idx").collect()] == [(0, ""), (1, "НД")]
    two = source.unionByName(spark.createDataFrame([("M", 0)], "sheet string, row_idx int"))
    assert [(r.sheet, r.row_idx, r.status) for r in export.merge_into_source(two, rows, "r").orderBy("sheet", "row_idx").collect()] == [("L", 0, ""), ("L", 1, "Нет"), ("M", 0, "")]


def test_reports(spark, tmp_path):
    run = "6f1c2b1e-3a4d-4c55-9a77-0b5c9f1e2d3a"
    rows = export.rows(spark.createDataFrame([(k, f"t{k}", "Да", "c", 0.5, None) for k in range(20, 0, -1)], "id long, text string, status string, comment string, confidence double, error string").repartition(4), run)
    path = export.write_report(rows, run, "2026-01-02", output_dir=str(tmp_path), source_file="in/tz.xlsx")
    assert path == f"{tmp_path}/tz_report_6f1c2b1e.md"
    lines = [line for f in sorted(__import__("pathlib").Path(path).glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "---" and "# Результат анализа ТЗ — tz.xlsx" in lines and [line.split(" | ")[0] for line in lines[11:]] == [f"| {k}" for k in range(1, 21)]
    for kind in ("csv", "json"):
        out = export.write_report(rows, run, output_file=str(tmp_path / f"r.{kind}"))
        got = (spark.read.option("header", "true").csv if kind == "csv" else spark.read.json)(out)
        assert got.count() == 20 and set(got.columns) == set(export.REPORT_COLUMNS)
    assert export.report_format(None, "x.CSV") == "csv" and export.report_format(".MD") == "md" and export.report_format() == "md"
    for wrong in ({"output_format": "xlsx"}, {"output_mode": "append_to_original"}):
        with pytest.raises(ValueError):
            export.write_report(rows, run, **wrong)


def test_error_reports(spark):
    rows = spark.createDataFrame([("r", "ask a@b.ru", "p", "HTTPError", "401 for a@b.ru"), ("r", "ask a@b.ru", "q", "Timeout", "timeout")], "run_id string, query string, provider string, error_type string, message string")
    row = export.error_report(rows, 3, "now").first()
    assert row.reason.endswith("(2 из 3)") and row.recommendation == "auth" and "a@b.ru" not in row.text and "- provider=p type=HTTPError message=401 for [EMAIL]" in row.text


def test_references(spark):
    df = spark.createDataFrame([("x", 0, 0, 0, 0), ("table_cell_list", 0, -1, None, 0), ("paragraph", None, None, None, None)], "type string, `table` int, row int, col int, paragraph int")
    got = [r.v for r in df.select(export.ref_violations(F.struct("*")).alias("v")).collect()]
    assert got == [["type"], ["negative_row", "cell_without_coordinates"], ["no_paragraph"]]


def test_error_classes(spark):
    df = spark.createDataFrame([("HTTP 401",), ("Connection reset",), ("400 bad",), (None,)], "t string").select(export.recommendation("t").alias("x"))
    assert [r.x for r in df.collect()] == ["auth", "network", "request", "default"]
