import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from lodestone.operators import export, quality
from lodestone.sources import formats, office, ooxml
from tests.test_sources import W, workbook


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def test_workbooks_by_sheet(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [("One", {1: {"A": "ID", "B": "Требование"}, 2: {"A": 1, "B": "x"}}), ("Two", {5: {"C": ...}})])
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / ".c.xlsx").write_bytes(b"hidden")
    df = spark.read.format("workbooks").load(str(tmp_path))
    rows = lambda df: sorted(map(str, df.drop("path").withColumn("error", F.col("error").isNotNull()).collect()))
    assert rows(df) == rows(office.read_cells(spark, str(tmp_path / "[ab]*"))) and df.rdd.getNumPartitions() == 3
    assert [(r.row, r.col, r.value) for r in df.where("sheet = 'Two'").collect()] == [(5, 3, "shared text")]
    reader = formats._Cells(str(tmp_path))
    assert list(reader.pushFilters([EqualTo(("sheet",), "Two"), EqualTo(("row",), 5)])) == [EqualTo(("row",), 5)]
    assert [p.sheet for p in reader.partitions()] == [1]  # no other sheet is read
    assert spark.read.format("workbooks").load(str(tmp_path / "b.xlsx")).where("error is not null").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("workbooks").load(str(tmp_path / "none")).count() == 0


def test_a_large_sheet_is_streamed(spark, tmp_path):
    n = 300_000
    with zipfile.ZipFile(tmp_path / "big.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r0"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r0" Target="worksheets/s0.xml"/></Relationships>')
        with z.open("xl/worksheets/s0.xml", "w") as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for k in range(1, n + 1):
                f.write(b'<row r="%d"><c r="A%d"><v>%d</v></c><c r="B%d" t="inlineStr"><is><t>text %d</t></is></c></row>' % (k, k, k, k, k))
            f.write(b"</sheetData></worksheet>")
    import tracemalloc

    tracemalloc.start()
    rows = sum(1 for _ in formats.cell_rows("x", str(tmp_path / "big.xlsx")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2 * n and peak < 8_000_000
    got = spark.read.format("workbooks").load(str(tmp_path)).agg(F.count("*"), F.max("row"), F.sum(F.expr("try_cast(value as long)"))).first()
    assert tuple(got) == (2 * n, n, n * (n + 1) // 2)


def test_merged_and_nested_cells(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda body, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{body}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('deep'))}</w:tr></w:tbl>"
    rows = [
        f"<w:tr>{cell(p('wide'), '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}{cell(p('tall'), '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}</w:tr>",
        f"<w:tr>{cell(p('a'))}{cell(p('b') + inner)}{cell(p(''), '<w:vMerge/>')}</w:tr>",
    ]
    style = "<w:p><w:pPr><w:pStyle w:val='X1'/></w:pPr><w:r><w:t>styled</w:t><w:noBreakHyphen/><w:t>x</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/styles.xml", f"<w:styles {W}><w:style w:styleId='X1'><w:name w:val='List Bullet'/></w:style></w:styles>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:tbl><w:tr>{cell(p('first table'))}</w:tr></w:tbl>{style}<w:tbl>{''.join(rows)}</w:tbl></w:body></w:document>")
    got = [tuple(r)[2:9] for r in spark.read.format("word_documents").load(str(tmp_path)).orderBy("ord").collect()]
    assert got == [
        ("paragraph", None, None, None, 1, True, "styled-x"), ("table", 1, 1, 1, 1, False, "first table"), ("table", 2, 1, 1, 1, False, "wide"), ("table", 2, 1, 2, 1, False, "wide"), ("table", 2, 1, 3, 1, False, "tall"),
        ("table", 2, 2, 1, 1, False, "a"), ("table", 2, 2, 2, 1, False, "b"), ("table", 21, 1, 1, 1, False, "deep"), ("table", 2, 2, 3, 1, False, "tall"),
    ]
    with zipfile.ZipFile(tmp_path / "a.docx") as z:
        assert len(list(ooxml.paragraphs(z))) == 9


def test_one_ordered_file(spark, tmp_path):
    lines = spark.range(5000).select(F.col("id").alias("position"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("строка "), F.col("id"))).alias("line")).repartition(6)
    path = formats.write_lines(lines, str(tmp_path / "out/report.txt"))
    assert open(path, encoding="utf-8").read() == "".join(f"строка {k}\n" if k % 7 else "\n" for k in range(5000))
    assert os.listdir(tmp_path / "out") == ["report.txt"]
    with pytest.raises(FileExistsError):
        formats.write_lines(lines, path)
    assert open(formats.write_lines(lines.limit(0), str(tmp_path / "empty.txt"))).read() == ""


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    lines = spark.range(100).select((F.col("id") * 2).alias("at"), F.when(F.col("id") < 60, F.lit("x")).otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("line")).repartition(3, "at")
    with pytest.raises(Exception, match="lost"):
        lines.write.format("report_file").option("size", 200).mode("append").save(str(tmp_path / "r.txt"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="of 7 bytes"):
        spark.createDataFrame([(0, "x")], "at long, line string").write.format("report_file").option("size", 7).mode("append").save(str(tmp_path / "r.txt"))
    assert os.listdir(tmp_path) == []


def test_evaluation_reports(spark, tmp_path):
    import csv
    import json

    gold = spark.createDataFrame([("1", "Да"), ("2", "Нет"), ("3", "НД"), ('4"', "Да"), ("5", "Нет")], "id string, status string")
    said = spark.createDataFrame([("1", "Да"), ("2", "Да"), ("3", "НД"), ("9", "Да")], "id string, status string")
    pairs = quality.matched(gold, said)
    formats.write_lines(quality.csv_report(pairs), str(tmp_path / "r.csv"), ["section", "position"])
    rows = list(csv.reader(open(tmp_path / "r.csv", newline="", encoding="utf-8")))
    assert rows[0] == ["label", "support", "tp", "fp", "fn", "precision", "recall", "f1"] and rows[1] == ["Да", "1", "1", "1", "0", "0.5000", "1.0000", "0.6667"]
    assert rows[5:] == [[], ["macro_f1", "0.4167"], ["accuracy", "0.6667"], ["matched", "3"], ["gold_total", "5"], ["pred_total", "4"]]
    formats.write_lines(quality.json_report(pairs), str(tmp_path / "r.json"), ["section", "position", "id"])
    report = json.load(open(tmp_path / "r.json", encoding="utf-8"))
    assert report["missing_in_pred"] == ['4"', "5"] and report["extra_in_pred"] == ["9"] and report["macro_f1"] == 0.4167 and report["per_class"]["НД"]["f1"] == 1.0 and report["pred_total"] == 4
    one = spark.createDataFrame([(5, 0.5, "mail a@b.org", None, ["c@d.org"])], "questions long, mrr double, note string, none string, more array<string>")
    formats.write_lines(quality.record_report(one), str(tmp_path / "e.json"))
    assert json.load(open(tmp_path / "e.json")) == {"questions": 5, "mrr": 0.5, "note": "mail [EMAIL]", "none": None, "more": ["[EMAIL]"]}


def test_markdown_as_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "r", "b|c", "Да", "x", 0.5, "run"), (1, "r", "a", "Нет", "y", 0.25, "run")], "id long, ref string, source_text string, status string, comment string, confidence double, run_id string")
    path = export.write_report(rows, "run", "2026", str(tmp_path / "r.md"), source_file="in/a.xlsx", one_file=True)
    want = [r.line for r in export.markdown_report(rows, "run", "2026", "in/a.xlsx").orderBy("position").collect()]
    assert open(path, encoding="utf-8").read().splitlines() == want
