import json
import zipfile

import pytest

from lodestone.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {S} {R}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>shared</t><r><t> text</t></r></si></sst>")
        for k, (_, rows) in enumerate(sheets):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{r}" t="s"><v>0</v></c>' if v is ... else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in row.items()) + "</row>" for r, row in rows.items())
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [("Лист1", {1: {"A": "ID", "B": "Требование"}, 2: {"A": 1, "B": " первое требование "}, 3: {"A": 2, "B": ...}, 4: {"A": 3, "B": "мал"}}), ("Б", {1: {"A": "n", "C": "Прочее"}, 2: {"A": 7, "C": "самое длинное описание"}})])
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    cells = office.read_cells(spark, str(tmp_path))
    assert [r.path[-6:] for r in cells.where("error is not null").collect()] == ["b.xlsx"]
    got = [(r.id, r.text, r.locator.sheet_name, r.locator.row, r.locator.column) for r in office.requirements_of_cells(cells).orderBy("id").collect()]
    assert got == [(1, "первое требование", "Лист1", 2, "Требование"), (2, "shared text", "Лист1", 3, "Требование"), (3, "самое длинное описание", "Б", 2, "Прочее")]
    assert {(r.sheet_no, r.by) for r in office.detect_columns(cells).collect() if r.sheet_no is not None} == {(0, "name"), (1, "profile")}


def test_documents(spark, tmp_path):
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    inner = f"<w:tbl><w:tr><w:tc>{p('вложенная ячейка')}</w:tc></w:tr></w:tbl>"
    body = f"<w:tbl><w:tr><w:tc>{p('1. ячейка таблицы')}{inner}</w:tc></w:tr></w:tbl>{p('абзац текста (без комментария БА)')}{p('---')}{p('пункт списка', 'List Paragraph')}{p('мал')}<w:p><w:r><w:t>строка раз</w:t><w:br/><w:t>- строка два</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"x")
    rows = office.read_paragraphs(spark, str(tmp_path))
    got = [(r.id, r.text, r.locator.type, r.locator.list_path) for r in office.requirements_of_paragraphs(rows).orderBy("id").collect()]
    assert got == [
        (1, "абзац текста", "paragraph", None), (2, "пункт списка", "paragraph", ["paragraph:3", "item:1"]), (3, "строка раз", "paragraph", None), (4, "строка два", "paragraph", ["paragraph:5", "fragment:2", "item:-"]),
        (5, "ячейка таблицы", "table", ["table:1", "row:1", "col:1", "paragraph:1", "item:1"]), (6, "вложенная ячейка", "table", None),
    ]
    assert rows.where("error is not null").count() == 1


def test_uploads(spark):
    df = spark.createDataFrame([("a.XLSX", 5), ("b.pdf", 5), ("c.docx", 11 * 2**20)], "path string, length long")
    assert [r.path for r in office.accepted(df).collect()] == ["a.XLSX"]


def test_folder_and_registry(spark, tmp_path):
    (tmp_path / "kb/sub").mkdir(parents=True)
    (tmp_path / "kb/a b.md").write_text("# T\nтекст", "utf-8")
    (tmp_path / "kb/sub/c.txt").write_text("x")
    (tmp_path / "kb/.hidden.md").write_text("x")
    (tmp_path / "kb/d.pdf").write_text("x")
    (tmp_path / "r.csv").write_text("filename,version,sha256_hash,indexed_date,status,coverage\na b.md,1,h,d,Indexed,full\na b.md,2,h,d,Indexed,full\n")
    got = {r.source: (r.text, r.version) for r in files.with_registry(files.read_folder(spark, str(tmp_path / "kb")), files.read_registry(spark, str(tmp_path / "r.csv"))).collect()}
    assert got == {"a b.md": ("# T\nтекст", "2"), "c.txt": ("x", None)}


def test_folder_with_broken_files(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"ab\xff\xfe\xd1cd")
    (tmp_path / "mark.txt").write_bytes("a\ufffdb".encode())
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "d.json").write_text('{"б": [1,{"a":null}]}', "utf-8")
    (tmp_path / "e.json").write_text("{no")
    got = {r.source: (r.text, r.valid) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"bad.txt": ("abcd", False), "mark.txt": ("a\ufffdb", True), "d.json": ('{\n  "б": [\n    1,\n    {\n      "a": null\n    }\n  ]\n}', True)}


def test_readers_by_extension(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [("Л", {1: {"A": "Требование"}, 2: {"A": "первое требование"}})])
    assert [r.text for r in office.read_requirements(spark, str(tmp_path / "a.xlsx")).collect()] == ["первое требование"]
    workbook(tmp_path / "none.xlsx", [("Л", {1: {"A": "Требование"}})])
    with pytest.raises(ValueError):
        office.read_requirements(spark, str(tmp_path / "none.xlsx"))
    with pytest.raises(NotImplementedError):
        office.read_requirements(spark, "a.pdf")


def test_synthetic_requirements(spark):
    assert [r.id for r in files.synthetic_requirements(spark, 3).collect()] == [1, 2, 3]


def test_golden_sets(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": "X", "question": "q", "expected_sources": ["s"], "expected_substrings": ["n"], "subset": "smoke"}, {"query": "second"}, {"question": " "}]}))
    (tmp_path / "g.jsonl").write_text('{"query": "a", "expected_pages": [3]}\n\n{"query": "b"}\n')
    got = {r.query_id: r for r in files.read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert set(got) == {"X", "JSON-002"} and got["X"].expected_sources == ["s"] and got["JSON-002"].expected_substrings == []
    assert files.subset(files.read_golden(spark, str(tmp_path / "g.json")), "smoke").count() == 1
    assert sorted((r.query_id, r.expected_pages) for r in files.read_golden(spark, str(tmp_path / "g.jsonl")).collect()) == [("JSONL-001", [3]), ("JSONL-003", [])]


def test_predictions(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"ID": 1, "Статус": "Да"}, {"[Статус]": "Нет"}]}, ensure_ascii=False), "utf-8")
    (tmp_path / "q.json").write_text(json.dumps([{"status": "a"}, {"classification": "b"}]))
    assert sorted((r.id, r.status) for r in files.read_predictions(spark, str(tmp_path / "p.json")).collect()) == [("1", "Да")]
    assert sorted((r.id, r.status) for r in files.read_predictions(spark, str(tmp_path / "q.json")).collect()) == [("1", "a"), ("2", "b")]
    assert files.pick_column(["ID", "Статус"], ["id", "ID"]) == "ID" and files.pick_column(["iD"], ["x", "ID"]) == "iD" and files.pick_column([], ["x"]) is None


def test_predictions_in_a_workbook(spark, tmp_path):
    workbook(tmp_path / "p.xlsx", [("A", {1: {"A": "Номер", "B": "статус"}, 2: {"A": 1, "B": " Да "}, 3: {"A": 7}}), ("B", {1: {"A": "status"}, 2: {"A": "no"}})])
    got = files.predictions_of_cells(office.read_cells(spark, str(tmp_path / "p.xlsx")))
    assert [(r.id, r.status) for r in got.orderBy("ord").collect()] == [("1", "Да"), ("7", "")]
    workbook(tmp_path / "q.xlsx", [("A", {1: {"A": "x", "B": "status"}, 2: {"A": 5, "B": "Да"}, 3: {"B": "Нет"}})])
    assert [(r.id, r.status) for r in files.predictions_of_cells(office.read_cells(spark, str(tmp_path / "q.xlsx"))).orderBy("ord").collect()] == [("1", "Да"), ("2", "Нет")]
    workbook(tmp_path / "r.xlsx", [("A", {1: {"A": "x"}, 2: {"A": 5}})])
    with pytest.raises(ValueError):
        files.predictions_of_cells(office.read_cells(spark, str(tmp_path / "r.xlsx")))


def test_prompts(spark, tmp_path):
    (tmp_path / "system_v1.0.txt").write_text("plain")
    (tmp_path / "system_v2.md").write_text("second\n")
    (tmp_path / "system_v2.txt").write_text("not this")
    (tmp_path / "shots_v1.0.json").write_text("[]")
    assert files.read_prompt(spark, str(tmp_path), "system")[0] == "plain"
    text, sha = files.read_prompt(spark, str(tmp_path), "system", "v2")
    assert text == "second\n" and sha == __import__("hashlib").sha256(b"second\n").hexdigest()
    assert files.read_prompt(spark, str(tmp_path), "shots", extensions=("json",))[0] == "[]"
    with pytest.raises(FileNotFoundError):
        files.read_prompt(spark, str(tmp_path), "none")


def test_gold_set(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": 1, "requirement": "r", "expected_status": "Да"}, {"ID": "2", "status": "Нет"}], ensure_ascii=False), "utf-8")
    got = files.read_gold_standard(spark, str(tmp_path / "g.json"))
    assert [(r.ord, r.id, r.requirement, r.status) for r in got.orderBy("ord").collect()] == [(1, "1", "r", "Да"), (2, "2", None, "Нет")]
    with pytest.raises(ValueError):
        files.demanded(got.limit(0), "items")
