import pytest

from lodestone.llm.line_dedup import drop_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=2):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(line.strip(BLANKS).translate(LOWER), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(BLANKS).translate(LOWER)) < 10 or len(held[k]) < min_docs or min(held[k]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


ROWS = [
    (1, "the same line here\nshort\nTHE SAME LINE HERE  \n"), (2, "\t the same Line here\nshort\n\nown words of two"), (3, None), (4, ""), (5, "\n\n"),
    (6, "größe über alles ÄÖ\nx"), (7, "GRößE über alles ÄÖ\nx"), (8, "größe über alles äö"), (9, "own\x0bline is here\x0c\r\nthe same line here"), (10, "nur einmal hier und da\n" * 300 + "the same line here"),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_against_brute_force(spark, min_docs):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs, min_docs=min_docs).collect())
    assert got == brute(ROWS, min_docs)


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the same line here\nx", 7), (1, "the same line here\nx", 8), (2, "the same line here\ny", 9), (None, "the same line here", 1), (2, "z\nthe same line here", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pos long")
    out = drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "_pos", "text", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id or 0), r._pos, r.text, r.n_dropped) for r in out.collect())
    assert got == [(0, 1, "the same line here", 0), (1, 7, "the same line here\nx", 0), (1, 8, "the same line here\nx", 0), (2, 3, "z", 1), (2, 9, "y", 1)]


def test_empty(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native_plan(spark):
    plan = drop_repeated_lines(spark.createDataFrame(ROWS, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
