import pytest
from pyspark.sql import functions as F

from lodestone.operators import sections


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_split(spark):
    text = "вступление\n# T\nбелый\n7.3.6 Заголовок\nтело\nраздел 4.2 Ещё\nx\n НАСТРОЙКА SSO\nконец"
    assert one(spark, text, sections.split_sections("t")) == ["вступление", "# T\nбелый", "7.3.6 Заголовок\nтело", "раздел 4.2 Ещё\nx", "НАСТРОЙКА SSO\nконец"]
    assert one(spark, "just text", sections.split_sections("t")) == ["just text"]
    assert one(spark, " \n ", sections.split_sections("t")) == [] and one(spark, None, sections.split_sections("t")) == []


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 4, 1), (1, 4, 1), (4, 4, 1), (5, 4, 1), (7, 4, 1), (8, 4, 3), (20, 5, 0), (3, 5, 4)])
def test_windows(spark, n, size, overlap):
    words = [str(k) for k in range(n)]
    want, at = [], 0
    while at < n:
        want.append(" ".join(words[at : at + size]))
        if at + size >= n:
            break
        at += size - overlap
    got = spark.createDataFrame([(words,)], "w array<string>").select(sections.windows("w", size, overlap).alias("x")).first().x
    assert got == want


def test_headings(spark):
    h = lambda t: tuple(one(spark, t, sections.heading("t")))
    assert h("## 7.3.6. Настройка  SSO..\nтекст") == ("7.3.6", "Настройка SSO")
    assert h("текст\nраздел 4.2 название") == ("4.2", "название")
    assert h("SECTION 1 x") == ("1", "x") and h("none") == (None, None)
    assert h("Раздел 9 a\n1.2 Title") == ("1.2", "Title")


def chunks(spark, rows):
    return spark.createDataFrame(rows, "source string, chunk_idx int, page_number int, number string, title string")


def test_propagation(spark):
    rows = chunks(spark, [("d-1.md", 0, 1, None, None), ("d-1.md", 1, 2, "1", "A"), ("d-1.md", 2, 3, None, None), ("d-1.md", 3, 9, None, None), ("d-1.md", 4, 8, None, None), ("d-1.md", 5, 10, "2", "B"), ("e.md", 0, 1, None, None)])
    got = sections.propagate(rows).orderBy("source", "chunk_idx").collect()
    assert [r.state for r in got] == ["unassigned", "heading", "inherited", "stale", "stale", "heading", "unassigned"]
    assert [(r.section_number, r.section_title) for r in got][:4] == [("document", "d 1"), ("1", "A"), ("1", "A"), ("document", "d 1")]
    s = sections.section_stats(sections.propagate(rows)).first()
    assert (s.chunks, s.headings, s.inherited, s.stale, s.unassigned, s.fallback) == (7, 2, 1, 2, 2, 4)
    assert [r.state for r in sections.propagate(rows, -1).orderBy("source", "chunk_idx").collect()][3] == "inherited"
    assert [r.state for r in sections.propagate(rows, enabled=False).orderBy("source", "chunk_idx").collect()][0] == "none"


def test_chunk_bounds(spark):
    pages = spark.createDataFrame([("a", 1, "x")], "source string, page_number int, text string")
    for size, overlap in ((100, 10), (800, 10), (512, 512), (512, -1)):
        with pytest.raises(ValueError):
            sections.chunk(pages, size, overlap)


def test_products(spark):
    p = spark.createDataFrame([("sip", "A"), ("sip_trunk", "B")], "prefix string, product string")
    s = spark.createDataFrame([("SIP_trunk.pdf",), ("sip.md",), ("other",)], "source string")
    assert {r.source: r["product"] for r in sections.infer_product(s, p).collect()} == {"SIP_trunk.pdf": "B", "sip.md": "A", "other": "unknown"}


def test_coverage(spark):
    base = sections.metadata(sections.propagate(chunks(spark, [("a.md", 0, 0, None, None), ("a.md", 1, 2, "1", "T")]).withColumn("text", F.lit("x"))).withColumn("product", F.lit(None).cast("string")))
    assert [r.page_number for r in base.orderBy("chunk_idx").collect()] == [1, 2]
    assert sections.coverage(base).first().coverage == 0.0
    assert sections.coverage(base.withColumn("product", F.lit("p"))).first().coverage == 1.0
    assert sections.coverage(base.limit(0)).first().coverage == 0.0


def test_registry(spark):
    old = spark.createDataFrame([("a", "2.0", "h", "d0", "Indexed", "full"), ("b", "1.0", "h", "d0", "Indexed", "")], "filename string, version string, sha256_hash string, indexed_date string, status string, coverage string")
    new = spark.createDataFrame([("a", "n"), ("c", "n")], "filename string, sha256_hash string")
    got = {r.filename: tuple(r)[1:] for r in sections.upsert_registry(old, new, "d1").collect()}
    assert got == {"a": ("2.0", "n", "d1", "Indexed", "full"), "b": ("1.0", "h", "d0", "Indexed", ""), "c": ("1.0", "n", "d1", "Indexed", "")}


def test_parent_ids(spark):
    r = spark.sql("SELECT 's' s, '1' n, 'T' t, '' e").select(sections.parent_id(F.col("s"), F.col("n"), F.col("t")).alias("a"), sections.parent_id(F.col("s"), F.col("e"), F.col("e")).alias("b")).first()
    assert (r.a, r.b) == ("s::1::T", "s::document")
