import os

from pyspark.sql import functions as F

from lodestone.plans import builds, flows
from lodestone.sources import files


def kept(path):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, names in os.walk(path) for f in names)


def rows(df):
    return sorted((r.source, r.chunk_idx, r.section_number, r.text, r.parent_text) for r in df.collect())


def test_only_what_changed_is_built(spark, tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    for k in range(6):
        (folder / f"f{k}.md").write_text(f"1.1 Title {k}\nbody of {k}\n")
    products = spark.createDataFrame([("f", "prod")], "prefix string, product string")
    store = builds.ChunkIndex(spark, str(tmp_path / "index"), products, fanout=4)
    whole = lambda: flows.build_index(files.read_folder(spark, str(folder)).select("source", "page_number", "text"), products)
    assert store.read().count() == 0
    first, counts = store.refresh(files.read_folder(spark, str(folder)))
    assert counts == {"new": 6} and rows(store.read()) == rows(whole()) and store.read().columns == whole().columns

    before = kept(tmp_path / "index")
    again, counts = store.refresh(files.read_folder(spark, str(folder)))
    assert again.number == first.number and counts == {} and kept(tmp_path / "index") == before

    (folder / "f1.md").write_text("2.1 Other\nnew body\n")
    (folder / "f2.md").unlink()
    (folder / "f9.md").write_text("text without a heading")
    was = rows(store.read())
    version, counts = store.refresh(files.read_folder(spark, str(folder)))
    assert counts == {"new": 1, "changed": 1, "deleted": 1} and version.number == first.number + 1
    assert rows(store.read()) == rows(whole()) and rows(store.read(version=first)) == was
    new = {p for p, _ in kept(tmp_path / "index")} - {p for p, _ in before}
    built = spark.read.parquet(*sorted({os.path.dirname(p) for p in new if "/chunks/" in p}))
    assert sorted(r.source for r in built.select("source").distinct().collect()) == ["f1.md", "f9.md"]
    assert [r.source for r in store.read(["f9.md"]).collect()] == ["f9.md"]


def test_merges_keep_the_rows(spark, tmp_path):
    products = spark.createDataFrame([("x", "y")], "prefix string, product string")
    store = builds.ChunkIndex(spark, str(tmp_path / "index"), products, fanout=2)
    state = {}
    for step in range(4):
        state = {k: v for k, v in state.items() if k != f"s{step - 2}.md"} | {f"s{step}.md": f"text {step}", "all.md": f"turn {step}"}
        frame = spark.createDataFrame([(k, 1, v) for k, v in state.items()], "source string, page_number int, text string")
        store.refresh(frame.withColumn("sha256_hash", F.sha2("text", 256)))
    assert sorted((r.source, r.text) for r in store.read().collect()) == sorted(state.items())
    assert len(store.store.version().segments) <= 2
    store.store.vacuum()
    assert sorted((r.source, r.text) for r in store.read().collect()) == sorted(state.items())
