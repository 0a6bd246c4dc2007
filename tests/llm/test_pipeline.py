"""The chain of stages against brute-force versions of each, on a small folder of tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import tokens
from tests.llm.test_decontam import brute as leaks_of
from tests.llm.test_line_dedup import brute as lines_of
from tests.llm.test_near_dedup import classes_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    vocabulary = ["".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(2, 8))) for _ in range(700)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(30)) for k in range(5)]
    rows, labels = [], []
    for k in range(240):
        lines = [some(rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
        toxic = int(k % 6 == 0)
        if toxic:
            lines[0] = f"zorkish {lines[0]} frumpen blimf {some(2)} zorkish"
        if k % 9 == 1:
            lines.append("This line is in many documents of the corpus")
        if k % 10 == 3:
            lines.append(items[k % 5][1])
        if k % 12 == 5:  # a copy, edited in a word, of a document some way before it
            words = rows[k - 4][1].split(" ") if k > 4 else lines
            words[0] = "edited"
            lines = [" ".join(words)]
        rows.append((k, "\n".join(lines), "en", f"src{k % 3}", 0))
        labels.append((k, 1, toxic))
    rows += [(240, None, "en", "x", 0), (241, "", "en", "x", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {k for k, _, t in labels if t}, items


def check_packing(packed, texts):
    """Every piece has the library's ids, and sequences are filled without gaps, as few as the ids allow."""
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for d, t in texts.items()}
    assert set(packed.doc_id) == set(want)
    for r in packed.itertuples():
        part = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.start == 4096 * r.piece and len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part)
    assert packed.groupby("doc_id").length.sum().to_dict() == {d: len(x) // 4 for d, x in want.items()}
    for _, seq in packed.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length.to_numpy())[:-1].tolist()] and seq.length.sum() <= 4096
    assert packed.sequence_id.nunique() == -(-packed.length.sum() // 4096)


def write(spark, path, rows, columns="doc_id long, text string, lang string, source string, n_chars long", labels=(), items=()):
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, str(tmp_path / "e"), [])).count() == 0


def test_repeated_rows_null_ids_very_long_texts_and_clashing_columns(spark, tmp_path):
    """Equal rows stay as long as no stage takes their document; rows without an id pass every stage; other columns do not reach the stages."""
    long = " ".join(f"w{k}" for k in range(30_000))
    leak = "an item of the benchmark that some document holds word for word as it is"
    rows = [(1, "alpha beta gamma\nown line of one", "en", "s", 1, "x", 9), (1, "alpha beta gamma\nown line of one", "en", "s", 1, "x", 9), (2, long, "en", "s", 1, "x", 9), (3, long + " end", "en", "s", 1, "x", 9)]
    rows += [(4, f"before {leak} after", "en", "s", 1, "x", 9), (None, f"before {leak} after", "en", "s", 1, "x", 9), (5, None, None, None, None, None, None), (6, "", "en", "s", 1, "x", 9)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, piece string, length long"
    got = corpus_pipeline.run(spark, write(spark, str(tmp_path / "r"), rows, columns, items=[(7, leak)])).toPandas()
    assert sorted(got.doc_id.dropna().astype(int).unique().tolist()) == [1, 2, 5, 6] and got.doc_id.isna().sum() == 1
    assert (got.doc_id == 1).sum() == 2 and got[got.doc_id == 2].length.sum() > 30_000 and got[got.doc_id == 5].length.tolist() == [1]


def test_stages(spark, folder, tmp_path):
    path, toxic, items = folder
    steps, docs = [], spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs)
        if k < len(names) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    one, two, three, four = ({r.doc_id: r.text for r in s.collect()} for s in steps[:4])
    assert set(one) == set(before) - toxic
    assert two == {d: t for d, t, _, _ in lines_of(list(one.items()))}
    rows = sorted(two.items())
    classes = classes_of([(d, t) for d, t in rows if t])
    assert set(three) == {d for d, _ in rows if classes.get(d, d) == d} and len(three) < len(two)
    assert set(four) == set(three) - {d for d, _ in leaks_of(sorted(three.items()), items)} and len(four) < len(three)
    packed = steps[4].toPandas()
    check_packing(packed, four)
    again = corpus_pipeline.run(spark, path).toPandas()
    keys = ["doc_id", "piece"]
    assert again.sort_values(keys).ids_crc32.tolist() == packed.sort_values(keys).ids_crc32.tolist()
