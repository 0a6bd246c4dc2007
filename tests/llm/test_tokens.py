import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, tokens
from lodestone.llm.scratch import Scratch

ODD = [
    None, "", "   ", "Hello, World. it's ΟΔΟΣ İstanbul J̌x éa", "a<|endoftext|>b <|startoftext|>", "...,,, ..word. 3.14 can't I'LL",
    "naïve Straße — “quote” x" * 3, " non breaking​zero", "x" * 500, "日本語 テキスト 42", "ab\u0000c 😀 😀😀", "word," * 50,
]


@functools.cache
def _library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return _library()


def packed(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_pieces_give_the_ids_of_whole_texts(library):
    known = tokens.PieceIds(tokens.VOCABULARY)
    texts = [t.encode("utf-8", "replace").decode() if t else t for t in ODD]
    for _ in range(2):
        known.learn({p for t in texts if t for p in known.pieces(t)})
        assert [known.ids(t) for t in texts] == [packed(library, t, 0)[:-4] for t in texts]


def test_files_hold_every_document_in_order_and_read_back(spark, library):
    rows = [(k * 7 % 23, f"Text number {k} of the corpus, it's {'long ' * (k % 5)}", k) for k in range(23)] + [(None, "no id", 1), (30, None, 2), (31, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    root = Scratch(spark, "t").path("ids")
    manifest = tokens.write_token_files(docs, root, end_id=2, files=4)
    got = tokens.read_token_files(spark, root, manifest).collect()
    at = 0
    for r, (doc_id, text, _) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        want = packed(library, text, 2)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, at, len(want) // 4, want)
        at += len(want) // 4


def test_no_documents_no_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    root = Scratch(spark, "t").path("ids")
    assert tokens.read_token_files(spark, root, tokens.write_token_files(docs, root, 2)).count() == 0
    assert packing.pack(docs).count() == 0


def test_packing_covers_every_id_once_without_gaps(spark, library):
    rows = [(k, "word and more " * (k % 9), "x") for k in range(60)] + [(5, "same id", "x"), (None, "no id", "x"), (70, None, "x"), (71, "many words " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, capacity=32, rows_per_salt=10).toPandas()
    total = sum(len(packed(library, t, 1)) // 4 for _, t, _ in rows)
    assert got.length.sum() == total
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 32
    long = got[got.doc_id == 71].sort_values("piece")
    raw = packed(library, rows[-1][1], 1)
    assert long.ids_crc32.tolist() == [zlib.crc32(raw[a : a + 128]) for a in range(0, len(raw), 128)]
    assert got.sequence_id.nunique() == -(-total // 32)


def brute_force_bins(sizes, capacity):
    """The least number of bins, by trying every placement."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_optimal_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(2, 20, 9).tolist(), reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.plan_sequences(counts, 20)
    assert sorted((s for m, n in plan for s in m for _ in range(n)), reverse=True) == sizes
    assert all(sum(m) <= 20 for m, _ in plan)
    assert sum(n for _, n in plan) == brute_force_bins(sizes, 20)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_optimal_where_no_short_piece_is_left(seed):
    rng = np.random.default_rng(seed)
    sizes = [55, 44, 30, 26, 23, 22] if not seed else sorted(rng.integers(*[(20, 60), (15, 34), (20, 40)][seed % 3], 10).tolist(), reverse=True)
    plan = packing.plan_sequences({s: sizes.count(s) for s in sizes}, 100)
    assert sorted((s for m, n in plan for s in m for _ in range(n)), reverse=True) == sizes
    assert all(sum(m) <= 100 for m, _ in plan)
    assert sum(n for _, n in plan) == brute_force_bins(sizes, 100)


def test_control_characters_that_only_python_takes_for_white_space(library):
    known = tokens.PieceIds(tokens.VOCABULARY)
    odd = "\x1c\x1d\x1e\x1f"
    texts = [f"One{c}Two {c} three.{c}{c} É{c}É́{c},x {c}" for c in odd] + [odd, f"a{odd}b\u0085c d e f g h i j　k\x0bl\x0cm", "tail\x1f", "\x1chead"]
    for _ in range(2):
        known.learn({p for t in texts for p in known.pieces(t)})
        assert [known.ids(t) for t in texts] == [packed(library, t, 0)[:-4] for t in texts]


def test_every_character_cuts_where_the_tokenizer_cuts(library):
    known = tokens.PieceIds(tokens.VOCABULARY)
    for c in map(chr, [*range(0x250), *range(0x1680, 0x1690), *range(0x1800, 0x1810), *range(0x2000, 0x2070), 0x3000, 0xFEFF]):
        assert known.ids(f"ab{c}cd , {c}") == packed(library, f"ab{c}cd , {c}", 0)[:-4], hex(ord(c))


@pytest.mark.parametrize("text", ["EKONOMİSİ, ve İ. İstanbul'da İ", "one\x1ctwo", "क़. क़, ड़ x", "ǰ. ΐ, ẖ.", "שׁ. ﬁ, ﬀ.", "가, 각. ㄱㅏ,"])
def test_letters_that_become_marks(library, text):
    known = tokens.PieceIds(tokens.VOCABULARY)
    for _ in range(2):
        known.learn(set(known.pieces(text)))
        assert known.ids(text) == packed(library, text, 0)[:-4]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["the", "Über", "İ", "ok.", "A,", "ab.$$$", "é***", "x_y", "don't!", "'s", "'re,", "q'", "é́", "<|", "\x1d", "。", "ß.", "\u0958,"])), max_size=12), st.sampled_from([" ", "", "\n", "\u00a0"]))
def test_any_text_has_the_library_s_ids(parts, between):
    text = between.join(parts).encode("utf-8", "ignore").decode()
    known = tokens.piece_ids(tokens.VOCABULARY)
    assert known.ids(text) == packed(_library(), text, 0)[:-4]
    assert next(tokens.encoded(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]}), tokens.VOCABULARY))[1] == packed(_library(), text, 0)[:-4]


def test_bounds_and_plans_of_large_and_tight_histograms():
    assert sum(n for _, n in packing.plan_sequences({3: 6_000_000}, 4096)) == packing.least_sequences({3: 6_000_000}, 4096) == -(-6_000_000 // 1365)
    assert packing.least_sequences({60: 5, 45: 4, 10: 1}, 100) == 9 - 2
    rng = np.random.default_rng(5)
    for _ in range(6):
        sizes = []
        for _ in range(20):
            a = int(rng.integers(20, 50))
            b = int(rng.integers(20, 81 - a))
            sizes += [a, b, 100 - a - b]
        plan = packing.plan_sequences({s: sizes.count(s) for s in sizes}, 100)
        assert sum(n for _, n in plan) == 20
        assert sorted(s for m, n in plan for s in m for _ in range(n)) == sorted(sizes)


def test_pieces_of_a_very_long_text_and_many_tiny_ones_fill_sequences_without_gaps(spark, library):
    """A text of far more than 4096 tokens, 3,000 equal tiny ones, repeated rows and null ids; the columns clash with the operator's own."""
    rows = [(1, "word " * 30_000, 5)] + [(10 + k, "a b", 1) for k in range(3_000)] + [(2, "one two", 1)] * 3 + [(None, None, 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(5), rows_per_salt=100).toPandas()
    own = [len(packed(library, t, 1)) // 4 for _, t, _ in rows]
    assert got.length.sum() == sum(own) and len(got) == len(rows) - 1 + -(-own[0] // 4096)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length.to_numpy())[:-1].tolist()] and seq.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-sum(own) // 4096)
