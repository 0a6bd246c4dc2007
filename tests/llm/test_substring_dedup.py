import random

import numpy as np

from lodestone.llm import substring_dedup as sd


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def brute(rows):
    """Chunks by the direct definition of the hash, first places by sorting, and runs."""
    where = {}
    parts = {}
    for doc, text in sorted(rows):
        raw = text.encode()
        ends, at = [], 0
        for i in range(len(raw)):
            h = sum(int(sd._GEAR[raw[i - k]]) << k for k in range(min(sd.WINDOW, i + 1))) & 0xFFFFFFFF
            cut = (h >> (sd.WINDOW - sd.CUT_BITS)) & (2**sd.CUT_BITS - 1) == 0
            if i + 1 < len(raw) and cut and raw[i + 1] & 0xC0 != 0x80 and i + 1 - at >= sd.LEAST_BYTES:
                ends.append(i + 1)
                at = i + 1
        ends.append(len(raw))
        parts[doc] = [(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a]
        for k, (a, b) in enumerate(parts[doc]):
            where.setdefault(raw[a:b], (doc, k))
    out = {}
    for doc, text in rows:
        raw, runs = text.encode(), []
        for k, (a, b) in enumerate(parts[doc]):
            if where[raw[a:b]] != (doc, k):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        at, kept = 0, b""
        for a, b in runs:
            if b - a >= sd.RUN_BYTES:
                kept += raw[at:a]
                at = b
        out[doc] = (kept + raw[at:]).decode()
    return out


def test_against_brute_force_and_shifts(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, rng.randint(1, 120))) for k in range(15)]
    rows += [(k, f"{prose(rng, rng.randint(0, 40))} {passage} {prose(rng, 20)}") for k in range(15, 25)]
    got = {r.doc_id: r for r in sd.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.text for k, r in got.items()} == brute(rows)
    assert all(got[k].n_dropped_bytes == 0 for k in range(16))
    assert all(got[k].n_dropped_bytes >= len(passage.encode()) / 2 and got[k].copy_of[0] == 15 for k in range(16, 25))


def test_cuts_are_bounded_and_split_no_character():
    rng = np.random.default_rng(1)
    for text in ("é" * 5000, "a" * 5000, "".join(chr(c) for c in rng.integers(0x400, 0x450, 5000)), "日本" * 900, "x"):
        raw = text.encode()
        ends = sd.cuts(np.frombuffer(raw, np.uint8)).tolist()
        assert ends[-1] == len(raw)
        assert max(b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)) <= sd.MOST_BYTES
        assert "".join(raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)) == text


def test_edge_cases(spark):
    long = prose(random.Random(2), 90)
    rows = [(1, long, "a"), (1, long, "b"), (2, long, "c"), (None, long, "d"), (3, None, "e"), (4, "", "f"), (5, long + " tail", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    out = sd.drop_repeated_passages(docs)
    assert out.columns == ["doc_id", "doc", "text", "n_chunks", "n_dropped_bytes", "dropped", "copy_of"]
    got = {r.doc: r for r in out.collect()}
    assert [got[k].text for k in "abd"] == [long] * 3 and got["e"].text == got["f"].text == ""
    assert got["c"].text == "" and got["c"].copy_of == [1] and got["g"].n_dropped_bytes > 300
    assert sd.drop_repeated_passages(docs.limit(0)).count() == 0


def test_rows_without_an_id_stay_whole_and_own_columns_give_way(spark):
    rng = random.Random(4)
    passage = prose(rng, 80)
    twice = f"{passage} {prose(rng, 30)} {passage} {prose(rng, 10)} {passage}"
    long = " ".join(prose(rng, 400) for _ in range(60)) + " " + passage + " " + prose(rng, 20_000)
    rows = [(None, twice, 1, "x"), (1, twice, 2, "y"), (2, long, 3, "z"), (None, None, 4, "w")]
    out = sd.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, n_chunks int, copy_of string"))
    assert out.columns == ["doc_id", "text", "n_chunks", "n_dropped_bytes", "dropped", "copy_of"]
    got = {(r.doc_id, r.text is not None and len(r.text) > 0): r for r in out.collect()}
    bare = got[None, True]
    assert bare.text == twice and bare.n_dropped_bytes == 0 and bare.dropped == [] and bare.copy_of == [] and bare.n_chunks > 10
    assert got[1, True].text.count(passage[40:-40]) == 1 and got[1, True].copy_of == []  # inside a document the first place stays
    assert got[2, True].text == brute([(1, twice), (2, long)])[2] and got[2, True].n_dropped_bytes > 300 and got[2, True].copy_of == [1]
    assert got[None, False].text == ""
