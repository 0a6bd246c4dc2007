import hashlib
import random
import zlib

import pytest

from lodestone.llm import prefix_trie as pt


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for key in sorted(members, key=len, reverse=True):
        n = children.get(key, 0)
        leaves[key] = leaves.get(key, 0) if n else 1
        saved[key] = saved.get(key, 0) + ((len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0)
        if key:
            up = key[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[key]
            saved[up] = saved.get(up, 0) + saved[key]
    out = []
    for key, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(key))))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), children.get(key, 0), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n, seed, long=()):
    rng = random.Random(seed)
    say = ["", "hello", "grüß", "yes please", None, "x" * 500]
    rows = []
    for c in [*range(0, n), *range(-12, 0)]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, rng.choice([t, t, t * 2]) if rng.random() < 0.98 else None, rng.choice(["user", "user", "assistant", None]), rng.choice(say if rng.random() < 0.8 else [f"own {c} {t}"])))
    for c, size in long:
        rows += [(c, 100 + t, "user", f"turn {t % 7}") for t in range(size)]
    # A turn that a conversation repeats must have one text, as the order of ties is the digest's.
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("seed,partitions", [(1, 4), (2, 9)])
def test_against_a_dictionary(spark, seed, partitions):
    rows = made(160, seed, long=[(5, 300), (7, 300), (21, 150)])
    rows += [(1000 + c, t, "user", "copied") for c in range(400) for t in range(3)]  # a large group of copies
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", depth string").repartition(6)
        got = pt.prefix_trie(df)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert held(got) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(pt, "LEAST_CELLS", 1 << 15)
    monkeypatch.setattr(pt, "MOST_CELLS", 1 << 15)
    monkeypatch.setattr(pt, "_estimated_once", lambda digests, cells, bits: digests[0] % 3 == 7)  # nothing is proven single
    rows = made(60, 3)
    assert held(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_single_prefixes_are_screened(spark):
    rows = [(5 * c, t, "user", f"{c} {t}") for c in range(300) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    scratch = pt.Scratch(spark, "test")
    turns, _ = pt.rebuilt(df, scratch)
    prefixes = turns.selectExpr("conv", "pos as depth", "t1", "t2", "xxhash64(conv, pos) as a", "xxhash64(pos, conv, 1) as b", "size", "size as upto").repartition(3, "conv").sortWithinPartitions("conv", "depth")
    kinds = [r.kind for r in pt._screened(prefixes, pt._sketch(prefixes, 1 << 16, scratch), 1 << 16).collect()]
    assert len(kinds) == 1200 and kinds.count(pt.MAYBE) < 12 and kinds.count(pt.FIRST) >= 300


def test_no_rows_turnless_and_null_ids(spark):
    assert held(pt.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert held(pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # no group to open with, and all of its own turn falls away
    rows = [(c, 0, "user", "x"), (None, 0, "user", "x")]
    assert held(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert held(pt.prefix_trie(spark.createDataFrame(rows * 2, SCHEMA))) == brute(rows * 2)


def test_turns_of_nodes(spark):
    rows = made(40, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    convs = rebuilt(rows)
    for r in pt.with_turns(pt.prefix_trie(df), df).collect():
        assert (r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None))
