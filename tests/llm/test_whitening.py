import math

import numpy as np
import pytest

from lodestone.llm import whitening as wh


def brute(rows, scale=256, most=4):
    """Rows of (vec_id, vector) by numpy's full eigendecomposition."""
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit - sums // n) - (sums % n) / n
    v = y.T @ y / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    out = {}
    for i, x in good:
        c = (np.array(x) - sums // n) - (sums % n) / n
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums.tolist(), strict=True))
        out.setdefault(i, []).append((n, dev, c @ basis / np.sqrt(values), values / np.trace(v)))
    return out


def compare(got, want):
    for i, each in want.items():
        n, dev, w, share = each[0]
        own = sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)
        assert len(own) == len(w) * len(each)
        own = own[:: len(each)]
        assert all(r.n == n and r.deviation == dev for r in own)
        assert np.allclose(np.abs([r.whitened for r in own]), np.abs(w), atol=1e-8)
        assert np.allclose([r.explained for r in own], share, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in own)
    assert len(got) == sum(len(e) * len(e[0][2]) for e in want.values())


def test_inertia_against_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 20):
        for _ in range(20):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if n > 2:
                a[0, 0] = a[1, 1] = 0.0
            e = np.linalg.eigvalsh(a)
            assert wh.inertia(a) == ((e > 0).sum(), (e < 0).sum(), 0)
    assert wh.inertia(np.zeros((3, 3))) == (0, 0, 3)
    assert wh.inertia(np.array([[0.0, 2.0], [2.0, 0.0]])) == (1, 1, 0)


@pytest.mark.parametrize("values", [[9, 5, 3, 1, 0.5], [4, 4, 4, 1, 1], [1, 1, 1, 1, 1], [7, 7 - 1e-9, 2, 2 - 1e-12, 1e-3], [1e9, 1, 0.1, 0, 0], [3, 0, 0, 0, 0]])
def test_leading_eigenvalues(values):
    rng = np.random.default_rng(11)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found = wh.leading(v, 4)
    size = max(values)
    want = [e for e in sorted(values, reverse=True)[:4] if e > 1e-12 * size]
    assert np.allclose([e for e, _ in found], want, atol=1e-12 * size)
    u = np.stack([y for _, y in found], axis=1)
    assert np.allclose(u.T @ u, np.eye(len(want)), atol=1e-12)
    assert np.allclose(v @ u, u * np.array([e for e, _ in found]), atol=1e-12 * size)


def test_against_full_decomposition(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 12)) * np.linspace(2, 0.3, 12) + rng.normal(size=12)
    rows = [(k, v.astype(np.float32).astype(float).tolist()) for k, v in enumerate(base)]
    rows += [(500 + k, rows[7][1]) for k in range(300)]  # copies count once
    rows += [(7, rows[7][1]), (900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component string").repartition(7)
    got = wh.whitened(vectors).collect()
    compare(got, brute([r for r in rows if r[1] is None or len(r[1]) == 12]))
    assert not {r.vec_id for r in got} & {900, 901, 902, 903, 904, 905}


def test_large_entries_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (2.0**40 + rng.normal(size=3) * [3, 2, 1]).tolist()) for k in range(50)]
    compare(wh.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), brute(rows))


def test_packed_round_trip():
    rng = np.random.default_rng(9)
    for top in (100, 30_000, 1 << 30, 1 << 60):
        x = rng.integers(-top, top, (20, 5))
        assert (wh.unpacked(wh.packed(x), 5) == x).all()


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whitened(spark.createDataFrame([], schema)).count() == 0
    assert wh.whitened(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # one vector has no variance
    got = wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 3.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.component, r.n, abs(r.whitened), r.explained) for r in got) == [("1", 1, 2, 1.0, 1.0), ("None", 1, 2, 1.0, 1.0)]
