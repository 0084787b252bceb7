"""Whitening against a full eigendecomposition, with awkward rows; the iteration by itself on hard spectra."""

import numpy as np
import pytest

from tallymart.llm import whitening


def brute(rows, k):
    """id -> (deviation, whitened of each component), eigenvalue shares; of the rows that remain."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    whole = [[n * int(a) - int(b) for a, b in zip(r, s)] for r in x]
    c = np.array(whole, float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return [sum(a * a for a in r) for r in whole], c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 20)) * np.linspace(3, 0.3, 20) + rng.standard_normal(20) * 5
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(base)] + [(7, [float(np.float32(v)) for v in base[7]]), (None, [1.0] * 20)]
    bad = [(900, None), (901, []), (902, [float("nan")] * 20), (903, [1.0] * 19 + [float("inf")]), (904, [1.0] * 19 + [None]), (905, [1.0] * 19), (906, [1e30] * 20)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    got = whitening.whitened(df, components=8, guard=4).collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)} and {r.component for r in got} == set(range(1, 9))
    assert got[0].identity_error < 1e-9 and got[0].residual < 1e-10
    deviation, z, explained = brute(rows, 8)
    at = {i: k for k, (i, _) in enumerate(rows)}
    signs = np.ones(8)
    for r in got:
        if r.vec_id == 0:
            signs[r.component - 1] = np.sign(r.whitened * z[0, r.component - 1])
    for r in got:
        k = at[r.vec_id]
        assert r.deviation == deviation[k]
        assert r.whitened == pytest.approx(signs[r.component - 1] * z[k, r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)


def test_reruns_and_layouts_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((120, 70)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = ({(r.vec_id, r.component): r.whitened for r in whitening.whitened(x).collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-8
    assert len(a) == 120 * 32


def test_nothing_to_whiten(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id string, embedding array<float>"))
    assert make([]).count() == 0 and make([("a", None)]).count() == 0 and make([("a", [1.0, 2.0])]).count() == 0
    assert make([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]).count() == 0
    flat = make([("a", [1.0, 2.0, 5.0]), ("b", [2.0, 2.0, 5.0]), ("c", [4.0, 2.0, 5.0])]).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
    wide = make([("a", [1.0e14, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0e14, 5.0])]).collect()
    assert all(r.deviation is None for r in wide if r.vec_id != "b")  # over 63 bits


@pytest.mark.parametrize("spectrum", [np.linspace(2, 1, 200), np.r_[np.full(5, 400.0), np.linspace(60, 50, 195)], 1.0 / np.arange(1, 201) ** 3, np.r_[np.ones(10), np.zeros(190)]])
def test_iteration(spectrum):
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    v = (q * spectrum) @ q.T
    passes = []
    e, u, residual = whitening.eigenpairs(lambda x: passes.append(x.shape[1]) or v @ x, 200, 16, 8)
    assert np.allclose(e, np.sort(spectrum)[::-1][:16], rtol=1e-9, atol=1e-12 * spectrum.max())
    assert np.allclose(u.T @ u, np.eye(16), atol=1e-10) and np.linalg.norm(v @ u - u * e, axis=0).max() <= 1e-9 * e[0]
    assert max(passes) <= 24  # the block stays thin
