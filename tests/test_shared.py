"""States as tables: exact sums of shared tiles, merging, streams, round trips, solving by groups."""

import time

import numpy as np
import pytest

from tracewell import compat, errors
from tracewell.operators import models, shared

RNG = np.random.default_rng(17)


def rows_of(state):
    return {(r.kind, r.a, r.b): (r.n, tuple(r.v)) for r in state.collect()}


def test_overlapping_points_of_many_variables(spark, monkeypatch):
    """A hundred variables over 150 samples: every matrix equals NumPy's, in several passes too, and halves merge."""
    n, ns, nv, nc = 400, 150, 100, 3
    x, y = RNG.integers(-9000, 9000, (n, ns)).astype(np.int16), RNG.integers(0, nc, (n, nv)).astype(np.uint16)
    points = [RNG.choice(ns, RNG.integers(1, 12), replace=False).tolist() for _ in range(nv - 1)] + [[7, 7, 149, 0]]
    t = compat.as_traces(x, y).repartition(3)
    state = compat.store(shared.lda_state(t, nc, points))
    kinds = rows_of(state)
    tiles = [k for k in kinds if k[0] == "tile"]
    assert len(tiles) <= 5 * 6 // 2  # blocks of 32 samples, each pair once
    monkeypatch.setattr(shared, "HELD", 3000)
    halves = [shared.lda_state(t.where(f"trace_id % 2 = {k}"), nc, points) for k in (0, 1)]
    assert rows_of(shared.merge_states(*halves)) == kinds
    gathered = {}
    for r in shared.by_variable(state).collect():
        gathered.setdefault(r["var"], []).append(r.asDict())
    for v, p in enumerate(points):
        s = shared.lda_of({c: [r[c] for r in gathered[v]] for c in ("kind", "b", "n", "i", "j", "v")})
        z = x[:, p].astype(np.int64)
        assert (s.scatter == z.T @ z).all() and s.points == tuple(p)
        assert (s.counts == np.bincount(y[:, v], minlength=nc)).all()
        assert (s.sums == np.stack([z[y[:, v] == c].sum(axis=0) for c in range(nc)])).all()


def test_sums_beyond_double_precision(spark):
    """Exact from 2^53 on, and an error from 2^63 on."""
    rows = [("tile", 0, 0, 1, [(1 << 60) + 1]), ("tile", 0, 0, 1, [(1 << 60) + 2]), ("tile", 0, 0, 1, [-1])]
    got = shared.sum_rows(spark.createDataFrame(rows, shared.STATE).repartition(3)).collect()
    assert [(r.n, r.v) for r in got] == [(3, [(1 << 61) + 2])]
    with pytest.raises(Exception, match="leaves 64 bits"):
        shared.sum_rows(spark.createDataFrame(rows[:1] * 8, shared.STATE)).collect()
    with pytest.raises(Exception, match="do not merge"):
        shared.sum_rows(spark.createDataFrame([("points", 0, 2, 0, [1]), ("points", 0, 2, 0, [2])], shared.STATE)).collect()


def test_round_trips(spark, tmp_path):
    x, y = RNG.integers(-50, 50, (300, 5)).astype(np.int16), RNG.integers(0, 3, (300, 2)).astype(np.uint16)
    acc = compat.LdaAcc(3, [[0, 1, 4], [2, 3]]).fit_u(x, y)
    acc.save(f"{tmp_path}/acc")
    lda = compat.Lda(compat.LdaAcc.load(f"{tmp_path}/acc").fit_u(x[:50], y[:50]), 1)
    lda.save(f"{tmp_path}/lda")
    np.testing.assert_allclose(compat.Lda.load(f"{tmp_path}/lda").predict_proba(x), lda.predict_proba(x))
    want = compat.Lda(compat.LdaAcc(3, [[0, 1, 4], [2, 3]]).fit_u(np.concatenate([x, x[:50]]), np.concatenate([y, y[:50]])), 1)
    np.testing.assert_allclose(lda.predict_proba(x), want.predict_proba(x))
    bits = RNG.integers(0, 8, (300, 1)).astype(np.uint64)
    fitted = compat.RLDAClassifier(3, 2).fit_u(x, bits).solve()
    fitted.save(f"{tmp_path}/rlda")
    again = compat.RLDAClassifier.load(f"{tmp_path}/rlda", 3, 2)
    np.testing.assert_allclose(again.predict_proba(x, 0), fitted.predict_proba(x, 0))
    again.fit_u(x[:10], bits[:10])
    with pytest.raises(errors.ShapeError):
        compat.RLDAClassifier(3, 9).fit_u(x, bits).solve()


def test_regression_scatter_by_tiles(spark):
    """More samples than a tile is wide; sums equal NumPy's."""
    x, y = RNG.integers(-3000, 3000, (200, 100)).astype(np.int16), RNG.integers(0, 1 << 5, (200, 2)).astype(np.uint64)
    got = rows_of(shared.rlda_state(compat.as_traces(x, y, np.uint64).repartition(2), 5))
    z = x.astype(np.int64)
    full = z.T @ z
    for (kind, a, b), (n, v) in got.items():
        if kind == "tile":
            own = full[a * 32 : (a + 1) * 32, b * 32 : (b + 1) * 32]
            assert n == 200 and v == tuple(own.reshape(-1).tolist())
    assert sum(k[0] == "tile" for k in got) == 4 * 5 // 2
    signs = [models.bits_of(y[:, v], 5).astype(np.int64) for v in range(2)]
    assert all(got["bits", v, i][1] == tuple((signs[v].T @ signs[v])[i].tolist()) and got["cross", v, i][1] == tuple((signs[v].T @ z)[i].tolist()) for v in range(2) for i in range(6))


def test_top_directions_from_few_rows_equal_the_full_decomposition():
    n, classes, p = 600, 12, 4
    a = RNG.normal(0, 1, (n, n + 20))
    cov, factor = a @ a.T / n, RNG.normal(0, 1, (classes, n))
    began = time.perf_counter()
    got = models.top_directions(factor, cov, p)
    fast = time.perf_counter() - began
    began = time.perf_counter()
    values, full = models.eigenpairs(factor.T @ factor, cov)
    slow = time.perf_counter() - began
    assert fast < slow
    np.testing.assert_allclose(got @ cov @ got.T, np.eye(p), atol=1e-8)
    # the same subspace: each direction is a combination of the full ones
    inner = got @ cov @ full[:p].T
    np.testing.assert_allclose(inner @ inner.T, np.eye(p), atol=1e-8)
    np.testing.assert_allclose(np.abs(np.diag(inner)), 1, atol=1e-6)
    np.testing.assert_allclose(factor.T @ factor @ full.T, cov @ full.T * values, atol=1e-4)
    beyond = models.top_directions(factor[:2], cov, 3)  # more directions than rows
    np.testing.assert_allclose(beyond @ cov @ beyond.T, np.eye(3), atol=1e-6)
    with pytest.raises(errors.SingularError):
        models.top_directions(factor, np.zeros((n, n)), p)
