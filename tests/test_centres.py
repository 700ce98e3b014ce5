"""Class points, the centre tree, leader clustering and bounds against plain loops over all classes."""

import numpy as np
import pytest

from tracewell import compat, errors
from tracewell.operators import centres, models

RNG = np.random.default_rng(41)


def test_chunked_points_equal_signed_bits():
    for nb, p in ((1, 1), (4, 3), (8, 2), (11, 3), (16, 2), (33, 2)):
        coefs = RNG.normal(0, 1, (p, nb + 1))
        tables = centres.chunk_tables(coefs)
        assert sum(t.size for t in tables) <= -(-nb // 8) * 256 * p
        classes = np.unique(np.concatenate([[0, (1 << nb) - 1], RNG.integers(0, 1 << nb, 50)]).astype(np.uint64))
        want = np.array([[c[0] + sum(w * (2 * (int(k) >> i & 1) - 1) for i, w in enumerate(c[1:])) for c in coefs] for k in classes])
        np.testing.assert_allclose(centres.class_points(tables, classes), want, atol=1e-12)


def brute_closest(points, q):
    d = ((points - q) ** 2).sum(axis=1)
    return np.lexsort((np.arange(len(d)), d)), d


@pytest.mark.parametrize("n,p", [(1, 2), (7, 1), (9, 3), (500, 2), (3000, 4)])
def test_tree_equals_brute_force(n, p):
    points = np.round(RNG.normal(0, 2, (n, p)))  # many ties
    weights = RNG.integers(1, 5, n)
    tree = centres.CentreTree(points, weights)
    at = np.concatenate([RNG.normal(0, 3, (40, p)), points[: min(n, 5)]])
    number, d = tree.nearest(at)
    for i, q in enumerate(at):
        order, own = brute_closest(points, q)
        assert number[i] == order[0] and d[i] == own[order[0]]
    radius = RNG.uniform(0, 4, len(at))
    rows, found, _ = tree.within(at, radius)
    for i, q in enumerate(at):
        order, own = brute_closest(points, q)
        assert found[rows == i].tolist() == order[own[order] <= radius[i] ** 2].tolist()
    for need in (1, 6, 100, 10**9):
        rows, found, _ = tree.closest(at, need)
        for i, q in enumerate(at):
            order, _ = brute_closest(points, q)
            enough = int(np.searchsorted(np.cumsum(weights[order]), need)) + 1
            assert found[rows == i][:enough].tolist() == order[:enough].tolist()


def test_tree_visits_few_of_many_centres():
    points = RNG.normal(0, 1, (100_000, 4))
    points[::1000] = points[0]  # ties
    tree = centres.CentreTree(points)
    at = RNG.normal(0, 1, (64, 4))
    number, d = tree.nearest(at)
    for i, q in enumerate(at):
        order, own = brute_closest(points, q)
        assert (number[i], d[i]) == (order[0], pytest.approx(own[order[0]]))
    assert tree.visited < 0.05 * len(at) * len(points)


def brute_leaders(means, radius):
    """The sequential rule: (leaders, each class's leader)."""
    found, owner = [], np.empty(len(means), np.int64)
    for c, m in enumerate(means):
        d = [float(centres.squared_pairs(means[k : k + 1], m[None])[0]) for k in found]
        if d and min(d) <= radius * radius:
            owner[c] = found[int(np.argmin(d))]
        else:
            found.append(c)
            owner[c] = c
    return found, owner


@pytest.mark.parametrize("nb,p,radius", [(4, 2, 0.0), (4, 1, 1.0), (6, 3, 0.7), (8, 2, 0.5), (8, 4, 2.0), (9, 2, 50.0), (10, 1, 0.02)])
@pytest.mark.parametrize("per_block", [1 << 14, 32])
def test_leaders_equal_the_sequential_rule(spark, monkeypatch, nb, p, radius, per_block):
    """In one block, and in many that exchange their edges."""
    monkeypatch.setattr(centres, "PER_BLOCK", per_block)
    monkeypatch.setattr(centres, "ROWS", 16 if per_block == 32 else 512)
    model = models.RldaModel(nb, np.eye(p), RNG.normal(0, 1, (p, nb + 1)) * (1 if radius else 0.0) + (np.arange(nb + 1) % 2 if not radius else 0))
    want, owner = brute_leaders(model.means(), radius)
    got = model.clustered(spark, radius)
    assert got.centres.tolist() == want
    assert got.centres[got.owner].tolist() == owner.tolist()
    assert got.weights.tolist() == np.bincount(got.owner).tolist()
    assert (got.get_size(), got.get_max_sqdist()) == (len(want), radius * radius)
    light = model.clustered(spark, radius, keep_members=False)
    assert light.owner is None and light.weights.tolist() == got.weights.tolist()
    assert sorted(map(tuple, model.cluster_rows(spark, radius).collect())) == list(enumerate(owner.tolist()))


def test_monotone_classes_settle_block_after_block(spark, monkeypatch):
    """Coordinates ascend with the class, so that each block waits for the one before."""
    monkeypatch.setattr(centres, "PER_BLOCK", 64)
    nb = 9
    model = models.RldaModel(nb, np.eye(1), np.concatenate([[0.0], 0.5 * 2.0 ** np.arange(nb)])[None, :])
    assert model.clustered(spark, 3.5).centres.tolist() == list(range(0, 512, 4))


def test_too_many_clusters(spark):
    model = models.RldaModel(5, np.eye(2), RNG.normal(0, 1, (2, 6)))
    for radius in (0.0, 1e-6):
        with pytest.raises(errors.ShapeError):
            model.clustered(spark, radius, max_clusters=8)


def brute_bounds(clustered, x, y, budget):
    means, low, high = clustered.model.means(), [], []
    for t, c in zip(clustered.model.project(x), y):
        e = ((means[clustered.centres] - t) ** 2).sum(axis=1)
        order = np.argsort(e, kind="stable")
        near = set(order[np.cumsum(clustered.weights[order]) < budget].tolist()) if clustered.owner is not None else set()
        least = most = 0.0
        for k, (d, w) in enumerate(zip(e, clustered.weights)):
            if k in near:
                own = np.exp(-0.5 * ((means[clustered.owner == k] - t) ** 2).sum(axis=1)).sum()
                least, most = least + own, most + own
            else:
                least += w * np.exp(-0.5 * (np.sqrt(d) + clustered.radius) ** 2)
                most += w * np.exp(-0.5 * max(np.sqrt(d) - clustered.radius, 0) ** 2)
        p = np.exp(-0.5 * ((means[int(c)] - t) ** 2).sum())
        low.append(p / most)
        high.append(p / least)
    return np.array(low), np.array(high)


def test_bounds_equal_the_enumeration_of_all_classes(spark):
    nb, p = 8, 3
    model = models.RldaModel(nb, np.eye(p), RNG.normal(0, 0.8, (p, nb + 1)))
    x, y = np.round(RNG.normal(0, 2, (60, p)) * 2).astype(np.int16), RNG.integers(0, 1 << nb, 60)
    exact = model.probabilities(x)[np.arange(60), y]
    for radius in (0.0, 0.4, 1.5):
        for keep in (True, False):
            clustered = model.clustered(spark, radius, keep_members=keep)
            for budget in (0, 5, 60, 1 << 20):
                low, high = clustered.bounded(x, y, budget)
                want = brute_bounds(clustered, x, y, budget)
                np.testing.assert_allclose(low, want[0], rtol=1e-9)
                np.testing.assert_allclose(high, want[1], rtol=1e-9)
                assert (low <= exact * (1 + 1e-9)).all() and (exact <= high * (1 + 1e-9)).all()
                if keep and budget == 1 << 20 or not radius:
                    np.testing.assert_allclose(low, exact)
                    np.testing.assert_allclose(high, exact)


def test_far_traces_have_bounds(spark):
    """Where all exponents are 0 in double precision."""
    model = models.RldaModel(4, np.eye(2), RNG.normal(0, 1, (2, 5)))
    x, y = np.array([[400, -300], [0, 0]], np.int16), np.array([3, 4])
    low, high = model.clustered(spark, 0.3).bounded(x, y, 4)
    exact = model.probabilities(x)[np.arange(2), y]
    assert np.isfinite(low).all() and np.isfinite(high).all() and (low <= exact * (1 + 1e-9)).all() and (exact <= high * (1 + 1e-9)).all()


def test_accessors_and_information(spark):
    nb, n = 8, 600
    y = RNG.integers(0, 1 << nb, n).astype(np.uint64)
    x = RNG.integers(-30, 30, (n, 6)).astype(np.int16)
    x[:, 0] += y.astype(np.int16)
    fitted = compat.RLDAClassifier(nb, 3).fit_u(x, y[:, None]).solve()
    clustered = fitted.get_clustered_model(0, 0.05)
    point = fitted.solved[0].project(x[:1])[0]
    e = ((fitted.solved[0].means()[clustered.centres] - point) ** 2).sum(axis=1)
    assert clustered.nearest(point) == (clustered.centres[e.argmin()], pytest.approx(e.min()))
    order = np.argsort(e, kind="stable")
    assert clustered.close_centres(point, 9) == order[np.cumsum(clustered.weights[order]) < 9].tolist()
    with pytest.raises(errors.ShapeError):
        fitted.get_clustered_model(0, 0.05, store_associated_classes=False).close_centres(point, 9)
    own = np.log2(fitted.predict_proba(x, 0)[np.arange(n), y.astype(int)])
    flat = compat.RLDAInformationEstimator(fitted.get_clustered_model(0, 0, 2**16, False), 0)
    flat.fit_u(x[:200], y[:200]).fit_u(x[200:], y[200:])
    assert flat.get_information() == pytest.approx((nb + own.mean(),) * 2)
    assert flat.get_deviation() == (pytest.approx(own.std()), pytest.approx(own.std()), n)


def test_one_class_of_many_bits_in_constant_memory(spark):
    nb = 32
    model = models.RldaModel(nb, np.eye(3), RNG.normal(0, 1, (3, nb + 1)))
    y = RNG.integers(0, 1 << nb, 200).astype(np.uint64)
    x = RNG.integers(-9, 9, (200, 3)).astype(np.int16)
    got = {r.trace_id: r.value for r in models.rlda_distances(compat.as_traces(x, y[:, None], np.uint64), model).collect()}
    signs = models.bits_of(y.astype(np.int64), nb)
    np.testing.assert_allclose([got[i] for i in range(200)], ((x - signs @ model.coefs.T) ** 2).sum(axis=1))
    assert sum(t.size for t in centres.chunk_tables(model.coefs)) == 4 * 256 * 3
