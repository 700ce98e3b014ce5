"""Operators against NumPy brute force, batch splits and partition counts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import compat, errors
from tracewell.functions import kernels as K
from tracewell.operators import metrics, models, quantize, rank, shared, stats
from tracewell.plans.graph import parse
from tracewell.plans.propagation import Beliefs, infer
from tracewell.sources import traces as sources

RNG = np.random.default_rng(3)


def brute_snr(x, y, nc):
    out = []
    for j in range(x.shape[1]):
        n, s, ss = len(x), int(x[:, j].sum()), int((x[:, j].astype(int) ** 2).sum())
        ssc = sum((int(x[y == c, j].sum()) ** 2) * n // int((y == c).sum()) for c in range(nc) if (y == c).any())
        out.append((ssc - s * s) / (n * ss - ssc) if n * ss != ssc else np.nan)
    return np.array(out)


@pytest.mark.parametrize("nc,nv,ns,n", [(2, 1, 1, 10), (16, 2, 5, 200), (4, 3, 2, 30)])
def test_snr_batches_equal_brute_force(spark, nc, nv, ns, n):
    x = RNG.integers(-(1 << 15), 1 << 15, (n, ns)).astype(np.int16)
    y = RNG.integers(0, nc, (n, nv)).astype(np.uint16)
    whole, parts = compat.SNR(nc), compat.SNR(nc)
    whole.fit_u(x, y)
    for i in range(0, n, 50):
        parts.fit_u(x[i : i + 50], y[i : i + 50])
    want = np.stack([brute_snr(x, y[:, v], nc) for v in range(nv)])
    np.testing.assert_allclose(whole.get_snr(), want, rtol=1e-6)
    np.testing.assert_allclose(parts.get_snr(), want, rtol=1e-6)


def test_snr_dense_and_exact_paths_agree(spark):
    x, y = RNG.integers(-1000, 1000, (300, 4)).astype(np.int16), RNG.integers(0, 5, (300, 2)).astype(np.uint16)
    t = compat.as_traces(x, y)
    a, b = (sorted(map(tuple, stats.class_state(t.repartition(k), dense=d).collect())) for k, d in ((1, False), (7, True)))
    assert a == b
    exact = {(r["var"], r["sample"]): r["snr"] for r in metrics.snr(stats.class_state(t), exact=True).collect()}
    for v in range(2):
        np.testing.assert_allclose([exact[v, s] for s in range(4)], brute_snr(x, y[:, v], 5), rtol=1e-9)


def test_constant_samples_and_bad_batches(spark):
    s = compat.SNR(2).fit_u(np.ones((6, 1), np.int16), np.array([0, 1] * 3, np.uint16))
    assert np.isnan(s.get_snr()).all()
    with pytest.raises(errors.ClassOutOfBoundError):
        compat.SNR(2).fit_u(np.ones((2, 1), np.int16), np.array([0, 2], np.uint16))
    with pytest.raises(errors.ShapeError):
        s.fit_u(np.ones((2, 2), np.int16), np.array([0, 1], np.uint16))
    with pytest.raises(errors.ShapeError):
        compat.SNR(1 << 17)
    with pytest.raises(errors.ShapeError):
        compat.as_traces(np.ones((2, 2)))


def brute_ttest(x, g, d):
    out = []
    for k in range(1, d + 1):
        parts = []
        for c in (0, 1):
            v = x[g == c].astype(float)
            m = v.mean(axis=0)
            cm = lambda p, v=v, m=m: ((v - m) ** p).mean(axis=0)
            u, var = (m, cm(2)) if k == 1 else (cm(2), cm(4) - cm(2) ** 2) if k == 2 else (cm(k) / cm(2) ** (k / 2), (cm(2 * k) - cm(k) ** 2) / cm(2) ** k)
            parts.append((u, var / len(v)))
        out.append((parts[0][0] - parts[1][0]) / np.sqrt(parts[0][1] + parts[1][1]))
    return np.array(out)


@pytest.mark.parametrize("d", [1, 2, 4])
def test_ttest_batches(spark, d):
    g = RNG.integers(0, 2, 240).astype(np.uint16)
    x = (RNG.integers(0, 10, (240, 5)) + g[:, None] * RNG.integers(0, 3, (240, 5))).astype(np.int16)
    t = compat.Ttest(d)
    for i in range(0, 240, 80):
        t.fit_u(x[i : i + 80], g[i : i + 80])
    np.testing.assert_allclose(t.get_ttest(), brute_ttest(x, g, d), rtol=1e-6)


def test_mttest_repeats_and_orders(spark):
    g = RNG.integers(0, 2, 150).astype(np.uint16)
    x = RNG.integers(-50, 50, (150, 6)).astype(np.int16)
    for d, pois in ((2, np.array([[0, 1, 3], [1, 1, 5]])), (3, np.array([[0, 1], [2, 2], [5, 2]]))):
        got = compat.MTtest(d, pois).fit_u(x[:70], g[:70]).fit_u(x[70:], g[70:]).get_ttest()
        want = []
        for own in pois.T:
            parts = []
            for c in (0, 1):
                v = x[g == c].astype(float)
                z = v[:, own] - v.mean(axis=0)[own]
                if d > 2:
                    z = z / v.std(axis=0)[own]
                p = z.prod(axis=1)
                parts.append((p.mean(), (p**2).mean() - p.mean() ** 2, len(v)))
            want.append((parts[0][0] - parts[1][0]) / math.sqrt(parts[0][1] / parts[0][2] + parts[1][1] / parts[1][2]))
        np.testing.assert_allclose(got, want, rtol=1e-6)


@pytest.mark.parametrize("kind", ["xor", "add"])
def test_cpa_every_key(spark, kind):
    nc, x, y = 8, RNG.integers(0, 10, (100, 3)).astype(np.int16), RNG.integers(0, 8, (100, 2)).astype(np.uint16)
    m = RNG.random((2, nc, 3))
    got = compat.Cpa(nc, kind).fit_u(x, y).get_correlation(m)
    for v, k, s in itertools.product(range(2), range(nc), range(3)):
        value = (k ^ y[:, v]) if kind == "xor" else (k + y[:, v]) % nc
        c = m[v, :, s] - m[v, :, s].mean()
        cov = ((x[:, s] - x[:, s].mean()) * c[value]).sum()
        assert got[v, k, s] == pytest.approx(cov / (99 * math.sqrt(m[v, :, s].var() * x[:, s].var(ddof=1))), rel=1e-6)


def gaussian(n=600, ns=6, nc=4):
    centres = RNG.normal(0, 50, (nc, ns))
    y = RNG.integers(0, nc, (n, 2)).astype(np.uint16)
    return np.round(centres[y[:, 0]] + RNG.normal(0, 20, (n, ns))).astype(np.int16), y


def test_lda_scatter_probabilities_and_selection(spark):
    x, y = gaussian()
    points = [[0, 2, 5], [5, 1, 2, 0]]
    acc = compat.LdaAcc(4, points).fit_u(x[:200], y[:200]).fit_u(x[200:], y[200:])
    for v, p in enumerate(points):
        z, c = x[:, p].astype(float), y[:, v]
        mus = np.stack([z[c == k].mean(axis=0) for k in range(4)])
        s_b = sum((c == k).sum() * np.outer(mus[k] - z.mean(axis=0), mus[k] - z.mean(axis=0)) for k in range(4))
        s_w = (z - mus[c]).T @ (z - mus[c])
        np.testing.assert_allclose(acc.get_mus()[v], mus)
        np.testing.assert_allclose(acc.get_sb()[v], s_b, rtol=1e-6, atol=1e-3)
        np.testing.assert_allclose(acc.get_sw()[v], s_w, rtol=1e-6, atol=1e-3)
        cov = s_w / (len(x) - 4)
        d = np.stack([np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(cov), z - m) for m in mus], axis=1)
        want = models.softmax(-0.5 * d)
        np.testing.assert_allclose(shared.lda_models(shared.lda_solve(acc.state, len(p)).where(f"var = {v}"))[0].probabilities(x), want, atol=1e-8)
    lda = compat.Lda(acc, 2)
    w = lda.models[0].w
    np.testing.assert_allclose(w @ (acc.get_sw()[0] / (len(x) - 4)) @ w.T, np.eye(2), atol=1e-8)
    np.testing.assert_allclose(lda.select_vars([1, 0, 1]).predict_proba(x), lda.predict_proba(x)[[1, 0, 1]])
    p = lda.predict_proba(x)
    np.testing.assert_allclose(lda.predict_log2_proba_class(x, y)[1], np.log2(p[1][np.arange(len(x)), y[:, 1]]))
    rows = lda.predict_table(compat.as_traces(x, y)).where("var = 1").orderBy("trace_id").collect()
    np.testing.assert_allclose([r["value"] for r in rows], p[1])
    np.testing.assert_allclose(lda.models[0].probabilities(x), p[0])
    with pytest.raises(errors.ShapeError):
        compat.Lda(acc, 9)
    with pytest.raises(errors.EmptyClassError):
        compat.Lda(compat.LdaAcc(5, points).fit_u(x, y), 1)
    with pytest.warns(DeprecationWarning):
        old = compat.LDAClassifier(4, 2).fit_u(x, y[:, 0]).solve(done=True)
    assert old.predict_proba(x).shape == (600, 4)


def test_rlda_probabilities_clusters_and_information(spark):
    nb, n = 4, 800
    y = RNG.integers(0, 1 << nb, (n, 1)).astype(np.uint64)
    bits = models.bits_of(y[:, 0], nb)
    x = np.round(bits @ RNG.normal(0, 60, (nb + 1, 5)) + RNG.normal(0, 30, (n, 5))).astype(np.int16)
    m = compat.RLDAClassifier(nb, 3).fit_u(x[:300], y[:300]).fit_u(x[300:], y[300:]).solve()
    coefs, *_ = np.linalg.lstsq(bits, x.astype(float), rcond=None)
    residual = x - bits @ coefs
    proj = m.get_proj()[0]
    np.testing.assert_allclose(proj @ (residual.T @ residual / n) @ proj.T, np.eye(3), atol=1e-6)
    np.testing.assert_allclose(m.get_proj_coefs()[0], proj @ coefs.T, rtol=1e-6)
    p = m.predict_proba(x, 0)
    means = models.bits_of(np.arange(16), nb) @ m.get_proj_coefs()[0].T
    d = ((x @ proj.T)[:, None, :] - means[None]) ** 2
    np.testing.assert_allclose(p, models.softmax(-0.5 * d.sum(axis=2)), atol=1e-9)
    true = p[np.arange(n), y[:, 0].astype(int)]
    for radius in (0.0, 0.8):
        clustered = m.get_clustered_model(0, radius)
        low, high = clustered.bounded(x, y[:, 0], 4)
        assert (low <= true + 1e-12).all() and (true <= high + 1e-12).all()
        if not radius:
            np.testing.assert_allclose(low, high)
        est = compat.RLDAInformationEstimator(clustered, 4).fit_u(x, y[:, 0])
        r = models.information(compat.as_traces(x, y, np.uint64), clustered, 4).first()
        assert est.get_information() == pytest.approx((r.lower, r.upper)) and est.get_deviation()[2] == r.n
    with pytest.raises(errors.EmptyClassError):
        compat.RLDAClassifier(nb, 2).fit_u(x, y & np.uint64(3)).solve()


def test_quantizer(spark):
    x = RNG.normal(0, 1, (500, 4))
    t = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "trace_id long, samples array<double>")
    for method in ("bounds", "moment"):
        p = {r["sample"]: r for r in quantize.fit(t, method).collect()}
        q = np.array([r.samples for r in quantize.apply(t, quantize.fit(t, method)).orderBy("trace_id").collect()])
        back = q / [p[j].scale for j in range(4)] + [p[j].shift for j in range(4)]
        assert np.abs(back - x).max() < 1e-2
    wide = t.withColumn("samples", F.transform("samples", lambda v: v * 8))
    assert quantize.apply(wide, quantize.fit(t), clip=True).count() == 500
    with pytest.raises(Exception, match="does not fit int16"):
        quantize.apply(wide, quantize.fit(t)).collect()


@pytest.mark.parametrize("method", ["hist", "scaledhist", "histbignum"])
def test_rank_bounds_hold_the_exact_rank(method):
    for seed in range(6):
        r = np.random.default_rng(seed)
        costs, key = [r.random(int(r.integers(2, 9))) * 5 for _ in range(4)], None
        key = [int(r.integers(len(c))) for c in costs]
        exact = compat.rank_nbin(costs, key, 0, "naive")[0]
        low, guess, high = rank.rank_bins(costs, key, 256, method)
        assert low <= exact <= high and low <= guess
        low, _, high = compat.rank_accuracy(costs, key, 0.2, method)
        assert low <= exact <= high


def test_rank_small_cases_and_errors(spark):
    want = {(0, 0): 2, (0, 1): 1, (1, 0): 4, (1, 1): 3}
    for key, r in want.items():
        assert compat.rank_nbin([[0.2, 0.8], [0.4, 0.3]], key, 0, "naive")[0] == r
    one_hot = [-np.log(np.where(np.arange(256) == 7, 1.0, 0.1)) for _ in range(4)]
    assert compat.rank_accuracy(one_hot, [7] * 4, 0.2)[0] == 1
    costs = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, float("nan"))], "problem_id long, subkey int, value long, cost double")
    with pytest.raises(errors.RankError):
        rank.checked(costs, costs.limit(1).select("problem_id", "subkey", "value"))


def brute_message(f, nc, kinds, beliefs, dest):
    """The message by enumeration of all assignments of (result, operands)."""
    out = np.zeros(nc)
    for v in itertools.product(range(nc), repeat=len(beliefs)):
        if f(v, nc):
            out[v[dest]] += np.prod([b[x] for i, (b, x) in enumerate(zip(beliefs, v, strict=True)) if i != dest])
    del kinds
    return out / out.sum()


FACTORS = {
    "a = b ^ c": (8, lambda v, n: v[0] == v[1] ^ v[2]),
    "a = b & c": (8, lambda v, n: v[0] == v[1] & v[2]),
    "a = !b & c": (4, lambda v, n: v[0] == (n - 1 - v[1]) & v[2]),
    "a = b | !c": (4, lambda v, n: v[0] == v[1] | (n - 1 - v[2])),
    "a = b + c": (7, lambda v, n: v[0] == (v[1] + v[2]) % n),
    "a = -b + c": (7, lambda v, n: v[0] == (v[2] - v[1]) % n),
    "a = b * c": (5, lambda v, n: v[0] == v[1] * v[2] % n),
    "a = !b": (8, lambda v, n: v[0] == n - 1 - v[1]),
    "a = b": (5, lambda v, n: v[0] == v[1]),
    "a = t[b]": (4, lambda v, n: v[0] == (0, 0, 3, 1)[v[1]]),
    "g(a, b, c)": (3, lambda v, n: (v[0] + 2 * v[1] + v[2]) % n == 1),
}


@pytest.mark.parametrize("text", FACTORS)
def test_factor_messages_equal_enumeration(text):
    nc, holds = FACTORS[text]
    names = [n for n in "abc" if n in text]
    extra = "TABLE t = [0, 0, 3, 1]\n" * ("[" in text) + "GENERIC SINGLE g\n" * ("g(" in text)
    g = parse(f"NC {nc}\n" + "".join(f"VAR MULTI {n}\n" for n in names) + extra + f"PROPERTY f: {text}")
    generic = {"g": np.array([v for v in itertools.product(range(nc), repeat=3) if holds(v, nc)])} if "g(" in text else None
    s, n = Beliefs(g, 3, generic=generic), 3
    own = RNG.random((len(names), n, nc))
    for i, v in enumerate(names):
        s.set_evidence(v, own[i])
    s.propagate_all_vars()
    s.propagate_factor("f")
    for d, v in enumerate(names):
        got = s.get_belief_to_var(v, "f")
        for e in range(n):
            np.testing.assert_allclose(got[e], brute_message(holds, nc, None, own[:, e], d), atol=1e-9)


def test_public_operands_and_single_products():
    g = parse("NC 8\nVAR SINGLE k\nVAR MULTI x\nPUB MULTI p\nPROPERTY f: x = k ^ p")
    n = 40
    p = RNG.integers(0, 8, n)
    s, x = Beliefs(g, n, {"p": p}), RNG.random((n, 8))
    s.set_evidence("x", x)
    s.bp_acyclic("k")
    want = np.array([np.log(x[np.arange(n), k ^ p]).sum() for k in range(8)])
    np.testing.assert_allclose(s.get_distribution("k"), np.exp(want - want.max()) / np.exp(want - want.max()).sum(), atol=1e-9)
    with pytest.raises(errors.ShapeError):
        Beliefs(g, 2, {"p": [0, 8]})
    with pytest.raises(KeyError):
        Beliefs(g, 2)


def test_cycles_and_faults():
    assert not parse("NC 2\nVAR MULTI a\nVAR MULTI b\nPROPERTY a = b").is_cyclic(5)
    only_many = parse("NC 2\nVAR SINGLE k\nVAR SINGLE l\nVAR MULTI a\nPROPERTY a = k ^ l")
    assert not only_many.is_cyclic(1) and only_many.is_cyclic(2)
    assert parse("NC 2\nVAR MULTI a\nVAR MULTI b\nPROPERTY a = b\nPROPERTY b = !a").is_cyclic(1)
    for bad in ("VAR MULTI a", "NC 4\nVAR MULTI a\nPROPERTY a = q", "NC 4\nVAR MULTI a\nVAR MULTI a", "NC 4\nTABLE t = [0]", "NC 4\nVAR MULTI a\nVAR MULTI b\nPROPERTY a = b ^ b & a", "NC 5\nVAR MULTI a\nVAR MULTI b\nPROPERTY a = !b"):
        with pytest.raises(errors.GraphError):
            parse(bad)


def test_sanity_check_honours_signs():
    g = parse("NC 7\nVAR MULTI a\nVAR MULTI b\nVAR MULTI c\nPROPERTY f: a = b - c")
    g.sanity_check({}, {"a": [1, 5], "b": [3, 0], "c": [2, 2]})
    with pytest.raises(errors.GraphError):
        g.sanity_check({}, {"a": [5, 5], "b": [3, 0], "c": [2, 2]})


def test_transforms_undo_themselves():
    p = RNG.random((2, 16))
    np.testing.assert_allclose(K.walsh_hadamard(K.walsh_hadamard(p)) / 16, p)
    np.testing.assert_allclose(K.superset_sums(K.superset_sums(p), inverse=True), p)
    np.testing.assert_allclose(K.and_result_transform(K.and_result_transform(p)), p)


def test_simulated_traces_leak(spark):
    t = sources.simulated(spark, 400, ns=4)
    assert sources.shape(t) == (400, 4, 1)
    assert metrics.snr(stats.class_state(t)).agg(F.min("snr")).first()[0] > 0


def test_squares_beyond_63_bits_are_whole(spark):
    """Sums of squares past the range of a long, by both paths and after a merge; squares that do not fit raise."""
    big = 3_000_000_000
    rows = [(i, [big - i, -big], [i % 2]) for i in range(40)]
    t = spark.createDataFrame(rows, "trace_id long, samples array<long>, labels array<int>").repartition(3)
    for dense in (False, True):
        state = stats.class_state(t, dense=dense)
        for s in (state, stats.merge_class_states(*(stats.class_state(t.where(F.col("trace_id") % 3 == k), dense) for k in range(3)))):
            got = {(r["class"], r["sample"]): int(r["ss"]) for r in s.collect()}
            assert got == {(c, j): sum((r[1][j]) ** 2 for r in rows if r[2][0] == c) for c in (0, 1) for j in (0, 1)}
        with pytest.raises(Exception):  # noqa: B017
            stats.class_state(spark.createDataFrame([(0, [1 << 33], [0])], "trace_id long, samples array<long>, labels array<int>"), dense).collect()


def test_int16_extremes_by_both_paths(spark):
    rows = [(i, [(-32768, 32767)[(i + j) % 2] for j in range(6)], [i % 3]) for i in range(500)]
    t = spark.createDataFrame(rows, "trace_id long, samples array<smallint>, labels array<int>")
    a, b = (sorted(map(tuple, stats.class_state(t, d).collect())) for d in (False, True))
    assert a == b and sum(int(r[5]) for r in a if r[2] == 0) == sum(r[1][0] ** 2 for r in rows)
    assert stats.int_gram(np.full((70000, 1), -32768), np.full((70000, 1), -32768))[0, 0] == 70000 * (1 << 30)


def test_dense_moments_equal_two_passes(spark):
    r = np.random.default_rng(8)
    t = spark.createDataFrame([(i, r.integers(-500, 500, 5).tolist(), [i % 2]) for i in range(301)], "trace_id long, samples array<int>, labels array<int>").repartition(4)
    g = F.get("labels", F.lit(0))
    for other in (stats.dense_moments(t, g, 6), stats.merge_moments(stats.dense_moments(t.where("trace_id < 100"), g, 6), stats.dense_moments(t.where("trace_id >= 100"), g, 6))):
        want = {(x.grp, x["sample"]): [x.n, x["mean"], *x.cs] for x in stats.central_moments(stats.by_group(t, g), 6).collect()}
        got = {(x.grp, x["sample"]): [x.n, x["mean"], *x.cs] for x in other.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-3) for k in want)


def test_partitions_of_executions_change_nothing(spark):
    """A single key from 600 executions, whose losing classes lie far below the smallest double of a product."""
    r = np.random.default_rng(5)
    g = parse("NC 4\nVAR SINGLE k\nVAR MULTI x\nPUB SINGLE c\nPROPERTY x = k ^ c")
    p = r.dirichlet([4, 3, 3, 3], 600)
    given = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(p)], "exec long, node string, probs array<double>")
    shown = spark.createDataFrame([(None, "c", 3)], "exec long, node string, value int")
    logs = np.log(np.maximum(p, 1e-40)).sum(axis=0)[np.arange(4) ^ 3]
    want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    for partitions in (1, 7):
        (row,) = infer(g, given.repartition(partitions), ["k"], publics=shown).collect()
        assert np.allclose(row.probs, want, rtol=1e-6, atol=0)


def test_labels_of_their_own(spark):
    t = spark.createDataFrame([(1, [1]), (2, [2])], "trace_id long, samples array<int>")
    good = spark.createDataFrame([(1, [0]), (2, [1])], "trace_id long, labels array<int>")
    assert sources.join_labels(t, good).count() == 2
    for rows in ([(1, [0]), (1, [0])], [(1, [0])], [(1, [0]), (2, [1]), (3, [1])]):
        with pytest.raises(errors.ShapeError):
            sources.join_labels(t, spark.createDataFrame(rows, "trace_id long, labels array<int>"))


GRAPHS = {
    "xor chain": "NC 8\nVAR MULTI a\nVAR MULTI b\nVAR MULTI c\nVAR MULTI d\nPUB MULTI p\nPROPERTY f: a = b ^ c ^ p\nPROPERTY h: d = !a",
    "logic": "NC 8\nVAR MULTI a\nVAR MULTI b\nVAR MULTI c\nVAR MULTI d\nPUB SINGLE q\nPROPERTY f: a = !b & c & q\nPROPERTY h: d = a | !b",
    "sums": "NC 7\nVAR MULTI a\nVAR MULTI b\nVAR MULTI c\nVAR SINGLE k\nPUB MULTI p\nPROPERTY f: a = b - k + p\nPROPERTY h: c = a * k * p",
    "tables": "NC 4\nVAR MULTI a\nVAR MULTI b\nVAR SINGLE k\nVAR SINGLE l\nTABLE t = [0, 0, 3, 1]\nGENERIC SINGLE g\nGENERIC MULTI m\nPROPERTY f: a = t[b]\nPROPERTY g(a, k, b)\nPROPERTY o: m(b, k)\nPROPERTY s: l = k ^ k2\nVAR SINGLE k2",
}


@pytest.mark.parametrize("name", GRAPHS)
def test_message_tables_equal_arrays(spark, name):
    """Three loopy rounds on graphs with cycles: every message and distribution equals the array engine's."""
    g, r = parse(GRAPHS[name]), np.random.default_rng(len(name))
    n, nc = 5, g.nc
    publics = {p: r.integers(0, nc, n if multi else 1) for p, multi in g.publics.items()}
    generic = {x: [r.random((nc,) * 2) for _ in range(n)] if multi else r.random((nc,) * 3) for x, multi in g.generics.items()}
    own = {v: r.dirichlet(np.ones(nc), n if multi else 1) for v, multi in g.variables.items() if v not in ("d", "k2")}
    arrays = Beliefs(g, n, publics, generic)
    for v, d in own.items():
        arrays.set_evidence(v, d)
    arrays.bp_loopy(3, initialize_states=True)
    given = spark.createDataFrame([(e, v, own[v][e].tolist()) for v in own if g.variables[v] for e in range(n)], "exec long, node string, probs array<double>")
    shown = spark.createDataFrame([(e if g.publics[p] else None, p, int(v[e])) for p, v in publics.items() for e in range(len(v))], "exec long, node string, value int")
    singles = {v: own[v][0].tolist() for v in own if not g.variables[v]}
    got = {}
    for row in infer(g, given, list(g.variables), iterations=3, publics=shown, single_evidence=singles, generic=generic).collect():
        got.setdefault(row.node, {})[row.exec] = row.probs
    for v, multi in g.variables.items():
        want = arrays.get_distribution(v)
        found = np.array([got[v][e] for e in range(n)]) if multi else np.array(got[v][None])
        np.testing.assert_allclose(found, want, atol=1e-9)


def test_message_tables_name_what_is_missing(spark):
    g = parse("NC 4\nVAR MULTI a\nVAR MULTI b\nPUB MULTI p\nPROPERTY a = b ^ p")
    given = spark.createDataFrame([(0, "b", [0.25] * 4)], "exec long, node string, probs array<double>")
    with pytest.raises(KeyError):
        infer(g, given, ["a"])
    with pytest.raises(Exception, match="not below"):
        infer(g, given, ["a"], publics=spark.createDataFrame([(0, "p", 4)], "exec long, node string, value int")).collect()
    with pytest.raises(KeyError):
        infer(g, given.withColumn("node", F.lit("z")), ["a"], publics=spark.createDataFrame([(0, "p", 3)], "exec long, node string, value int"))


def test_a_group_of_jobs_can_be_cancelled(spark):
    import threading
    import time

    failed = []

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    def work():
        with compat.job_group("slow"):
            try:
                spark.range(4).mapInArrow(slow, "id long").count()
            except Exception as e:
                failed.append(str(e))

    thread = threading.Thread(target=work)
    began = time.monotonic()
    thread.start()
    while not spark.sparkContext.statusTracker().getJobIdsForGroup("slow") and time.monotonic() - began < 30:
        time.sleep(0.1)
    time.sleep(1)
    compat.cancel("slow")
    thread.join(40)
    assert not thread.is_alive() and "cancel" in failed[0].lower()


def test_clustered_models_are_saved(spark, tmp_path):
    model = models.RldaModel(5, RNG.normal(0, 1, (2, 4)), RNG.normal(0, 1, (2, 6)))
    x, y = RNG.integers(-5, 5, (20, 4)).astype(np.int16), RNG.integers(0, 32, 20)
    for keep in (True, False):
        own = model.clustered(spark, 0.8, keep_members=keep)
        own.save(spark, f"{tmp_path}/{keep}")
        again = models.ClusteredModel.load(spark, f"{tmp_path}/{keep}")
        np.testing.assert_allclose(again.bounded(x, y, 6), own.bounded(x, y, 6))
        assert (again.owner is None) == (not keep) and again.get_size() == own.get_size()
