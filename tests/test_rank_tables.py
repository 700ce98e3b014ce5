"""Merging subkeys and convolving in ranges, against enumeration and exact whole numbers."""

import itertools

import numpy as np
import pytest

from tracewell.operators import rank

RNG = np.random.default_rng(23)


def problem(spark, sizes, problem_id=0):
    costs = [(problem_id, k, v, float(RNG.integers(0, 1000)) / 8) for k, n in enumerate(sizes) for v in range(n)]
    truth = [(problem_id, k, int(RNG.integers(n))) for k, n in enumerate(sizes)]
    return costs, truth


def tables(spark, *problems):
    costs, truth = ([r for p in problems for r in p[i]] for i in (0, 1))
    return spark.createDataFrame(costs, "problem_id long, subkey int, value long, cost double"), spark.createDataFrame(truth, "problem_id long, subkey int, value long")


def test_ragged_subkeys_merge_up_to_a_length(spark):
    a, b = problem(spark, [3, 5, 2, 7, 1, 40, 2]), problem(spark, [2, 2, 2], 1)
    costs, truth = tables(spark, a, b)
    groups = {(r.problem_id, r.subkey): (r.grp, r.place) for r in rank.merge_groups(costs, 30).collect()}
    assert [groups[0, k] for k in range(7)] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert [groups[1, k] for k in range(3)] == [(0, 0), (0, 1), (0, 2)]
    merged, key = rank.auto_merge(costs, truth, 30)
    got = {(r.problem_id, r.subkey, r.value): r.cost for r in merged.collect()}
    of = lambda p, k: [c for _, s, _, c in p[0] if s == k]
    want = {}
    for p, pid, own in ((a, 0, [[0, 1, 2], [3, 4], [5], [6]]), (b, 1, [[0, 1, 2]])):
        for g, members in enumerate(own):
            for n, combination in enumerate(itertools.product(*(of(p, k) for k in members))):
                want[pid, g, n] = sum(combination)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    true = {k: v for _, k, v in a[1]}
    assert {(r.subkey, r.value) for r in key.where("problem_id = 0").collect()} == {(0, (true[0] * 5 + true[1]) * 2 + true[2]), (1, true[3] + true[4]), (2, true[5]), (3, true[6])}
    few = rank.auto_merge(*tables(spark, problem(spark, [4, 3, 5])), 12)
    assert rank.naive_rank(*few, [0, 1]).count() == 1


def exact_histogram(bins, counts, n_bins):
    out = {0: 1}
    for own, c in zip(bins, counts):
        new = {}
        for b, n in out.items():
            for at, m in zip(own.tolist(), c.tolist()):
                if b + at < n_bins:
                    new[b + at] = new.get(b + at, 0) + n * int(m)
        out = new
    return out


def ranges(spark, bins, counts, width):
    rows = [(0, int(b), float(c)) for b, c in zip(bins, counts)]
    return rank.ranges_of(spark.createDataFrame(rows, "problem_id long, bin long, c double"), width)


@pytest.mark.parametrize("n_bins,width,filled", [(100, 16, 40), (1 << 22, 1 << 18, 300), (5000, 1024, 900)])
def test_ranges_convolve_to_exact_counts(spark, n_bins, width, filled):
    """Sparse and dense ranges, up to 2^22 bins."""
    bins = [np.sort(RNG.choice(n_bins // 2, min(filled, n_bins // 2), replace=False)) for _ in range(2)]
    counts = [RNG.integers(1, 50, len(b)) for b in bins]
    a, b = (ranges(spark, x, c, width) for x, c in zip(bins, counts))
    got = {}
    for r in rank.convolved_ranges(a, b, n_bins, width).collect():
        got.update({r.chunk * width + at: c for at, c in zip(r["at"], r.c)})
    want = exact_histogram(bins, counts, -(-n_bins // width) * width)
    assert got == want


def test_partitioned_rank_equals_the_relational_one(spark):
    problems = [problem(spark, [40, 30, 50], i) for i in range(3)]
    costs, truth = tables(spark, *problems)
    for n_bins, width in ((64, 16), (300, 64), (300, 4096)):
        got, want = (sorted(map(tuple, r.collect())) for r in (rank.partitioned_histogram_rank(costs, truth, [0, 1, 2], n_bins, width), rank.relational_histogram_rank(costs, truth, [0, 1, 2], n_bins)))
        assert got == want


@pytest.mark.parametrize("method", ["hist", "scaledhist", "histbignum"])
def test_problems_of_all_methods_equal_the_array_form(spark, method):
    """Ragged problems of one to five subkeys beside each other; five of 40 values hold more combinations than 2^26."""
    problems = [problem(spark, sizes, i) for i, sizes in enumerate(([40] * 5, [3, 70, 1, 9], [30], [100, 100]))]
    costs, truth = tables(spark, *problems)
    for n_bins, width in ((64, 16), (700, 256)):
        got = {r[0]: r[1:] for r in rank.histogram_rank(costs, truth, n_bins, method, width=width).collect()}
        assert len(got) == len(problems)
        for i, (own, key) in enumerate(problems):
            lists = [np.array([c for _, s, _, c in own if s == k]) for k in range(len(key))]
            assert got[i] == pytest.approx(rank.rank_bins(lists, [v for _, _, v in key], n_bins, method), rel=1e-9)


@pytest.mark.parametrize("method", ["scaledhist", "histbignum"])
def test_accuracy_closes_each_problem_at_its_own_bins(spark, method):
    problems = [problem(spark, sizes, i) for i, sizes in enumerate(([12] * 3, [40, 40], [5]))]
    costs, truth = tables(spark, *problems)
    got = {r[0]: r[1:] for r in rank.accuracy_rank(costs, truth, 0.4, method, 1 << 12, max_len=None, width=64).collect()}
    for i, (own, key) in enumerate(problems):
        lists = [np.array([c for _, s, _, c in own if s == k]) for k in range(len(key))]
        assert got[i] == pytest.approx(rank.rank_to_accuracy(lists, [v for _, _, v in key], 0.4, method, 1 << 12, 1), rel=1e-9)


def test_exact_counts_pass_the_doubles(spark):
    """Sixteen subkeys of equal costs: all 40^16 combinations fall into one bin, beyond 2^53 and 38 digits of squares."""
    costs = spark.createDataFrame([(7, k, v, 1.0) for k in range(16) for v in range(40)], "problem_id long, subkey int, value long, cost double")
    truth = spark.createDataFrame([(7, k, 3) for k in range(16)], "problem_id long, subkey int, value long")
    assert [tuple(r) for r in rank.histogram_rank(costs, truth, 32, "histbignum").collect()] == [(7, 1.0, float(40**16 // 2), float(40**16))]


def test_rank_tables_empty_infinite_and_wrong(spark):
    costs, truth = tables(spark, problem(spark, [4, 4]))
    none = [t.limit(0) for t in (costs, truth)]
    assert rank.histogram_rank(*none, 64).isEmpty() and rank.accuracy_rank(*none).isEmpty()
    more = costs.unionByName(spark.createDataFrame([(0, 0, 4, float("inf")), (0, 9, 0, 1.0)], costs.schema))
    assert rank.histogram_rank(more, truth, 64).collect() == rank.histogram_rank(costs, truth, 64).collect()
    for bad in (lambda: rank.histogram_rank(costs, truth, 2), lambda: rank.histogram_rank(costs, truth, 64, "other"), lambda: rank.accuracy_rank(costs, truth, max_bins=8)):
        with pytest.raises(rank.RankError):
            bad()
    with pytest.raises(rank.RankError):
        rank.histogram_rank(costs.withColumn("cost", costs["cost"] * float("nan")), truth, 64)
