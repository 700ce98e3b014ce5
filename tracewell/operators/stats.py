"""Mergeable accumulators: state tables from traces, by relational aggregation or dense Arrow partials.

``class_state`` is the one state behind signal-to-noise ratios, correlations and class means:
(var, class, sample, n, s, ss), sums of samples and squares by class, all integers, so merging is
a sum and independent of partitioning. Squares are summed in two halves of 32 bits and kept with 38
digits: samples may reach MAX_SAMPLE in magnitude and rows 2^31 a task; beyond that a sum raises, it
never wraps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError

#: From this many samples times labels a trace on, dense partials beat exploded rows.
DENSE_FROM = 256
STATE = "var int, class int, sample int, n long, s long, ss decimal(38,0)"
#: The largest magnitude whose square fits 63 bits.
MAX_SAMPLE = 3_037_000_499


def exploded(traces: DataFrame) -> DataFrame:
    """(trace_id, labels, sample, x): one row for each sample."""
    return traces.select("trace_id", "labels", F.posexplode("samples").alias("sample", "x")).withColumn("x", F.col("x").cast("long"))


def halves(square: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of a square: their sums cannot overflow where the square does not."""
    return F.shiftright(square, 32), square.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def joined(high: Column, low: Column) -> Column:
    """The whole number of 38 digits of sums of high and low halves."""
    return (high.cast("decimal(27,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def class_state(traces: DataFrame, dense: bool = False) -> DataFrame:
    """Sums by label, class and sample. ``dense`` picks NumPy partials, one set of rows for each task."""
    if dense:
        return merge_class_states(dense_class_state(traces))
    rows = exploded(traces).select("sample", "x", F.posexplode(F.col("labels").cast("array<int>")).alias("var", "class"))
    high, low = halves(F.col("x") * F.col("x"))
    sums = rows.groupBy("var", "class", "sample").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(high).alias("high"), F.sum(low).alias("low"))
    return sums.select("var", "class", "sample", "n", "s", joined(F.col("high"), F.col("low")).alias("ss"))


def dense_class_state(traces: DataFrame) -> DataFrame:
    """Partial states, unmerged: each task holds one dense block for each class of each label that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if x.size and max(int(x.max()), -int(x.min())) > MAX_SAMPLE:
                raise ShapeError("a sample's square does not fit 63 bits")
            for var in range(y.shape[1]):
                order = np.argsort(y[:, var], kind="stable")
                classes, starts, counts = np.unique(y[order, var], return_index=True, return_counts=True)
                own = x[order]
                sums, square = np.add.reduceat(own, starts, axis=0), own * own
                high, low = np.add.reduceat(square >> 32, starts, axis=0), np.add.reduceat(square & 0xFFFFFFFF, starts, axis=0)
                for c, n, *new in zip(classes.tolist(), counts.tolist(), sums, high, low, strict=True):
                    old = held.setdefault((var, c), [0, 0, 0, 0])
                    old[0] += n
                    old[1:] = [u + v for u, v in zip(old[1:], new, strict=True)]
        for (var, c), (n, s, high, low) in held.items():
            k = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, var, np.int32)), pa.array(np.full(k, c, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, n)), pa.array(s), pa.array(high), pa.array(low)], ["var", "class", "sample", "n", "s", "high", "low"])

    parts = traces.select(F.col("samples").cast("array<long>"), F.col("labels").cast("array<int>")).mapInArrow(run, "var int, class int, sample int, n long, s long, high long, low long")
    return parts.select("var", "class", "sample", "n", "s", joined(F.col("high"), F.col("low")).alias("ss"))


def merge_class_states(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy("var", "class", "sample").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").cast("decimal(38,0)").alias("ss"))


def totals(state: DataFrame) -> DataFrame:
    """(var, sample, n, s, ss) over all classes."""
    return state.groupBy("var", "sample").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").cast("decimal(38,0)").alias("ss"))


def class_means(state: DataFrame) -> DataFrame:
    return state.select("var", "class", "sample", (F.col("s") / F.col("n")).alias("mean"))


def class_counts(traces: DataFrame) -> DataFrame:
    return traces.select(F.posexplode("labels").alias("var", "class")).groupBy("var", "class").agg(F.count("*").alias("n"))


def by_group(traces: DataFrame, group: Column) -> DataFrame:
    """(grp, sample, x) with one group a trace."""
    return traces.select(group.cast("int").alias("grp"), F.posexplode("samples").alias("sample", "x")).withColumn("x", F.col("x").cast("double"))


def central_moments(rows: DataFrame, order: int) -> DataFrame:
    """(grp, sample, n, mean, cs): two passes, means first; cs[p] is the sum of (x - mean)^p, p up to ``order``.

    The means, as many numbers as a trace has samples for each group, are broadcast: rows stay put.
    """
    means = rows.groupBy("grp", "sample").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    d = F.col("x") - F.col("mean")
    powers = [F.sum(reduce(lambda a, b: a * b, [d] * p)).alias(f"c{p}") for p in range(2, order + 1)]
    sums = rows.join(F.broadcast(means), ["grp", "sample"]).groupBy("grp", "sample").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *powers)
    return sums.select("grp", "sample", "n", "mean", F.array(F.col("n").cast("double"), F.lit(0.0), *(F.col(f"c{p}") for p in range(2, order + 1))).alias("cs"))


def dense_moments(traces: DataFrame, group: Column, order: int) -> DataFrame:
    """The state of ``central_moments`` straight from trace vectors: each task keeps one dense block for each group.

    Batches are merged in the task, tasks by ``merge_moments``: one pass over the traces, no row for each sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for k in np.unique(g).tolist():
                own = x[g == k]
                mean = own.mean(axis=0)
                d, power, cs = own - mean, np.ones_like(own), []
                for p in range(order + 1):
                    cs.append(power.sum(axis=0) if p != 1 else np.zeros(len(mean)))
                    power = power * d
                held[k] = merged_moments(held[k], (len(own), mean, cs)) if k in held else (len(own), mean, cs)
        for k, (n, mean, cs) in held.items():
            ns = len(mean)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(ns + 1) * (order + 1), pa.int32()), pa.array(np.stack(cs, axis=1).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(ns, k, np.int32)), pa.array(np.arange(ns, dtype=np.int32)), pa.array(np.full(ns, n)), pa.array(mean), lists], ["grp", "sample", "n", "mean", "cs"])

    parts = traces.select(group.cast("int").alias("grp"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, "grp int, sample int, n long, mean double, cs array<double>")
    return merge_moments(parts, order=order)


def merged_moments(a: tuple, b: tuple) -> tuple:
    """Two groups' (n, mean, central sums by power) as one, by the binomial shift rule."""
    n = a[0] + b[0]
    mean = a[1] + (b[1] - a[1]) * (b[0] / n)
    out = []
    for p in range(len(a[2])):
        moved = [sum(comb(p, k) * cs[k] * (m - mean) ** (p - k) for k in range(p + 1)) for _, m, cs in (a, b)]
        out.append(moved[0] + moved[1] if p != 1 else np.zeros_like(mean))
    return n, mean, out


def merge_moments(*states: DataFrame, order: int | None = None) -> DataFrame:
    """States of any number of batches as one: central sums are shifted to the common mean by the binomial rule."""
    if order is None:
        one = states[0].select(F.size("cs").alias("k")).first()
        if one is None:
            return reduce(DataFrame.unionByName, states)
        order = one.k - 1
    top = order
    both = reduce(DataFrame.unionByName, states)
    common = both.groupBy("grp", "sample").agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_all"))
    shift = F.col("mean") - F.col("mean_all")
    moved = [F.sum(sum((F.lit(float(comb(p, k))) * F.get("cs", F.lit(k)) * F.pow(shift, F.lit(float(p - k))) for k in range(p + 1)), F.lit(0.0))).alias(f"c{p}") for p in range(2, top + 1)]
    merged = both.join(common, ["grp", "sample"]).groupBy("grp", "sample").agg(F.first("n_all").alias("n"), F.first("mean_all").alias("mean"), *moved)
    return merged.select("grp", "sample", "n", "mean", F.array(F.col("n").cast("double"), F.lit(0.0), *(F.col(f"c{p}") for p in range(2, top + 1))).alias("cs"))


def int_gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact int64 product a^T b of integer matrices: float products, in slices short enough for 53 bits."""
    top = int(max(1, np.abs(a).max(initial=0))) * int(max(1, np.abs(b).max(initial=0)))
    if top > 1 << 52:
        return a.astype(np.int64).T @ b.astype(np.int64)
    step, out = max(1, min(len(a), (1 << 53) // top)), np.zeros((a.shape[1], b.shape[1]), np.int64)
    for i in range(0, len(a), step):
        out += (a[i : i + step].astype(np.float64).T @ b[i : i + step].astype(np.float64)).astype(np.int64)
    return out


def pair_scatter(traces: DataFrame, points: list[int], dense: bool = True) -> DataFrame:
    """(i, j, n, sxy), i <= j positions among the points: sums of products over all traces."""
    cut = traces.select("trace_id", F.transform(F.array(*map(F.lit, points)), lambda i: F.get("samples", i)).alias("v"))
    if not dense:
        long = cut.select("trace_id", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("long"))
        pairs = long.alias("a").join(long.alias("b"), (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.i") <= F.col("b.i")))
        return pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count("*").alias("n"), F.sum(F.col("a.x") * F.col("b.x")).alias("sxy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = len(points), 0
        total = np.zeros((k, k), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += int_gram(v, v)
                n += len(v)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(total[i, j])], ["i", "j", "n", "sxy"])

    partial = cut.select(F.col("v").cast("array<long>")).mapInArrow(run, "i int, j int, n long, sxy long")
    return partial.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("sxy").alias("sxy"))


def powers_of(d: int) -> list[tuple[int, ...]]:
    """The exponents 0 to 2 of each of d points, in a fixed order: what a product statistic's state keeps."""
    return list(product(range(3), repeat=d))


def tuple_moments(traces: DataFrame, group: Column, tuples: list[list[int]]) -> DataFrame:
    """(grp, tuple_id, n, means, cs): for each tuple of d samples the sums of products of its centred samples' powers.

    ``cs`` follows ``powers_of``. Means of all samples come first; then each task turns its traces
    into one dense block for each group, so that rows grow with tuples and tasks, not with traces.
    The tuples are parameters. States merge by ``merge_tuple_moments``.
    """
    d = len(tuples[0])
    cut = traces.select(group.cast("int").alias("grp"), F.col("samples").cast("array<double>").alias("samples"))
    points, place = np.array(tuples, np.int64).reshape(-1, d), {}
    used = np.unique(points)
    place = np.searchsorted(used, points)

    def picked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if len(used) and used[-1] >= x.shape[1]:
            raise ShapeError("a point is out of bounds")
        return batch.column(0).to_numpy(zero_copy_only=False), x[:, used]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                g, x = picked(batch)
                for k in np.unique(g).tolist():
                    own = held.setdefault(k, [0, np.zeros(x.shape[1])])
                    own[0] += int((g == k).sum())
                    own[1] = own[1] + x[g == k].sum(axis=0)
        for k, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(np.full(len(s), n)), pa.array(s)], ["grp", "at", "n", "s"])

    sums = cut.mapInArrow(first, "grp int, at int, n long, s double").groupBy("grp", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a trace's length for each group
    counts = {r.grp: r.n for r in sums}
    means = {g: np.zeros(len(used)) for g in counts}
    for r in sums:
        means[r.grp][r["at"]] = r.s / r.n
    exponents = powers_of(d)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g, x = picked(batch)
            for k in np.unique(g).tolist():
                centred = x[g == k] - means[k]
                total = held.setdefault(k, np.zeros((len(exponents), len(points))))
                step = max(1, (1 << 22) // max(1, len(centred)))
                for a in range(0, len(points), step):
                    own = [centred[:, place[a : a + step, j]] for j in range(d)]
                    square = [o * o for o in own]
                    for i, e in enumerate(exponents):
                        p = None
                        for j, q in enumerate(e):
                            if q:
                                f = own[j] if q == 1 else square[j]
                                p = f if p is None else p * f
                        total[i, a : a + step] += len(centred) if p is None else p.sum(axis=0)
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), k, np.int32)), pa.array(np.arange(len(points), dtype=np.int32)), *(pa.array(row) for row in total)], ["grp", "tuple_id", *(f"c{i}" for i in range(len(exponents)))])

    names = [f"c{i}" for i in range(len(exponents))]
    summed = cut.mapInArrow(second, "grp int, tuple_id int, " + ", ".join(f"{n} double" for n in names)).groupBy("grp", "tuple_id").agg(*(F.sum(n).alias(n) for n in names))
    at = traces.sparkSession.createDataFrame([(g, t, counts[g], m[place[t]].tolist()) for g, m in means.items() for t in range(len(points))], "grp int, tuple_id int, n long, means array<double>")
    return summed.join(at, ["grp", "tuple_id"]).select("grp", "tuple_id", "n", "means", F.array(*names).alias("cs"))


def merge_tuple_moments(*states: DataFrame, d: int) -> DataFrame:
    """States of any number of batches as one: sums of products are moved to the common means by the shift rule of each point."""
    both = reduce(DataFrame.unionByName, states)
    common = both.groupBy("grp", "tuple_id").agg(F.sum("n").alias("n_all"), *((F.sum(F.col("n") * F.get("means", F.lit(j))) / F.sum("n")).alias(f"m{j}") for j in range(d)))
    exponents = powers_of(d)
    where = {e: i for i, e in enumerate(exponents)}
    shift = [F.get("means", F.lit(j)) - F.col(f"m{j}") for j in range(d)]

    def moved(e: tuple[int, ...]) -> Column:
        terms = []
        for f in product(*(range(q + 1) for q in e)):
            term = F.get("cs", F.lit(where[f])) * F.lit(float(np.prod([comb(q, r) for q, r in zip(e, f, strict=True)])))
            for j, (q, r) in enumerate(zip(e, f, strict=True)):
                for _ in range(q - r):
                    term = term * shift[j]
            terms.append(term)
        return reduce(lambda a, b: a + b, terms)

    merged = both.join(common, ["grp", "tuple_id"]).groupBy("grp", "tuple_id").agg(F.first("n_all").alias("n"), F.array(*(F.first(f"m{j}") for j in range(d))).alias("means"), F.array(*(F.sum(moved(e)) for e in exponents)).alias("cs"))
    return merged.select("grp", "tuple_id", "n", "means", "cs")


def used_bits(traces: DataFrame) -> DataFrame:
    """(sample, used): the bits that any magnitude of a sample sets."""
    return exploded(traces).groupBy("sample").agg(F.bit_or(F.abs("x")).alias("used"))
