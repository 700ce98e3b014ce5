"""Key rank from per-subkey costs: exact enumeration, histograms by convolution, bounds.

Costs are (problem_id, subkey, value, cost), the truth (problem_id, subkey, value). A rank is the
number of value combinations that cost no more than the true one, so it starts at 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RankError
from ..sources.scratch import Scratch

SCALE_TO = 2.0**26
MAX_BINS = 1 << 26


def checked(costs: DataFrame, truth: DataFrame) -> None:
    """Costs are numbers above minus infinity, and the true values' are finite."""
    if costs.where(F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") == float("-inf"))).limit(1).count():
        raise RankError("a cost is null, NaN or minus infinity")
    own = truth.join(costs, ["problem_id", "subkey", "value"], "left")
    if own.where(F.col("cost").isNull() | (F.col("cost") == float("inf"))).limit(1).count():
        raise RankError("a true value has no finite cost")


def naive_rank(costs: DataFrame, truth: DataFrame, subkeys: list[int]) -> DataFrame:
    """(problem_id, rank) by enumeration: a chain of joins, one for each subkey; for few combinations only."""
    everything = None
    for k in subkeys:
        own = costs.where(F.col("subkey") == k).select("problem_id", F.col("cost").alias("c"))
        if everything is None:
            everything = own.withColumnRenamed("c", "cost")
        else:
            everything = everything.join(own, "problem_id").select("problem_id", (F.col("cost") + F.col("c")).alias("cost"))
    key = truth.where(F.col("subkey").isin(subkeys)).join(costs, ["problem_id", "subkey", "value"]).groupBy("problem_id").agg(ordered_sum().alias("key_cost"))
    return everything.join(key, "problem_id").groupBy("problem_id").agg(F.count_if(F.col("cost") <= F.col("key_cost")).alias("rank"))


def ordered_sum():
    """Costs of a key added in the order of its subkeys, as enumeration adds them."""
    rows = F.array_sort(F.collect_list(F.struct("subkey", "cost")))  # one entry for each subkey
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["cost"])


def merged(costs: list[np.ndarray], key: list[int], merge: int) -> tuple[list[np.ndarray], list[int]]:
    """Groups of ``merge`` subkeys as one: sums of costs, first most significant."""
    out_costs, out_key = [], []
    for i in range(0, len(costs), merge):
        total, at = costs[i], key[i]
        for c, k in zip(costs[i + 1 : i + merge], key[i + 1 : i + merge], strict=True):
            total = (total[:, None] + c[None, :]).reshape(-1)
            at = at * len(c) + k
        out_costs.append(total)
        out_key.append(at)
    return out_costs, out_key


def choose_merge(costs: list[np.ndarray]) -> int:
    longest = max(map(len, costs))
    return min(len(costs), max(1, int(16 / math.log2(longest)))) if longest > 1 else 1


def rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero; NaN and negatives are bin 0."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(x) | (x < 0), 0, np.floor(x + 0.5))


def convolve(hists: list, exact: bool, n_bins: int):
    out = hists[0]
    for h in hists[1:]:
        out = exact_product(out, h, n_bins) if exact else fft_product(out, h, n_bins)
    return out


def fft_product(a: np.ndarray, b: np.ndarray, n_bins: int) -> np.ndarray:
    size = 1 << max(1, (2 * n_bins - 1).bit_length())
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n_bins].round(), 0)


def exact_product(a: list[int], b: list[int], n_bins: int) -> list[int]:
    """Polynomials as one big integer each: a product of two numbers convolves exactly."""
    width = (max(a).bit_length() + max(b).bit_length() + n_bins.bit_length() + 8) // 8
    pack = lambda v: int.from_bytes(b"".join(int(x).to_bytes(width, "little") for x in v), "little")
    product = (pack(a) * pack(b)).to_bytes(2 * n_bins * width + 8, "little")
    return [int.from_bytes(product[i * width : (i + 1) * width], "little") for i in range(n_bins)]


def rank_bins(costs: list[np.ndarray], key: list[int], n_bins: int, method: str = "hist", merge: int = 1) -> tuple[float, float, float]:
    """(least, estimate, greatest) rank with a fixed number of bins.

    Costs are shifted to start at 0 and binned by rounding; bins beyond the key's are dropped. A
    bin's error is half a bin for each merged subkey, which bounds the rank from both sides.
    """
    costs = [np.asarray(c, float) - np.min(c) for c in costs]
    costs, key = merged(costs, key, merge)
    m = len(costs)
    key_cost = float(sum(c[k] for c, k in zip(costs, key, strict=True)))
    margin = math.ceil(m / 2)
    if n_bins - margin - 1 <= 0:
        raise RankError("too few bins")
    size = key_cost / (n_bins - margin - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bins = [rounded(c / size) if size else np.where(c == 0, 0, np.inf) for c in costs]
    hists = [np.bincount(b[b < n_bins].astype(np.int64), minlength=n_bins).astype(float) for b in bins]
    at = key_cost / size if size else 0.0
    low, high = (int(max(0, min(n_bins - 1, f(x)))) for f, x in ((math.ceil, at - m / 2), (math.floor, at + m / 2)))
    middle = int(min(n_bins - 1, rounded(np.array(at))))
    if method in ("histbignum", "ntl"):
        total = convolve([[int(x) for x in h] for h in hists], True, n_bins)
        before = lambda b: sum(total[:b])
        least, most = 1 + before(low), before(high + 1)
        guess = max(least, before(middle) + (total[middle] + 1) // 2)
        return float(least), float(guess), float(max(most, least))
    if method == "hist":
        total = convolve(hists, False, n_bins)
        least, most = 1 + total[:low].sum(), total[: high + 1].sum()
        guess = max(least, total[:middle].sum() + math.ceil(total[middle] / 2))
        return float(least), float(guess), float(max(most, least))
    if method == "scaledhist":
        (lower, upper), scale = scaled_pair(hists[0])
        for h in hists[1:]:
            (a, b), s = scaled_pair(h)
            lower, upper, scale = fft_product(lower, a, n_bins), fft_product(upper, b, n_bins), scale * s
            if (top := upper.sum()) > SCALE_TO:
                lower, upper, scale = np.floor(lower * (SCALE_TO / top)), np.ceil(upper * (SCALE_TO / top)), scale * (top / SCALE_TO)
        least, most = 1 + lower[:low].sum() * scale, upper[: high + 1].sum() * scale
        guess = (sum(h[:middle].sum() + math.ceil(h[middle] / 2) for h in (lower, upper)) / 2) * scale
        return float(least), float(max(least, guess)), float(max(most, least))
    raise RankError(f"unknown method {method}")


def scaled_pair(h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    total = h.sum()
    if total <= SCALE_TO:
        return (h, h), 1.0
    f = SCALE_TO / total
    return (np.floor(h * f), np.ceil(h * f)), 1 / f


def rank_to_accuracy(costs: list[np.ndarray], key: list[int], accuracy: float = 1.0, method: str = "scaledhist", max_bins: int = MAX_BINS, merge: int | None = None) -> tuple[float, float, float]:
    """Bins are doubled from 16 until greatest and least rank lie within ``accuracy`` bits."""
    merge = merge or choose_merge(costs)
    bins, best = 16, None
    while bins <= max_bins:
        try:
            best = rank_bins(costs, key, bins, method, merge)
        except RankError:
            best = None
        if best and math.log2(best[2]) - math.log2(best[0]) <= accuracy:
            break
        bins *= 2
    if best is None:
        raise RankError("too few bins allowed")
    return best


def merge_groups(costs: DataFrame, max_len: int) -> DataFrame:
    """(problem_id, subkey, grp, place, size): subkeys in order, as many in a group as keep its combinations at ``max_len`` or fewer, one at least.

    A subkey's size is its greatest value plus one; sizes may differ. One row for each subkey of a
    problem is gathered, no costs.
    """
    sizes = costs.groupBy("problem_id", "subkey").agg((F.max("value") + 1).cast("long").alias("size"))
    lists = sizes.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("subkey", "size"))).alias("x"))
    start = F.struct(F.lit(-1).alias("grp"), F.lit(0).alias("place"), F.lit(0).cast("decimal(38,0)").alias("product"), F.array().cast("array<struct<subkey:int,size:bigint,grp:int,place:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["grp"] >= 0) & (a["product"] * x["size"] <= max_len)
        grp, place = F.when(joins, a["grp"]).otherwise(a["grp"] + 1), F.when(joins, a["place"] + 1).otherwise(0)
        product = F.when(joins, (a["product"] * x["size"]).cast("decimal(38,0)")).otherwise(x["size"].cast("decimal(38,0)"))
        row = F.struct(x["subkey"].cast("int").alias("subkey"), x["size"].alias("size"), grp.alias("grp"), place.alias("place"))
        return F.struct(grp.alias("grp"), place.alias("place"), product.alias("product"), F.concat(a["out"], F.array(row)).alias("out"))

    return lists.select("problem_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("g")).select("problem_id", "g.*")


def auto_merge(costs: DataFrame, truth: DataFrame, max_len: int) -> tuple[DataFrame, DataFrame]:
    """(costs, truth) with the subkeys of a group as one: sums of costs over all combinations, the first subkey most significant.

    One join for each further subkey of a group; a group's rows are bounded by ``max_len``, which
    also bounds what a problem's key multiplies.
    """
    groups = merge_groups(costs, max_len)
    most = groups.agg(F.max("place")).first()[0] or 0
    rows = costs.join(groups, ["problem_id", "subkey"])
    keys = truth.join(groups, ["problem_id", "subkey"])
    out, key = None, None
    for place in range(most + 1):
        own = rows.where(F.col("place") == place).select("problem_id", "grp", F.col("value").cast("long").alias("v"), F.col("cost").alias("c"), "size")
        right = keys.where(F.col("place") == place).select("problem_id", "grp", F.col("value").cast("long").alias("v"), "size")
        if out is None:
            out, key = own.select("problem_id", "grp", F.col("v").alias("value"), F.col("c").alias("cost")), right.select("problem_id", "grp", F.col("v").alias("value"))
        else:  # groups that end before this place stay as they are
            out = out.join(own, ["problem_id", "grp"], "left").select("problem_id", "grp", F.coalesce(F.col("value") * F.col("size") + F.col("v"), F.col("value")).alias("value"), F.coalesce(F.col("cost") + F.col("c"), F.col("cost")).alias("cost"))
            key = key.join(right, ["problem_id", "grp"], "left").select("problem_id", "grp", F.coalesce(F.col("value") * F.col("size") + F.col("v"), F.col("value")).alias("value"))
    return out.withColumnRenamed("grp", "subkey"), key.withColumnRenamed("grp", "subkey")


RANGE = "problem_id long, kind int, chunk long, scale double, at array<int>, c array<{}>"
RANKS = "problem_id long, least double, estimate double, greatest double"
#: Up to so many filled bins a range is convolved by shifting and adding; beyond, by Fourier transforms or one product of whole numbers.
SPARSE = 64
#: Bins in a range: counts as doubles, and as whole numbers of any size.
WIDTH, WIDTH_EXACT = 1 << 18, 1 << 12
#: Subkeys are merged up to so many combinations where that is asked for.
MERGE_TO = 1 << 16
EXACT = ("histbignum", "ntl")
METHODS = ("hist", "scaledhist", *EXACT)


def counts_in(values: pa.ListScalar, exact: bool) -> np.ndarray:
    """A range's counts: doubles, or Python's whole numbers from big-endian bytes."""
    return np.array([int.from_bytes(x) for x in values.as_py()] + [0], object)[:-1] if exact else values.values.to_numpy(zero_copy_only=False)


def counts_out(values: np.ndarray, exact: bool) -> list[bytes] | np.ndarray:
    return [int(x).to_bytes((int(x).bit_length() + 7) // 8) for x in values] if exact else values


def ranges_of(hist: DataFrame, width: int, exact: bool = False) -> DataFrame:
    """(problem_id, kind, chunk, scale, at, c): bins cut into ranges of ``width``, as places within the range and counts."""
    count = F.unhex(F.hex(F.col("c").cast("long"))) if exact else F.col("c").cast("double")
    place = F.struct(F.pmod("bin", F.lit(width)).cast("int").alias("at"), count.alias("c"))
    rows = hist.groupBy("problem_id", F.expr(f"bin div {width}").alias("chunk")).agg(F.sort_array(F.collect_list(place)).alias("x"))  # at most ``width`` bins
    return rows.select("problem_id", F.lit(0).alias("kind"), "chunk", F.lit(1.0).alias("scale"), F.transform("x", lambda e: e["at"]).alias("at"), F.transform("x", lambda e: e["c"]).alias("c"))


def range_product(at: np.ndarray, c: np.ndarray, at2: np.ndarray, c2: np.ndarray, width: int) -> np.ndarray:
    """The 2 ``width`` bins of two ranges' convolution. Fourier transforms are rounded to whole counts; their error is about 1e-16 times the sum of all products."""
    if len(at) > len(at2):
        at, c, at2, c2 = at2, c2, at, c
    exact = c.dtype == object
    if len(at) <= SPARSE:
        out = np.zeros(2 * width, c.dtype)
        for shift, n in zip(at.tolist(), c.tolist(), strict=True):
            out[at2 + shift] += n * c2
        return out
    dense = np.zeros((2, width), c.dtype)
    dense[0, at], dense[1, at2] = c, c2
    if exact:
        return np.array(exact_product(dense[0].tolist(), dense[1].tolist(), 2 * width), object)
    spectrum = np.fft.rfft(dense, 2 * width, axis=1)
    return np.maximum(np.rint(np.fft.irfft(spectrum[0] * spectrum[1], 2 * width)), 0.0)


def range_rows(keys: list[tuple], values: list[np.ndarray], exact: bool) -> pa.RecordBatch:
    """Rows of (problem_id, kind, chunk, scale) and the bins that are filled."""
    filled = [np.flatnonzero(v).astype(np.int32) for v in values]
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))]
    columns += [pa.array(filled, pa.list_(pa.int32())), pa.array([counts_out(v[f], exact) for v, f in zip(values, filled, strict=True)], pa.list_(pa.binary() if exact else pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["problem_id", "kind", "chunk", "scale", "at", "c"])


def convolved_ranges(a: DataFrame, b: DataFrame, n_bins: int, width: int, exact: bool = False) -> DataFrame:
    """Ranges of the convolution of two histograms given as ranges, below ``n_bins``; a task holds a few ranges.

    Pairs of ranges are convolved one by one; each gives a part of two ranges of the result
    (overlap-add), and parts of a range are added as a stream. Scales multiply.
    """
    last = -(-n_bins // width)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problem, kind, chunk, scale = (batch.column(i).to_pylist() for i in range(4))
            for k in range(batch.num_rows):
                at, at2 = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (4, 6))
                both = range_product(at, counts_in(batch.column(5)[k], exact), at2, counts_in(batch.column(7)[k], exact), width)
                parts = [(chunk[k] + i, both[i * width : (i + 1) * width]) for i in (0, 1)]
                parts = [(to, v) for to, v in parts if to < last and v.any()]
                yield range_rows([(problem[k], kind[k], to, scale[k]) for to, _ in parts], [v for _, v in parts], exact)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)
        for batch in batches:
            for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                if now is None or key[:3] != now[:3]:
                    if now:
                        yield range_rows([now], [total], exact)
                    now, total = key, np.zeros(width, object if exact else float)
                total[batch.column(4)[k].values.to_numpy(zero_copy_only=False)] += counts_in(batch.column(5)[k], exact)
        if now:
            yield range_rows([now], [total], exact)

    schema = RANGE.format("binary" if exact else "double")
    right = b.select("problem_id", "kind", F.col("chunk").alias("chunk2"), F.col("scale").alias("scale2"), F.col("at").alias("at2"), F.col("c").alias("c2"))
    met = a.join(right, ["problem_id", "kind"]).where(F.col("chunk") + F.col("chunk2") < last).repartition("problem_id", "kind", "chunk", "chunk2")
    parts = met.select("problem_id", "kind", (F.col("chunk") + F.col("chunk2")).alias("chunk"), (F.col("scale") * F.col("scale2")).alias("scale"), "at", "c", "at2", "c2").mapInArrow(pairs, schema)
    return parts.repartition("problem_id", "kind", "chunk").sortWithinPartitions("problem_id", "kind", "chunk").mapInArrow(add, schema)


def rescaled(ranges: DataFrame, n_bins: int, width: int) -> DataFrame:
    """Counts from below (kind 0, rounded down) and above (kind 1, rounded up), divided so that a problem's upper ones below ``n_bins`` add up to 2^26 at most."""
    within = lambda x, i: F.when(F.element_at("at", i + 1) + F.col("chunk") * width < n_bins, x).otherwise(0.0)
    ranges = ranges.withColumn("c", F.transform("c", within))
    top = ranges.where("kind = 1").groupBy("problem_id").agg(F.sum(F.aggregate("c", F.lit(0.0), lambda a, x: a + x)).alias("top"))
    f = F.least(F.lit(1.0), F.lit(SCALE_TO) / F.col("top"))
    c = F.transform("c", lambda x: F.when(F.col("kind") == 0, F.floor(x * f)).otherwise(F.ceil(x * f)).cast("double"))
    return ranges.join(top, "problem_id").select("problem_id", "kind", "chunk", (F.col("scale") * F.greatest(F.lit(1.0), F.col("top") / SCALE_TO)).alias("scale"), "at", c.alias("c"))


def read_ranges(ranges: DataFrame, keys: DataFrame, n_bins: int, width: int, method: str) -> DataFrame:
    """(problem_id, least, estimate, greatest) from sums around the true key's bin: four numbers a range, added as a stream by problem."""
    exact, at, half = method in EXACT, F.coalesce(F.try_divide("key_cost", "size"), F.lit(0.0)), F.col("m") / 2
    cap = lambda x: F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), x)).cast("long")
    marks = keys.select("problem_id", cap(F.ceil(at - half)).alias("lo"), cap(F.floor(at + 0.5)).alias("mid"), cap(F.floor(at + half)).alias("hi"))
    rows = ranges.join(marks, "problem_id").select("problem_id", "kind", "chunk", "scale", "at", "c", "lo", "mid", "hi")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for k, (chunk, lo, mid, hi) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 6, 7, 8)), strict=True)):
                bins, c = batch.column(4)[k].values.to_numpy(zero_copy_only=False) + chunk * width, counts_in(batch.column(5)[k], exact)
                sums.append(counts_out(np.array([c[own].sum() for own in (bins < lo, bins < mid, bins == mid, bins <= hi)], c.dtype), exact))
            columns = [*batch.columns[:4], pa.array(sums, pa.list_(pa.binary() if exact else pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["problem_id", "kind", "chunk", "scale", "sums"])

    def answer(problem: int, sums: np.ndarray, scale: float) -> tuple:
        (lo, _, _, up), (_, _, _, up_above) = sums
        if method == "scaledhist":
            least, most = 1 + float(lo) * scale, float(up_above) * scale
            guess = sum(float(below + math.ceil(at / 2)) for _, below, at, _ in sums) / 2 * scale
        else:
            least, most, guess = 1 + lo, up, sums[0][1] + ((sums[0][2] + 1) // 2 if exact else math.ceil(sums[0][2] / 2))
        return problem, float(least), float(max(least, guess)), float(max(least, most))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, scale, out = None, np.zeros(0), 0.0, []
        for batch in batches:
            for k, (problem, kind, own) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                if problem != now:
                    if now is not None:
                        out.append(answer(now, sums, scale))
                    now, sums, scale = problem, np.zeros((2, 4), object if exact else float), own
                sums[kind] += counts_in(batch.column(4)[k], exact)
                scale = max(scale, own)
        if now is not None:
            out.append(answer(now, sums, scale))
        types = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["problem_id", "least", "estimate", "greatest"])

    summed = rows.mapInArrow(parts, f"problem_id long, kind int, chunk long, scale double, sums array<{'binary' if exact else 'double'}>")
    return summed.repartition("problem_id").sortWithinPartitions("problem_id", "kind", "chunk").mapInArrow(add, RANKS)


def prepared(scratch: Scratch, costs: DataFrame, truth: DataFrame, max_len: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Stored costs (problem_id, place, cost) from 0 for each subkey, keys (problem_id, key_cost, m), and the most subkeys of a problem.

    Costs of subkeys without a true value are left out. Subkeys are merged up to ``max_len`` combinations first.
    """
    checked(costs, truth)
    costs = costs.join(truth.select("problem_id", "subkey").distinct(), ["problem_id", "subkey"], "left_semi")
    if max_len:
        costs, truth = auto_merge(costs, truth, max_len)
    own = costs.groupBy("problem_id", "subkey").agg(F.min("cost").alias("low"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("problem_id").orderBy("subkey")) - 1)  # one row for each subkey of a problem
    shifted = scratch.store(costs.join(own, ["problem_id", "subkey"]).select("problem_id", "subkey", "place", "value", (F.col("cost") - F.col("low")).alias("cost")))
    key = scratch.store(truth.join(shifted, ["problem_id", "subkey", "value"]).groupBy("problem_id").agg(ordered_sum().alias("key_cost"), F.count("*").alias("m")))
    return shifted, key, key.agg(F.max("m")).first()[0] or 0


def ranks_at(scratch: Scratch, shifted: DataFrame, key: DataFrame, most: int, n_bins: int, method: str, width: int) -> DataFrame:
    """Ranks of those problems of ``key`` for which ``n_bins`` are enough."""
    margin = F.ceil(F.col("m") / 2) + 1
    keys = key.where(margin < n_bins).withColumn("size", F.col("key_cost") / (n_bins - margin))
    at = F.floor(F.try_divide("cost", "size") + 0.5)
    binned = shifted.join(keys, "problem_id").withColumn("bin", F.coalesce(at, F.when(F.col("cost") == 0, 0)))
    hist = binned.where(F.col("bin") < n_bins).groupBy("problem_id", "place", "bin").agg(F.count("*").alias("c"))
    # a problem of fewer subkeys takes neutral histograms for the rest
    rest = keys.where(F.col("m") < most).select("problem_id", F.explode(F.sequence(F.col("m").cast("int"), F.lit(most - 1))).alias("place"), F.lit(0).cast("long").alias("bin"), F.lit(1).cast("long").alias("c"))
    hist, total, exact = scratch.store(hist.unionByName(rest)), None, method in EXACT
    for k in range(most):
        own = ranges_of(hist.where(F.col("place") == k), width, exact)
        if method == "scaledhist":
            own = rescaled(own.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))), n_bins, width)
        total = own if total is None else convolved_ranges(total, own, n_bins, width, exact)
        if k and method == "scaledhist":
            total = rescaled(scratch.store(total), n_bins, width)
    return read_ranges(total, keys, n_bins, width, method)


def histogram_rank(costs: DataFrame, truth: DataFrame, n_bins: int, method: str = "hist", max_len: int | None = None, width: int | None = None) -> DataFrame:
    """(problem_id, least, estimate, greatest) with a fixed number of bins, any number of problems, subkeys and bins.

    Histograms are tables of ranges of ``width`` bins, convolved pair by pair in tasks; no task holds a
    problem. ``hist`` counts in doubles (exact up to 2^53 where a subkey fills few bins of a range),
    ``scaledhist`` in doubles from below and above, divided so that none is lost to rounding,
    ``histbignum`` in whole numbers of any size. Joins on ``problem_id`` meet a problem's ranges with
    each other: n_bins / width of them a side. Subkeys may be ragged; an empty table gives no rows.
    """
    if method not in METHODS:
        raise RankError(f"unknown method {method}")
    scratch = Scratch(costs.sparkSession)
    shifted, key, most = prepared(scratch, costs, truth, max_len)
    if most and n_bins <= math.ceil(most / 2) + 1:
        raise RankError("too few bins")
    out = ranks_at(scratch, shifted, key, most, n_bins, method, width or (WIDTH_EXACT if method in EXACT else WIDTH)) if most else costs.sparkSession.createDataFrame([], RANKS)
    return scratch.last(out)


def accuracy_rank(costs: DataFrame, truth: DataFrame, accuracy: float = 1.0, method: str = "scaledhist", max_bins: int = MAX_BINS, max_len: int | None = MERGE_TO, width: int | None = None) -> DataFrame:
    """(problem_id, least, estimate, greatest): bins are doubled from 16 until greatest and least rank lie within ``accuracy`` bits.

    All open problems take a round together; those that are near enough leave it, and what ``max_bins``
    give is kept for the rest. The driver knows whether any is open, nothing else.
    """
    if method not in METHODS:
        raise RankError(f"unknown method {method}")
    scratch = Scratch(costs.sparkSession)
    shifted, key, most = prepared(scratch, costs, truth, max_len)
    n_bins, found, still = 16, costs.sparkSession.createDataFrame([], RANKS), key
    while most and n_bins <= max_bins and not still.isEmpty():
        got = scratch.store(ranks_at(scratch, shifted, still, most, n_bins, method, width or (WIDTH_EXACT if method in EXACT else WIDTH)))
        near = got if 2 * n_bins > max_bins else got.where(F.log2("greatest") - F.log2("least") <= accuracy)
        found, still = found.unionByName(near), scratch.store(still.join(near, "problem_id", "left_anti"))
        n_bins *= 2
    if not still.isEmpty():
        raise RankError("too few bins allowed")
    return scratch.last(found)


def partitioned_histogram_rank(costs: DataFrame, truth: DataFrame, subkeys: list[int], n_bins: int, width: int = WIDTH) -> DataFrame:
    """``histogram_rank`` of some subkeys, in ranges of ``width`` bins."""
    return histogram_rank(*(t.where(F.col("subkey").isin(subkeys)) for t in (costs, truth)), n_bins, width=width)


def binned_costs(costs: DataFrame, truth: DataFrame, subkeys: list[int], n_bins: int) -> tuple[DataFrame, DataFrame, Column, int]:
    """(problem_id, subkey, bin, c) below ``n_bins``, the true keys' costs, the bin size as a column of these, the number of subkeys."""
    m = len(subkeys)
    own = costs.where(F.col("subkey").isin(subkeys))
    shifted = own.join(own.groupBy("problem_id", "subkey").agg(F.min("cost").alias("low")), ["problem_id", "subkey"]).withColumn("cost", F.col("cost") - F.col("low")).drop("low")
    key = truth.join(shifted, ["problem_id", "subkey", "value"]).groupBy("problem_id").agg(ordered_sum().alias("key_cost"))
    size = F.col("key_cost") / (n_bins - math.ceil(m / 2) - 1)
    binned = shifted.join(key, "problem_id").withColumn("bin", F.floor(F.try_divide(F.col("cost"), size) + 0.5)).withColumn("bin", F.coalesce("bin", F.when(F.col("cost") == 0, 0)))
    return binned.where(F.col("bin") < n_bins).groupBy("problem_id", "subkey", "bin").agg(F.count("*").cast("decimal(38,0)").alias("c")), key, size, m


def read_rank(bins: DataFrame, key: DataFrame, size: Column, m: int, n_bins: int) -> DataFrame:
    """Prefix sums of (problem_id, bin, c) around the true key's bin."""
    at = F.coalesce(F.try_divide(F.col("key_cost"), size), F.lit(0.0))
    cap = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(n_bins - 1)), x))
    marked = bins.join(key, "problem_id").withColumns({"lo": cap(F.ceil(at - m / 2).cast("double")), "hi": cap(F.floor(at + m / 2).cast("double")), "mid": cap(F.floor(at + 0.5).cast("double")), "c": F.col("c").cast("double")})
    up_to = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0.0))
    g = marked.groupBy("problem_id").agg((1 + up_to(F.col("bin") < F.col("lo"))).alias("least"), (up_to(F.col("bin") < F.col("mid")) + F.ceil(up_to(F.col("bin") == F.col("mid")) / 2)).alias("guess"), up_to(F.col("bin") <= F.col("hi")).alias("greatest"))
    return g.select("problem_id", "least", F.greatest("least", "guess").alias("estimate"), F.greatest("least", "greatest").alias("greatest"))


def relational_histogram_rank(costs: DataFrame, truth: DataFrame, subkeys: list[int], n_bins: int) -> DataFrame:
    """(problem_id, least, estimate, greatest) by joins alone: bins are filtered before each convolution join, counts are exact.

    The joins on ``problem_id`` multiply a problem's filled bins: for up to some ten thousand bins a
    problem; ``histogram_rank`` takes more.
    """
    hist, key, size, m = binned_costs(costs, truth, subkeys, n_bins)
    total = None
    for k in subkeys:
        part = hist.where(F.col("subkey") == k).select("problem_id", "bin", "c")
        if total is None:
            total = part
        else:
            right = part.select("problem_id", F.col("bin").alias("b2"), F.col("c").alias("c2"))
            met = total.join(right, "problem_id").where(F.col("bin") + F.col("b2") < n_bins)
            total = met.groupBy("problem_id", (F.col("bin") + F.col("b2")).alias("bin")).agg(F.sum(F.col("c").cast("decimal(19,0)") * F.col("c2").cast("decimal(18,0)")).cast("decimal(38,0)").alias("c"))
    return read_rank(total, key, size, m, n_bins)


def cumulative(hist: DataFrame, bin_col: str = "bin", count_col: str = "c", by: tuple[str, ...] = ()) -> DataFrame:
    """A histogram with ``up_to``, the count of its bins so far; one row for each bin of a group is sorted."""
    return hist.withColumn("up_to", F.sum(count_col).over(Window.partitionBy(*by).orderBy(bin_col)))


def class_ranks(distributions: DataFrame, by: str = "exec", digits: int = 9) -> DataFrame:
    """(by, class, rank) of rows (by, probs): each class's rank by descending probability, equal ones (to ``digits`` places) share the least."""
    p = distributions.select(by, F.posexplode("probs").alias("class", "p"))
    return p.select(by, "class", F.rank().over(Window.partitionBy(by).orderBy(F.desc(F.round("p", digits)))).alias("rank"))
