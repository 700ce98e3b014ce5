"""Leakage metrics: final projections over the state tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..functions.kernels import walsh_hadamard
from .stats import central_moments, powers_of, totals


def ratio(a, b):
    """a / b; NaN for 0/0 and an infinity for x/0, as in floating point."""
    return F.when(b != 0, a / b).when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def fields(rows: str, name: str) -> Column:
    """One field of an array of structs, as doubles."""
    return F.transform(rows, lambda r: r[name].cast("double"))


def snr(state: DataFrame, exact: bool = False) -> DataFrame:
    """(var, sample, snr): between-class over within-class variation.

    SSC sums s^2 n / n_c over classes that occur; signal SSC - S^2, noise n SS - SSC. ``exact``
    floors each class's term and keeps 38 digits.
    """
    if exact:
        t = totals(state).select("var", "sample", F.col("n").alias("n_all"))
        square = "cast(cast(s as decimal(19,0)) * cast(s as decimal(19,0)) as decimal(38,0))"
        # s^2 = q n_c + r: n q + floor(n r / n_c) stays within 38 digits
        r = F.expr(f"{square} % cast(n as decimal(38,0))")
        q = F.expr(f"cast(({square} - {square} % cast(n as decimal(38,0))) / n as decimal(38,0))")
        n_all = F.col("n_all").cast("decimal(38,0)")
        ssc = F.sum(q * n_all + F.floor((r * n_all).cast("double") / F.col("n")).cast("decimal(38,0)")).cast("decimal(38,0)")
        g = state.join(t, ["var", "sample"]).groupBy("var", "sample").agg(ssc.alias("ssc"), F.first("n_all").alias("n"), F.sum("s").alias("s"), F.sum("ss").cast("decimal(38,0)").alias("ss"))
        kind = "decimal(38,0)"
    else:  # n leaves the sum, so one pass over the state is enough
        share = F.sum(F.col("s").cast("double") * F.col("s") / F.col("n"))
        g = state.groupBy("var", "sample").agg((F.sum("n") * share).alias("ssc"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        kind = "double"
    n, s, ss = (F.col(c).cast(kind) for c in ("n", "s", "ss"))
    return g.select("var", "sample", ratio((F.col("ssc") - s * s).cast("double"), (n * ss - F.col("ssc")).cast("double")).alias("snr"))


def top_points(scores: DataFrame, k: int, score: str = "snr") -> DataFrame:
    """The k samples of each label with the greatest score; ties go to the smaller sample."""
    from pyspark.sql import Window

    order = Window.partitionBy("var").orderBy(F.col(score).desc(), "sample")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ttest(moments: DataFrame, d: int) -> DataFrame:
    """(order, sample, t) for orders 1 to d: Welch's statistic of group 0 minus group 1 from central sums up to 2d."""
    cm = lambda p: F.get("cs", F.lit(p)) / F.col("n")
    stats = []
    for k in range(1, d + 1):
        if k == 1:
            u, v = F.col("mean"), cm(2)
        elif k == 2:
            u, v = cm(2), cm(4) - cm(2) * cm(2)
        else:
            u = ratio(cm(k), F.pow(cm(2), F.lit(k / 2)))
            v = ratio(cm(2 * k) - cm(k) * cm(k), F.pow(cm(2), F.lit(float(k))))
        stats.append(F.struct(F.lit(k).alias("order"), u.alias("u"), (v / F.col("n")).alias("v")))
    rows = moments.select("grp", "sample", F.explode(F.array(*stats)).alias("x")).select("grp", "sample", "x.*")
    pick = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    both = rows.groupBy("order", "sample").agg(pick(0, "u").alias("u0"), pick(1, "u").alias("u1"), pick(0, "v").alias("v0"), pick(1, "v").alias("v1"))
    return both.select("order", "sample", ratio(F.col("u0") - F.col("u1"), F.sqrt(F.col("v0") + F.col("v1"))).alias("t"))


def ttest_of(rows: DataFrame, d: int) -> DataFrame:
    return ttest(central_moments(rows, 2 * d), d)


def mttest(state: DataFrame, d: int) -> DataFrame:
    """(tuple_id, t): Welch's statistic of products of d centred samples, from a state of ``stats.tuple_moments``."""
    if d < 2:
        raise ShapeError("products need two samples at least")
    at = {e: i for i, e in enumerate(powers_of(d))}
    mean = lambda *e: F.get("cs", F.lit(at[e])) / F.col("n")
    scale = reduce(lambda a, b: a * b, [mean(*(2 if i == j else 0 for i in range(d))) for j in range(d)])
    mu, sq = mean(*[1] * d), mean(*[2] * d)
    if d > 2:
        mu, sq = ratio(mu, F.sqrt(scale)), ratio(sq, scale)
    each = state.select("grp", "tuple_id", mu.alias("mu"), ((sq - mu * mu) / F.col("n")).alias("v"))
    pick = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    both = each.groupBy("tuple_id").agg(pick(0, "mu").alias("u0"), pick(1, "mu").alias("u1"), pick(0, "v").alias("v0"), pick(1, "v").alias("v1"))
    return both.select("tuple_id", ratio(F.col("u0") - F.col("u1"), F.sqrt(F.col("v0") + F.col("v1"))).alias("t"))


def cpa(state: DataFrame, models: DataFrame, nc: int, kind: str = "xor") -> DataFrame:
    """(var, key, sample, rho): correlation of class sums with a leakage model under each key.

    ``models`` is (var, class, sample, m) with all nc classes. The intermediate value is
    ``key ^ label`` or ``(key + label) mod nc``. Model variance is the population's over all
    classes, data variance the sample's, so |rho| may exceed 1. All keys of a sample come from one
    Walsh-Hadamard or Fourier transform of its class sums.
    """
    if kind not in ("xor", "add"):
        raise ShapeError("kind is xor or add")
    if kind == "xor" and nc & (nc - 1):
        raise ShapeError("xor needs a power of two as number of classes")
    own = state.groupBy("var", "sample").agg(F.collect_list(F.struct("class", "n", "s")).alias("classes"), F.sum("n").cast("double").alias("n"), F.sum("s").cast("double").alias("s"), F.sum("ss").cast("double").alias("ss"))
    model = models.groupBy("var", "sample").agg(F.collect_list(F.struct("class", "m")).alias("model"))  # both lists have nc entries at most
    met = own.join(model, ["var", "sample"]).select("n", "s", "ss", *(fields("classes", f).alias(f"c_{f}") for f in ("class", "n", "s")), *(fields("model", f).alias(f"m_{f}") for f in ("class", "m")), F.col("var").cast("int").alias("v"), F.col("sample").cast("int").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // nc)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                column = lambda name, part=part: part.column(part.schema.get_field_index(name))
                flat = lambda name, column=column: column(name).flatten().to_numpy(zero_copy_only=False)
                n, s, ss = (column(k).to_numpy(zero_copy_only=False) for k in ("n", "s", "ss"))
                sums, counts, m = (np.zeros((part.num_rows, nc)) for _ in range(3))
                at = np.repeat(np.arange(part.num_rows), column("c_class").value_lengths().to_numpy(zero_copy_only=False)), flat("c_class").astype(np.int64)
                sums[at], counts[at] = flat("c_s"), flat("c_n")
                m[np.repeat(np.arange(part.num_rows), column("m_class").value_lengths().to_numpy(zero_copy_only=False)), flat("m_class").astype(np.int64)] = flat("m_m")
                m -= m.mean(axis=1, keepdims=True)
                spread = (m**2).mean(axis=1)
                own = sums - (s / n)[:, None] * counts
                if kind == "xor":
                    dot = walsh_hadamard(walsh_hadamard(own) * walsh_hadamard(m)) / nc
                else:
                    dot = np.fft.irfft(np.conj(np.fft.rfft(own, axis=1)) * np.fft.rfft(m, axis=1), nc, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    data = (n * ss - s * s) / (n * (n - 1))
                    rho = dot / ((n - 1) * np.sqrt(spread * data))[:, None]
                who = lambda name, column=column: pa.array(np.repeat(column(name).to_numpy(zero_copy_only=False), nc))
                yield pa.RecordBatch.from_arrays([who("v"), pa.array(np.tile(np.arange(nc, dtype=np.int32), part.num_rows)), who("p"), pa.array(rho.reshape(-1))], ["var", "key", "sample", "rho"])

    return met.mapInArrow(run, "var int, key int, sample int, rho double")


def best_key(rho: DataFrame) -> DataFrame:
    """(var, key, peak): the key with the greatest absolute correlation at any sample."""
    per_key = rho.groupBy("var", "key").agg(F.max(F.abs("rho")).alias("peak"))
    return per_key.groupBy("var").agg(F.max_by("key", F.struct("peak", -F.col("key"))).alias("key"), F.max("peak").alias("peak"))


def lda_scatter(state: DataFrame, scatter: DataFrame, points: list[int]) -> DataFrame:
    """(i, j, s_b, s_w) of one label: between- and within-class scatter at point positions, i <= j."""
    at = state.where("var = 0").join(F.broadcast(reduce(DataFrame.unionAll, [state.sparkSession.sql(f"SELECT {i} AS pos, {p} AS sample") for i, p in enumerate(points)])), "sample")
    t = at.groupBy("pos").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    own = at.join(t, "pos").select("class", "pos", F.col("n").cast("double"), (F.col("s") - F.col("n") * F.col("s_all") / F.col("n_all")).alias("d"), F.col("s_all").cast("double"))
    a, b = own.alias("a"), own.alias("b")
    between = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.pos") <= F.col("b.pos"))).groupBy(F.col("a.pos").alias("i"), F.col("b.pos").alias("j")).agg(F.sum(F.col("a.d") * F.col("b.d") / F.col("a.n")).alias("s_b"), F.first("a.s_all").alias("si"), F.first("b.s_all").alias("sj"))
    return between.join(scatter, ["i", "j"]).select("i", "j", "s_b", (F.col("sxy") - F.col("si") * F.col("sj") / F.col("n") - F.col("s_b")).alias("s_w"))
