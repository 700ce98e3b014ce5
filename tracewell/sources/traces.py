"""Trace tables: validation, generation, state sinks.

The canonical table is (trace_id long, samples array<smallint>, labels array<int>): one measurement
vector a row, its labels beside it. Reading is Spark's own (``spark.read``); nothing here is a format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClassOutOfBoundError, ShapeError

INT16 = (-(1 << 15), (1 << 15) - 1)


def shape(traces: DataFrame) -> tuple[int, int, int]:
    """(traces, samples per trace, labels per trace); one aggregate that also checks the table.

    All vectors must have one length and no null, samples must fit int16.
    """
    low, high = F.array_min("samples"), F.array_max("samples")
    r = traces.agg(
        F.count("*").alias("n"), F.min(F.size("samples")).alias("a"), F.max(F.size("samples")).alias("b"),
        F.min(F.size("labels")).alias("c"), F.max(F.size("labels")).alias("d"), F.min(low).alias("low"), F.max(high).alias("high"),
        F.coalesce(F.max(F.exists("samples", lambda x: x.isNull())), F.lit(False)).alias("holes"),
        F.sum(F.when(F.col("samples").isNull() | F.col("labels").isNull(), 1).otherwise(0)).alias("nulls"),
    ).first()
    if r.n and (r.nulls or r.holes or r.a != r.b or r.c != r.d):
        raise ShapeError("traces and labels must be arrays of one length, without nulls")
    if r.n and (r.low < INT16[0] or r.high > INT16[1]):
        raise ShapeError("samples do not fit int16")
    return r.n, r.a or 0, r.c or 0


def check_classes(traces: DataFrame, nc: int) -> None:
    """Labels lie in [0, nc)."""
    r = traces.agg(F.min(F.array_min("labels")).alias("a"), F.max(F.array_max("labels")).alias("b")).first()
    if r.a is not None and (r.a < 0 or r.b >= nc):
        raise ClassOutOfBoundError(f"labels span {r.a} to {r.b}, with {nc} classes")


def join_labels(traces: DataFrame, labels: DataFrame, key: str = "trace_id") -> DataFrame:
    """Traces with the labels of a table of their own; every trace needs exactly one row there."""
    once = labels.groupBy(key).agg(F.count("*").alias("of_labels"))
    both = traces.groupBy(key).agg(F.count("*").alias("of_traces")).join(once, key, "full")
    if not both.where("of_labels is null or of_traces is null or of_labels <> 1").isEmpty():
        raise ShapeError("every trace needs exactly one row of labels, and every label a trace")
    return traces.join(labels, key)


def gather(samples: Column, points: list[int]) -> Column:
    """The samples at the points, in their order."""
    return F.transform(F.array(*map(F.lit, points)), lambda i: F.get(samples, i))


def prune(traces: DataFrame, points: list[list[int]]) -> tuple[DataFrame, list[list[int]]]:
    """Traces cut to the union of all points, and the points' new indices: prune before exploding."""
    union = sorted({p for own in points for p in own})
    at = {p: i for i, p in enumerate(union)}
    return traces.withColumn("samples", gather(F.col("samples"), union)), [[at[p] for p in own] for own in points]


def simulated(spark: SparkSession, n: int, ns: int = 32, noise: float = 2.0, nc: int = 256, seed: int = 0) -> DataFrame:
    """n traces of ``leaking``, numbered from 0."""
    return leaking(spark.range(n).withColumnRenamed("id", "trace_id"), ns, noise, nc, seed)


def leaking(ids: DataFrame, ns: int = 32, noise: float = 2.0, nc: int = 256, seed: int = 0) -> DataFrame:
    """A trace for each trace_id: samples leak the Hamming weight of a permuted class of the id, with Gaussian noise, times 256."""
    key = F.pmod(F.col("trace_id") * 167 + 13, F.lit(nc))
    leak = F.transform(F.sequence(F.lit(0), F.lit(ns - 1)), lambda j: F.bit_count(F.pmod(F.col("class") * (2 * j + 1) + j, F.lit(nc)).cast("int")))
    rows = ids.select("trace_id").withColumn("class", key.cast("int")).withColumn("w", F.array(*(F.randn(seed * ns + j) for j in range(ns))))
    noisy = F.zip_with(leak, F.col("w"), lambda x, w: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), (x + noise * w) * 256)).cast("smallint"))
    return rows.select("trace_id", noisy.alias("samples"), F.array("class").alias("labels"))


def save_state(state: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Any operator's state is a table; this is its sink."""
    state.write.mode(mode).parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
