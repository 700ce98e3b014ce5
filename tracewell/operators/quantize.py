"""Affine quantisation of floating-point traces to int16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(traces: DataFrame, method: str = "bounds", margin: float = 4.0, nstd: float = 7.0) -> DataFrame:
    """(sample, shift, scale). ``bounds``: middle and half range times a margin; ``moment``: mean and standard deviations."""
    long = traces.select(F.posexplode("samples").alias("sample", "x")).withColumn("x", F.col("x").cast("double"))
    if method == "bounds":
        g = long.groupBy("sample").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        return g.select("sample", ((F.col("a") + F.col("b")) / 2).alias("shift"), F.try_divide(F.lit(32768.0), (F.col("b") - F.col("a")) / 2 * margin).alias("scale"))
    if method == "moment":
        g = long.groupBy("sample").agg(F.avg("x").alias("shift"), F.stddev_samp("x").alias("sd"))
        return g.select("sample", "shift", F.try_divide(F.lit(32768.0), nstd * F.col("sd")).alias("scale"))
    raise ValueError("method is bounds or moment")


def parameters(fitted: DataFrame) -> DataFrame:
    """One row: (params), the fitted values by sample."""
    return fitted.agg(F.array_sort(F.collect_list(F.struct("sample", "shift", "scale"))).alias("params"))


def apply(traces: DataFrame, fitted: DataFrame, clip: bool = False, rounded: bool = False) -> DataFrame:
    """Samples as smallint: (x - shift) * scale, truncated towards zero (or rounded).

    Out of range without ``clip``: the query fails. A constant sample, which has no scale, is null.
    """

    def one(x: Column, p: Column) -> Column:
        v = (x - p["shift"]) * p["scale"]
        v = F.round(v) if rounded else v
        if clip:
            return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), v)).cast("smallint")
        whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
        return F.when((whole < -32768) | (whole > 32767), F.raise_error(F.lit("a quantised sample does not fit int16; clip or fit on more traces"))).otherwise(whole.cast("smallint"))

    return traces.crossJoin(F.broadcast(parameters(fitted))).withColumn("samples", F.zip_with(F.col("samples").cast("array<double>"), "params", one)).drop("params")  # one row of parameters
