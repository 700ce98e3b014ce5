"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local master, as in tests, gets a temporary
    folder where it is unset, removed at exit; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracewell-{uuid.uuid4().hex}"


def store(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to a new scratch folder and read it back: lineage ends, lost executors cost nothing."""
    spark = spark or df.sparkSession
    return Scratch(spark).store(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Hadoop's file systems reach it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The stored tables of one operator, deleted once its last one is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Store ``df``, then delete every table stored before: nothing that is read later needs them."""
        before, kept = self.paths, self.store(df)
        for path in before:
            if path != self.paths[-1]:
                remove(self.spark, path)
        self.paths = self.paths[-1:]
        return kept

    def only(self, kept: DataFrame) -> DataFrame:
        """Of the tables stored before, all but the last one, which is ``kept``, go."""
        for path in self.paths[:-1]:
            remove(self.spark, path)
        self.paths = self.paths[-1:]
        return kept
