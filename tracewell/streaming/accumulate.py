"""Incremental accumulation with Structured Streaming into compacted state tables.

Class sums add up, moments shift to a common mean, tiles and tuple products have rules of their own:
every state of this library has a function that merges two. A stream keeps one merged table: each
micro-batch's own state is merged with the last version and written as the next one, and a marker
with the batch's number makes it count. A batch that is replayed after a failure finds its marker
and changes nothing; one that failed before its marker starts from the version before. So a key has
one row however many batches have come, and old versions go. A state folder belongs to the
checkpoint of its stream; neither is of use without the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ShapeError
from ..operators.stats import central_moments, class_state, merge_class_states, merge_moments, merge_tuple_moments, tuple_moments
from ..sources.scratch import remove


class StateTable:
    """Versions of a state below ``path``, named by the last micro-batch that they hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str):
        """(file system, folder) of Hadoop, whatever store the path names."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, name: str) -> list[int]:
        fs, at = self._folder(name)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def last(self) -> int | None:
        """The last micro-batch that counts."""
        return max(self._numbers("commits"), default=None)

    def read(self) -> DataFrame | None:
        """The state at this moment; accumulation may go on, and the version before the last stays readable."""
        at = self.last()
        return None if at is None else self.spark.read.parquet(f"{self.path}/versions/{at}")

    def commit(self, batch_id: int, state: DataFrame) -> None:
        before = self.last()
        state.write.mode("overwrite").parquet(f"{self.path}/versions/{batch_id}")
        fs, at = self._folder(f"commits/{batch_id}")
        fs.create(at, True).close()
        for name in ("versions", "commits"):
            for old in self._numbers(name):
                if old not in (batch_id, before):
                    remove(self.spark, f"{self.path}/{name}/{old}")


def stream_state(rows: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Start a query that merges ``make`` of each micro-batch into the state table at ``path``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, path)
        last = table.last()
        if last is not None and batch_id <= last:
            return
        new = make(batch)
        table.commit(batch_id, new if last is None else merge(table.read(), new))

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    found = StateTable(spark, path).read()
    if found is None:
        raise ShapeError(f"no batch has reached {path}")
    return found


def stream_class_state(traces: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Class sums of traces."""
    return stream_state(traces, path, checkpoint, class_state, merge_class_states, trigger)


def stream_moments(rows: DataFrame, order: int, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Central moments of (grp, sample, x) rows, one row for each group and sample."""
    return stream_state(rows, path, checkpoint, partial(central_moments, order=order), partial(merge_moments, order=order), trigger)


def stream_tuple_moments(traces: DataFrame, tuples: list[list[int]], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Products of tuples of samples; the first label is the group."""
    make = lambda t: tuple_moments(t, F.get("labels", F.lit(0)), tuples)
    return stream_state(traces, path, checkpoint, make, partial(merge_tuple_moments, d=len(tuples[0])), trigger)


read_class_state = read_moments = read_state


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """Counts, sums and squares of event values by type and event-time window; an extension of our own."""
    stamped = events.withWatermark(time_col, late) if events.isStreaming else events
    return stamped.groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).select(F.col("w.start").alias("start"), "event_type", "n", "s", "ss")
