"""Streams equal batches, replays count once, and the engine works without the subpackage on documents."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.compat import as_traces
from tracewell.operators import metrics, shared, stats
from tracewell.streaming import accumulate

RNG = np.random.default_rng(5)


def test_micro_batches_equal_one_batch(spark, tmp_path):
    x, y = RNG.integers(-500, 500, (120, 4)).astype(np.int16), RNG.integers(0, 3, (120, 1)).astype(np.uint16)
    t = as_traces(x, y)
    schema = t.schema
    for k in range(3):
        t.where(F.col("trace_id") % 3 == k).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        accumulate.stream_class_state(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got, want = (sorted(map(tuple, s.select("var", "class", "sample", "n", "s", "ss").collect())) for s in (accumulate.read_class_state(spark, f"{tmp_path}/state"), stats.class_state(t)))
    assert got == want


def test_streamed_moments_merge(spark, tmp_path):
    rows = spark.createDataFrame([(int(g), s, float(v)) for g, s, v in zip(RNG.integers(0, 2, 300), [0, 1, 2] * 100, RNG.normal(0, 3, 300), strict=True)], "grp int, sample int, x double")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    accumulate.stream_moments(stream, 4, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got, want = ({(r.order, r.sample): r.t for r in metrics.ttest(m, 2).collect()} for m in (accumulate.read_moments(spark, f"{tmp_path}/state"), stats.central_moments(rows, 4)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def small_files(spark, path, rows, files):
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_one_row_a_key_after_many_batches_and_a_restart(spark, tmp_path):
    """Ten micro-batches; the query fails in the middle, after writing a version and before its marker, and starts again."""
    rows = spark.createDataFrame([(int(g), s, float(v)) for g, s, v in zip(RNG.integers(0, 2, 400), [0, 1] * 200, RNG.normal(5, 2, 400), strict=True)], "grp int, sample int, x double")
    stream = small_files(spark, f"{tmp_path}/in", rows, 10)
    calls = []

    def breaking(a, b):
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("lost")
        return stats.merge_moments(a, b, order=4)

    start = lambda merge: accumulate.stream_state(stream, f"{tmp_path}/state", f"{tmp_path}/check", lambda t: stats.central_moments(t, 4), merge)
    with pytest.raises(Exception, match="lost"):
        start(breaking).awaitTermination()
    table = accumulate.StateTable(spark, f"{tmp_path}/state")
    middle = table.last()
    assert middle == 4
    start(breaking).awaitTermination()
    assert table.last() > middle
    assert len(list((tmp_path / "state/versions").iterdir())) == 2
    got, want = ({(r.grp, r.sample): r for r in m.collect()} for m in (accumulate.read_state(spark, f"{tmp_path}/state"), stats.central_moments(rows, 4)))
    assert accumulate.read_state(spark, f"{tmp_path}/state").count() == 4 and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].n == r.n and np.allclose(got[k].cs, r.cs) and np.isclose(got[k]["mean"], r["mean"])


def test_replayed_batches_count_once(spark, tmp_path):
    """A version whose batch the stream's own log has lost is not merged again."""
    x, y = RNG.integers(-99, 99, (90, 3)).astype(np.int16), RNG.integers(0, 2, (90, 1)).astype(np.uint16)
    t = as_traces(x, y)
    stream = small_files(spark, f"{tmp_path}/in", t, 3)
    accumulate.stream_class_state(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    last = sorted((tmp_path / "check/commits").iterdir(), key=lambda p: p.name)[-1]
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    accumulate.stream_class_state(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got, want = (sorted(map(tuple, s.select("var", "class", "sample", "n", "s", "ss").collect())) for s in (accumulate.read_state(spark, f"{tmp_path}/state"), stats.class_state(t)))
    assert got == want


def test_every_state_streams(spark, tmp_path):
    x, y = RNG.integers(-99, 99, (120, 40)).astype(np.int16), RNG.integers(0, 2, (120, 1)).astype(np.uint16)
    t = as_traces(x, y)
    stream = small_files(spark, f"{tmp_path}/in", t, 3)
    accumulate.stream_state(stream, f"{tmp_path}/lda", f"{tmp_path}/c1", lambda b: shared.lda_state(b, 2, [[0, 3, 39]]), shared.merge_states).awaitTermination()
    key = lambda s: {(r.kind, r.a, r.b): (r.n, tuple(r.v)) for r in s.collect()}
    assert key(accumulate.read_state(spark, f"{tmp_path}/lda")) == key(shared.lda_state(t, 2, [[0, 3, 39]]))
    tuples = [[0, 1], [2, 3]]
    accumulate.stream_tuple_moments(stream, tuples, f"{tmp_path}/tuples", f"{tmp_path}/c2").awaitTermination()
    got, want = ({r.tuple_id: r.t for r in metrics.mttest(s, 2).collect()} for s in (accumulate.read_state(spark, f"{tmp_path}/tuples"), stats.tuple_moments(t, F.get("labels", F.lit(0)), tuples)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_entry_without_the_documents_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "tracewell").mkdir()
    for p in (root / "tracewell").iterdir():
        if p.name != "llm":
            (tmp_path / "tracewell" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(sorted(m.queries())); assert set(m.oracle_sql()) <= set(m.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True).stdout
    assert "snr_embeddings" in out and "op1_" not in out
