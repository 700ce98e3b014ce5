"""Rows that the near-duplicate stage keeps, texts it fetches, and pairs of crowded buckets, against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import near_dup


def words(seed: int, n: int) -> list[str]:
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 10_000, n)]


def test_kept_rows_with_clashing_columns_null_ids_and_repeated_rows(spark):
    a, b = " ".join(words(1, 80)), " ".join(words(2, 80))
    rows = [(1, a), (2, a), (3, b), (3, b), (None, a), (None, None), (4, None), (5, ""), (6, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", "text", *(F.coalesce("doc_id", F.lit(0)).alias(c) for c in ("slot", "word", "row", "open", "component_id", "a.b")))
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(map(str, (tuple(r)[:3] for r in kept.collect())))
    assert got == sorted(map(str, ((i, t, i or 0) for i, t in rows if i not in (2, 5))))
    assert near_dup.keep_one_of_each(docs.limit(0)).count() == 0


def test_texts_of_ids_with_and_without_broadcast_joins(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.unionByName(docs)  # repeated rows come once
    nodes = spark.createDataFrame([(i,) for i in (*range(0, 500, 7), 900)], "doc_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = near_dup.texts_of(docs, nodes)
            assert sorted(map(tuple, got.collect())) == [(i, f"t{i}") for i in range(0, 500, 7)]
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Semi" not in plan  # one would be pushed below the bitmap
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_padded_lists_of_keys():
    lists = np.empty(3, object)
    lists[:] = [np.array([3, -1]), np.array([], np.int64), np.array([5])]
    got = near_dup.padded(lists)
    assert got.tolist() == [[3, (1 << 64) - 1], [0, 0], [5, 0]]
    assert near_dup.padded(np.empty(0, object)).shape == (0, 0)


def test_open_pairs_equal_all_pairs_of_buckets(spark):
    """Three buckets that overlap: each near pair with different roots once, whatever buckets it shares."""
    base = words(3, 200)
    texts = {i: " ".join(base[: 200 - i] + words(50 + i, i)) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = near_dup.long_fingerprints(docs, 5)
    buckets = {11: range(12), 7: range(3, 9), -5: range(0, 12, 2)}
    root = {i: 0 if i < 5 else i for i in texts}
    members = spark.createDataFrame([(k, i, root[i]) for k, own in buckets.items() for i in own], "key long, rid long, root long")
    found = near_dup.open_pairs(near_dup.open_members(members), prints, 0.8).collect()
    got = {(r.a, r.b) for r in found}
    assert len(found) == len(got)
    sets = {i: set(near_dup.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    near = {(i, j) for i in texts for j in texts if i < j and root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near and near <= got and all(root[i] != root[j] for i, j in got)
