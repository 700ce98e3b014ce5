"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned and sorted by length (Euclidean norm), once for the whole table. The
longest range, about ``LONGEST`` of the rows, is searched first; the k-th best scores found there are
the queries' thresholds for all shorter ranges, of which those too short for any query are not read.
Within a task, vectors come in buckets of similar length. Per query and bucket, the k-th best score
so far over the product of the query's length and the bucket's greatest length is the local cosine
threshold. Above 1 the bucket is pruned whole, and so are the shorter ones after it. A high
threshold makes coordinate pruning worth its cost: the product over the query block's heaviest
coordinates plus the Cauchy-Schwarz bound of the rest drops candidates before the full product;
otherwise lengths alone prune. Survivors get their exact product. Products that double precision
cannot hold exactly are computed with whole numbers of any size.

Queries are taken in blocks of at most ``BLOCK`` vectors, the only thing sent to all executors; each
task keeps k rows for a query, and a final ranking joins those.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import store

BLOCK = 4096
BUCKET = 2048
FOCUS = 16
#: Share of the rows in the range that is searched first.
LONGEST = 0.1
#: Local cosine threshold from which coordinates prune.
HIGH = 0.5
EXACT = 2.0**53


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double.

    Null vectors and those with a null or non-finite component are left out, as are rows with a
    null id; empty vectors stay (their products are 0). From 2^53 on a double has no fraction, so
    scale * x stands for its floor there.
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    usable = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("x")).where("vec_id is not null and x is not null")
    finite = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return usable.where(F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))


def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
    v = batch.column(batch.schema.get_field_index("v"))
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
    return ids, np.split(flat, ends[:-1]) if len(ids) else []


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.inf)  # scores below are not asked for

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        s, i = np.concatenate([self.score[query], scores]), np.concatenate([self.id[query], ids])
        order = np.lexsort((i, -s))[:k]
        self.score[query], self.id[query] = s[order], i[order]


def search_batch(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Offer each candidate of the batch to each query; see the module's text for what is pruned."""
    length = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    query_length = np.sqrt((queries**2).sum(axis=1))
    focus = np.argsort(-(queries**2).sum(axis=0), kind="stable")[: min(FOCUS, queries.shape[1])]
    rest = np.setdiff1d(np.arange(queries.shape[1]), focus)
    query_rest = np.sqrt((queries[:, rest] ** 2).sum(axis=1))
    for a in range(0, len(ids), BUCKET):
        v, own, n = vectors[a : a + BUCKET], ids[a : a + BUCKET], length[a : a + BUCKET]
        least = np.maximum(best.score[:, -1], best.floor)
        reach = query_length * n[0]
        open_ = np.flatnonzero(reach * (1 + 1e-9) >= least)  # else even the same direction scores less
        if not len(open_):
            if (least >= 0).all():
                break  # later buckets are shorter still
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach[open_] > 0, least[open_] / reach[open_], 0)
        by_coordinates = open_[local >= HIGH]
        plain = open_[local < HIGH]
        if len(by_coordinates):
            part = queries[by_coordinates][:, focus] @ v[:, focus].T
            bound = part + query_rest[by_coordinates][:, None] * np.sqrt((v[:, rest] ** 2).sum(axis=1))[None, :]
            keep = bound * (1 + 1e-9) + 1e-6 >= least[by_coordinates][:, None]
            for q, row in zip(by_coordinates.tolist(), keep, strict=True):
                row &= own != query_ids[q]
                if row.any():
                    best.add(q, v[row] @ queries[q], own[row])
        if len(plain):
            scores = queries[plain] @ v.T
            for q, row in zip(plain.tolist(), scores, strict=True):
                keep = (row >= max(best.score[q, -1], best.floor[q])) & (own != query_ids[q])
                if keep.any():
                    best.add(q, row[keep], own[keep])


def whole_products(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Inner products as whole numbers of any size."""
    q = [int(x) for x in query]
    return [sum(map(mul, q, map(int, v))) for v in vectors.tolist()]


def search_exactly(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: list[list[tuple[int, int]]]) -> None:
    """Offer each candidate to each query by whole numbers; ``best`` holds (minus score, id), ascending, k of them after each call."""
    for i, q in enumerate(queries):
        other = ids != query_ids[i]
        best[i] = sorted([*best[i], *((-s, j) for s, j in zip(whole_products(q, vectors[other]), ids[other].tolist(), strict=True))])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query, all if fewer.

    Both sides are (vec_id, v). A query meets every candidate of its dimension but those with its
    own id. Ranks start at 1; ties go to the smaller id. A query given twice counts once; a
    candidate row given twice stands twice. Scores are exact and ranked so up to 38 digits; beyond
    the range of a long they are given as its end. Infinite components count as the greatest double. Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    limit = float(np.finfo(float).max)
    once = queries.select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))).alias("v")).distinct()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sized = vectors.select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))).alias("v")).withColumn("length", length)
    ranged = store(by_length(sized))
    cut = ranged.agg(F.percentile_approx("length", 1 - LONGEST)).first()[0]
    blocks = max(1, -(-once.count() // BLOCK))
    marked = once.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    marked = store(marked) if blocks > 1 else marked
    found = []
    for b in range(blocks if cut is not None else 0):
        block = marked.where(F.col("b") == b).select("vec_id", "v").collect()  # about BLOCK vectors
        for start in range(0, len(block), BLOCK):
            own = sorted((r.vec_id, r.v) for r in block[start : start + BLOCK])
            first = store(one_block(ranged.where(F.col("length") >= cut), own, k, {}))
            least = {r.query_id: int(r.least) for r in first.groupBy("query_id").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("least")).where(F.col("n") >= k).select("query_id", "least").collect()} if k else {}  # a number for each query of the block; lists have k entries for each task
            found += [first, store(one_block(ranged.where(F.col("length") < cut).where(F.col("length") >= shortest(own, least)), own, k, least))]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    near = reduce(DataFrame.unionAll, found)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))  # k rows for each task and query
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.greatest(low, F.least(high, F.col("score"))).cast("long").alias("score"))


def by_length(sized: DataFrame) -> DataFrame:
    """Partitions by ranges of length, longest first; vectors of one length, as unit ones are, are dealt over tasks by their ids' hash."""
    return sized.repartitionByRange(F.desc("length"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("length"))


def shortest(block: list[tuple[int, list[float]]], least: dict[int, int]) -> float:
    """The length below which no candidate reaches any query's threshold; 0 where some query has none above 0."""
    bounds = [least.get(i, 0) / n if (n := float(np.linalg.norm(v))) > 0 else 0.0 for i, v in block]
    return max(0.0, min(bounds, default=0.0) * (1 - 1e-9))


def one_block(vectors: DataFrame, block: list[tuple[int, list[float]]], k: int, least: dict[int, int]) -> DataFrame:
    """(query_id, vec_id, score): up to k best of each task for each query; those below ``least`` may be missing."""
    sizes = sorted({len(v) for _, v in block})
    own_size = {n: [(i, v) for i, v in block if len(v) == n] for n in sizes}
    sides = {n: (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], float).reshape(len(own), n)) for n, own in own_size.items()}
    bound = 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, whole = {}, {}
        for n, (query_ids, _) in sides.items():
            best[n] = Best(len(query_ids), k)
            whole[n] = [[] for _ in query_ids]
            best[n].floor = np.array([least.get(i, -np.inf) for i in query_ids.tolist()], float)
        held: dict[int, list] = {n: [] for n in sides}
        waiting = dict.fromkeys(sides, 0)

        def search(n: int) -> None:
            if not held[n]:
                return
            query_ids, queries = sides[n]
            ids, v = np.concatenate([i for i, _ in held[n]]), np.concatenate([x for _, x in held[n]])
            held[n], waiting[n] = [], 0
            ample = np.abs(queries).max(axis=1, initial=0)
            large = np.abs(v).max(axis=1, initial=0)
            wide = ample > 2.0**26
            over = max(n, 1) * large * ample[~wide].max(initial=0) >= EXACT
            for q in np.flatnonzero(wide).tolist():
                one = [whole[n][q]]
                search_exactly(queries[q : q + 1], query_ids[q : q + 1], ids, v, one)
                whole[n][q] = one[0][:k]
            narrow = np.flatnonzero(~wide)
            if over.any():
                own = [whole[n][q] for q in narrow.tolist()]
                search_exactly(queries[narrow], query_ids[narrow], ids[over], v[over], own)
                for q, rows in zip(narrow.tolist(), own, strict=True):
                    whole[n][q] = rows[:k]
            if len(narrow) and not over.all():
                part = Best(0, k)
                part.score, part.id, part.floor = best[n].score[narrow], best[n].id[narrow], best[n].floor[narrow]
                search_batch(queries[narrow], query_ids[narrow], ids[~over], v[~over], part)
                best[n].score[narrow], best[n].id[narrow] = part.score, part.id

        for batch in batches:
            ids, own = vectors_of(batch)
            dims = np.array([len(v) for v in own])
            for n in sides:
                at = np.flatnonzero(dims == n)
                if len(at):
                    held[n].append((ids[at], np.stack([own[i] for i in at]).reshape(len(at), n)))
                    waiting[n] += len(at)
                    if waiting[n] >= BUCKET:  # whole buckets, however the session cuts its batches
                        search(n)
        for n, (query_ids, _) in sides.items():
            search(n)
            got = np.isfinite(best[n].score)
            rows, _ = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(best[n].id[got]), pa.array(best[n].score[got].astype(np.int64)).cast(pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])
            exact = [(int(i), j, Decimal(min(bound, max(-bound, -s)))) for i, own in zip(query_ids, whole[n], strict=True) for s, j in own]
            if exact:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*exact, strict=True), (pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score decimal(38,0)")
