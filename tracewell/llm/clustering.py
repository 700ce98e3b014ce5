"""Centroid clustering of whole-number vectors, exact at any magnitude.

Squared distances come from the expansion |x|^2 - 2 x.c + |c|^2: a block of vectors meets all
centroids in one float64 matrix product. Every term and partial sum is a whole number, so the
product is exact as long as dims * (max |x| + max |c|)^2 stays below 2^53. That bound is checked for
each row; rows beyond it are computed in int64 while the same bound stays below 2^63, and with whole
numbers of any size from there on. A round's sums are one row for each task and cluster, combined by
``treeAggregate`` over those rows; only k sums of ``dims`` numbers reach the driver, where centroids
become exact floors. Assignments are recomputed from the table in each pass, so a lost executor costs
its own blocks and nothing of the vectors is shuffled, kept or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a matrix product.
BLOCK = 4096
#: Below this double precision holds every whole number.
EXACT = 2.0**53
WIDE = 2.0**62
LONG = (-(1 << 63), (1 << 63) - 1)
PART = "cluster int, n long, inertia string, sums array<string>"


@dataclass(frozen=True)
class Shape:
    """Vectors of ``dims`` components x count as floor(scale * x); ``k`` centroids start at the smallest SHA-256 of ``salt:<id>``."""

    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: float = 64.0
    salt: str = "1"


def kept(df: DataFrame, shape: Shape, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>): the vectors that take part, unscaled."""
    x = F.col("x")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where((F.size(x) == shape.dims) & F.coalesce(finite, F.lit(False)))


def floors(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly: from 2^53 on a double has no fraction."""
    limit = np.finfo(float).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(x * scale, -limit, limit))


def blocks(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers as doubles) of at most BLOCK rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            flat = part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            yield part.column(part.schema.get_field_index("vec_id")), floors(flat.reshape(part.num_rows, shape.dims), shape.scale)


def whole(v: np.ndarray) -> np.ndarray:
    """Doubles without fraction as Python's whole numbers."""
    return np.array([[int(e) for e in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
    most = max((abs(c) for row in centroids for c in row), default=0)
    reach = np.abs(v).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        bound = v.shape[1] * (reach + float(most) if most < 1 << 1000 else np.full(len(v), np.inf)) ** 2
    at, distance = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    blas = np.flatnonzero(bound < EXACT)
    if len(blas):
        x, c = v[blas], np.array(centroids, float)
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
        at[blas] = d.argmin(axis=1)
        distance[blas] = d.min(axis=1).astype(np.int64)
    middle = np.flatnonzero((bound >= EXACT) & (bound < WIDE))
    if len(middle):
        x, c = v[middle].astype(np.int64), np.array(centroids, np.int64)
        d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
        at[middle], distance[middle] = d.argmin(axis=1), d.min(axis=1)
    large = np.flatnonzero(bound >= WIDE)
    if not len(large):
        return at, distance
    exact = distance.astype(object)
    for i, row in zip(large.tolist(), whole(v[large]).tolist(), strict=True):
        own = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids]
        exact[i] = min(own)
        at[i] = own.index(exact[i])
    return at, exact.tolist()


def sums_of(v: np.ndarray, at: np.ndarray, k: int) -> list[list[int]]:
    """Exact componentwise sums of each cluster: a product with the assignment where double precision holds it."""
    small = np.abs(v).max(axis=1, initial=0.0) * max(len(v), 1) < EXACT
    one_hot = np.zeros((k, len(v)))
    one_hot[at, np.arange(len(v))] = 1.0
    total = whole(one_hot[:, small] @ v[small])
    for i in np.flatnonzero(~small).tolist():
        total[at[i]] += whole(v[i : i + 1])[0]
    return total.tolist()


def total(distance: list[int] | np.ndarray, own: np.ndarray) -> int:
    """The exact sum of the chosen distances."""
    if isinstance(distance, np.ndarray) and int(distance.max(initial=0)) * max(len(distance), 1) < 1 << 63:
        return int(distance[own].sum())
    return sum(int(d) for d, o in zip(distance, own.tolist(), strict=True) if o)


def pass_over(vectors: DataFrame, shape: Shape, centroids: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """(n, inertia, sums) of each cluster over all vectors: a row for each task and cluster, combined by ``treeAggregate``."""
    k, dims = len(centroids), shape.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = [0] * k, [0] * k, [[0] * dims for _ in range(k)]
        for _, v in blocks(batches, shape):
            at, distance = nearest(v, centroids)
            for c, (new, have) in enumerate(zip(sums_of(v, at, k), np.bincount(at, minlength=k).tolist(), strict=True)):
                n[c] += have
                sums[c] = [a + b for a, b in zip(sums[c], new, strict=True)]
                inertia[c] += total(distance, at == c)
        own = [c for c in range(k) if n[c]]
        columns = (own, [n[c] for c in own], [str(inertia[c]) for c in own], [[str(s) for s in sums[c]] for c in own])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], ["cluster", "n", "inertia", "sums"])

    def add(held: dict, row) -> dict:
        n, inertia, sums = held.get(row[0], (0, 0, [0] * dims))
        return held | {row[0]: (n + int(row[1]), inertia + int(row[2]), [a + int(b) for a, b in zip(sums, row[3], strict=True)])}

    def merge(a: dict, b: dict) -> dict:
        for c, rest in b.items():
            a = add(a, (c, *rest))
        return a

    found = vectors.mapInArrow(run, PART).rdd.treeAggregate({}, add, merge)
    return [found.get(c, (0, 0, [0] * dims)) for c in range(k)]


def first_centroids(vectors: DataFrame, shape: Shape) -> list[list[int]]:
    """The k vectors whose ids hash smallest, in ascending order of hash; equal ids in ascending order of components. Null ids start none."""
    digest = F.sha2(F.concat(F.lit(f"{shape.salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").select(digest.alias("h"), "x").orderBy("h", "x").limit(shape.k).collect()  # k rows
    return whole(floors(np.array([r.x for r in rows], float).reshape(len(rows), shape.dims), shape.scale)).tolist()


def fit(vectors: DataFrame, shape: Shape) -> list[list[int]]:
    """The centroids after all rounds; a cluster without vectors keeps its centroid."""
    centroids = first_centroids(vectors, shape)
    for _ in range(shape.rounds if centroids else 0):
        found = pass_over(vectors, shape, centroids)
        centroids = [[s // n for s in sums] if n else old for old, (n, _, sums) in zip(centroids, found, strict=True)]
    return centroids


def clusters(df: DataFrame, shape: Shape | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a vector that takes part.

    Vectors that are null, of another length, or hold a null or non-finite component take no part.
    Rows with a null or repeated id take part like any other. With fewer vectors than ``k`` there
    are as many centroids as vectors. Ties go to the smaller cluster number. ``distance`` is squared;
    it and the inertias are exact and given as the end of a long where they lie beyond. scale * x
    beyond the doubles counts as the greatest one. Other columns, whatever their names, are not
    read. An empty table, or one where no vector has an id, gives an empty result.
    """
    shape = shape or Shape()
    vectors = kept(df, shape, id_col, vector_col)
    centroids = fit(vectors, shape)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    cut = lambda d: max(LONG[0], min(LONG[1], int(d)))
    each = [inertia for _, inertia, _ in pass_over(vectors, shape, centroids)]
    own, overall = np.array([cut(d) for d in each], np.int64), cut(sum(each))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in blocks(batches, shape):
            at, distance = nearest(v, centroids)
            columns = [ids, pa.array(at.astype(np.int32)), pa.array(distance if isinstance(distance, np.ndarray) else [cut(d) for d in distance], pa.int64()), pa.array(own[at]), pa.array(np.full(len(at), overall, np.int64)), pa.array([digests[c] for c in at.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(run, schema)


def oracle_sql(shape: Shape | None = None, table: str = "embeddings") -> str:
    """The same in DuckDB's SQL, for ids that are not null and sums within a huge integer."""
    shape = shape or Shape()
    distance = "list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({shape.scale} * e::DOUBLE)::BIGINT) AS x FROM {table}
  WHERE embedding IS NOT NULL AND len(embedding) = {shape.dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{shape.salt}:' || vec_id::VARCHAR), x) - 1 AS cluster, x AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {shape.k})"""]
    for r in range(shape.rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, cluster, distance FROM (SELECT v.vec_id, v.x, c.cluster, {distance} AS distance, row_number() OVER (PARTITION BY v.vec_id, v.x ORDER BY {distance}, c.cluster) AS r FROM kept AS v, c{r} AS c) WHERE r = 1)")
        if r < shape.rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT cluster, list(f ORDER BY i) AS c FROM (SELECT cluster, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS f FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c::BIGINT[], c.c) AS c FROM c{r} AS c LEFT JOIN m{r} AS m USING (cluster))""")
    last = shape.rounds
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{last} AS a JOIN c{last} AS c USING (cluster)"""
