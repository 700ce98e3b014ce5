"""Class centres of regression models: points of any class, leader clustering, a tree to search them.

A class of nb bits has its projected mean as a sum of table entries, one for each byte of the class,
so no table grows with 2^nb. Leader clustering keeps, in class order, each class that lies farther than
the radius from all leaders before it. It runs in rounds over blocks of space: a block sweeps its
classes in order and settles those that no unsettled class of a neighbouring block can touch; blocks
exchange only what lies within the radius of their edges. The search tree splits centres at medians and
lies in flat arrays, so it is built once, sent to executors, and walked level by level for a whole
batch of points at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..sources.scratch import Scratch

CHUNK_BITS = 8
#: Points in a leaf of the tree.
LEAF = 8
#: Classes in a block of space, about, and rows of a block that are settled at a time.
PER_BLOCK, ROWS = 1 << 14, 512
#: Distances are compared with so much room when whole boxes are left out.
ROOM = 1 + 1e-9


def chunk_tables(coefs: np.ndarray) -> list[np.ndarray]:
    """For each byte of a class, 256 partial sums (fewer for the last bits) of (p, nb + 1) coefficients; the first holds the intercept."""
    nb = coefs.shape[1] - 1
    tables = []
    for low in range(0, max(nb, 1), CHUNK_BITS):
        own = coefs[:, 1 + low : 1 + min(nb, low + CHUNK_BITS)]
        signs = 2.0 * ((np.arange(1 << own.shape[1])[:, None] >> np.arange(own.shape[1])) & 1) - 1
        tables.append(signs @ own.T + (coefs[:, 0] if not low else 0.0))
    return tables


def class_points(tables: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """(n, p): the projected means of the given classes."""
    c = np.asarray(classes).astype(np.uint64)
    out = tables[0][(c & np.uint64(len(tables[0]) - 1)).astype(np.int64)].copy()
    for k, t in enumerate(tables[1:], 1):
        out += t[((c >> np.uint64(k * CHUNK_BITS)) & np.uint64(len(t) - 1)).astype(np.int64)]
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m) squared distances, a coordinate at a time."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return out


def squared_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed in the same order as ``squared``."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += (a[:, d] - b[:, d]) ** 2
    return out


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as Arrow lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).reshape(-1)))


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which span, position) of every position of the spans, laid end to end."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


class CentreTree:
    """Boxes around points, split at the median of their widest coordinate; node i has children 2 i + 1 and 2 i + 2.

    ``visited`` counts the points whose distance was taken.
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray | None = None):
        self.points = np.asarray(points, float)
        n = len(self.points)
        self.weights = np.ones(n, np.int64) if weights is None else np.asarray(weights, np.int64)
        self.visited = 0
        self.levels = max(0, math.ceil(math.log2(n / LEAF))) if n > LEAF else 0
        order = np.arange(n)
        low, high, weight = [], [], []
        for level in range(self.levels + 1):
            edges = self.edges(level)
            if n:
                own = self.points[order]
                low.append(np.minimum.reduceat(own, edges[:-1]))
                high.append(np.maximum.reduceat(own, edges[:-1]))
                weight.append(np.add.reduceat(self.weights[order], edges[:-1]))
                if level < self.levels:
                    node = np.repeat(np.arange(1 << level), np.diff(edges))
                    widest = (high[-1] - low[-1]).argmax(axis=1)
                    order = order[np.lexsort((own[np.arange(n), widest[node]], node))]
        self.order = order
        self.low, self.high, self.weight = (np.concatenate(x) if x else np.zeros(0) for x in (low, high, weight))

    def edges(self, level: int) -> np.ndarray:
        """Where the nodes of a level begin in ``order``, and the end."""
        return (np.arange((1 << level) + 1) * len(self.points)) >> level

    def walk(self, at: np.ndarray, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``at``, point, squared distance), nearest first by row, of all points within reach.

        ``reach(rows, nodes, far)`` gives each row's squared radius for the next level, from its open
        nodes and the squared distances of their far corners.
        """
        if not len(self.points) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, nodes = np.arange(len(at)), np.zeros(len(at), np.int64)
        limit = np.full(len(at), np.inf)
        for level in range(self.levels + 1):
            q, low, high = at[rows], self.low[nodes], self.high[nodes]
            near = (np.maximum(0, np.maximum(low - q, q - high)) ** 2).sum(axis=1)
            far = (np.maximum(q - low, high - q) ** 2).sum(axis=1)
            limit = np.minimum(limit, reach(rows, nodes, far))
            keep = near <= limit[rows] * ROOM + 1e-300
            rows, nodes = rows[keep], nodes[keep]
            if level < self.levels:
                rows, nodes = np.repeat(rows, 2), np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).reshape(-1)
        edges, first = self.edges(self.levels), (1 << self.levels) - 1
        which, place = spans(edges[nodes - first], edges[nodes - first + 1])
        rows, points = rows[which], self.order[place]
        self.visited += len(points)
        d = squared_pairs(at[rows], self.points[points])
        keep = d <= limit[rows] * ROOM + 1e-300
        rows, points, d = rows[keep], points[keep], d[keep]
        order = np.lexsort((points, d, rows))
        return rows[order], points[order], d[order]

    def within(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, point, squared distance) of the points within each row's radius, nearest first; ties go to the smaller number."""
        square = np.broadcast_to(np.asarray(radius, float) ** 2, (len(at),))
        rows, points, d = self.walk(at, lambda *_: square)
        keep = d <= square[rows]
        return rows[keep], points[keep], d[keep]

    def closest(self, at: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``within``, with radii such that points of weight ``need`` at least come first, all if there are fewer."""

        def reach(rows: np.ndarray, nodes: np.ndarray, far: np.ndarray) -> np.ndarray:
            order = np.lexsort((far, rows))
            r, w = rows[order], self.weight[nodes[order]]
            upto = np.cumsum(w)
            start = np.searchsorted(r, np.arange(len(at)))
            before = np.where(start > 0, upto[np.maximum(start - 1, 0)], 0)
            enough = upto - before[r] >= need
            out = np.full(len(at), np.inf)
            np.minimum.at(out, r[enough], far[order][enough])
            return out

        return self.walk(at, reach)

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, squared distance) nearest to each row; ties go to the smaller number."""
        if not len(self.points):
            raise ShapeError("there is no centre")
        rows, points, d = self.closest(at, 1)
        first = np.searchsorted(rows, np.arange(len(at)))
        return points[first], d[first]


def settle(x: np.ndarray, own: np.ndarray, known: np.ndarray, blocked: np.ndarray, follows: np.ndarray, square: float) -> np.ndarray:
    """States of rows in class order: 1 leads, 2 follows, -1 not yet known.

    ``known`` rows lead already, ``follows`` have an earlier leader, ``blocked`` an earlier row that is
    not known. Rows of other blocks (not ``own``) never become leaders here.
    """
    near = np.tril(squared(x, x) <= square, -1)
    state = np.where(known, 1, np.where(follows, 2, 0))
    while True:
        state_before = state.copy()
        state[(state == 0) & (near & (state == 1)).any(axis=1)] = 2
        free = (state == 0) & ~(near & (state <= 0)).any(axis=1)
        state[free] = np.where(own[free] & ~blocked[free], 1, -1)
        if (state == state_before).all():
            return np.where(state == 0, -1, state)


def touched(x: np.ndarray, others: list[np.ndarray], square: float) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for o in others:
        rest = np.flatnonzero(~out)
        out[rest] = (squared(x[rest], o) <= square).any(axis=1)
    return out


WORK = "class_id long, x array<double>, leads boolean"


def sweep(square: float):
    """Settle the classes of each block, rows sorted by (block, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leaders, open_ = None, [], []
        for batch in batches:
            blocks, ids, own, leads = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "class_id", "own", "leads"))
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if b > a and blocks[a] != block:
                    block, leaders, open_ = blocks[a], [], []
                for i in range(a, b, ROWS):
                    cut = slice(i, min(b, i + ROWS))
                    state = settle(x[cut], own[cut], leads[cut], touched(x[cut], open_, square), touched(x[cut], leaders, square), square)
                    leaders, open_ = gathered(leaders, x[cut][state == 1]), gathered(open_, x[cut][state == -1])
                    out = own[cut] & (state != 2)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cut][out]), lists(x[cut][out]), pa.array(state[out] == 1)], ["class_id", "x", "leads"])

    return run


def gathered(parts: list[np.ndarray], more: np.ndarray) -> list[np.ndarray]:
    """Arrays of some thousand rows, so that neither their number nor the copying grows with each chunk."""
    if not len(more):
        return parts
    if parts and len(parts[-1]) < 4096:
        return [*parts[:-1], np.concatenate([parts[-1], more])]
    return [*parts, more]


def class_table(spark: SparkSession, coefs: np.ndarray) -> DataFrame:
    """(class_id, x) of all 2^nb classes, made where they are used."""
    nb, tables = coefs.shape[1] - 1, chunk_tables(coefs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = class_points(tables, ids) + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x)], ["class_id", "x"])

    return spark.range(1 << nb).withColumnRenamed("id", "class_id").mapInArrow(run, "class_id long, x array<double>")


def blocked(rows: DataFrame, coefs: np.ndarray, radius: float) -> DataFrame:
    """Rows with their block, and again, not as its own, for each neighbouring block whose edge is within the radius."""
    spread = 2 * np.abs(coefs[:, 1:]).sum(axis=1)
    dims = np.argsort(-spread, kind="stable")[: min(2, len(spread))].tolist()
    many = max(1, (1 << (coefs.shape[1] - 1)) // PER_BLOCK) ** (1 / len(dims))
    parts = []
    for d in dims:
        width = max(radius * ROOM, float(spread[d]) / many, 1e-300)
        at = (F.get("x", F.lit(d)) - F.lit(float(coefs[d, 0] - spread[d] / 2))) / F.lit(width)
        cell, room = F.floor(at), F.lit(radius / width * ROOM + 1e-9)
        shifts = F.filter(F.array(F.when(at - cell <= room, F.lit(-1)), F.lit(0), F.when(cell + 1 - at <= room, F.lit(1))), lambda s: s.isNotNull())
        parts.append((cell, shifts))
    for k, (cell, shifts) in enumerate(parts):
        rows = rows.withColumn(f"cell{k}", cell).withColumn(f"shift{k}", F.explode(shifts))
    moved = [F.col(f"shift{k}") for k in range(len(parts))]
    own = moved[0] == 0
    for m in moved[1:]:
        own = own & (m == 0)
    block = F.lit(0).cast("long")
    for k, m in enumerate(moved):  # cells of a dimension are far fewer than 2^30
        block = block * (1 << 31) + F.col(f"cell{k}") + m + 1
    return rows.select(block.alias("block"), own.alias("own"), "class_id", "x", "leads")


def leaders(spark: SparkSession, coefs: np.ndarray, radius: float, max_clusters: int) -> DataFrame:
    """(class_id, x): the classes that lead, as the rule in class order finds them."""
    table = class_table(spark, coefs)
    if radius == 0:
        found = Scratch(spark).last(table.groupBy("x").agg(F.min("class_id").alias("class_id")).select("class_id", "x"))
        return bounded(found, found.count(), max_clusters)
    scratch, work = Scratch(spark), table.withColumn("leads", F.lit(False))
    while True:
        rows = blocked(work, coefs, radius).repartition("block").sortWithinPartitions("block", "class_id")
        work = scratch.last(rows.mapInArrow(sweep(radius * radius), WORK))
        lead, rest = work.agg(F.count_if("leads"), F.count_if(~F.col("leads"))).first()
        bounded(work, lead, max_clusters)
        if not rest:
            return work.select("class_id", "x")


def bounded(found: DataFrame, n: int, max_clusters: int) -> DataFrame:
    if n > max_clusters:
        raise ShapeError("more clusters than allowed")
    return found


def owners(spark: SparkSession, coefs: np.ndarray, ids: np.ndarray, radius: float) -> DataFrame:
    """(class_id, leader): each class with the nearest of the leaders before it, or itself.

    ``ids`` are the leading classes in order; they and their tree go to all executors, so their number
    must be bounded (``max_clusters``).
    """
    tables = chunk_tables(coefs)
    tree = CentreTree(class_points(tables, ids) + 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                classes = batch.column(0).slice(a, 1024).to_numpy()
                rows, points, _ = tree.within(class_points(tables, classes) + 0.0, np.full(len(classes), radius))
                earlier = ids[points] <= classes[rows]
                rows, points = rows[earlier], points[earlier]
                first = np.searchsorted(rows, np.arange(len(classes)))
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(ids[points[first]])], ["class_id", "leader"])

    return spark.range(1 << (coefs.shape[1] - 1)).mapInArrow(run, "class_id long, leader long")
