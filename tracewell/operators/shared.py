"""States of Gaussian models as tables, shared by variables, and solving as a grouped operation.

A state is rows (kind, a, b, n, v) of whole numbers that add up by (kind, a, b):

``union``   all samples that any variable uses, in order; ``points``, by variable, its own (b: classes or bits)
``class``   by (variable, class): number of traces and sums over the variable's points
``tile``    by (row block, column block) of the used samples: sums of products, each computed once
            however many variables need it
``bits``, ``cross``  by (variable, bit): sums of products of signed bits with bits, and with samples

Tasks turn Arrow batches into dense blocks and send a row for each key they met; rows of a key are
then added as a stream, one in memory at a time. Sums are exact int64 and raise where they leave it.
Solving gathers each variable's matrices from the tiles it touches, in one group a variable, so the
driver holds no matrix; a model is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..errors import ShapeError
from .models import LdaModel, LdaState, RldaModel, RldaState, bits_of, matrix_of
from .stats import int_gram

TILE = 32
STATE = "kind string, a int, b int, n long, v array<long>"
KEY = ["kind", "a", "b"]
#: Whole numbers of state that a task holds in one pass over the traces, and traces of a matrix product.
HELD, ROWS = 1 << 25, 2048
FIXED = ("union", "points")


def state_batches(rows: Iterator[tuple[str, int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """State rows as Arrow batches of at most a few megabytes."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kind, a, b, n, v = zip(*held, strict=True)
        flat = pa.array(np.concatenate([np.asarray(x, np.int64).reshape(-1) for x in v]), pa.int64())
        offsets = pa.array(np.concatenate([[0], np.cumsum([np.size(x) for x in v])]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["kind", "a", "b", "n", "v"])

    for row in rows:
        held.append(row)
        size += np.size(row[4])
        if size >= 1 << 18:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of int64 arrays, which must stay in range."""
    s = a + b
    if (((a ^ s) & (b ^ s)) < 0).any():
        raise OverflowError("a sum leaves 64 bits")
    return s


def sum_rows(rows: DataFrame) -> DataFrame:
    """One row for each (kind, a, b); of fixed kinds, which must agree, the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> Iterator[tuple]:
            now, n, total = None, 0, None
            for batch in batches:
                kinds, a, b, counts = (batch.column(i).to_pylist() for i in range(4))
                v = batch.column(4)
                flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
                for key, count, own in zip(zip(kinds, a, b, strict=True), counts, np.split(flat, ends[:-1]), strict=True):
                    if key != now:
                        if now:
                            yield (*now, n, total)
                        now, n, total = key, count, own.copy()
                    elif own.shape != total.shape or key[0] in FIXED and (own != total).any():
                        raise ShapeError("states of different variables do not merge")
                    elif key[0] not in FIXED:
                        n, total = n + count, added(total, own)
            if now:
                yield (*now, n, total)

        yield from state_batches(summed())

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, STATE)


def merge_states(*states: DataFrame) -> DataFrame:
    """States of any number of batches as one."""
    return sum_rows(reduce(DataFrame.unionByName, states))


def tiles_of(places: list[np.ndarray]) -> list[tuple[int, int]]:
    """(row block, column block), row block first or equal, of every pair of points that some variable has."""
    found: set[tuple[int, int]] = set()
    for own in {tuple(np.unique(p // TILE).tolist()) for p in places}:
        found.update((a, b) for i, a in enumerate(own) for b in own[i:])
    return sorted(found)


def passes(sizes: list[tuple[int, object]]) -> list[list]:
    """Items in runs whose sizes add up to HELD at most, one item at least."""
    out: list[list] = []
    room = 0
    for size, item in sizes:
        if not out or size > room:
            out.append([])
            room = HELD
        out[-1].append(item)
        room -= size
    return out


def add_tiles(held: dict[tuple[int, int], np.ndarray], x: np.ndarray, tiles: list[tuple[int, int]]) -> None:
    by_row: dict[int, list[int]] = {}
    for a, b in tiles:
        by_row.setdefault(a, []).append(b)
    for a, columns in by_row.items():
        at = np.concatenate([np.arange(b * TILE, min((b + 1) * TILE, x.shape[1])) for b in columns])
        product = int_gram(x[:, a * TILE : (a + 1) * TILE], x[:, at])
        start = 0
        for b in columns:
            width = min((b + 1) * TILE, x.shape[1]) - b * TILE
            own = product[:, start : start + width]
            held[a, b] = added(held[a, b], own) if (a, b) in held else own.copy()
            start += width


def lda_state(traces: DataFrame, nc: int, points: list[list[int]]) -> DataFrame:
    """The state of linear discriminants of nc classes: a label and a list of points for each variable.

    State beyond HELD numbers a task is computed in several passes over the traces.
    """
    used = np.unique(np.concatenate([np.asarray(p, np.int64) for p in points])) if any(points) else np.zeros(0, np.int64)
    places = [np.searchsorted(used, np.asarray(p, np.int64)) for p in points]
    cut = traces.select(F.col("samples").cast("array<long>").alias("samples"), F.col("labels").cast("array<int>").alias("labels"))
    work = passes([(nc * len(p), v) for v, p in enumerate(points)] + [(TILE * TILE, t) for t in tiles_of(places)])

    def one_pass(own: list) -> Callable:
        variables, tiles = [x for x in own if isinstance(x, int)], [x for x in own if not isinstance(x, int)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = {v: np.zeros(nc, np.int64) for v in variables}
            sums = {v: np.zeros((nc, len(places[v])), np.int64) for v in variables}
            held: dict[tuple[int, int], np.ndarray] = {}
            n = 0
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    x, y = matrix_of(part, "samples"), matrix_of(part, "labels")
                    if len(used) and used[-1] >= x.shape[1]:
                        raise ShapeError("a point of interest is out of bounds")
                    if y.shape[1] != len(points) or y.min() < 0 or y.max() >= nc:
                        raise ShapeError("a label is out of bounds")
                    x = x[:, used]
                    n += len(x)
                    for v in variables:
                        hot = np.zeros((len(x), nc), np.int64)
                        hot[np.arange(len(x)), y[:, v]] = 1
                        counts[v] += hot.sum(axis=0)
                        sums[v] = added(sums[v], int_gram(hot, x[:, places[v]]))
                    add_tiles(held, x, tiles)
            rows = [("class", v, c, int(counts[v][c]), sums[v][c]) for v in variables for c in np.flatnonzero(counts[v]).tolist()]
            yield from state_batches(iter(rows + [("tile", a, b, n, m) for (a, b), m in held.items()]))

        return run

    rows = [cut.mapInArrow(one_pass(own), STATE) for own in work]
    fixed = [("union", 0, 0, 0, used.tolist()), *(("points", v, nc, 0, list(map(int, p))) for v, p in enumerate(points))]
    return sum_rows(reduce(DataFrame.unionByName, rows, traces.sparkSession.createDataFrame(fixed, STATE)))


def rlda_state(traces: DataFrame, nb: int) -> DataFrame:
    """The state of the regression of all samples on the labels' bits, for each label.

    A task holds ns^2 / 2 sums of products and (nb + 1) ns sums for each label.
    """
    cut = traces.select(F.col("samples").cast("array<long>").alias("samples"), F.col("labels").cast("array<long>").alias("labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        bits: np.ndarray | None = None
        cross, n, ns = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, y = matrix_of(part, "samples"), matrix_of(part, "labels")
                n, ns = n + len(x), x.shape[1]
                signs = [bits_of(y[:, v], nb).astype(np.int64) for v in range(y.shape[1])]
                new = np.stack([int_gram(s, s) for s in signs]), np.stack([int_gram(s, x) for s in signs])
                bits, cross = new if bits is None else (added(bits, new[0]), added(cross, new[1]))
                add_tiles(held, x, tiles_of([np.arange(ns)]))
        if n:
            rows = [("bits", v, i, n, r) for v, m in enumerate(bits) for i, r in enumerate(m)] + [("cross", v, i, n, r) for v, m in enumerate(cross) for i, r in enumerate(m)]
            fixed = [("union", 0, 0, 0, np.arange(ns))] + [("points", v, nb, 0, np.arange(ns)) for v in range(len(bits))]
            yield from state_batches(iter(fixed + rows + [("tile", a, b, n, m) for (a, b), m in held.items()]))

    return sum_rows(cut.mapInArrow(run, STATE))


GATHERED = "var int, kind string, b int, n long, i array<int>, j array<int>, v array<long>"


def by_variable(state: DataFrame) -> DataFrame:
    """(var, kind, b, n, i, j, v): each variable's own rows, and the entries of tiles between its points, as places in its list."""
    union = state.where("kind = 'union'").select("v").first()
    used = np.array(union.v if union else [], np.int64)  # as many as a trace has samples

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for var, points in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = np.unique(np.searchsorted(used, np.array(points, np.int64)) // TILE).tolist()
                pairs = [(a, b) for k, a in enumerate(blocks) for b in blocks[k:]]
                yield pa.RecordBatch.from_arrays([pa.array([var] * len(pairs), pa.int32()), pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()), pa.array([points] * len(pairs), pa.list_(pa.int64()))], ["var", "a", "b", "points"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("var", "a", "b", "points", "n")]
            tiles = batch.column(batch.schema.get_field_index("v"))
            for k, (var, a, b, points, n) in enumerate(zip(*columns, strict=True)):
                place = np.searchsorted(used, np.array(points, np.int64))
                i, j = np.flatnonzero(place // TILE == a), np.flatnonzero(place // TILE == b)
                width = min((b + 1) * TILE, len(used)) - b * TILE
                tile = tiles[k].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                own = tile[np.ix_(place[i] % TILE, place[j] % TILE)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((var, pa.int32()), ("tile", pa.string()), (0, pa.int32()), (n, pa.int64()), (i.astype(np.int32), pa.list_(pa.int32())), (j.astype(np.int32), pa.list_(pa.int32())), (own.reshape(-1), pa.list_(pa.int64())))], ["var", "kind", "b", "n", "i", "j", "v"])

    points = state.where("kind = 'points'").select(F.col("a").alias("var"), F.col("v").alias("points"))
    tiles = points.mapInArrow(needed, "var int, a int, b int, points array<long>").join(state.where("kind = 'tile'").select("a", "b", "n", "v"), ["a", "b"])
    none = F.lit(None).cast("array<int>")
    own = state.where("kind not in ('union', 'tile')").select(F.col("a").alias("var"), "kind", "b", "n", none.alias("i"), none.alias("j"), "v")
    return own.unionByName(tiles.mapInArrow(cut, GATHERED))


def scatter_of(rows: dict, size: int) -> np.ndarray:
    out = np.zeros((size, size), np.int64)
    for kind, i, j, v in zip(rows["kind"], rows["i"], rows["j"], rows["v"], strict=True):
        if kind == "tile":
            block = np.array(v, np.int64).reshape(len(i), len(j))
            out[np.ix_(i, j)] = block
            out[np.ix_(j, i)] = block.T
    return out


def lda_of(rows: dict) -> LdaState:
    at = rows["kind"].index("points")
    nc, points = rows["b"][at], tuple(rows["v"][at])
    counts, sums = np.zeros(nc, np.int64), np.zeros((nc, len(points)), np.int64)
    for kind, b, n, v in zip(rows["kind"], rows["b"], rows["n"], rows["v"], strict=True):
        if kind == "class":
            counts[b], sums[b] = n, v
    return LdaState(nc, points, counts, sums, scatter_of(rows, len(points)))


def rlda_of(rows: dict) -> RldaState:
    at = rows["kind"].index("points")
    nb, ns = rows["b"][at], len(rows["v"][at])
    xtx, xty, n = np.zeros((nb + 1, nb + 1)), np.zeros((nb + 1, ns)), 0
    for kind, b, count, v in zip(rows["kind"], rows["b"], rows["n"], rows["v"], strict=True):
        if kind in ("bits", "cross"):
            (xtx if kind == "bits" else xty)[b], n = v, count
    return RldaState(nb, n, xtx[None], xty[None], scatter_of(rows, ns).astype(float))


def each_variable(state: DataFrame, make: Callable[[dict], tuple], schema: str) -> DataFrame:
    """(var, ..., error): what ``make`` gives for each variable's rows; where it raises an error of ours, its name and text."""
    fields = schema.count(",") + 1 if schema else 0
    target = f"var int, {schema}, error string"

    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("var", "kind", "b", "n", "i", "j", "v")}
        try:
            values, error = make(rows), None
        except errors.TracewellError as e:
            values, error = (None,) * fields, f"{type(e).__name__}: {e}"
        types = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
        names = [part.rpartition(" ") for part in schema.split(", ")]
        columns = [pa.array([rows["var"][0]], pa.int32()), *(pa.array([v.tolist() if isinstance(v, np.ndarray) else v], types[k]) for v, (_, _, k) in zip(values, names, strict=True)), pa.array([error], pa.string())]
        return pa.Table.from_arrays(columns, ["var", *(n for n, _, _ in names), "error"])

    return by_variable(state).groupBy("var").applyInArrow(run, target)


def lda_solve(state: DataFrame, p: int) -> DataFrame:
    """(var, nc, points, w, omega, pk, error): a solved model a row."""

    def make(rows: dict) -> tuple:
        m = lda_of(rows).solve(p)
        return m.nc, list(m.points), m.w, m.omega, m.pk

    return each_variable(state, make, "nc int, points array<int>, w array<array<double>>, omega array<array<double>>, pk array<double>")


def lda_matrices(state: DataFrame) -> DataFrame:
    """(var, n, s_w, s_b, mus, error): scatter within and between classes, and class means, of each variable."""

    def make(rows: dict) -> tuple:
        s = lda_of(rows)
        return s.n, s.within(), s.between(), s.means()

    return each_variable(state, make, "n long, s_w array<array<double>>, s_b array<array<double>>, mus array<array<double>>")


def rlda_solve(state: DataFrame, p: int) -> DataFrame:
    """(var, nb, proj, coefs, error): a solved regression model a row."""

    def make(rows: dict) -> tuple:
        m = rlda_of(rows).solve_one(0, p)
        return m.nb, m.proj, m.coefs

    return each_variable(state, make, "nb int, proj array<array<double>>, coefs array<array<double>>")


def collected(table: DataFrame) -> list:
    """Rows by variable; the first error among them is raised."""
    rows = table.orderBy("var").collect()
    for r in rows:
        if r.error:
            name, _, text = r.error.partition(": ")
            raise getattr(errors, name)(text)
    return rows


def lda_models(table: DataFrame) -> list[LdaModel]:
    """Solved models, a few numbers for each point and class, for prediction."""
    return [LdaModel(r.nc, tuple(r.points), np.array(r.w), np.array(r.omega), np.array(r.pk)) for r in collected(table)]


def rlda_models(table: DataFrame) -> list[RldaModel]:
    return [RldaModel(r.nb, np.array(r.proj), np.array(r.coefs)) for r in collected(table)]


def selected(table: DataFrame, chosen: list[int]) -> DataFrame:
    """The chosen variables' models, numbered anew in the given order, repeats allowed."""
    order = table.sparkSession.createDataFrame(list(enumerate(chosen)), "new_var int, var int")
    return order.join(table, "var").drop("var").withColumnRenamed("new_var", "var").select(*table.columns)
