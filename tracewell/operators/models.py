"""Gaussian models of traces: linear discriminants and regression on label bits.

States are sums that merge (class sums and a pair scatter; normal equations); ``shared`` keeps them
as tables and solves each variable's matrices in a group of its own. A solved model is one row a
variable, small enough to send to every executor, where prediction is dense NumPy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyClassError, ShapeError, SingularError
from .centres import CentreTree, chunk_tables, class_points, leaders, owners, spans, squared_pairs


def matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def lower_factor(c: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(c)
    except np.linalg.LinAlgError as e:
        raise SingularError("the within-class covariance is singular; add traces or drop constant samples") from e


def eigenpairs(s_b: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values descending, rows W) of all generalised eigenpairs, with W cov W^T = I."""
    low = lower_factor(cov)
    inner = np.linalg.solve(low, np.linalg.solve(low, s_b).T)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], np.linalg.solve(low.T, vectors[:, order]).T


def top_directions(factor: np.ndarray, cov: np.ndarray, p: int) -> np.ndarray:
    """(p, samples): the p greatest generalised eigenvectors of S_B = factor^T factor, with W cov W^T = I and each row's largest entry positive.

    ``factor`` has a row for each class or bit. With fewer rows than samples only a problem of its
    rows is decomposed: the eigenvectors of factor cov^-1 factor^T give those of S_B. Directions
    beyond its rank need the full decomposition.
    """
    w = None
    if len(factor) < len(cov):
        lower_factor(cov)  # is positive definite
        inner = np.linalg.solve(cov, factor.T)
        small = factor @ inner
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:p], vectors[:, ::-1][:, :p]
        if len(values) == p and values[-1] > 1e-9 * values[0]:
            w = ((inner @ vectors) / np.sqrt(values)).T
    if w is None:
        w = eigenpairs(factor.T @ factor, cov)[1][:p]
    return w * np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)])[:, None]


def whitening(cov: np.ndarray) -> np.ndarray:
    """(n, n): rows of eigenvectors over roots of eigenvalues."""
    values, vectors = np.linalg.eigh(cov)
    if values.min(initial=1.0) <= 0:
        raise SingularError("the covariance is singular; add traces or drop constant samples")
    return (vectors / np.sqrt(values)).T


@dataclass
class LdaState:
    """Mergeable sums of one variable over its points of interest."""

    nc: int
    points: tuple[int, ...]
    counts: np.ndarray
    sums: np.ndarray  # (nc, points)
    scatter: np.ndarray  # (points, points)

    def merge(self, other: LdaState) -> LdaState:
        if (self.nc, self.points) != (other.nc, other.points):
            raise ShapeError("states of different variables do not merge")
        return LdaState(self.nc, self.points, self.counts + other.counts, self.sums + other.sums, self.scatter + other.scatter)

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    def means(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.sums / self.counts[:, None]

    def factor(self) -> np.ndarray:
        """(nc, points): a row for each class, whose products sum to the scatter between classes."""
        d = self.sums - self.counts[:, None] * (self.sums.sum(axis=0) / self.n)
        return d / np.sqrt(np.maximum(self.counts, 1))[:, None]

    def between(self) -> np.ndarray:
        return self.factor().T @ self.factor()

    def within(self) -> np.ndarray:
        s = self.sums.sum(axis=0).astype(np.longdouble)  # whole sums may need more than 53 bits before they cancel
        return (self.scatter.astype(np.longdouble) - np.outer(s, s) / self.n).astype(float) - self.between()

    def solve(self, p: int) -> LdaModel:
        if (self.counts == 0).any():
            raise EmptyClassError("a class has no trace")
        if p > len(self.points):
            raise ShapeError("more dimensions than points of interest")
        if self.n <= self.nc:
            raise SingularError("more traces than classes are needed")
        cov = self.within() / (self.n - self.nc)
        w = top_directions(self.factor(), cov, p) if p < len(self.points) else whitening(cov)
        omega = self.means() @ w.T
        return LdaModel(self.nc, self.points, w, omega, -0.5 * (omega**2).sum(axis=1))


@dataclass
class LdaModel:
    nc: int
    points: tuple[int, ...]
    w: np.ndarray  # (p, points)
    omega: np.ndarray  # (nc, p)
    pk: np.ndarray  # (nc,)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x[:, list(self.points)].astype(float) @ self.w.T

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.project(x) @ self.omega.T + self.pk

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x))

    def log2_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        s = s - s.max(axis=1, keepdims=True)
        return s[np.arange(len(s)), y] * np.log2(np.e) - np.log2(np.exp(s).sum(axis=1))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def select_vars(models: list, chosen: list[int]) -> list:
    """The chosen variables' models in the given order, repeats allowed."""
    return [models[v] for v in chosen]


def per_trace(traces: DataFrame, schema: str, make: Callable[[np.ndarray, np.ndarray], list[tuple[int, np.ndarray]]]) -> DataFrame:
    """Rows (trace_id, var, value) from the dense result of each batch."""
    cut = traces.select("trace_id", F.col("samples").cast("array<long>").alias("samples"), F.col("labels").cast("array<long>").alias("labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                for var, value in make(matrix_of(part, "samples"), matrix_of(part, "labels")):
                    column = pa.array(value.tolist(), pa.list_(pa.float64()) if value.ndim == 2 else pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, var, np.int32)), column], ["trace_id", "var", "value"])

    return cut.mapInArrow(run, f"trace_id long, var int, value {schema}")


def lda_predict(traces: DataFrame, models: list[LdaModel]) -> DataFrame:
    """(trace_id, var, value): class probabilities."""
    return per_trace(traces, "array<double>", lambda x, y: [(v, m.probabilities(x)) for v, m in enumerate(models)])


def lda_project(traces: DataFrame, models: list[LdaModel]) -> DataFrame:
    return per_trace(traces, "array<double>", lambda x, y: [(v, m.project(x)) for v, m in enumerate(models)])


def lda_log2(traces: DataFrame, models: list[LdaModel]) -> DataFrame:
    """(trace_id, var, value): log2 probability of the trace's own label."""
    return per_trace(traces, "double", lambda x, y: [(v, m.log2_of(x, y[:, v])) for v, m in enumerate(models)])


def bits_of(y: np.ndarray, nb: int) -> np.ndarray:
    """(n, nb + 1): an intercept, then bits as -1 and 1."""
    b = 2.0 * ((y[:, None].astype(np.int64) >> np.arange(nb)) & 1) - 1
    return np.concatenate([np.ones((len(y), 1)), b], axis=1)


@dataclass
class RldaState:
    """Normal equations of the regression of samples on label bits, by variable."""

    nb: int
    n: int
    xtx: np.ndarray  # (vars, nb + 1, nb + 1)
    xty: np.ndarray  # (vars, nb + 1, samples)
    scatter: np.ndarray  # (samples, samples)

    def merge(self, other: RldaState) -> RldaState:
        return RldaState(self.nb, self.n + other.n, self.xtx + other.xtx, self.xty + other.xty, self.scatter + other.scatter)

    def solve(self, p: int) -> list[RldaModel]:
        return [self.solve_one(v, p) for v in range(len(self.xtx))]

    def solve_one(self, v: int, p: int) -> RldaModel:
        xtx, xty, n = self.xtx[v], self.xty[v], self.n
        if (np.abs(xtx[0, 1:]) == n).any():
            raise EmptyClassError("a bit is constant")
        low = lower_factor(xtx)
        coefs = np.linalg.solve(low.T, np.linalg.solve(low, xty))
        model = coefs.T @ xtx @ coefs
        values, vectors = np.linalg.eigh(xtx - np.outer(xtx[0], xtx[0]) / n)
        factor = (vectors * np.sqrt(np.maximum(values, 0))).T @ coefs  # its products are the scatter between classes
        s_w = self.scatter + model - xty.T @ coefs - coefs.T @ xty
        ns = xty.shape[1]
        if p > ns:
            raise ShapeError("more dimensions than samples")
        direction = np.eye(ns) if p == ns else top_directions(factor, s_w, p)
        proj = whitening(direction @ s_w @ direction.T / n) @ direction
        return RldaModel(self.nb, proj, proj @ coefs.T)


@dataclass
class RldaModel:
    nb: int
    proj: np.ndarray  # (p, samples)
    coefs: np.ndarray  # (p, nb + 1)
    chunks: list[np.ndarray] | None = field(default=None, repr=False)

    def points(self, classes: np.ndarray) -> np.ndarray:
        """(n, p) projected means of the given classes, from tables of 256 sums for each byte: nothing grows with 2^nb."""
        if self.chunks is None:
            self.chunks = chunk_tables(self.coefs)
        return class_points(self.chunks, classes) + 0.0

    def means(self) -> np.ndarray:
        """(2^nb, p) projected class means."""
        return self.points(np.arange(1 << self.nb))

    def project(self, x: np.ndarray) -> np.ndarray:
        return x.astype(float) @ self.proj.T

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distance of each projected trace to its own class's mean."""
        return squared_pairs(self.project(x), self.points(y))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        y, c = self.project(x), self.means()
        return softmax(-0.5 * ((y**2).sum(axis=1)[:, None] - 2 * y @ c.T + (c**2).sum(axis=1)))

    def clustered(self, spark: SparkSession, radius: float, max_clusters: int = 10_000_000, keep_members: bool = True) -> ClusteredModel:
        """Greedy leaders in class order: a class joins the nearest centre within the radius, else founds one.

        Leaders and members are found by tasks; what reaches the driver is ``max_clusters`` centres and
        weights at most and, where members are kept, four bytes a class.
        """
        if keep_members and self.nb > MEMBER_BITS:
            raise ShapeError(f"members are kept for {MEMBER_BITS} bits at most")
        ids = np.sort(column(leaders(spark, self.coefs, radius, max_clusters), "class_id"))
        found = owners(spark, self.coefs, ids, radius)
        owner = None
        if keep_members:
            rows = found.toArrow()
            owner = np.empty(1 << self.nb, np.int32)
            owner[rows.column("class_id").to_numpy()] = np.searchsorted(ids, rows.column("leader").to_numpy())
            weights = np.bincount(owner, minlength=len(ids))
        else:
            rows = found.groupBy("leader").agg(F.count("*").alias("n")).toArrow()
            weights = rows.column("n").to_numpy()[np.argsort(rows.column("leader").to_numpy())]
        return ClusteredModel(self, ids, weights, owner, radius)

    def cluster_rows(self, spark: SparkSession, radius: float, max_clusters: int = 10_000_000) -> DataFrame:
        """(class_id, leader): every class with the centre that it joins."""
        ids = np.sort(column(leaders(spark, self.coefs, radius, max_clusters), "class_id"))
        return owners(spark, self.coefs, ids, radius)


#: Up to so many bits a clustered model can keep its members.
MEMBER_BITS = 26


def column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(name).toArrow().column(name).to_numpy()


@dataclass
class ClusteredModel:
    model: RldaModel
    centres: np.ndarray
    weights: np.ndarray
    owner: np.ndarray | None
    radius: float
    _tree: CentreTree | None = field(default=None, repr=False)
    _members: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @property
    def tree(self) -> CentreTree:
        if self._tree is None:
            self._tree = CentreTree(self.model.points(self.centres), self.weights)
        return self._tree

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """(classes by centre, where each centre's begin)."""
        if self._members is None:
            self._members = np.argsort(self.owner, kind="stable"), np.concatenate([[0], np.cumsum(self.weights)])
        return self._members

    def save(self, spark: SparkSession, path: str) -> None:
        """Centres, members where kept, and the model, as tables below ``path``."""
        model = (self.model.nb, self.model.proj.tolist(), self.model.coefs.tolist(), float(self.radius), self.owner is not None)
        spark.createDataFrame([model], "nb int, proj array<array<double>>, coefs array<array<double>>, radius double, members boolean").write.parquet(f"{path}/model")
        spark.createDataFrame(pa.table({"class_id": self.centres.astype(np.int64), "weight": self.weights.astype(np.int64)})).write.parquet(f"{path}/centres")
        if self.owner is not None:
            spark.createDataFrame(pa.table({"class_id": np.arange(len(self.owner)), "centre": self.owner.astype(np.int32)})).write.parquet(f"{path}/members")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusteredModel:
        r = spark.read.parquet(f"{path}/model").first()
        centres = spark.read.parquet(f"{path}/centres").toArrow().sort_by("class_id")
        members = spark.read.parquet(f"{path}/members").toArrow().sort_by("class_id") if r.members else None
        return cls(RldaModel(r.nb, np.array(r.proj), np.array(r.coefs)), centres.column("class_id").to_numpy(), centres.column("weight").to_numpy(), members.column("centre").to_numpy() if members else None, r.radius)

    def get_size(self) -> int:
        return len(self.centres)

    def get_max_sqdist(self) -> float:
        return self.radius * self.radius

    def nearest(self, point: np.ndarray) -> tuple[int, float]:
        """(class of the nearest centre, squared distance)."""
        at, d = self.tree.nearest(np.asarray(point, float)[None, :])
        return int(self.centres[at[0]]), float(d[0])

    def close_centres(self, point: np.ndarray, budget: int) -> list[int]:
        """Nearest centres, by number, as long as their members together stay below the budget."""
        if self.owner is None:
            raise ShapeError("the model was clustered without members")
        _, at, _ = self.tree.closest(np.asarray(point, float)[None, :], budget)
        return at[np.cumsum(self.weights[at]) < budget].tolist()

    def table(self, spark: SparkSession) -> DataFrame:
        classes, starts = self.members() if self.owner is not None else (None, None)
        rows = [(i, int(c), int(w), classes[starts[i] : starts[i + 1]].tolist() if classes is not None else None) for i, (c, w) in enumerate(zip(self.centres, self.weights, strict=True))]
        return spark.createDataFrame(rows, "cluster_id int, class_id long, weight long, members array<long>")

    def bounded(self, x: np.ndarray, y: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) probability of each trace's own class; members of near centres are counted exactly.

        Traces go through the tree together. Each has its exponents shifted by that of its nearest
        centre's upper bound, so that far traces neither vanish nor divide by zero; centres whose shifted
        upper bound is 0 in double precision are not visited. Where even the lower sum vanishes, the upper
        probability is 1.
        """
        at, own, tree = self.model.project(x), self.model.distances(x, y), self.tree
        low, high = np.empty(len(at)), np.empty(len(at))
        step = max(1, min(1024, PAIRS // max(1, len(self.centres))))
        for a in range(0, len(at), step):
            q = at[a : a + step]
            _, first = tree.nearest(q)
            shift = 0.5 * np.maximum(np.sqrt(first) - self.radius, 0) ** 2
            rows, points, d = tree.within(q, (self.radius + np.sqrt(2 * (VANISH + shift))) * (1 + 1e-9))
            root, weight = np.sqrt(d), self.weights[points]
            exact = np.zeros(len(q))
            near = np.zeros(len(rows), bool)
            if self.owner is not None and budget > 1:
                upto = np.cumsum(weight)
                begin = np.searchsorted(rows, np.arange(len(q)))
                before = np.where(begin > 0, upto[np.maximum(begin - 1, 0)], 0)
                near = upto - before[rows] < budget
                classes, starts = self.members()
                which, place = spans(starts[points[near]], starts[points[near] + 1])
                own_rows = rows[near][which]
                exact = np.bincount(own_rows, np.exp(shift[own_rows] - 0.5 * squared_pairs(q[own_rows], self.model.points(classes[place]))), len(q))
            r, w, s, root = rows[~near], weight[~near], shift[rows[~near]], root[~near]
            least = exact + np.bincount(r, np.exp(s - 0.5 * (root + self.radius) ** 2) * w, len(q))
            most = exact + np.bincount(r, np.exp(s - 0.5 * np.maximum(root - self.radius, 0) ** 2) * w, len(q))
            p = np.exp(shift - 0.5 * own[a : a + step])
            low[a : a + step] = p / most
            high[a : a + step] = np.divide(p, least, out=np.ones(len(q)), where=least > 0)
        return low, high


#: Pairs of traces and centres that are held at a time, about; exponents beyond VANISH are 0 in double precision.
PAIRS, VANISH = 1 << 22, 750.0


def rlda_predict(traces: DataFrame, model: RldaModel, var: int = 0) -> DataFrame:
    return per_trace(traces, "array<double>", lambda x, y: [(var, model.probabilities(x))])


def rlda_distances(traces: DataFrame, model: RldaModel, var: int = 0) -> DataFrame:
    """(trace_id, var, value): squared distance of the projected trace to the mean of its own class, for any number of bits."""
    return per_trace(traces, "double", lambda x, y: [(var, model.distances(x, y[:, var]))])


def information_sums(traces: DataFrame, clustered: ClusteredModel, budget: int, var: int = 0) -> DataFrame:
    """One row (n, lower, upper, lower2, upper2): sums of the bounds' log2 and of its square, which merge."""
    clustered.tree, clustered.owner is not None and clustered.members()  # made once, sent to all
    both = per_trace(traces, "array<double>", lambda x, y: [(var, np.stack(clustered.bounded(x, y[:, var], budget), axis=1))])
    logs = both.select(F.log2(F.get("value", F.lit(0))).alias("l"), F.log2(F.get("value", F.lit(1))).alias("h"))
    return logs.agg(F.count("*").alias("n"), F.sum("l").alias("lower"), F.sum("h").alias("upper"), F.sum(F.col("l") * F.col("l")).alias("lower2"), F.sum(F.col("h") * F.col("h")).alias("upper2"))


def information(traces: DataFrame, clustered: ClusteredModel, budget: int, var: int = 0) -> DataFrame:
    """One row: (n, lower, upper, deviation_lower, deviation_upper) of the estimated information in bits."""
    nb, n = clustered.model.nb, F.col("n")
    spread = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"{c}2"), n) - F.try_divide(F.col(c), n) ** 2)).alias(f"deviation_{c}")
    return information_sums(traces, clustered, budget, var).select("n", *((nb + F.try_divide(F.col(c), n)).alias(c) for c in ("lower", "upper")), spread("lower"), spread("upper"))
