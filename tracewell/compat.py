"""Accumulator objects over the operators: ``fit_u`` takes batches, ``get_*`` reads out at any time.

Batches are DataFrames (trace_id, samples, labels) or pairs of NumPy arrays; results are arrays.
State between batches is a stored table or a small matrix.
"""

from __future__ import annotations

import contextlib
import warnings
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ShapeError
from .operators import metrics, models, quantize, rank, shared, stats
from .plans.graph import Graph, parse
from .plans.propagation import Beliefs
from .sources import traces as sources
from .sources.scratch import remove, store

_SESSION: ContextVar[SparkSession | None] = ContextVar("session", default=None)


class Config:
    """The session that accumulators use; ``activate`` scopes it."""

    def __init__(self, session: SparkSession | None = None, n_threads: int | None = None, show_progress: bool = True):
        self.session, self.n_threads, self.show_progress = session, n_threads, show_progress

    @contextlib.contextmanager
    def activate(self):
        token = _SESSION.set(self.session or new_session(self.n_threads, self.show_progress))
        try:
            yield self
        finally:
            _SESSION.reset(token)


def new_session(n_threads: int | None = None, show_progress: bool = True) -> SparkSession:
    builder = SparkSession.builder.config("spark.ui.showConsoleProgress", str(show_progress).lower())
    return (builder.master(f"local[{n_threads}]") if n_threads else builder).getOrCreate()


def default_config() -> Config:
    return Config()


def get_config() -> Config:
    return Config(_SESSION.get() or SparkSession.getActiveSession())


def session() -> SparkSession:
    return _SESSION.get() or SparkSession.getActiveSession() or new_session()


@contextlib.contextmanager
def job_group(name: str, description: str = ""):
    """Jobs inside belong to a group that ``cancel(name)`` ends from anywhere; an interrupt (Ctrl-C) inside ends them too."""
    sc = session().sparkContext
    sc.setJobGroup(name, description, interruptOnCancel=True)
    try:
        yield name
    except KeyboardInterrupt:
        sc.cancelJobGroup(name)
        raise
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def cancel(name: str) -> None:
    """End all running jobs of a group; the call that waits for them raises."""
    session().sparkContext.cancelJobGroup(name)


class ContextExecutor(ThreadPoolExecutor):
    """Tasks see the submitter's context variables."""

    def submit(self, fn, /, *args, **kwargs):
        return super().submit(copy_context().run, fn, *args, **kwargs)


def as_traces(batch, labels=None, kind=np.uint16) -> DataFrame:
    """A canonical table of a batch; arrays are checked like the table's types."""
    if isinstance(batch, DataFrame):
        return batch
    x = np.asarray(batch)
    if x.dtype != np.int16 or x.ndim != 2:
        raise ShapeError("traces are a two-dimensional int16 array")
    y = np.zeros((len(x), 1), kind) if labels is None else np.asarray(labels)
    if y.dtype != kind or y.ndim not in (1, 2):
        raise ShapeError(f"labels are a one- or two-dimensional {np.dtype(kind).name} array")
    y = y[:, None] if y.ndim == 1 else y
    if len(y) != len(x):
        raise ShapeError("traces and labels differ in number")
    import pyarrow as pa

    def nested(a: np.ndarray, t: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1).astype(np.int64), pa.int64()).cast(t))

    table = pa.table({"trace_id": np.arange(len(x)), "samples": nested(x, pa.int16()), "labels": nested(y, pa.int64())})
    return session().createDataFrame(table)


def cube(rows: list, names: tuple[str, ...], value: str, dims: tuple[int, ...]) -> np.ndarray:
    out = np.full(dims, np.nan)
    for r in rows:
        out[tuple(r[n] for n in names)] = np.nan if r[value] is None else r[value]
    return out


def _replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new`` as a stored table; the one it was made from goes."""
    kept = store(new)
    if old is not None:
        remove(old.sparkSession, old.inputFiles()[0].rsplit("/", 1)[0]) if old.inputFiles() else None
    return kept


class _Fitted:
    """Shape is learnt from the first batch and holds from then on."""

    def __init__(self):
        self.ns = self.nv = None

    def _check(self, t: DataFrame) -> DataFrame:
        n, ns, nv = sources.shape(t)
        if self.ns is None:
            self.ns, self.nv = ns, nv
        elif n and (ns, nv) != (self.ns, self.nv):
            raise ShapeError(f"batches have {self.ns} samples and {self.nv} labels, this one {ns} and {nv}")
        return t


class _ClassSums(_Fitted):
    def __init__(self, nc: int):
        super().__init__()
        if not 2 <= nc <= 1 << 16:
            raise ShapeError("2 to 65536 classes")
        self.nc, self.state = nc, None

    def fit_u(self, traces, x=None):
        t = self._check(as_traces(traces, x))
        sources.check_classes(t, self.nc)
        new = stats.class_state(t, dense=self.ns * self.nv >= stats.DENSE_FROM)
        merged = new if self.state is None else stats.merge_class_states(self.state, new)
        self.state = _replaced(self.state, merged)
        return self


class SNR(_ClassSums):
    def __init__(self, nc: int, use_64bit: bool = False):
        super().__init__(nc)
        self.use_64bit = use_64bit

    def get_snr(self) -> np.ndarray:
        return cube(metrics.snr(self.state).collect(), ("var", "sample"), "snr", (self.nv, self.ns))


class Cpa(_ClassSums):
    Xor, Add = "xor", "add"

    def __init__(self, nc: int, kind: str = "xor", use_64bit: bool = False):
        super().__init__(nc)
        self.kind, self.use_64bit = kind, use_64bit

    def get_correlation(self, leakage: np.ndarray) -> np.ndarray:
        m = np.asarray(leakage, float)
        if m.shape != (self.nv, self.nc, self.ns):
            raise ShapeError(f"models need shape {(self.nv, self.nc, self.ns)}")
        v, c, s = np.meshgrid(*map(np.arange, m.shape), indexing="ij")
        import pyarrow as pa

        table = session().createDataFrame(pa.table({"var": v.ravel().astype(np.int32), "class": c.ravel().astype(np.int32), "sample": s.ravel().astype(np.int32), "m": m.ravel()}))
        return cube(metrics.cpa(self.state, table, self.nc, self.kind).collect(), ("var", "key", "sample"), "rho", (self.nv, self.nc, self.ns))


class Ttest(_Fitted):
    def __init__(self, d: int):
        super().__init__()
        self.d, self.state = d, None

    def fit_u(self, traces, x=None):
        t = self._check(as_traces(traces, x))
        sources.check_classes(t, 2)
        new = stats.dense_moments(t, F.get("labels", F.lit(0)), 2 * self.d)
        merged = new if self.state is None else stats.merge_moments(self.state, new, order=2 * self.d)
        self.state = _replaced(self.state, merged)
        return self

    def get_ttest(self) -> np.ndarray:
        rows = metrics.ttest(self.state, self.d).withColumn("order", F.col("order") - 1).collect()
        return cube(rows, ("order", "sample"), "t", (self.d, self.ns))


class MTtest(_Fitted):
    def __init__(self, d: int, pois):
        super().__init__()
        pois = np.asarray(pois)
        if d < 2 or pois.ndim != 2 or len(pois) != d:
            raise ShapeError("pois has one row for each of d > 1 samples")
        self.d, self.pois, self.state = d, pois, None

    def fit_u(self, traces, x=None):
        t = self._check(as_traces(traces, x))
        sources.check_classes(t, 2)
        new = stats.tuple_moments(t, F.get("labels", F.lit(0)), self.pois.T.tolist())
        self.state = _replaced(self.state, new if self.state is None else stats.merge_tuple_moments(self.state, new, d=self.d))
        return self

    def get_ttest(self) -> np.ndarray:
        return cube(metrics.mttest(self.state, self.d).collect(), ("tuple_id",), "t", (self.pois.shape[1],))


class LdaAcc:
    """The state is a stored table; scatter matrices and means are made by variable when asked for."""

    def __init__(self, nc: int, pois: list[list[int]]):
        self.nc, self.pois, self.state = nc, [list(map(int, p)) for p in pois], None

    def fit_u(self, traces, x=None):
        t = as_traces(traces, x)
        _, ns, nv = sources.shape(t)
        if nv != len(self.pois):
            raise ShapeError("one label for each list of points")
        if max((max(p, default=0) for p in self.pois), default=0) >= ns:
            raise ShapeError("a point of interest is out of bounds")
        sources.check_classes(t, self.nc)
        new = shared.lda_state(t, self.nc, self.pois)
        self.state = _replaced(self.state, new if self.state is None else shared.merge_states(self.state, new))
        return self

    def _matrices(self, name: str) -> list[np.ndarray]:
        return [np.array(r[name]) for r in shared.collected(shared.lda_matrices(self.state).select("var", name, "error"))]

    def get_sw(self):
        return self._matrices("s_w")

    def get_sb(self):
        return self._matrices("s_b")

    def get_mus(self):
        return self._matrices("mus")

    def save(self, path: str) -> None:
        sources.save_state(self.state, path)

    @classmethod
    def load(cls, path: str) -> LdaAcc:
        state = sources.load_state(session(), path)
        points = state.where("kind = 'points'").orderBy("a").collect()
        acc = cls(points[0].b if points else 0, [r.v for r in points])
        acc.state = store(state)
        return acc


class Lda:
    """Solved models as a stored table of a row for each variable; prediction reads it and runs over the traces' batches."""

    def __init__(self, acc: LdaAcc | None, p: int = 1, table: DataFrame | None = None):
        self.table = table if table is not None else store(shared.lda_solve(acc.state, p))
        self.models = shared.lda_models(self.table)

    def _by_var(self, rows: DataFrame) -> list[np.ndarray]:
        """One array a variable, traces in order."""
        out: dict[int, list] = {v: [] for v in range(len(self.models))}
        for r in rows.orderBy("var", "trace_id").toLocalIterator():
            out[r["var"]].append(r["value"])
        return [np.array(v) for v in out.values()]

    def predict_proba(self, traces) -> np.ndarray:
        return np.stack(self._by_var(models.lda_predict(as_traces(traces), self.models)))

    def predict_log2_proba_class(self, traces, x=None) -> np.ndarray:
        return np.stack(self._by_var(models.lda_log2(as_traces(traces, x), self.models)))

    def project(self, traces) -> list[np.ndarray]:
        return self._by_var(models.lda_project(as_traces(traces), self.models))

    def select_vars(self, chosen: list[int]) -> Lda:
        return Lda(None, table=store(shared.selected(self.table, chosen)))

    def predict_table(self, traces: DataFrame) -> DataFrame:
        return models.lda_predict(traces, self.models)

    def save(self, path: str) -> None:
        sources.save_state(self.table, path)

    @classmethod
    def load(cls, path: str) -> Lda:
        return cls(None, table=sources.load_state(session(), path))


class LDAClassifier:
    """Deprecated: one variable over all samples; use LdaAcc and Lda."""

    def __init__(self, nc: int, p: int):
        warnings.warn("use LdaAcc and Lda", DeprecationWarning, stacklevel=2)
        if p >= nc:
            raise ShapeError("fewer dimensions than classes")
        self.nc, self.p, self.acc, self.lda, self.done = nc, p, None, None, False

    def fit_u(self, traces, x=None):
        if self.done:
            raise ShapeError("no more traces after the last solve")
        t = as_traces(traces, x)
        self.acc = self.acc or LdaAcc(self.nc, [list(range(sources.shape(t)[1]))])
        self.acc.fit_u(t)
        self.lda = None
        return self

    def solve(self, done: bool = False):
        if self.lda is not None:
            raise ShapeError("already solved")
        self.lda, self.done = Lda(self.acc, self.p), done
        return self

    def predict_proba(self, traces):
        return self.lda.predict_proba(traces)[0]

    def get_sw(self):
        return self.acc.get_sw()[0]

    def get_sb(self):
        return self.acc.get_sb()[0]

    def get_mus(self):
        return self.acc.get_mus()[0]


class MultiLDA:
    """Deprecated: variables with classes and dimensions of their own; use LdaAcc and Lda."""

    def __init__(self, ncs, ps, pois):
        warnings.warn("use LdaAcc and Lda", DeprecationWarning, stacklevel=2)
        self.ps, self.accs, self.ldas = ps, [LdaAcc(nc, [p]) for nc, p in zip(ncs, pois, strict=True)], []

    def fit_u(self, traces, x):
        for v, acc in enumerate(self.accs):
            acc.fit_u(traces, np.ascontiguousarray(np.asarray(x)[:, v]))
        return self

    def solve(self):
        self.ldas = [Lda(a, p) for a, p in zip(self.accs, self.ps, strict=True)]
        return self

    def predict_proba(self, traces):
        return [m.predict_proba(traces)[0] for m in self.ldas]


class RLDAClassifier:
    def __init__(self, nb: int, p: int):
        self.nb, self.p, self.state, self.table, self.solved = nb, p, None, None, None

    def fit_u(self, traces, x=None, gemm_mode: int = 1):
        new = shared.rlda_state(as_traces(traces, x, np.uint64), self.nb)
        self.state = _replaced(self.state, new if self.state is None else shared.merge_states(self.state, new))
        return self

    def solve(self):
        self.table = store(shared.rlda_solve(self.state, self.p))
        self.solved = shared.rlda_models(self.table)
        return self

    def save(self, path: str) -> None:
        """The state and, where solved, the models."""
        sources.save_state(self.state, f"{path}/state")
        if self.table is not None:
            sources.save_state(self.table, f"{path}/models")

    @classmethod
    def load(cls, path: str, nb: int, p: int, solved: bool = True) -> RLDAClassifier:
        new = cls(nb, p)
        new.state = store(sources.load_state(session(), f"{path}/state"))
        if solved:
            new.table = sources.load_state(session(), f"{path}/models")
            new.solved = shared.rlda_models(new.table)
        return new

    def get_proj(self):
        return np.stack([m.proj for m in self.solved])

    def get_proj_coefs(self):
        return np.stack([m.coefs for m in self.solved])

    def predict_proba(self, traces, var: int):
        rows = models.rlda_predict(as_traces(traces), self.solved[var], var).orderBy("trace_id").toLocalIterator()
        return np.array([r["value"] for r in rows])

    def get_clustered_model(self, var: int, t: float, max_clusters: int = 10_000_000, store_associated_classes: bool = True):
        return self.solved[var].clustered(session(), t, max_clusters, store_associated_classes)


class RLDAInformationEstimator:
    def __init__(self, model: models.ClusteredModel, max_popped_classes: int):
        self.model, self.budget = model, max_popped_classes
        self.n, self.sums = 0, np.zeros(4)

    def fit_u(self, traces, x=None):
        r = models.information_sums(as_traces(traces, x, np.uint64), self.model, self.budget).first()
        self.n += r.n
        self.sums += [r.lower or 0.0, r.upper or 0.0, r.lower2 or 0.0, r.upper2 or 0.0]
        return self

    def get_information(self) -> tuple[float, float]:
        return self.model.model.nb + self.sums[0] / self.n, self.model.model.nb + self.sums[1] / self.n

    def get_deviation(self) -> tuple[float, float, int]:
        m = self.sums / self.n
        return float(np.sqrt(max(m[2] - m[0] ** 2, 0))), float(np.sqrt(max(m[3] - m[1] ** 2, 0))), self.n


class QuantFitMethod:
    def __init__(self, kind: str, **options):
        self.kind, self.options = kind, options

    @classmethod
    def bounds(cls, margin: float = 4.0):
        return cls("bounds", margin=margin)

    @classmethod
    def moment(cls, nstd: float = 7.0):
        return cls("moment", nstd=nstd)


class Quantizer:
    """Shift and scale by sample, over DataFrames of float traces."""

    def __init__(self, fitted: DataFrame):
        self.fitted = fitted

    @classmethod
    def fit(cls, traces: DataFrame, method: QuantFitMethod | None = None):
        method = method or QuantFitMethod.bounds()
        return cls(quantize.fit(traces, method.kind, **method.options))

    @classmethod
    def of(cls, shift, scale):
        return cls(session().createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(shift, scale, strict=True))], "sample int, shift double, scale double"))

    def quantize(self, traces: DataFrame, clip: bool = False) -> DataFrame:
        return quantize.apply(traces, self.fitted, clip)


class FactorGraph(Graph):
    def __new__(cls, text: str, tables: dict | None = None):
        return parse(text, tables)


BPState = Beliefs


class GenFactor:
    """Values of a generic factor: rows of operand values, or an array with one axis an operand."""

    @staticmethod
    def sparse_functional(rows) -> np.ndarray:
        return np.asarray(rows, np.int64)

    @staticmethod
    def dense(weights) -> np.ndarray:
        return np.asarray(weights, float)


def rank_nbin(costs, key, nbins: int, method: str = "hist") -> tuple[float, float, float]:
    lists = [np.asarray(c, float) for c in costs]
    if method == "naive":
        everything, at = rank.merged(lists, list(key), len(lists))
        r = float((everything[0] <= everything[0][at[0]]).sum())
        return r, r, r
    return rank.rank_bins(lists, list(key), nbins, method, rank.choose_merge(lists))


def rank_accuracy(costs, key, acc_bit: float = 1.0, method: str = "scaledhist", max_nb_bin: int = 1 << 26) -> tuple[float, float, float]:
    return rank.rank_to_accuracy([np.asarray(c, float) for c in costs], list(key), acc_bit, method, max_nb_bin)
