"""Belief propagation over a factor graph.

``Beliefs`` holds the messages of one batch of executions as NumPy arrays (executions, classes);
None is uniform. It steps through a graph by hand; ``infer`` runs whole schedules over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, NotAcyclicError, ShapeError
from ..functions import kernels as K
from ..functions.scalar import MIN_PROBABILITY
from .graph import Graph, sparse_rows
from .tables import MessageTable


def times(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    if a is None or b is None:
        return b if a is None else a
    return K.scaled(a * b)


class Beliefs:
    """State of propagation: evidence, variables' distributions, two messages an edge."""

    def __init__(self, graph: Graph, nexec: int, publics: dict | None = None, generic: dict | None = None):
        self.graph, self.n = graph, nexec
        publics = publics or {}
        if missing := [p for p in graph.publics if p not in publics]:
            raise KeyError(f"public values are missing: {missing}")
        if extra := [p for p in publics if p not in graph.publics]:
            raise KeyError(f"not public: {extra}")
        self.publics = {}
        for name, value in publics.items():
            v = np.atleast_1d(np.asarray(value, np.int64))
            if len(v) not in ((nexec,) if graph.publics[name] else (1,)):
                raise ShapeError(f"{name} needs {'one value for each execution' if graph.publics[name] else 'one value'}")
            if v.min(initial=0) < 0 or v.max(initial=0) >= graph.nc:
                raise ShapeError(f"{name} is not below {graph.nc}")
            self.publics[name] = v
        generic = generic or {}
        if missing := [g for g in graph.generics if g not in generic]:
            raise KeyError(f"generic factors are missing: {missing}")
        self.generic = generic
        self.evidence: dict[str, np.ndarray | None] = dict.fromkeys(graph.variables)
        self.state: dict[str, np.ndarray | None] = dict.fromkeys(graph.variables)
        self.to_var: dict[tuple[str, str], np.ndarray | None] = {}
        self.from_var: dict[tuple[str, str], np.ndarray | None] = {}

    def _rows(self, var: str) -> int:
        if var not in self.graph.variables:
            raise KeyError(var)
        return self.n if self.graph.variables[var] else 1

    def _checked(self, var: str, distribution) -> np.ndarray | None:
        rows = self._rows(var)
        if distribution is None:
            return None
        d = np.asarray(distribution, float)
        d = d[None, :] if d.ndim == 1 and rows == 1 and not self.graph.variables[var] else d
        if d.shape != (rows, self.graph.nc):
            raise ShapeError(f"{var} needs shape {(rows, self.graph.nc)}")
        return d

    def set_evidence(self, var: str, distribution=None) -> None:
        """Evidence as it is, not normalised; None drops it."""
        self.evidence[var] = self._checked(var, distribution)

    def set_distribution(self, var: str, distribution=None) -> None:
        self.state[var] = self._checked(var, distribution)

    def drop_distribution(self, var: str) -> None:
        self._rows(var)
        self.state[var] = None

    def get_distribution(self, var: str) -> np.ndarray | None:
        rows = self._rows(var)
        d = self.state[var]
        if d is None:
            return None
        return d if self.graph.variables[var] else d.reshape(rows, -1)[0]

    def get_belief_to_var(self, var: str, factor: str) -> np.ndarray | None:
        self._edge(var, factor)
        return self.to_var.get((var, factor))

    def get_belief_from_var(self, var: str, factor: str) -> np.ndarray | None:
        self._edge(var, factor)
        return self.from_var.get((var, factor))

    def set_belief_from_var(self, var: str, factor: str, distribution) -> None:
        self._edge(var, factor)
        self.from_var[var, factor] = distribution

    def _edge(self, var: str, factor: str) -> None:
        if factor not in self.graph.factors:
            raise KeyError(factor)
        if var not in self.graph.factors[factor].edges:
            raise GraphError(f"{factor} does not touch {var}")

    def propagate_var(self, var: str, factors: list[str] | None = None, clear_beliefs: bool = True, clear_evidence: bool = False) -> None:
        """Messages from a variable to all or the given factors; those read are dropped if asked."""
        self._rows(var)
        own = self.graph.factors_of(var)
        to = [f for f in own if factors is None or f in factors]
        for f in factors or []:
            self._edge(var, f)
        multi = self.graph.variables[var]
        base = self.evidence[var]
        local = {}  # a single variable's messages from multi factors, multiplied over executions
        incoming = {}
        for f in own:
            m = self.to_var.get((var, f))
            if m is not None and not multi and len(m) > 1:
                whole, rest = K.exclusive_products([r[None, :] for r in K.clipped(m)])
                local[f] = np.concatenate([np.broadcast_to(r, (1, self.graph.nc)) for r in rest])
                m = whole
            incoming[f] = m
        for f in own:
            if f not in to:
                base = times(base, incoming[f])
        parts = [incoming[f] for f in to]
        state = base
        for p in parts:
            state = times(state, p)
        for i, f in enumerate(to):
            message = base
            for j, p in enumerate(parts):
                if j != i:
                    message = times(message, p)
            if f in local:
                message = times(local[f], message)
            self.from_var[var, f] = None if message is None else K.regularised(message)
        self.state[var] = None if state is None else K.regularised(state)
        if clear_beliefs:
            for f in own:
                self.to_var[var, f] = None
        if clear_evidence:
            self.evidence[var] = None

    def propagate_factor(self, factor: str, variables: list[str] | None = None, clear_incoming: bool = False) -> None:
        """Messages from a factor to all or the given variables."""
        if factor not in self.graph.factors:
            raise KeyError(factor)
        f = self.graph.factors[factor]
        for v in variables if variables is not None else f.edges:
            self._edge(v, factor)
            self.to_var[v, factor] = self._message(f, v)
        if clear_incoming:
            for v in f.edges:
                self.from_var[v, factor] = None

    def _message(self, f, dest: str) -> np.ndarray | None:
        nc, n = self.graph.nc, self.n if f.multi else 1
        flat = np.full((1, nc), 1.0 / nc)
        places = [i for i, o in enumerate(f.operands) if o.name in self.graph.variables and o.name != dest]
        at = next(i for i, o in enumerate(f.operands) if o.name == dest)
        beliefs = {i: self.from_var.get((f.operands[i].name, f.name)) for i in places}
        unknown = [i for i in places if beliefs[i] is None]
        if f.kind in ("xor", "add") and unknown:
            return None  # one uniform term makes the sum uniform
        b = {i: np.broadcast_to(flat if x is None else x, (n, nc)) for i, x in beliefs.items()}
        shown = {i: np.broadcast_to(self.publics[o.name], (n,)) for i, o in enumerate(f.operands) if o.name in self.publics}
        if f.kind in ("xor", "not"):
            constant = np.zeros(n, np.int64)
            for v in shown.values():
                constant = constant ^ v
            if f.kind == "not":
                constant = constant ^ (nc - 1)
            out = K.xor_message(list(b.values()), constant) if b else np.eye(nc)[constant]
        elif f.kind == "add":
            sign = [-1 if i == 0 or o.flip else 1 for i, o in enumerate(f.operands)]
            constant = sum((sign[i] * v for i, v in shown.items()), np.zeros(n, np.int64))
            terms = [K.negated_sum(x) if sign[i] < 0 else x for i, x in b.items()]
            out = K.sum_distribution(terms, constant % nc) if terms else np.eye(nc)[constant % nc]
            out = K.negated_sum(out) if sign[at] > 0 else out
        elif f.kind == "and":
            constant = np.full(n, nc - 1, np.int64)
            for i, v in shown.items():
                constant = constant & ((nc - 1) ^ v if f.operands[i].flip else v)
            own = {i: K.negated_bits(x) if f.operands[i].flip else x for i, x in b.items()}
            rest = [x for i, x in own.items() if i]
            if at == 0:
                out = K.and_forward(rest, constant) if rest else np.eye(nc)[constant]
            else:
                out = K.and_backward(own[0], rest, constant)
            out = K.negated_bits(out) if f.operands[at].flip else out
        elif f.kind == "mul":
            constant = np.ones(n, np.int64)
            for v in shown.values():
                constant = constant * v % nc
            rest = [x for i, x in b.items() if i]
            out = K.multiply_forward(rest, constant) if at == 0 and rest else np.eye(nc)[constant % nc] if at == 0 else K.multiply_backward(b[0], rest, constant)
        elif f.kind == "lookup":
            table = self.graph.tables[f.table]
            (x,) = b.values()
            out = K.lookup_forward(x, table) if at == 0 else K.lookup_backward(x, table)
        else:
            given = self.generic[f.table]
            each = given if self.graph.generics[f.table] else [given]
            if self.graph.generics[f.table] and (not isinstance(given, list) or len(given) != self.n):
                raise ShapeError(f"{f.table} needs one array for each execution")
            out = np.zeros((n, nc))
            for k, one in enumerate(each):
                rows, weights = sparse_rows(one, nc, len(f.operands))
                own = slice(k, k + 1) if self.graph.generics[f.table] else slice(None)
                w = np.broadcast_to(weights, (n, len(weights)))[own].copy()
                for i, x in b.items():
                    w *= x[own][:, rows[:, i]]
                for i, v in shown.items():
                    w *= v[own][:, None] == rows[:, i][None, :]
                part = np.zeros((len(w), nc))
                np.add.at(part, (slice(None), rows[:, at]), w)
                out[own] = part
        return K.regularised(np.ascontiguousarray(out))

    def is_cyclic(self) -> bool:
        return self.graph.is_cyclic(self.n)

    def propagate_all_vars(self, clear_beliefs: bool = True) -> None:
        for v in self.graph.variables:
            self.propagate_var(v, None, clear_beliefs)

    def bp_loopy(self, iterations: int, initialize_states: bool = False, clear_beliefs: bool = True) -> None:
        """All factors, then all variables, in declaration order, so many times."""
        if initialize_states:
            self.propagate_all_vars(clear_beliefs)
        for _ in range(iterations):
            for f in self.graph.factors:
                self.propagate_factor(f)
            self.propagate_all_vars(clear_beliefs)

    def bp_acyclic(self, dest: str, clear_intermediates: bool = True, clear_evidence: bool = False) -> None:
        """Exact inference towards one variable, from the leaves."""
        self._rows(dest)
        if self.is_cyclic():
            raise NotAcyclicError("the graph has a cycle")
        for kind, node, to in self.graph.order_towards(dest):
            if kind == "v":
                self.propagate_var(node, [] if to is None else [to], clear_intermediates, clear_evidence)
            else:
                self.propagate_factor(node, [to], clear_intermediates)

    def log_messages(self, dest: str) -> np.ndarray:
        """(nc,): the sum over executions of the logarithms of what the factors tell a SINGLE variable of an acyclic graph."""
        total = np.zeros(self.graph.nc)
        for kind, node, to in self.graph.order_towards(dest):
            if kind == "f":
                self.propagate_factor(node, [to], True)
            elif node != dest:
                self.propagate_var(node, [to], True)
        for f in self.graph.factors_of(dest):
            m = self.to_var.get((dest, f))
            if m is not None:
                total += np.log(np.maximum(m, MIN_PROBABILITY)).sum(axis=0)
        return total

    def debug(self) -> dict:
        """Everything held, by name."""
        return {"evidence": self.evidence, "state": self.state, "to_var": self.to_var, "from_var": self.from_var}


def checked_rows(graph: Graph, rows: DataFrame, generic: dict | None = None) -> DataFrame:
    """One boolean column a factor: whether it holds for each row, whose columns are the graph's variables and publics."""
    names = [*graph.variables, *graph.publics]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(graph.holds(f, values, generic), (batch.num_rows,))) for f in graph.factors], list(graph.factors))

    return rows.select(*(F.col(n).cast("long").alias(n) for n in names)).mapInArrow(run, ", ".join(f"`{f}` boolean" for f in graph.factors))


def infer(graph: Graph, evidence: DataFrame, dest: list[str], iterations: int | None = None, publics: DataFrame | None = None, single_evidence: dict | None = None, generic: dict | None = None) -> DataFrame:
    """(exec, node, probs) of the variables ``dest`` from evidence (exec, node, probs).

    ``publics`` is (exec, node, value), with a null exec for SINGLE values. ``generic`` has a factor's
    array, or for a MULTI one a list or dict of arrays by exec. With ``iterations`` propagation is
    loopy, once for all of ``dest``, else exact. Executions stay rows all the way, see ``tables``.
    """
    table = MessageTable(graph, evidence, publics, single_evidence, generic)
    found = None
    if iterations is not None:
        table.loopy(iterations)
    for d in dest:
        if iterations is None:
            table.acyclic(d)
        one = table.distribution(d)
        found = one if found is None else found.unionByName(one)
    return found
