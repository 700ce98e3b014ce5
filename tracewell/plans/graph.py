"""The factor-graph language: text to a checked graph.

Line by line, ``#`` starts a comment:

    NC 16
    VAR SINGLE|MULTI name          PUB SINGLE|MULTI name
    TABLE name [= [0, 1, ...]]     GENERIC SINGLE|MULTI name
    PROPERTY [label:] w = t[x]     w = x ^ y ^ ...     w = [!]x & [!]y ...   w = [!]x | [!]y ...
                      w = !x       w = x * y ...       w = [-]x + y - z ...  f(x, y, ...)

One kind of operation a property. Declarations may follow their use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..errors import GraphError
from .language import Faults, Property, statements_of


@dataclass(frozen=True)
class Operand:
    name: str
    flip: bool = False  # complemented (logic) or subtracted (sums)


@dataclass
class Factor:
    """``operands[0]`` is the result, but in a generic factor all operands are equal."""

    name: str
    kind: str  # and, xor, not, add, mul, lookup, generic
    operands: list[Operand]
    table: str | None = None
    multi: bool = False
    edges: list[str] = field(default_factory=list)  # variables, in operand order


@dataclass
class Graph:
    nc: int
    variables: dict[str, bool]  # name -> multi
    publics: dict[str, bool]
    tables: dict[str, np.ndarray]
    generics: dict[str, bool]
    factors: dict[str, Factor]

    def vars(self) -> list[str]:
        return list(self.variables)

    def factor_names(self) -> list[str]:
        return list(self.factors)

    def scope(self, factor: str) -> list[str]:
        if factor not in self.factors:
            raise KeyError(factor)
        return list(self.factors[factor].edges)

    def factors_of(self, var: str) -> list[str]:
        return [f.name for f in self.factors.values() if var in f.edges]

    def is_cyclic(self, nexec: int) -> bool:
        """Whether the graph with that many executions has a cycle; two copies show what any larger number does."""
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for copy in range(min(nexec, 2)):
            for f in self.factors.values():
                if not f.multi and copy:
                    continue
                for v in f.edges:
                    a, b = root(("f", f.name, copy if f.multi else 0)), root(("v", v, copy if self.variables[v] else 0))
                    if a == b:
                        return True
                    parent[a] = b
        return False

    def order_towards(self, dest: str) -> list[tuple[str, str, str | None]]:
        """(kind, node, next node) from the leaves of dest's tree to dest."""
        out, stack, seen = [], [("v", dest, None)], {("v", dest)}
        while stack:
            kind, node, to = stack.pop()
            out.append((kind, node, to))
            near = [("f", f) for f in self.factors_of(node)] if kind == "v" else [("v", v) for v in self.factors[node].edges]
            for n in near:
                if n not in seen:
                    seen.add(n)
                    stack.append((*n, node))
        return out[::-1]

    def sanity_check(self, publics: dict, assignment: dict, factor: str | None = None, generic: dict | None = None) -> None:
        """Every factor (or the one named) holds for the values; arrays give one value for each execution."""
        values = {k: np.asarray(v, np.int64) for k, v in {**publics, **assignment}.items()}
        for f in [self.factors[factor]] if factor else self.factors.values():
            if not np.all(self.holds(f.name, values, generic)):
                raise GraphError(f"factor {f.name} does not hold")

    def holds(self, factor: str, values: dict, generic: dict | None = None) -> np.ndarray:
        """Whether a factor holds, for each execution of the values by name."""
        for f in [self.factors[factor]]:
            v = [np.asarray(values[o.name], np.int64) for o in f.operands]
            flip = [o.flip for o in f.operands]
            if f.kind == "generic":
                rows, weights = sparse_rows((generic or {})[f.table], self.nc, len(f.operands))
                key = sum(x * self.nc**i for i, x in enumerate(v))
                ok = np.isin(key, sum(rows[:, i] * self.nc**i for i in range(len(v)))[weights > 0])
            else:
                top = self.nc - 1
                logic = [top ^ x if s else x for x, s in zip(v, flip, strict=True)]
                result, rest = logic[0], logic[1:]
                if f.kind == "and":
                    got = np.bitwise_and.reduce(np.broadcast_arrays(*rest)) if len(rest) > 1 else rest[0]
                elif f.kind == "xor":
                    got = np.bitwise_xor.reduce(np.broadcast_arrays(*rest)) if len(rest) > 1 else rest[0]
                elif f.kind == "not":
                    result, got = v[0], top ^ v[1]
                elif f.kind == "add":
                    result, got = v[0], sum(-x if s else x for x, s in zip(v[1:], flip[1:], strict=True)) % self.nc
                elif f.kind == "mul":
                    result, got = v[0], v[1]
                    for x in v[2:]:
                        got = got * x % self.nc
                    got = got % self.nc
                else:
                    result, got = v[0], self.tables[f.table][v[1]]
                ok = result == got
            return np.asarray(ok)


def sparse_rows(factor, nc: int, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of operand values, weights) of a generic factor: a dense array with one axis an operand, or rows."""
    a = np.asarray(factor)
    if a.ndim == 2 and a.shape[1] == arity and a.dtype.kind in "iu" and a.shape != (nc,) * arity:
        return a.astype(np.int64), np.ones(len(a))
    if a.shape == (nc,) * arity:
        at = np.argwhere(a != 0)
        return at, a[tuple(at.T)].astype(float)
    raise GraphError("a generic factor is rows of operand values or an array with one axis an operand")


def parse(text: str, tables: dict | None = None) -> Graph:
    """The graph of the text; all faults are reported together, each with its line, column and a mark below it."""
    faults = Faults(text)
    found = statements_of(text, faults)
    for again in found.nc[1:]:
        faults.at(again, "NC is given twice")
    if not found.nc:
        faults.add("NC is missing")
    nc = int(found.nc[0].text) if found.nc else 2
    variables, publics, generics, declared, names = {}, {}, {}, {}, set()
    for kind, multi, name in found.declared:
        if name.text in names:
            faults.at(name, f"{name.text} is declared twice")
        names.add(name.text)
        {"VAR": variables, "PUB": publics, "GENERIC": generics}[kind][name.text] = multi
    known: dict[str, np.ndarray] = {}
    for name, values in found.tables:
        if name.text in names:
            faults.at(name, f"{name.text} is declared twice")
        names.add(name.text)
        declared[name.text] = True
        own = [int(v.text) for v in values] if values is not None else (tables or {}).get(name.text)
        if own is None:
            faults.at(name, f"table {name.text} has no values")
            continue
        known[name.text] = np.asarray(own, np.int64)
        for v in values or ():
            if int(v.text) >= nc and found.nc:
                faults.at(v, f"values of a table lie below {nc}")
        outside = values is None and (known[name.text].min(initial=0) < 0 or known[name.text].max(initial=0) >= nc)
        if found.nc and (len(known[name.text]) != nc or outside):
            faults.at(name, f"table {name.text} needs {nc} values below {nc}")
    for name in tables or {}:
        if name not in declared:
            faults.add(f"table {name} is not declared")
    factors: dict[str, Factor] = {}
    for p in found.properties:
        before = len(faults.found)
        f = factor_of(p, f"ANONYMOUS_{len(factors)}", nc if found.nc else None, variables, publics, generics, declared, faults)
        if f.name in factors:
            faults.at(p.label or p.place, f"{f.name} is used twice")
        if p.whole and len(faults.found) == before:
            factors[f.name] = f
    faults.check()
    return Graph(nc, variables, publics, known, generics, factors)


def factor_of(p: Property, anonymous: str, nc: int | None, variables: dict, publics: dict, generics: dict, tables: dict, faults: Faults) -> Factor:
    """The factor of a property; what is wrong with it is noted at its place."""
    result = [Operand(p.result.text)] if p.result else []
    terms = [Operand(t.name.text, bool(t.prefix and t.prefix.text in "!-")) for t in p.terms]
    kind = p.kind
    if kind == "or":  # w = x | y as !w = !x & !y
        kind, result, terms = "and", [Operand(o.name, True) for o in result], [Operand(o.name, not o.flip) for o in terms]
    elif kind in ("not", "xor", "mul", "lookup"):
        terms = [Operand(o.name) for o in terms]
    f = Factor(p.label.text if p.label else anonymous, kind, result + terms, p.table.text if p.table else None)
    tokens = ([p.result] if p.result else []) + [t.name for t in p.terms]
    seen: set[str] = set()
    for token in tokens:
        if token.text not in variables and token.text not in publics:
            faults.at(token, f"{token.text} is not declared")
        elif token.text in variables and token.text in seen:
            faults.at(token, "a variable occurs twice")
        seen.add(token.text)
    f.edges = [o.name for o in f.operands if o.name in variables]
    if kind == "generic":
        if p.table.text not in generics:
            faults.at(p.table, f"{p.table.text} is not a generic factor")
        for t in p.terms:
            if t.prefix:
                faults.at(t.prefix, "operands of generic factors cannot be negated")
    if kind == "lookup":
        if p.table.text not in tables:
            faults.at(p.table, f"table {p.table.text} is not declared")
        for token in tokens:
            if token.text in publics:
                faults.at(token, "both sides of a lookup are variables")
    if kind in ("and", "xor", "not") and nc and nc & (nc - 1):
        faults.at(p.place, "logic needs a power of two as NC")
    if kind in ("and", "mul") and p.result and p.result.text in publics:
        faults.at(p.result, "the result of this operation cannot be public")
    f.multi = any(variables.get(o.name, publics.get(o.name)) for o in f.operands) or kind == "generic" and generics.get(f.table, False)
    if not f.multi and any(variables[v] for v in f.edges):
        faults.at(p.place, "a single factor has a multi variable")
    return f
