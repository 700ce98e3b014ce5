"""Message passing as tables: a row for each execution, a column for each message, by DataFrame functions alone.

A message is an array column over the classes; one that is uniform is no column at all. Factors of
logic, sums and lookups are array expressions (transforms of n log n steps, convolutions), products
and generic factors explode to the assignments that fit and group by the value asked for. A SINGLE
variable's messages from all executions are one aggregation of their logarithms; the total comes
back to every row, where a row's own logarithm is taken off again for the message to its factor, so
executions are never gathered in one group. Schedules are made by the graph on the driver; after each
SINGLE variable and each loopy round the rows are written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotAcyclicError, ShapeError
from ..functions.scalar import clipped, one_hot
from ..sources.scratch import Scratch
from .graph import Factor, Graph, sparse_rows


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled(p: Column) -> Column:
    """Over the greatest magnitude; zeros stay."""
    return let(p, lambda p: let(F.array_max(F.transform(p, F.abs)), lambda top: F.transform(p, lambda x: F.when(top > 0, x / top).otherwise(0.0))))


def regularised(p: Column) -> Column:
    """Moved up to be non-negative, then shares of the sum; all zero stays so."""
    sums = lambda q: F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    moved = lambda p: let(F.least(F.array_min(p), F.lit(0.0)), lambda low: F.transform(p, lambda x: x - low))
    return let(let(p, moved), lambda q: let(sums(q), lambda t: F.transform(q, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def logs(p: Column) -> Column:
    return F.transform(clipped(p), lambda x: F.log(F.abs(x)))


def softmaxed(p: Column) -> Column:
    return regularised(let(p, lambda p: let(F.array_max(p), lambda top: F.transform(p, lambda x: F.exp(x - top)))))


def product(a: Column | None, b: Column | None) -> Column | None:
    if a is None or b is None:
        return b if a is None else a
    return scaled(F.zip_with(a, b, lambda x, y: x * y))


def staged(p: Column, nc: int, step: Callable[[Column, Column, Column, int], Column]) -> Column:
    """A transform by bits: ``step(whole, entry, index, bit)`` gives each entry's next value."""

    def once(h: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(a, lambda x, i: step(a, x, i, h))

    for k in range((nc - 1).bit_length()):
        p = let(p, once(1 << k))
    return p


def low(i: Column, h: int) -> Column:
    return i.bitwiseAND(F.lit(h)) == 0


def walsh_hadamard(p: Column, nc: int) -> Column:
    return staged(p, nc, lambda a, x, i, h: F.when(low(i, h), x + F.get(a, i.bitwiseXOR(F.lit(h)))).otherwise(F.get(a, i.bitwiseXOR(F.lit(h))) - x))


def superset_sums(p: Column, nc: int, inverse: bool = False) -> Column:
    sign = -1.0 if inverse else 1.0
    return staged(p, nc, lambda a, x, i, h: F.when(low(i, h), x + sign * F.get(a, i.bitwiseOR(F.lit(h)))).otherwise(x))


def and_result_transform(p: Column, nc: int) -> Column:
    return staged(p, nc, lambda a, x, i, h: F.when(low(i, h), x).otherwise(F.get(a, i.bitwiseXOR(F.lit(h))) - x))


def times(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda x, y: x * y)
    return out


def indexed(nc: int, value: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), value)


def negated_sum(p: Column, nc: int) -> Column:
    return let(p, lambda p: indexed(nc, lambda i: F.get(p, F.pmod(-i, F.lit(nc)))))


def convolved(a: Column, b: Column, nc: int) -> Column:
    """The distribution of the sum of independent terms modulo nc."""
    return let(a, lambda a: let(b, lambda b: indexed(nc, lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(nc - 1)), F.lit(0.0), lambda s, j: s + F.get(a, j) * F.get(b, F.pmod(i - j, F.lit(nc)))))))


def and_forward(parts: list[Column], constant: Column, nc: int) -> Column:
    whole = times([superset_sums(p, nc) for p in parts])
    masked = F.transform(whole, lambda x, i: F.when(i.bitwiseAND(F.bitwise_not(constant)) == 0, x).otherwise(0.0))
    return superset_sums(masked, nc, inverse=True)


class MessageTable:
    """The messages of all executions. ``rows`` has one row for each; ``at`` names the column of a message, none where it is uniform."""

    def __init__(self, graph: Graph, evidence: DataFrame, publics: DataFrame | None = None, single_evidence: dict | None = None, generic: dict | None = None):
        self.graph, self.nc, self.scratch, self.made = graph, graph.nc, Scratch(evidence.sparkSession), 0
        given = evidence.select("exec", "node", "probs", F.lit(None).cast("int").alias("value"))
        single: dict[str, int] = {}
        if publics is not None:
            names = [p for p, multi in graph.publics.items() if not multi]
            single = {r.node: r.value for r in publics.where(F.col("exec").isNull() & F.col("node").isin(names)).distinct().collect()} if names else {}  # a value for each
            given = given.unionByName(publics.where("exec is not null").select("exec", "node", F.lit(None).cast("array<double>").alias("probs"), F.col("value").cast("int")))
        nodes = {r.node for r in given.select("node").distinct().collect()}  # names of the graph
        if missing := [p for p, multi in graph.publics.items() if p not in (nodes if multi else single)]:
            raise KeyError(f"public values are missing: {missing}")
        if unknown := nodes - set(graph.variables) - set(graph.publics):
            raise KeyError(f"not in the graph: {sorted(unknown)}")
        if missing := [g for g in graph.generics if g not in (generic or {})]:
            raise KeyError(f"generic factors are missing: {missing}")
        if any(not 0 <= v < self.nc for v in single.values()):
            raise ShapeError(f"public values are not below {self.nc}")
        self.generic = {g: self._generic_rows(g, of) for g, of in (generic or {}).items()}
        own = sorted(nodes)
        of = lambda n: F.first(F.when(F.col("node") == n, F.col("value" if n in graph.publics else "probs")), ignorenulls=True)
        self.rows = given.groupBy("exec").agg(*(of(n).alias(f"given{i}") for i, n in enumerate(own)))
        flat = F.array_repeat(F.lit(1.0 / self.nc), self.nc)
        self.evidence: dict[str, Column] = {n: F.coalesce(F.col(f"given{i}"), flat) for i, n in enumerate(own) if n in graph.variables}
        for n, d in (single_evidence or {}).items():
            self.evidence[n] = F.array(*(F.lit(float(x)) for x in d))
        fits = lambda c: F.when((c >= 0) & (c < self.nc), c).otherwise(F.raise_error(F.lit(f"public values are not below {self.nc}")))
        self.public: dict[str, Column] = {n: fits(F.col(f"given{i}")) for i, n in enumerate(own) if n in graph.publics} | {n: F.lit(v) for n, v in single.items()}
        self.clear()

    def clear(self) -> None:
        """Drop all messages; evidence stays."""
        self.at: dict[tuple[str, str, str], str | None] = {}

    def _generic_rows(self, name: str, given) -> list:
        """The factor's rows of values and weights; of a MULTI one with the execution."""
        arity = next((len(f.operands) for f in self.graph.factors.values() if f.table == name and f.kind == "generic"), 0)
        each = (given.items() if isinstance(given, dict) else enumerate(given)) if self.graph.generics[name] else [(None, given)]
        rows = []
        for e, one in each if arity else ():
            values, weights = sparse_rows(one, self.nc, arity)
            rows += [(e, v, w) for v, w in zip(values.tolist(), np.asarray(weights, float).tolist(), strict=True)]
        return rows

    def _get(self, *key: str) -> Column | None:
        name = self.at.get(key)
        return None if name is None else F.col(name)

    def _put(self, key: tuple[str, str, str], value: Column | None) -> None:
        self.at[key] = None
        if value is not None:
            self.made += 1
            self.at[key] = f"m{self.made}"
            self.rows = self.rows.withColumn(self.at[key], value)

    def settle(self) -> None:
        """Write the rows with the messages that are still in use, and read them again."""
        used = [n for n in self.at.values() if n is not None]
        keep = [c for c in self.rows.columns if c == "exec" or c.startswith("given") or c in used]
        self.rows = self.scratch.last(self.rows.select(*keep))

    def propagate_var(self, var: str, to: list[str] | None = None, clear: bool = True) -> None:
        """Messages from a variable to its factors ``to`` (all), and its distribution."""
        own = self.graph.factors_of(var)
        to = own if to is None else to
        incoming = {f: self._get("to", var, f) for f in own}
        base = self.evidence.get(var)
        if self.graph.variables[var]:
            for f in own:
                if f not in to:
                    base = product(base, incoming[f])
            state = base
            for f in to:
                state = product(state, incoming[f])
            for f in to:
                message = base
                for g in to:
                    message = message if g == f else product(message, incoming[g])
                self._put(("from", var, f), None if message is None else regularised(message))
            self._put(("state", var, ""), None if state is None else regularised(state))
        else:
            self._single(var, to, incoming, base)
        if clear:
            for f in own:
                self.at["to", var, f] = None

    def _single(self, var: str, to: list[str], incoming: dict[str, Column | None], base: Column | None) -> None:
        """A SINGLE variable: sums of logarithms over executions, once, and back to every row."""
        known = {f: m for f, m in incoming.items() if m is not None}
        many = [f for f in known if self.graph.factors[f].multi]
        if base is None and not known:
            for f in to:
                self._put(("from", var, f), None)
            self._put(("state", var, ""), None)
            return
        parts = [logs(base)] if base is not None else []
        parts += [logs(m) for f, m in known.items() if f not in many]
        if many:
            self.settle()
            terms = self.rows.select(F.posexplode(let_sum([logs(self._get("to", var, f)) for f in many])).alias("class", "l"))
            sums = terms.groupBy("class").agg(F.sum("l").alias("l"))
            one = sums.agg(F.array_sort(F.collect_list(F.struct("class", "l"))).alias("x")).select(F.transform("x", lambda s: s["l"]).alias(f"sum{self.made}"))  # one entry for each class
            self.rows = self.rows.crossJoin(F.broadcast(one))  # one row
            parts.append(F.col(f"sum{self.made}"))
        total = let_sum(parts)
        self._put(("total", var, ""), total)
        total = self._get("total", var, "")
        for f in to:
            if f in known:
                self._put(("from", var, f), softmaxed(F.zip_with(total, logs(known[f]), lambda a, b: a - b)) if len(known) > 1 or base is not None or f in many else None)
            else:
                self._put(("from", var, f), softmaxed(total))
        self._put(("state", var, ""), softmaxed(total))

    def propagate_factor(self, factor: str, variables: list[str] | None = None, clear: bool = False) -> None:
        """Messages from a factor to its variables (all)."""
        f = self.graph.factors[factor]
        for v in variables if variables is not None else f.edges:
            self._put(("to", v, factor), self._message(f, v))
        if clear:
            for v in f.edges:
                self.at["from", v, factor] = None

    def _message(self, f: Factor, dest: str) -> Column | None:
        nc = self.nc
        places = [i for i, o in enumerate(f.operands) if o.name in self.graph.variables and o.name != dest]
        at = next(i for i, o in enumerate(f.operands) if o.name == dest)
        found = {i: self._get("from", f.operands[i].name, f.name) for i in places}
        if f.kind in ("xor", "add") and any(b is None for b in found.values()):
            return None  # one uniform term makes the sum uniform
        flat = F.array_repeat(F.lit(1.0 / nc), nc)
        b = {i: flat if x is None else x for i, x in found.items()}
        shown = {i: self.public[o.name] for i, o in enumerate(f.operands) if o.name in self.graph.publics}
        if f.kind in ("xor", "not"):
            constant = F.lit(nc - 1 if f.kind == "not" else 0)
            for v in shown.values():
                constant = constant.bitwiseXOR(v)
            if not b:
                return one_hot(constant, nc)
            (whole,) = [walsh_hadamard(times([walsh_hadamard(p, nc) for p in b.values()]), nc)] if len(b) > 1 else list(b.values())
            return regularised(let(whole, lambda p: let(constant, lambda c: indexed(nc, lambda i: F.get(p, i.bitwiseXOR(c))))))
        if f.kind == "add":
            sign = [-1 if i == 0 or o.flip else 1 for i, o in enumerate(f.operands)]
            constant = F.lit(0)
            for i, v in shown.items():
                constant = constant + sign[i] * v
            out = one_hot(F.pmod(constant, F.lit(nc)), nc)
            terms = [negated_sum(x, nc) if sign[i] < 0 else x for i, x in b.items()]
            if terms:
                whole = terms[0]
                for t in terms[1:]:
                    whole = convolved(whole, t, nc)
                out = let(whole, lambda p: let(constant, lambda c: indexed(nc, lambda i: F.get(p, F.pmod(i - c, F.lit(nc))))))
            return regularised(negated_sum(out, nc) if sign[at] > 0 else out)
        if f.kind == "and":
            constant = F.lit(nc - 1)
            for i, v in shown.items():
                constant = constant.bitwiseAND(F.lit(nc - 1).bitwiseXOR(v) if f.operands[i].flip else v)
            own = {i: F.reverse(x) if f.operands[i].flip else x for i, x in b.items()}
            rest = [x for i, x in own.items() if i]
            forward = and_forward(rest, constant, nc) if rest else one_hot(constant, nc)
            out = forward if at == 0 else and_result_transform(times([and_result_transform(own[0], nc), superset_sums(forward, nc)]), nc)
            return regularised(F.reverse(out) if f.operands[at].flip else out)
        if f.kind == "lookup":
            table = self.graph.tables[f.table].tolist()
            (x,) = b.values()
            if at:
                return regularised(let(x, lambda p: F.transform(F.array(*map(F.lit, table)), lambda t: F.get(p, t))))
            inverse = [[i for i, v in enumerate(table) if v == k] for k in range(nc)]
            lists = F.array(*(F.array(*map(F.lit, own)).cast("array<int>") for own in inverse))
            return regularised(let(x, lambda p: F.transform(lists, lambda own: F.aggregate(own, F.lit(0.0), lambda s, i: s + F.get(p, i)))))
        return self._grouped(f, at, b, shown)

    def _grouped(self, f: Factor, at: int, b: dict[int, Column], shown: dict[int, Column]) -> Column:
        """Products and generic factors: rows of assignments that fit, weighed and summed by the value asked for."""
        spark, nc = self.rows.sparkSession, self.nc
        if f.kind == "mul":
            return self._multiplied(at, b, shown)
        given = self.generic[f.table]
        rows = spark.createDataFrame(given, "on long, ops array<int>, weight double")  # a parameter of the factor
        one = self.rows.select("exec", F.array(*b.values()).alias("b") if b else F.array().cast("array<array<double>>").alias("b"), F.array(*shown.values()).cast("array<int>").alias("s"))
        met = one.join(rows, F.col("exec") == F.col("on")) if self.graph.generics[f.table] else one.crossJoin(F.broadcast(rows.drop("on")))  # every execution under every row of the factor
        weight = F.col("weight")
        for k, i in enumerate(b):
            weight = weight * F.get(F.get("b", F.lit(k)), F.get("ops", F.lit(i)))
        for k, i in enumerate(shown):
            met = met.where(F.get("ops", F.lit(i)) == F.get("s", F.lit(k)))
        return self._joined(met.select("exec", F.get("ops", F.lit(at)).alias("i"), weight.alias("w")))

    def _multiplied(self, at: int, b: dict[int, Column], shown: dict[int, Column]) -> Column:
        nc, constant = self.nc, F.lit(1).cast("long")
        for v in shown.values():
            constant = F.pmod(constant * v, F.lit(nc))
        rest = [x for i, x in b.items() if i]
        whole = one_hot(F.pmod(constant, F.lit(nc)).cast("int"), nc)
        for p in rest:  # the product of the operands so far with one more
            pairs = self.rows.select("exec", F.posexplode(whole).alias("i", "p"), p.alias("q")).where("p <> 0").select("exec", "i", "p", F.posexplode("q").alias("j", "q"))
            whole = self._joined(pairs.select("exec", F.pmod(F.col("i") * F.col("j"), F.lit(nc)).alias("i"), (F.col("p") * F.col("q")).alias("w")), share=False)
        if at == 0:
            return regularised(whole)
        return regularised(let(whole, lambda y: let(b[0], lambda r: indexed(nc, lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(nc - 1)), F.lit(0.0), lambda s, k: s + F.get(y, k) * F.get(r, F.pmod(x * k, F.lit(nc))))))))

    def _joined(self, weights: DataFrame, share: bool = True) -> Column:
        """Sums of (exec, i, w) as an array column of the rows."""
        sums = weights.groupBy("exec", "i").agg(F.sum("w").alias("w"))
        self.made += 1
        name = f"m{self.made}"
        lists = sums.groupBy("exec").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("x"))  # one entry for each class
        lists = lists.select("exec", let(F.col("x"), lambda m: indexed(self.nc, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))).alias(name))
        self.rows = self.rows.join(lists, "exec", "left")
        out = F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), self.nc))
        return regularised(out) if share else out

    def loopy(self, iterations: int) -> None:
        """All factors, then all variables, so many times, after the variables once; a round is written."""
        for v in self.graph.variables:
            self.propagate_var(v)
        for _ in range(iterations):
            for f in self.graph.factors:
                self.propagate_factor(f)
            for v in self.graph.variables:
                self.propagate_var(v)
            self.settle()

    def acyclic(self, dest: str) -> None:
        """Exact inference towards one variable, from the leaves."""
        if self.graph.is_cyclic(2):
            raise NotAcyclicError("the graph has a cycle")
        self.clear()
        for kind, node, to in self.graph.order_towards(dest):
            if kind == "v":
                self.propagate_var(node, [] if to is None else [to])
            else:
                self.propagate_factor(node, [to], clear=True)

    def distribution(self, var: str) -> DataFrame:
        """(exec, node, probs): a row for each execution, of a SINGLE variable one with a null exec; none while nothing is known."""
        state = self._get("state", var, "")
        if state is None:
            return self.rows.sparkSession.createDataFrame([], "exec long, node string, probs array<double>")
        if self.graph.variables[var]:
            return self.rows.select(F.col("exec").cast("long").alias("exec"), F.lit(var).alias("node"), state.alias("probs"))
        return self.rows.agg(F.first(state).alias("probs")).select(F.lit(None).cast("long").alias("exec"), F.lit(var).alias("node"), "probs")


def let_sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda x, y: x + y)
    return out
