"""The factor-graph language's statements with their places, and a report of every fault.

A line is cut into tokens that know their column. A fault is noted where it stands and reading goes
on: at the next operand of the same line, and at the next line. So one report shows all that is wrong
with a text, each fault with its line and a mark under what it is about.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import GraphError

TOKEN = re.compile(r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+)|(?P<symbol>[=\[\](),:^&|*+\-!])|(?P<blank>\s+)|(?P<other>.)")
#: Operator -> kind of property.
KINDS = {"^": "xor", "&": "and", "|": "or", "*": "mul", "+": "add", "-": "add"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, symbol, end
    text: str
    line: int
    column: int

    def __str__(self) -> str:
        return f"'{self.text}'" if self.text else "the end of the line"


@dataclass(frozen=True)
class Fault:
    message: str
    line: int = 0  # 0: of the text as a whole
    column: int = 1
    length: int = 1


@dataclass
class Term:
    """An operand; ``prefix`` is the sign or the negation before it."""

    name: Token
    prefix: Token | None = None


@dataclass
class Property:
    """``kind``: and, or, xor, not, add, mul, lookup, generic. ``table`` names a lookup's table or a generic factor."""

    place: Token
    label: Token | None
    kind: str
    result: Token | None
    terms: list[Term]
    table: Token | None = None
    whole: bool = True  # no fault inside


@dataclass
class Statements:
    nc: list[Token] = field(default_factory=list)
    declared: list[tuple[str, bool, Token]] = field(default_factory=list)  # VAR, PUB or GENERIC; multi; name
    tables: list[tuple[Token, list[Token] | None]] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)


class Faults:
    """The text's faults so far."""

    def __init__(self, text: str):
        self.lines, self.found = text.splitlines(), []

    def at(self, token: Token, message: str) -> None:
        self.found.append(Fault(message, token.line, token.column, max(1, len(token.text))))

    def add(self, message: str) -> None:
        self.found.append(Fault(message))

    def check(self) -> None:
        """Raise one error that shows all faults, with each one's line and a mark below it."""
        if not self.found:
            return
        parts = []
        for f in sorted(self.found, key=lambda f: (f.line or len(self.lines) + 1, f.column)):
            if f.line:
                line = self.lines[f.line - 1].replace("\t", " ")
                parts.append(f"line {f.line}, column {f.column}: {f.message}\n  {line}\n  {' ' * (f.column - 1)}{'^' * f.length}")
            else:
                parts.append(f.message)
        error = GraphError("\n".join(parts))
        error.faults = self.found
        raise error


class Reader:
    """The tokens of one line."""

    def __init__(self, number: int, line: str, faults: Faults):
        self.faults, self.tokens, self.i = faults, [], 0
        body = line.partition("#")[0]
        for m in TOKEN.finditer(body):
            token = Token(m.lastgroup or "", m[0], number, m.start() + 1)
            if token.kind == "other":
                faults.at(token, f"unexpected character {token}")
            elif token.kind != "blank":
                self.tokens.append(token)
        self.end = Token("end", "", number, len(body.rstrip()) + 1)

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else self.end

    def next(self) -> Token:
        token = self.peek()
        self.i += token.kind != "end"
        return token

    def is_symbol(self, text: str, ahead: int = 0) -> bool:
        token = self.peek(ahead)
        return token.kind == "symbol" and token.text in text

    def expect(self, kind: str, what: str, text: str = "") -> Token | None:
        """The next token if it is as asked for; else a fault, and the token stays unless nothing can follow it."""
        token = self.peek()
        if token.kind == kind and (not text or token.text in text.split()):
            return self.next()
        self.faults.at(token, f"expected {what}, found {token}")
        return None

    def finish(self) -> None:
        if self.peek().kind != "end":
            self.faults.at(self.peek(), f"unexpected {self.peek()}")


def statements_of(text: str, faults: Faults) -> Statements:
    out = Statements()
    for number, line in enumerate(faults.lines, 1):
        reader = Reader(number, line, faults)
        first = reader.next()
        if first.kind == "end":
            continue
        if first.text == "NC":
            value = reader.expect("number", "a number")
            if value:
                out.nc.append(value)
            reader.finish()
        elif first.text in ("VAR", "PUB", "GENERIC"):
            kind, name = reader.expect("name", "SINGLE or MULTI", "SINGLE MULTI"), None
            if kind is None and reader.peek(1).kind == "name":
                reader.next()  # a wrong word in its place
            name = reader.expect("name", "a name")
            if name:
                out.declared.append((first.text, bool(kind and kind.text == "MULTI"), name))
                reader.finish()
        elif first.text == "TABLE":
            read_table(reader, out)
        elif first.text == "PROPERTY":
            out.properties.append(read_property(reader, first))
        else:
            faults.at(first, f"expected NC, VAR, PUB, TABLE, GENERIC or PROPERTY, found {first}")
    return out


def read_table(reader: Reader, out: Statements) -> None:
    name = reader.expect("name", "a name")
    if not name:
        return
    values: list[Token] | None = None
    if reader.is_symbol("="):
        reader.next()
        values = []
        if reader.expect("symbol", "'['", "["):
            while not reader.is_symbol("]") and reader.peek().kind != "end":
                value = reader.expect("number", "a number")
                if value:
                    values.append(value)
                elif not reader.is_symbol(","):
                    reader.next()
                if not reader.is_symbol("]") and reader.peek().kind != "end" and reader.is_symbol(","):
                    reader.next()
            reader.expect("symbol", "']'", "]")
    out.tables.append((name, values))
    reader.finish()


def read_property(reader: Reader, place: Token) -> Property:
    before, label = len(reader.faults.found), None
    if reader.peek().kind == "name" and reader.is_symbol(":", 1):
        label = reader.next()
        reader.next()
    result = reader.expect("name", "a name")
    if result is None and reader.peek().kind != "end" and not reader.is_symbol("="):
        reader.next()
    if result and reader.is_symbol("("):
        reader.next()
        found = Property(place, label, "generic", None, read_terms(reader, ",", "!)"), result)
        reader.expect("symbol", "')'", ")")
    else:
        reader.expect("symbol", "'=' or '('" if result else "'='", "=")
        found = read_right(reader, place, label, result)
    reader.finish()
    found.whole = len(reader.faults.found) == before
    return found


def read_terms(reader: Reader, separators: str, closing: str) -> list[Term]:
    """Operands between separators; where one is missing a fault is noted and reading goes on after the next separator."""
    terms: list[Term] = []
    while True:
        prefix = reader.next() if reader.is_symbol("!") else None
        name = reader.expect("name", "an operand")
        if name:
            terms.append(Term(name, prefix))
        while not reader.is_symbol(separators + closing[1:]) and reader.peek().kind != "end":
            if name:
                reader.faults.at(reader.peek(), f"unexpected {reader.peek()}")
                name = None
            reader.next()
        if not reader.is_symbol(separators):
            return terms
        reader.next()


def read_right(reader: Reader, place: Token, label: Token | None, result: Token | None) -> Property:
    if reader.peek().kind == "name" and reader.is_symbol("[", 1):
        table = reader.next()
        reader.next()
        name = reader.expect("name", "an operand")
        if not name and not reader.is_symbol("]"):
            reader.next()
        reader.expect("symbol", "']'", "]")
        return Property(place, label, "lookup", result, [Term(name)] if name else [], table)
    terms: list[Term] = []
    kind, operator, names = "", None, 0
    while True:
        prefix = reader.next() if reader.is_symbol("!") or not terms and operator is None and reader.is_symbol("+-") else None
        name = reader.expect("name", "an operand")
        names += 1
        if name:
            sign = operator if operator and operator.text in "+-" else None
            terms.append(Term(name, prefix or sign))
        while reader.peek().kind != "end" and not reader.is_symbol("^&|*+-"):  # up to the next operator
            if name:
                reader.faults.at(reader.peek(), f"expected an operator, found {reader.peek()}")
                name = None
            reader.next()
        if reader.peek().kind == "end":
            break
        operator = reader.next()
        own = KINDS[operator.text]
        if kind and own != kind:
            reader.faults.at(operator, "one kind of operation a property")
        kind = kind or own
    if not kind:
        kind = "not" if terms and terms[0].prefix and terms[0].prefix.text == "!" else "add"
    for t in terms:
        if t.prefix and t.prefix.text == "!" and kind in ("xor", "mul", "add"):
            reader.faults.at(t.prefix, "operands of this operation cannot be negated")
        if t.prefix and t.prefix.text in "+-" and kind != "add":
            reader.faults.at(t.prefix, "a sign needs a sum")
    return Property(place, label, kind, result, terms)
