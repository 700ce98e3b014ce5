"""Every grammar rule, and reports that show all faults of a text with their places."""

import pytest

from tracewell.errors import GraphError
from tracewell.plans.graph import parse

HEAD = "NC 4\nVAR MULTI w\nVAR MULTI x\nVAR MULTI y\nVAR SINGLE k\nPUB MULTI p\nPUB SINGLE q\nTABLE t = [3, 0, 1, 2]\nTABLE u\nGENERIC SINGLE g\nGENERIC MULTI h\n"


def kinds(line):
    (f,) = parse(HEAD + line, {"u": [0, 1, 2, 3]}).factors.values()
    return f.kind, [(o.name, o.flip) for o in f.operands], f.table, f.multi


@pytest.mark.parametrize("line,want", [
    ("PROPERTY w = t[x]", ("lookup", [("w", False), ("x", False)], "t", True)),
    ("PROPERTY w = u [ x ]", ("lookup", [("w", False), ("x", False)], "u", True)),
    ("PROPERTY w = x ^ y ^ p", ("xor", [("w", False), ("x", False), ("y", False), ("p", False)], None, True)),
    ("PROPERTY w = !x & y & !p", ("and", [("w", False), ("x", True), ("y", False), ("p", True)], None, True)),
    ("PROPERTY w = !x | y", ("and", [("w", True), ("x", False), ("y", True)], None, True)),
    ("PROPERTY w = x * y", ("mul", [("w", False), ("x", False), ("y", False)], None, True)),
    ("PROPERTY w = -x + y - k", ("add", [("w", False), ("x", True), ("y", False), ("k", True)], None, True)),
    ("PROPERTY w = x", ("add", [("w", False), ("x", False)], None, True)),
    ("PROPERTY w = !x  # a comment", ("not", [("w", False), ("x", False)], None, True)),
    ("PROPERTY name : g(w, x , q)", ("generic", [("w", False), ("x", False), ("q", False)], "g", True)),
    ("PROPERTY h(k)", ("generic", [("k", False)], "h", True)),
    ("\tPROPERTY\tw=x^y", ("xor", [("w", False), ("x", False), ("y", False)], None, True)),
])
def test_rules(line, want):
    assert kinds(line) == want


def faults(text, tables=None):
    with pytest.raises(GraphError) as e:
        parse(text, {"u": [0, 1, 2, 3]} if tables is None else tables)
    return {(f.line, f.column): f.message for f in e.value.faults}, str(e.value)


def test_all_faults_of_a_text_are_shown_with_their_places():
    text = "\n".join([
        "NC 4", "VAR MULTI w", "VAR MANY x", "VAR MULTI y y", "VAR SINGLE", "TABLE t = [0, 1, z, 9]", "TABLE e = 3", "JUNK 3",
        "PROPERTY w = x ^ ^ y ^", "PROPERTY w = y & x | y + z", "PROPERTY w y", "PROPERTY = x", "PROPERTY g(w, , !x", "PROPERTY w = !x ^ $y", "NC 5", "PROPERTY w = t[3]", "PROPERTY a: w = x y",
    ])
    got, report = faults(text, {})
    want = {(3, 5), (4, 13), (5, 11), (6, 18), (6, 21), (7, 11), (8, 1), (9, 18), (9, 23), (10, 20), (10, 24), (10, 26), (11, 12), (12, 10), (13, 15), (13, 19), (14, 14), (14, 19), (15, 4), (16, 16), (17, 19)}
    assert want <= set(got), want - set(got)
    lines = report.splitlines()
    at = lines.index("line 9, column 18: expected an operand, found '^'")
    assert lines[at + 1 : at + 3] == ["  PROPERTY w = x ^ ^ y ^", "  " + " " * 17 + "^"]
    at = next(i for i, x in enumerate(lines) if x.startswith("line 8, column 1:"))
    assert lines[at + 2] == "  ^^^^"


@pytest.mark.parametrize("line,place,message", [
    ("PROPERTY w = x ^ nowhere", (12, 18), "nowhere is not declared"),
    ("PROPERTY w = s[x]", (12, 14), "table s is not declared"),
    ("PROPERTY w = t[p]", (12, 16), "both sides of a lookup are variables"),
    ("PROPERTY w = x ^ x", (12, 18), "a variable occurs twice"),
    ("PROPERTY w = !x * y", (12, 14), "operands of this operation cannot be negated"),
    ("PROPERTY w = x + !y", (12, 18), "operands of this operation cannot be negated"),
    ("PROPERTY g(w, !x)", (12, 15), "operands of generic factors cannot be negated"),
    ("PROPERTY f(w, x)", (12, 10), "f is not a generic factor"),
    ("PROPERTY p = x & y", (12, 10), "the result of this operation cannot be public"),
    ("VAR MULTI w", (12, 11), "w is declared twice"),
    ("TABLE v = [0, 1]", (12, 7), "table v needs 4 values below 4"),
    ("TABLE v", (12, 7), "table v has no values"),
    ("PROPERTY a: w = x\nPROPERTY a: w = y", (13, 10), "a is used twice"),
])
def test_each_check_names_its_place(line, place, message):
    got, _ = faults(HEAD + line)
    assert got == {place: message} or got[place] == message


def test_faults_of_the_text_as_a_whole():
    got, report = faults("VAR MULTI x\nPROPERTY x = y", {"b": [0]})
    assert "NC is missing" in report and "table b is not declared" in report and got[2, 14] == "y is not declared"
    got, _ = faults("NC 6\nVAR MULTI x\nVAR MULTI y\nPROPERTY x = !y", {})
    assert got == {(4, 1): "logic needs a power of two as NC"}
