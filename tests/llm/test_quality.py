"""Quality statistics against plain Python, outliers against planted ones."""

import math
import random
import re
from collections import Counter

import pytest

from tracewell.llm import quality

R = random.Random(14)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \t\n\x0b\x0c\r ", "a", " lead and trail ", "x y z", "é😀 # $$ |\n\na b\na b\r\na b\n", "a a a a a a a a a a a a", "one two three four five " * 3, "a b c d e f a b c d e g a b c d e", "w " * 30_000, "<" * 50_000, " ".join(f"w{i}" for i in range(60_000))]


def test_counts_equal_plain_python(spark):
    vocabulary = ["a", "bb", "#c", "d$", "é", "|", "x" * 20]
    texts = ODD + ["".join(R.choice(vocabulary) + R.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(R.randrange(0, 120))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t[:50]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_ordinary_documents_stay(spark):
    word = lambda: "".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(R.randrange(5, 15))) for _ in range(n))
    rows = [(i, prose(R.randrange(3, 40)), "en", f"s{i % 2}" if i < 900 else f"tiny{i}") for i in range(1000)]
    rows += [(2000 + i, prose(5), "xx", "alone") for i in range(20)]
    junk = [(5000 + i, "".join(c + ("$%&" if c == " " else "") for c in prose(6)), "en", "s0") for i in range(60)]
    lines = [(6000 + i, "\n".join([prose(1)] + [word() + " " + word() for _ in range(3)] * 8), "en", "tiny5") for i in range(3)]
    df = spark.createDataFrame(rows + junk + lines, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert sum(not got[r[0]].kept for r in rows) <= 2
    assert not any(got[r[0]].kept for r in junk + lines)
    assert all(got[r[0]].distance is None for r in rows if r[2] == "xx")  # twenty documents of a language are too few
    again = {r.doc_id: r for r in quality.judge(df.repartition(7)).collect()}
    assert got == again
    assert quality.judge(df.limit(0)).collect() == []


def test_quantiles_of_chi_squared():
    """Values of printed tables."""
    for p, dims, x in ((0.95, 1, 3.841), (0.95, 5, 11.070), (0.99, 5, 15.086), (0.999, 10, 29.588)):
        assert quality.quantile(p, dims) == pytest.approx(x, abs=1e-3)
    assert math.isclose(quality.chi_squared(quality.CUTOFF, 5), 1 - 1e-6, abs_tol=1e-12)
