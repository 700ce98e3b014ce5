"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracewell.llm import prefix_trie

R = random.Random(13)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        opens = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt = tuple(turns.get(opens, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def held_to_brute(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, depth int").repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    key = lambda r: (r[1], r[0])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def talk(c, n, words=("a", "bb", "ccc")):
    return [(c, t, R.choice(["user", "assistant"]), R.choice(words)) for t in range(n)]


def test_many_conversations_that_share_openings(spark):
    rows = [r for c in range(350) for r in talk(c, R.randrange(1, 9))]
    rows += [r for c in range(-120, -90) for r in talk(c, R.randrange(1, 4))]
    held_to_brute(spark, rows)


def test_copies_nulls_ties_and_long_turns(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(1000, 1120) for t in range(7)]
    odd = [(5, None, "user", "first"), (5, 0, None, None), (5, 0, "", ""), (5, 1, "user", "x"), (5, 1, "user", "w"), (5, 1, "user", "w"), (None, 1, "user", "y"), (7, 2, "us", "erz"), (9, 2, "user", "z"), (11, 0, "user", "\U0001f600é" * 5000)]
    held_to_brute(spark, same + odd)


def test_one_long_conversation_is_cut_over_tasks(spark, monkeypatch):
    """Longer than a partition and than a block of a path."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rows = [(300, t, "user", f"t{t % 5}") for t in range(700)] + [(301, t, "user", f"t{t % 5}") for t in range(300)] + [r for c in range(302, 312) for r in talk(c, 5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held_to_brute(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_across_partitions():
    """Scans of two halves, put together, equal the scan of the whole."""
    ends = [(1, 0, 3, (5).to_bytes(16, "big")), (1, 1, 2, (7).to_bytes(16, "big")), (1, 2, 1, (9).to_bytes(16, "big")), (2, 2, 4, (1).to_bytes(16, "big"))]
    b = prefix_trie.BASE
    assert prefix_trie.carried(ends) == {(1, 1): (3, 5), (1, 2): (5, (5 + 7 * pow(b, 3, prefix_trie.P)) % prefix_trie.P)}


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "y")]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert prefix_trie.prefix_trie(df).collect() == []
