import collections
import itertools
import re

import numpy as np
import xxhash

from tracewell.llm import near_dup


def brute_fingerprint(text, width=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """id -> smallest id reachable over pairs at most two bits apart."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in prints}


def test_golay_balls_tile_the_space_and_share_keys():
    table = near_dup.golay_table()
    assert set(np.bincount(table, minlength=4096).tolist()) == {2048}
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 300).astype(np.uint32)
    for flips in ((0,), (3,), (0, 22), (5, 11)):
        other = words ^ np.uint32(sum(1 << f for f in flips))
        near = [collections.defaultdict(set) for _ in range(2)]
        for k, w in enumerate((words, other)):
            for row, key in zip(*near_dup.fuzzy_keys(w, table), strict=True):
                near[k][row].add(int(key))
        assert all(near[0][i] & near[1][i] for i in range(300))
        assert {len(v) for v in near[0].values()} <= {1, 6}


TEXTS = [None, "", " \t\n", "One", "one", "One two", "one  two", "a b c", "A B C", "x y z w", "é Ä ß", "same words here " * 40, "same words here " * 40, "long " + "tail of a text " * 3000]


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(4)]
    near = []
    for b in base:
        for _ in range(12):
            ws = b.split()
            ws[int(rng.integers(300))] = "edit"
            near.append(" ".join(ws))
    texts = TEXTS + base + near
    docs = spark.createDataFrame([(1000 - i, t, 5, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int, key string, component_id int").repartition(6)
    got = near_dup.near_duplicates(docs).collect()
    prints = {1000 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    assert len(got) == len(texts)
    for r in got:
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]


def test_crowded_buckets_keep_every_link(spark):
    """Fingerprints packed round one word: all share keys, and chains of two-bit steps connect some of them."""
    rng = np.random.default_rng(3)
    fps = {int(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4, 6) for _ in range(25)}
    reps = [(np.uint64(f).astype(np.int64).item(), i) for i, f in enumerate(sorted(fps))]
    edges = near_dup.links(spark.createDataFrame(reps, "fp long, rid long"))
    roots = {r.node: r.root for r in near_dup.components(edges).collect()}
    want = brute_components({i: f % (1 << 64) for f, i in reps})
    assert {i: roots.get(i, i) for i in want} == want


def test_long_chain_settles(spark):
    n = 700
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(2000, 2001)], "a long, b long").repartition(5)
    roots = {r.node: r.root for r in near_dup.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, n + 1)}, 2001: 2000}


def test_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "quite other words in here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.keep_one_of_each(spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (3, "other text of six words here")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def edited(text, share, rng):
    words = text.split()
    for at in rng.choice(len(words), int(share * len(words)), replace=False):
        words[at] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


def jaccard(a, b):
    x, y = (set(near_dup.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_meet_and_others_do_not(spark):
    """Near copies at a five-word similarity of 0.85 and more; strangers share a passage of sixty words."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words, 60))
    base = [" ".join(rng.choice(words, 200)) + " " + passage + " " + " ".join(rng.choice(words, 200)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 0.012, rng)) for i, t in enumerate(base)] + [(900, base[0]), (901, None), (902, "")]
    pairs = [(i, 100 + i) for i in range(60) if jaccard(base[i], rows[60 + i][1]) >= 0.85]
    groups = {r.doc_id: r.component_id for r in near_dup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) > 40 and sum(groups[a] == groups[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert len({groups[i] for i in range(60)}) == 60 and groups[900] == 0 and groups[902] == groups[901] == 901
    for a, b in itertools.combinations(sorted(groups), 2):
        if groups[a] == groups[b] and b < 900:
            assert jaccard(dict(rows)[a], dict(rows)[b]) > 0.7


def test_large_group_of_near_copies_meets(spark):
    rng = np.random.default_rng(10)
    text = " ".join(rng.choice([f"w{i}" for i in range(5000)], 300))
    rows = [(i, text if not i else edited(text, 0.01, rng)) for i in range(400)]
    groups = collections.Counter(r.component_id for r in near_dup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert groups[0] >= 396


def groups_of(spark, rows):
    return {r.doc_id: r.component_id for r in near_dup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}


def brute_groups(rows, similarity=0.8):
    sets = {i: set(near_dup.shingle_hashes(t, 5).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        either = len(sets[a] | sets[b])
        if not either or len(sets[a] & sets[b]) / either >= similarity:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def test_pairs_at_the_similarity_meet_and_just_below_do_not(spark):
    """Of 90 shingles each, 80 in common are a similarity of exactly 0.8; 79 are 0.78."""
    rows, limit = [], {}
    for k in range(60):
        text = [f"p{k}w{i}" for i in range(94)]
        lost = 10 + k % 2
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:-lost] + [f"p{k}x{i}" for i in range(lost)]))]
        limit[k] = jaccard(rows[-2][1], rows[-1][1])
        assert (limit[k] == 0.8) if k % 2 == 0 else 0.77 < limit[k] < 0.8
    groups = groups_of(spark, rows)
    assert all((groups[2 * k] == groups[2 * k + 1]) == (limit[k] >= 0.8) for k in limit)


def test_groups_behind_a_passage_that_all_texts_share_are_whole(spark):
    """A passage of 200 words in 1,200 texts, small groups of near copies among them."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(20000)]
    passage = " ".join(rng.choice(words, 200))
    base = [passage + " " + " ".join(rng.choice(words, n)) for n in rng.integers(24, 90, 400)]
    rows = [(3 * i + j, edited(t, 0.012, rng) if j else t) for i, t in enumerate(base) for j in range(3)]
    assert groups_of(spark, rows) == brute_groups(rows)


def test_repeats_within_a_text_count_once(spark):
    """Lines repeated ten times do not make texts alike, nor does their number make copies differ."""
    rng = np.random.default_rng(22)
    words = [f"w{i}" for i in range(20000)]
    line = " ".join(rng.choice(words, 100)) + " "
    strangers = [(i, line * 10 + " ".join(rng.choice(words, 100))) for i in range(30)]
    own = " ".join(rng.choice(words, 300)) + " "
    copies = [(100, own + line * 2), (101, own + line * 40)]
    rows = strangers + copies
    groups = groups_of(spark, rows)
    assert groups == brute_groups(rows) and len({groups[i] for i in range(30)}) == 30 and groups[101] == 100
