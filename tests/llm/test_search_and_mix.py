"""Decontamination, mixing, URL filters and top-k against brute force and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontam, mixing, queries, topk, url_filter

R = random.Random(8)
DATA = "/root/testdata/sf0.001"


def brute_distance(item, window):
    """Least edit distance of the item to any stretch of the window."""
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    for _ in range(300):
        item, window = [R.randrange(1, 5) for _ in range(R.randrange(1, 12))], [R.randrange(0, 5) for _ in range(R.randrange(0, 20))]
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontam.edit_distance_within(masks, len(item), window)[0] == brute_distance(item, window)


WORDS = [f"word{i}" for i in range(3000)]


def planted(rate):
    items = [(i, " ".join(R.choice(WORDS) for _ in range(R.randrange(12, 50)))) for i in range(40)]
    docs = []
    for i, t in items:
        own = t.split()
        for _ in range(int(rate * len(own))):
            at = R.randrange(len(own))
            own[at : at + 1] = R.choice([["edit"], [], [own[at], "edit"]])
        docs.append((i, " ".join([*(R.choice(WORDS) for _ in range(60)), *own, *(R.choice(WORDS) for _ in range(60))]).upper()))
    return items, docs


@pytest.mark.parametrize("rate,recall", [(0.0, 1.0), (0.1, 0.97), (0.19, 0.9)])
def test_edited_passages_are_found_and_clean_text_is_not(spark, rate, recall):
    items, docs = planted(rate)
    clean = [(1000 + i, " ".join(R.choice(WORDS) for _ in range(200))) for i in range(30)]
    odd = [(2000, None), (2001, ""), (None, docs[0][1]), (2002, "word1 " * 20_000)]
    bench = spark.createDataFrame([*items, (90, None), (91, "too short")], "item_id long, text string")
    found = decontam.find(spark.createDataFrame([(d, t, 1) for d, t in docs + clean + odd], "doc_id long, text string, distance int"), bench).collect()
    hits = {(r.doc_id, r.item_id) for r in found}
    assert sum((i, i) in hits for i, _ in items) >= recall * len(items)
    assert all(d == i or d is None for d, i in hits)
    text = dict(docs)
    for r in found:
        if r.doc_id is not None:
            assert r.distance == brute_distance(dict(items)[r.item_id].split(), text[r.doc_id].lower().split())


def test_every_stretch_within_the_bound_is_found(spark):
    """Against all stretches of all texts: nothing beyond brute force, and nearly all of it; short and unspaced items word by word."""
    items, docs = planted(0.15)
    short = [(200, "seven plain words stand here as written"), (201, "alpha beta"), (202, "東京都は日本の首都です")]
    docs = [*docs, (300, "x SEVEN plain words stand here as written y"), (301, "seven plain words stand there as written"), (302, "some alpha beta too"), (303, "これは東京都は日本の首都です。")]
    docs += [(d, t) for d, t in docs[:2]]
    bench = spark.createDataFrame([*items, *short, (203, "alpha beta")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    split = [(i, decontam.words_of(t)) for i, t in [*items, *short, (203, "alpha beta")]]
    want = {(d, i) for d, t in docs for i, w in split if brute_distance(w, decontam.words_of(t)) <= (int(0.2 * len(w)) if len(w) >= 8 else 0)}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert {(300, 200), (302, 201), (302, 203), (303, 202)} <= found and not {d for d, _ in found} & {301}


def test_contaminated_rows_go(spark):
    items, docs = planted(0.0)
    table = spark.createDataFrame([(d, t, "en") for d, t in docs] + [(500, "nothing here", None), (501, None, None)], "doc_id long, text string, lang string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [500, 501]
    assert decontam.find(table.limit(0), bench).count() == 0 and decontam.find(table, bench.limit(0)).count() == 0


def brute_mix(rows, mix):
    cells = {}
    for key, tokens in rows:
        cells[key] = cells.get(key, 0) + tokens
    w, total = dict(cells), sum(cells.values())
    target = []
    for d in range(3):
        share = {}
        for k, t in cells.items():
            share[k[d]] = share.get(k[d], 0) + t
        powered = {c: t**mix.temper for c, t in share.items()}
        target.append({c: t / sum(powered.values()) for c, t in powered.items()})
    for _ in range(mix.rounds):
        for d in range(3):
            sums = {}
            for k, x in w.items():
                sums[k[d]] = sums.get(k[d], 0) + x
            w = {k: x * target[d][k[d]] / sums[k[d]] for k, x in w.items()}
    p = {k: min(1.0, mix.budget * total * w[k] / sum(w.values()) / cells[k]) for k in cells}
    for _ in range(mix.fills):  # what whole cells cannot give is asked of the others
        free, whole = sum(p[k] * cells[k] for k in cells if p[k] < 1), sum(cells[k] for k in cells if p[k] >= 1)
        if free:
            p = {k: min(1.0, p[k] * max(1.0, (mix.budget * total - whole) / free)) if p[k] < 1 else p[k] for k in cells}
    return p, w, target


def test_blocks_go_in_rounds_and_give_the_same(spark, monkeypatch):
    """Many small indexes, some at a time, find what one finds; so does the filter."""
    items, docs = planted(0.1)
    clean = [(1000 + i, " ".join(R.choice(WORDS) for _ in range(100))) for i in range(10)]
    df, bench = spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    stored = decontam.stored_indexes(bench, 0.2, 8, 0.95, decontam.Scratch(spark))
    size = stored.agg(F.sum(F.length("payload"))).first()[0]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    monkeypatch.setattr(decontam, "AT_ONCE", size // 3)
    split = decontam.stored_indexes(bench, 0.2, 8, 0.95, decontam.Scratch(spark))
    rounds = list(decontam.rounds_of(split))
    assert len(rounds) > 1 and sum(len(i.item_ids) for held in rounds for i in held) == len(items)
    hits = {(r.doc_id, r.item_id) for r in decontam.find(df, bench).collect()}
    assert sum((i, i) in hits for i, _ in items) >= 0.95 * len(items)
    kept = {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs + clean} - {d for d, _ in hits}


def test_a_long_item(spark):
    """Six thousand words, found with a tenth of them edited, and not where half differ."""
    item = [R.choice(WORDS) for _ in range(6000)]
    near, far = item.copy(), item.copy()
    for at in R.sample(range(6000), 600):
        near[at] = "other"
    for at in R.sample(range(6000), 3000):
        far[at] = "other"
    df = spark.createDataFrame([(1, " ".join(["x"] * 50 + near)), (2, " ".join(far)), (3, " ".join(item[:3000]))], "doc_id long, text string")
    found = decontam.find(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.end_word) for r in found] == [(1, 7, 6050)] and 580 <= found[0].distance <= 600


def test_mix_equals_brute_force_and_meets_marginals(spark):
    rows = [(i, R.choice(["one two", "a@b c " * 9, "x | y", None, "long text " * 90]), R.choice(["en", "de", None]), R.choice(["s0"] * 6 + ["s1", None]), i, 0.5) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long, probability double")
    mix = mixing.Mix()
    got = mixing.mix_documents(docs, mix).collect()
    own = [((r.source, r.lang, r.topic), r.tokens) for r in got]
    p, w, target = brute_mix(own, mix)
    for r in got:
        assert r.probability == pytest.approx(p[r.source, r.lang, r.topic], abs=2e-6)
        assert r.tokens == len((rows[r.doc_id][1] or "").split()) + 1
    total = sum(w.values())
    for c, share in target[2].items():
        assert sum(x for k, x in w.items() if k[2] == c) / total == pytest.approx(share, rel=1e-6)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r.doc_id for r in mixing.sample_documents(docs, mix).collect()}
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.sample_documents(docs).columns == docs.columns


def test_whole_cells_pass_on_what_they_cannot_give(spark):
    """A small source with a large target is kept whole; the others fill the budget."""
    rows = [(i, "w " * 20, "en", "small" if i < 40 else f"s{i % 3}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(budget=0.6, targets=(("source", (("small", 0.4), ("s0", 0.2), ("s1", 0.2), ("s2", 0.2))),))
    got = mixing.mix_documents(docs, mix).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.6 * sum(r.tokens for r in got), rel=1e-4)
    assert {r.probability for r in got if r.source == "small"} == {1.0}
    cells = docs.groupBy("source").agg(F.sum(F.lit(21)).cast("long").alias("tokens")).select("source", F.lit("en").alias("lang"), F.lit("short").alias("topic"), "tokens")
    assert all(abs(r.target - r.got) < 1e-9 for r in mixing.marginal_errors(mixing.raked(cells, mix), mix).collect())


def test_raking_needs_no_exchange_between_its_rounds(spark, monkeypatch):
    """By the plan of what is written: stage counts also hold what Spark decides while it runs."""
    plans = []

    class Watched(mixing.Scratch):
        def store(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().store(df)

    monkeypatch.setattr(mixing, "Scratch", Watched)
    cells = spark.createDataFrame([(f"s{i % 20}", f"l{i % 3}", "prose", 10 + i) for i in range(60)], "source string, lang string, topic string, tokens long")
    for rounds in (1, 10):
        plans.clear()
        mixing.raked(cells, mixing.Mix(rounds=rounds, fills=1)).collect()
        raking = [p for p in plans if "Window" in p]
        assert len(raking) == 1 and raking[0].count("Window") >= 3 * rounds and "Exchange" not in raking[0]


def test_more_cells_than_one_task_takes(spark, monkeypatch):
    rows = [((f"s{R.randrange(9)}", R.choice(["en", "de", ""]), R.choice(["prose", "short"])), 5 + i) for i in range(300)]
    cells = spark.createDataFrame([(*k, t) for k, t in rows], "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    mix = mixing.Mix(rounds=4)
    p, _, _ = brute_mix(rows, mix)
    for most in (mixing.ONE_TASK, 0):
        monkeypatch.setattr(mixing, "ONE_TASK", most)
        assert {(r.source, r.lang, r.topic): r.probability for r in mixing.raked(cells, mix).collect()} == pytest.approx(p, rel=1e-9)


def test_mix_of_odd_rows(spark):
    """Null ids draw as one, rows that share an id and a cell stay together, clashing columns come back."""
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 2), (5, "b", "en", "s", 3), (5, "b", "en", "s", 4), (6, None, None, None, 5), (7, "word " * 200_000, "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability long").withColumns({"cell": F.lit(1), "draw": F.lit(2), "topic": F.lit("x")})
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 6 and {r.tokens for r in got if r.doc_id == 7} == {200_001}
    kept = mixing.sample_documents(docs)
    assert kept.columns == docs.columns
    for pair in ({1, 2}, {3, 4}):
        assert len(pair & {r.probability for r in kept.collect()}) in (0, 2)


def test_named_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(200)], "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(budget=0.5, targets=(("source", (("a", 3.0), ("b", 1.0))),))
    p = {r.source: r.probability for r in mixing.mix_documents(docs, mix).collect()}
    assert p["a"] == pytest.approx(0.75) and p["b"] == pytest.approx(0.25)


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/7?x", "http://example.com", "http://example.com#/en/7", "http://sub.example.net/de/8/a/b/c/d/e", "http://notexample.net/de/8", "x://a.net/de/", "http://org/es/1", "http://É.org/es/", "http://a.com/en", "a://b://c.com/en/1"]


def brute_rule(host, path):
    best = (None, None)
    for verdict, rule in url_filter.RULES:
        h, p = url_filter.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_hosts_paths_and_rules(spark):
    got = url_filter.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")).collect()
    for r in got:
        url = URLS[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]] + [len(rest)])]
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rules = (("block", "a.com/ads/bad"), ("allow", "a.com/news/ok"))
    urls = [f"http://a.com/ads/bad{i}" for i in range(30)] + ["http://a.com/ads/bad7x", "http://a.com/ads/9"] + [f"http://a.com/news/ok{i}" for i in range(30)] + [f"http://a.com/wide/{chr(97 + i // 26)}{chr(97 + i % 26)}/1" for i in range(60)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r.template for r in got if "/wide/" in r.path} == {"wide/*/*"}
    assert {r.verdict for r in got if r.path.startswith("/ads/bad")} == {"block"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == want


def brute_top(rows, queries_, k):
    out = []
    for q, x in queries_:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(x) == len(y))[:k]
        out += [(q, r, i, int(-s)) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape,block", [("unit", 4096), ("spread", 4096), ("spread", 3)])
def test_top_k_is_exact(spark, monkeypatch, shape, block):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (300, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * (1 if shape == "unit" else r.exponential(1, (300, 1)))
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)]
    rows += [(400, None, ""), (450, [1.0, None], ""), (500, [float("nan")] * 24, ""), (550, [float("inf")] * 24, ""), (600, [0.0] * 24, ""), (650, [1.0, 2.0], ""), (651, [3.0, -1.0], ""), (700, [], "")]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5))
    plain = [(i, [math.floor(256 * c) for c in e]) for i, e, _ in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    got = topk.top_k(v, v.where(F.col("vec_id") % 50 == 0), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(plain, [(i, e) for i, e in plain if i % 50 == 0], 5)


def test_vectors_of_one_length_are_dealt_over_all_tasks(spark):
    """A third of the rows are shorter; the others are unit vectors."""
    rows = spark.range(30_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id") / 30_000).otherwise(1.0).alias("length"))
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    try:
        sizes = [r[1] for r in topk.by_length(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, before)
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)


def test_top_k_of_nothing(spark):
    v = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v, 5).count() == 0


def test_top_k_of_large_values_and_repeats(spark):
    """Whole products of any size; repeated queries count once, repeated candidates twice."""
    rows = [(0, [1e15, 3.0, -2.0]), (1, [1e15, 3.0, -1.0]), (2, [1e14, 5.0, 5.0]), (3, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (4, [1e300, 0.0, 1.0]), (50, [2.0, 1.0, 1.0]), (50, [2.0, 1.0, 1.0]), (51, [1.0, 2.0])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id in (0, 50)"), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [int(math.floor(x * 256)) if abs(x) < 2**40 else int(x * 256) for x in v]) for i, v in rows]
    for q in (0, 50):
        own = next(v for i, v in whole if i == q)
        best = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in whole if i != q and len(v) == 3))[:5]  # whole products choose
        assert got[q] == [(i, min(2**63 - 1, -s)) for s, i in best]  # and are given as far as a long goes


def test_top_k_does_not_depend_on_arrow_batches(spark):
    r = np.random.default_rng(12)
    rows = [(i, (r.normal(size=6) * r.uniform(0.1, 9)).tolist()) for i in range(900)]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(key), []
    for size in ("7", "1000"):
        spark.conf.set(key, size)
        found.append(sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).collect())))
    spark.conf.set(key, before)
    assert found[0] == found[1]


def test_wildcards_follow_support_at_any_depth(spark):
    """Ids become wildcards wherever they stand; thirty sections with many urls each stay names."""
    rows = [f"http://h.io/a/b/c/d/e/u{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)] + [f"http://h.io/s{chr(97 + i % 26)}{chr(97 + i // 26 % 2)}/page" for i in range(520)]
    got = {r.path: r.template for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    deep = {t for p, t in got.items() if p.startswith("/a/")}
    assert deep == {"a/b/c/d/e/*"} and len({t for p, t in got.items() if p.startswith("/s")}) == 52


def test_what_follows_a_deep_wildcard_stays(spark):
    """Eight segments, of which the fifth varies."""
    rows = [f"http://h.io/a/b/c/d/{chr(97 + i % 26)}{chr(97 + i // 26)}/x/y/{end}" for i in range(40) for end in ("edit", "view")]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {r.template for r in got} == {"a/b/c/d/*/x/y/edit", "a/b/c/d/*/x/y/view"}


def test_a_ladder_of_shares_does_not_chain(spark):
    """Nine siblings with 10 % to 90 % of blocked labels, and the same under another parent: far shares stay apart, parents too."""
    rules = (("block", "h.io/p/"), ("block", "h.io/q/"), *((("allow", f"h.io/p/s{chr(97 + k)}/v{j}") for k in range(1, 10) for j in range(10 - k))))
    rows = [f"http://h.io/p/s{chr(97 + k)}/v{j}" for k in range(1, 10) for j in range(10)] + [f"http://h.io/q/x/v{j}" for j in range(10)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    purity = {r.path.rsplit("/", 1)[0]: r.purity for r in url_filter.judge(df, rules).collect()}
    assert purity["/q/x"] == round(12 / 14, 6)
    siblings = spark.createDataFrame([("h", "s" * k, "block" if j < k else "allow") for k in range(1, 10) for j in range(10)], "host string, shape string, verdict string")
    found = {len(r.shape): r for r in url_filter.template_tree(siblings, url_filter.Scratch(spark)).collect()}
    assert found[1].purity < 0.35 and found[9].purity > 0.65 and 0.4 < found[5].purity < 0.6
    assert all(a <= b for a, b in zip([found[k].purity for k in range(1, 9)], [found[k].purity for k in range(2, 10)]))


def test_odd_urls(spark):
    rows = [(1, "http://x.y/" + "a/" * 20_000), (1, "http://x.y/" + "a/" * 20_000), (None, None), (2, "")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("template", F.lit(1))).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"} and max(len(r.path) for r in got) == 40_001
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
