"""Quality rules and robust outliers of documents' statistics, by DataFrame functions alone.

Base rules count words, symbols, repeated lines and repeated five-word windows of each whole text and
fail documents that are short or repeat themselves. Those that pass are then held against the others
of their language and source: five transformed statistics (logarithms of lengths, arcsines of shares)
on a grid of 1 / ``GRID`` get a minimum-covariance-determinant estimate a group, and a document is
rejected when its squared Mahalanobis distance lies beyond the chi-squared quantile.

The estimate keeps ``SHARE`` of a group. From two starts (medians with median deviations, plain means
with covariances) concentration steps follow: distances are binned, the nearest bins that hold the
share are chosen, and their mean and covariance are the next estimate; of the two ends the smaller
determinant stays. A step is one pass over small rows of whole numbers: sums and products are
aggregated by (group, start, bin) before anything is shuffled, so a group with a third of all rows
costs no more than others, and results do not depend on the order of sums. Statistics that hardly
vary would make any deviation an outlier, so each variance gets the square of ``FLOORS``. Groups of
fewer than ``LEAST`` documents are pooled by language; pools that are still smaller reject nothing.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch

#: What separates words, what counts as a symbol.
SPACE, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
WINDOW = 5
#: (transformed statistic, least standard deviation), from the base's counts.
FEATURES = (
    ("ln(word_chars / n_words)", 0.1),
    ("2 * asin(sqrt(n_symbols / word_chars))", 0.2),
    ("2 * asin(sqrt(n_dup_lines / n_lines))", 0.2),
    ("2 * asin(sqrt(n_repeat_words / n_words))", 0.2),
    ("ln(n_words / n_lines)", 0.2),
)
DIMS = range(1, len(FEATURES) + 1)
PAIRS = [(i, j) for i in DIMS for j in range(1, i + 1)]
GRID = 256
#: Bins of ln(1 + squared distance), to choose the nearest.
BINS = 32
SHARE, STEPS, LEAST, TAIL = 0.75, 4, 50, 1e-6
FLOORS = [floor * GRID for _, floor in FEATURES]
GROUP = ["lang", "pool"]
FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def chi_squared(x: float, dims: int) -> float:
    """P(chi-squared of ``dims`` <= x), by the series of the incomplete gamma function."""
    a, half = dims / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a))) if half > 0 else 0.0


def quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, dims) < p else (low, mid)
    return high


#: A covariance of the nearest SHARE of a normal group is so much too small.
CONSISTENT = SHARE / chi_squared(quantile(SHARE, len(FEATURES)), len(FEATURES) + 2)
CUTOFF = quantile(1 - TAIL, len(FEATURES))


def bound(value: Column, use) -> Column:
    """use(value), with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered(words: Column, starts: Column) -> Column:
    """Words that lie in windows found twice or more; ``starts`` holds the windows' first places.

    Windows are told apart by 128 bits of hash. Most texts repeat none, which the first 64 show.
    """
    at = lambda i: [F.get(words, i + k) for k in range(WINDOW)]

    def repeated(rows: Column) -> Column:
        same = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"])
        twice = lambda x, k: F.coalesce(same(x, F.get(rows, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, k + 1)), F.lit(False))
        places = F.sort_array(F.transform(F.filter(rows, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    sorted_windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*at(i)).alias("a"), F.xxhash64(F.lit(1), *at(i)).alias("b"), i.alias("i"))))
    any_twice = bound(F.transform(starts, lambda i: F.xxhash64(*at(i))), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(any_twice, bound(sorted_windows, repeated)).otherwise(0)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words): counts of whole texts, a null one has none."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    counts = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.when(F.size(w) > WINDOW, bound(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda s: covered(w, s))).otherwise(0).cast("long").alias("n_repeat_words")))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")
    category = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), category(lang_col).alias("lang"), category(source_col).alias("source"), counts.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))
    return rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def on_grid() -> list[str]:
    """SQL of z1, z2, ...: the transformed statistics in steps of the grid, null where the base failed."""
    return [f"CASE WHEN {FAILED} THEN NULL ELSE CAST(floor({GRID} * ({f}) + 0.5) AS BIGINT) END AS z{i}" for i, (f, _) in zip(DIMS, FEATURES, strict=True)]


def estimate_sql() -> list[str]:
    """SQL, in order, from the sums (n, s1.., q11..) of chosen rows to mean m, inverse factor k and log-determinant of the corrected covariance."""
    out = [f"CAST(s{i} AS DOUBLE) / n AS m{i}" for i in DIMS]
    out += [f"{CONSISTENT} * (CAST(q{i}{j} AS DOUBLE) / n - m{i} * m{j})" + (f" + {FLOORS[i - 1] ** 2}" if i == j else "") + f" AS a{i}{j}" for i, j in PAIRS]
    return out + factor_sql()


def factor_sql() -> list[str]:
    """From a covariance (a11, a21, ...) to its Cholesky factor l, that factor's inverse k, and the log-determinant."""
    out = []
    for i, j in PAIRS:
        less = "".join(f" - l{i}{m} * l{j}{m}" for m in range(1, j))
        out.append(f"sqrt(a{i}{i}{less}) AS l{i}{i}" if i == j else f"(a{i}{j}{less}) / l{j}{j} AS l{i}{j}")
    for i, j in PAIRS:
        out.append(f"1 / l{i}{i} AS k{i}{i}" if i == j else f"-({' + '.join(f'l{i}{m} * k{m}{j}' for m in range(j, i))}) / l{i}{i} AS k{i}{j}")
    return [*out, "2 * (" + " + ".join(f"ln(l{i}{i})" for i in DIMS) + ") AS lndet"]


def start_sql() -> list[str]:
    """The first estimate: medians and squared median deviations on the diagonal."""
    out = [f"CAST(median{i} AS DOUBLE) AS m{i}" for i in DIMS]
    return out + [f"{1.4826**2} * mad{i} * mad{i} + {FLOORS[i - 1] ** 2} AS a{i}{j}" if i == j else f"0.0 AS a{i}{j}" for i, j in PAIRS] + factor_sql()


def distance_sql() -> str:
    """Squared Mahalanobis distance of z by m and k."""
    y = ["(" + " + ".join(f"k{i}{j} * (z{j} - m{j})" for j in range(1, i + 1)) + ")" for i in DIMS]
    return " + ".join(f"{x} * {x}" for x in y)


PARAMETERS = [f"m{i}" for i in DIMS] + [f"k{i}{j}" for i, j in PAIRS]
SUMS = [("n", "count(*)"), *((f"s{i}", f"sum(z{i})") for i in DIMS), *((f"q{i}{j}", f"sum(z{i} * z{j})") for i, j in PAIRS)]


def lets(df: DataFrame, expressions: list[str]) -> DataFrame:
    """Each expression may use the names before it."""
    for e in expressions:
        sql, _, name = e.rpartition(" AS ")
        df = df.withColumn(name, F.expr(sql))
    return df


def medians(rows: DataFrame) -> DataFrame:
    """(lang, pool, median1.., mad1..) by counting values, of which the grid has few."""
    long = rows.select(*GROUP, F.posexplode(F.array(*(f"z{i}" for i in DIMS))).alias("f", "z"))
    counts = long.groupBy(*GROUP, "f", "z").agg(F.count("*").alias("n"))

    def middle(df: DataFrame, value: str) -> DataFrame:
        """The least value that half of the rows do not exceed, as ``mid``."""
        own = Window.partitionBy(*GROUP, "f")
        df = df.withColumns({"upto": F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(own)})
        return df.withColumn("mid", F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col(value))).over(own))

    deviations = middle(counts, "z").withColumn("median", F.col("mid")).groupBy(*GROUP, "f", "median", F.abs(F.col("z") - F.col("median")).alias("dev")).agg(F.sum("n").alias("n"))
    both = middle(deviations, "dev").groupBy(*GROUP, "f").agg(F.min("median").alias("median"), F.min("mid").alias("mad"))
    return both.groupBy(*GROUP).agg(*(F.max(F.when(F.col("f") == i - 1, F.col(c))).alias(f"{c}{i}") for c in ("median", "mad") for i in DIMS))


def sums_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.expr(sql).alias(name) for name, sql in SUMS))


def concentrated(bins: DataFrame) -> DataFrame:
    """Sums over each group's nearest bins that hold SHARE of it."""
    own = Window.partitionBy(*GROUP, "start")
    marked = bins.withColumns({"nearer": F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(own)})
    return marked.where(F.col("nearer") < SHARE * F.col("all")).groupBy(*GROUP, "start").agg(*(F.sum(name).alias(name) for name, _ in SUMS))


def estimates(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, docs, m.., k..): the estimate for each group's documents, of a pool where the group is small.

    ``stats`` has lang, source and z1, ...; rows with null z take no part.
    """
    rows = stats.where("z1 is not null")
    sizes = scratch.store(rows.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", F.when(F.col("n") >= LEAST, F.concat(F.lit("="), F.col("source"))).otherwise("").alias("pool")))
    pooled = rows.join(sizes, ["lang", "source"])
    middle = lets(medians(pooled), start_sql()).select(*GROUP, F.lit(0).alias("start"), *PARAMETERS)
    plain = lets(sums_by(pooled, *GROUP), estimate_sql()).select(*GROUP, F.lit(1).alias("start"), *PARAMETERS)
    now = scratch.store(middle.unionByName(plain))
    for step in range(STEPS):
        by_source = sizes.join(now, GROUP)
        bins = sums_by(rows.join(by_source, ["lang", "source"]).withColumn("bin", F.expr(f"CAST(floor({BINS} * ln(1 + {distance_sql()})) AS BIGINT)")), *GROUP, "start", "bin")
        done = lets(concentrated(bins), estimate_sql())
        now = scratch.store(done.select(*GROUP, "start", *PARAMETERS, *(["lndet", "n"] if step == STEPS - 1 else [])))
    least = now.groupBy(*GROUP).agg(F.min(F.struct("lndet", "start", "n", *PARAMETERS)).alias("e"))
    docs = pooled.groupBy(*GROUP).agg(F.count("*").alias("docs"))
    return scratch.store(sizes.join(least, GROUP).join(docs, GROUP).select("lang", "source", "docs", *(F.col(f"e.{c}").alias(c) for c in PARAMETERS)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row.

    ``distance`` is the squared distance to two places, null where the base failed or a pool is too
    small to judge. Null languages and sources are the empty category. Null and empty texts have no
    words and fail the base. Rows and ids may repeat; a repeated row counts each time. Very long
    texts are counted whole, in memory of some ten times their size. Other columns are not read; an
    empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    stats = scratch.store(statistics(df, id_col, text_col, lang_col, source_col).withColumn("base_failed", F.expr(FAILED)).selectExpr("*", *on_grid()))
    # groups and pools in which nothing may be judged have no estimate or too few documents
    met = stats.join(estimates(stats, scratch), ["lang", "source"], "left").withColumn("d", F.when(F.col("z1").isNotNull() & (F.col("docs") >= LEAST), F.expr(distance_sql())))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d") <= CUTOFF, F.lit(True))
    return scratch.last(met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("d", 2).alias("distance")))


def oracle_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL: counts by unnested words and lines, estimates by the same arithmetic."""
    space = r"\x20\x09-\x0D"
    params, sums = ", ".join(PARAMETERS), ", ".join(f"{sql} AS {name}" for name, sql in SUMS)
    z = ", ".join(f"z{i}" for i in DIMS)
    parts = [f"""docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {table}),
words AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^{space}]+') AS w FROM docs)),
windows AS (SELECT r, i, {", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(WINDOW))} FROM words WINDOW w AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM windows WHERE w{WINDOW - 1} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, {", ".join(f"w{k}" for k in range(WINDOW))}) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS t(k) GROUP BY r),
counted AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^{space}]') GROUP BY r),
base AS (SELECT d.r, d.doc_id, d.lang, d.source, coalesce(c.n, 0) AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars, length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS n_symbols, coalesce(l.n, 0) AS n_lines,
  coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM docs AS d LEFT JOIN counted AS c USING (r) LEFT JOIN lines AS l USING (r) LEFT JOIN repeats AS p USING (r)),
stats AS MATERIALIZED (SELECT *, {FAILED} AS base_failed, {", ".join(on_grid())} FROM base),
sizes AS MATERIALIZED (SELECT lang, source, CASE WHEN count(*) >= {LEAST} THEN '=' || source ELSE '' END AS pool FROM stats WHERE z1 IS NOT NULL GROUP BY lang, source),
pooled AS MATERIALIZED (SELECT * FROM stats JOIN sizes USING (lang, source) WHERE z1 IS NOT NULL),
long AS (SELECT lang, pool, unnest([{z}]) AS z, unnest({[*DIMS]}) AS f FROM pooled),
mid AS (SELECT lang, pool, f, quantile_disc(z, 0.5) AS median FROM long GROUP BY ALL),
mads AS (SELECT lang, pool, f, any_value(median) AS median, quantile_disc(abs(z - median), 0.5) AS mad FROM long JOIN mid USING (lang, pool, f) GROUP BY ALL),
wide AS (SELECT lang, pool, {", ".join(f"max({c}) FILTER (f = {i}) AS {c}{i}" for c in ("median", "mad") for i in DIMS)} FROM mads GROUP BY ALL),
e0 AS MATERIALIZED (SELECT lang, pool, 0 AS start, {params} FROM (SELECT *, {", ".join(start_sql())} FROM wide)
  UNION ALL SELECT lang, pool, 1, {params} FROM (SELECT *, {", ".join(estimate_sql())} FROM (SELECT lang, pool, {sums} FROM pooled GROUP BY ALL)))"""]
    for a, b in pairwise(range(STEPS + 1)):
        parts.append(f"""b{b} AS (SELECT lang, pool, start, CAST(floor({BINS} * ln(1 + {distance_sql()})) AS BIGINT) AS bin, {sums} FROM pooled JOIN e{a} USING (lang, pool) GROUP BY ALL),
c{b} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang, pool, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer, sum(n) OVER (PARTITION BY lang, pool, start) AS whole FROM b{b}),
e{b} AS MATERIALIZED (SELECT *, {", ".join(estimate_sql())} FROM (SELECT lang, pool, start, {", ".join(f"sum({name}) AS {name}" for name, _ in SUMS)} FROM c{b} WHERE nearer < {SHARE} * whole GROUP BY ALL))""")
    parts.append(f"""best AS (SELECT *, row_number() OVER (PARTITION BY lang, pool ORDER BY lndet, start) AS o FROM e{STEPS}),
docs_of AS (SELECT lang, pool, count(*) AS docs FROM pooled GROUP BY ALL),
judged AS (SELECT p.r, {distance_sql()} AS d FROM pooled AS p JOIN best AS b USING (lang, pool) JOIN docs_of AS n USING (lang, pool) WHERE o = 1 AND docs >= {LEAST})
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, NOT s.base_failed AND coalesce(j.d <= {CUTOFF}, true) AS kept, round(j.d, 2) AS distance
FROM stats AS s LEFT JOIN judged AS j USING (r)""")
    return "WITH " + ",\n".join(parts)
