"""The engine's queries over the standard tables, and the SQL that DuckDB runs beside each."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import metrics, models, quantize, rank, shared, stats
from .plans.graph import parse
from .plans.propagation import checked_rows, infer
from .sources import traces as sources
from .sources.scratch import scratch_dir, store
from .streaming.accumulate import read_class_state, read_moments, stream_class_state, stream_moments, windowed

POINTS = [0, 5, 9, 17, 23, 40, 51, 63]
TUPLES2 = [[i, i + 1] for i in range(0, 62, 3)]
TUPLES3 = [[i, i + 1, i + 2] for i in range(0, 62, 4)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def traces_of(spark: SparkSession, d: str, nv: int = 1) -> DataFrame:
    """Embeddings as traces: 64 samples of trunc(4096 x), the label as class."""
    labels = F.array(F.col("label"), (F.col("label") % 2).cast("int")) if nv == 2 else F.array("label")
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("trace_id"), F.transform("embedding", lambda x: (x.cast("double") * 4096).cast("long")).alias("samples"), labels.alias("labels"))


def float_traces(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("trace_id"), F.col("embedding").cast("array<double>").alias("samples"), "label")


LONG = """long AS (SELECT vec_id, label AS class, s AS sample, CAST(trunc(embedding[s + 1]::DOUBLE * 4096) AS BIGINT) AS x
  FROM embeddings, (SELECT unnest(range(64)) AS s))"""
STATE = f"""{LONG}, state AS (SELECT class, sample, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS s, sum(x * x)::DOUBLE AS ss FROM long GROUP BY class, sample),
totals AS (SELECT sample, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM state GROUP BY sample)"""
SNR = f"""{STATE}, ssc AS (SELECT sample, sum(state.s * state.s * totals.n / state.n) AS ssc, any_value(totals.n) AS n, any_value(totals.s) AS s, any_value(totals.ss) AS ss
  FROM state JOIN totals USING (sample) GROUP BY sample),
snr AS (SELECT 0 AS var, sample, round((ssc - s * s) / (n * ss - ssc), 6) AS snr FROM ssc)"""


@query("snr_embeddings", f"WITH {SNR} SELECT var, sample::INTEGER AS sample, snr FROM snr")
def snr_embeddings(spark, d):
    return metrics.snr(stats.class_state(traces_of(spark, d))).withColumn("snr", F.round("snr", 6))


@query("snr_exact_embeddings", f"WITH {SNR} SELECT var, sample::INTEGER AS sample, round(snr, 4) AS snr FROM snr")
def snr_exact_embeddings(spark, d):
    return metrics.snr(stats.class_state(traces_of(spark, d)), exact=True).withColumn("snr", F.round("snr", 4))


@query("snr_dense_path", f"WITH {SNR} SELECT var, sample::INTEGER AS sample, snr FROM snr")
def snr_dense_path(spark, d):
    return metrics.snr(stats.class_state(traces_of(spark, d), dense=True)).withColumn("snr", F.round("snr", 6))


@query("snr_topk_poi", f"WITH {SNR} SELECT var, sample::INTEGER AS sample, snr, row_number() OVER (ORDER BY snr DESC, sample)::INTEGER AS rank FROM snr QUALIFY rank <= 8")
def snr_topk_poi(spark, d):
    return metrics.top_points(snr_embeddings(spark, d), 8)


LINE = """line AS (SELECT [l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT] AS samples,
  [CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END] AS labels FROM lineitem),
long AS (SELECT v AS var, labels[v + 1] AS class, s AS sample, samples[s + 1] AS x FROM line, (SELECT unnest(range(2)) AS v), (SELECT unnest(range(4)) AS s)),
state AS (SELECT var, class, sample, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS s, sum(x * x)::DOUBLE AS ss FROM long GROUP BY ALL),
totals AS (SELECT var, sample, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM state GROUP BY ALL),
ssc AS (SELECT var, sample, sum(state.s * state.s * totals.n / state.n) AS ssc, any_value(totals.n) AS n, any_value(totals.s) AS s, any_value(totals.ss) AS ss FROM state JOIN totals USING (var, sample) GROUP BY ALL)"""


@query("snr_lineitem", f"WITH {LINE} SELECT var::INTEGER AS var, sample::INTEGER AS sample, round((ssc - s * s) / (n * ss - ssc), 6) AS snr FROM ssc")
def snr_lineitem(spark, d, dense=False):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    line = read(spark, d, "lineitem").select(F.lit(0).alias("trace_id"), F.array(F.col("l_quantity").cast("long"), *(F.round(F.col(c) * 100).cast("long") for c in ("l_extendedprice", "l_discount", "l_tax"))).alias("samples"), F.array(flag, F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).alias("labels"))
    return metrics.snr(stats.class_state(line, dense)).withColumn("snr", F.round("snr", 6))


@query("snr_lineitem_dense", ORACLE["snr_lineitem"])
def snr_lineitem_dense(spark, d):
    return snr_lineitem(spark, d, dense=True)


@query("class_counts", "SELECT 0 AS var, label AS class, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, d):
    return stats.class_counts(traces_of(spark, d))


@query("class_sums", f"WITH {STATE} SELECT 0 AS var, class, sample::INTEGER AS sample, n::BIGINT AS n, s::BIGINT AS s, ss::BIGINT AS ss FROM state")
def class_sums(spark, d):
    return stats.class_state(traces_of(spark, d)).withColumn("ss", F.col("ss").cast("long"))


@query("class_means", f"WITH {STATE} SELECT 0 AS var, class, sample::INTEGER AS sample, round(s / n, 6) AS mean FROM state")
def class_means(spark, d):
    return stats.class_means(stats.class_state(traces_of(spark, d))).withColumn("mean", F.round("mean", 6))


@query("state_merge", f"WITH {STATE} SELECT 0 AS var, class, sample::INTEGER AS sample, n::BIGINT AS n, s::BIGINT AS s, ss::BIGINT AS ss FROM state")
def state_merge(spark, d):
    """Two halves accumulated apart, then merged."""
    t = traces_of(spark, d)
    return stats.merge_class_states(*(stats.class_state(t.where(F.col("trace_id") % 2 == k)) for k in (0, 1))).withColumn("ss", F.col("ss").cast("long"))


@query("validate_traces", "SELECT count(*) AS n, min(len(embedding))::INTEGER AS low, max(len(embedding))::INTEGER AS high, min(label) AS first_class, max(label) AS last_class FROM embeddings")
def validate_traces(spark, d):
    t = traces_of(spark, d)
    sources.shape(t)
    sources.check_classes(t, 10)
    return t.agg(F.count("*").alias("n"), F.min(F.size("samples")).alias("low"), F.max(F.size("samples")).alias("high"), F.min(F.get("labels", F.lit(0))).alias("first_class"), F.max(F.get("labels", F.lit(0))).alias("last_class"))


@query("poi_projection", "SELECT vec_id AS trace_id, " + ", ".join(f"CAST(trunc(embedding[{p + 1}]::DOUBLE * 4096) AS BIGINT) AS s{i}" for i, p in enumerate(POINTS)) + " FROM embeddings")
def poi_projection(spark, d):
    cut, (own,) = sources.prune(traces_of(spark, d), [POINTS])
    return cut.select("trace_id", *(F.get("samples", F.lit(p)).alias(f"s{i}") for i, p in enumerate(own)))


@query("bit_width_scan", f"WITH {LONG} SELECT sample::INTEGER AS sample, bit_or(abs(x))::BIGINT AS used FROM long GROUP BY sample")
def bit_width_scan(spark, d):
    return stats.used_bits(traces_of(spark, d))


FLOATS = "floats AS (SELECT vec_id, label, s AS sample, embedding[s + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS s))"
BOUNDS = f"{FLOATS}, params AS (SELECT sample, (min(x) + max(x)) / 2 AS shift, 32768.0 / ((max(x) - min(x)) / 2 * 4.0) AS scale FROM floats GROUP BY sample)"


@query("quant_bounds", f"WITH {BOUNDS} SELECT sample::INTEGER AS sample, round(shift, 6) AS shift, round(scale, 4) AS scale FROM params")
def quant_bounds(spark, d):
    return quantize.fit(float_traces(spark, d)).select("sample", F.round("shift", 6).alias("shift"), F.round("scale", 4).alias("scale"))


@query("quant_moment", f"WITH {FLOATS} SELECT sample::INTEGER AS sample, round(avg(x), 6) AS shift, round(32768.0 / (7.0 * stddev_samp(x)), 4) AS scale FROM floats GROUP BY sample")
def quant_moment(spark, d):
    return quantize.fit(float_traces(spark, d), "moment").select("sample", F.round("shift", 6).alias("shift"), F.round("scale", 4).alias("scale"))


@query("quant_apply", f"WITH {BOUNDS} SELECT sample::INTEGER AS sample, sum(CAST(trunc((x - shift) * scale) AS BIGINT))::BIGINT AS total, min(CAST(trunc((x - shift) * scale) AS BIGINT))::SMALLINT AS low, max(CAST(trunc((x - shift) * scale) AS BIGINT))::SMALLINT AS high FROM floats JOIN params USING (sample) GROUP BY sample")
def quant_apply(spark, d):
    t = float_traces(spark, d)
    q = quantize.apply(t, quantize.fit(t))
    return q.select(F.posexplode("samples").alias("sample", "q")).groupBy("sample").agg(F.sum("q").alias("total"), F.min("q").alias("low"), F.max("q").alias("high"))


@query("quant_clip", f"WITH {BOUNDS} SELECT sample::INTEGER AS sample, sum(CAST(trunc(greatest(-32768.0, least(32767.0, (x * 8 - shift) * scale))) AS BIGINT))::BIGINT AS total FROM floats JOIN params USING (sample) GROUP BY sample")
def quant_clip(spark, d):
    t = float_traces(spark, d)
    wide = t.withColumn("samples", F.transform("samples", lambda x: x * 8))
    return quantize.apply(wide, quantize.fit(t), clip=True).select(F.posexplode("samples").alias("sample", "q")).groupBy("sample").agg(F.sum("q").alias("total"))


def ttest_sql(rows: str, order: int) -> str:
    powers = ", ".join(f"sum(pow(x - mean, {p})) / any_value(n) AS m{p}" for p in range(2, 2 * order + 1))
    if order == 1:
        u, v = "mean", "m2"
    elif order == 2:
        u, v = "m2", "m4 - m2 * m2"
    else:
        u, v = f"m{order} / pow(m2, {order / 2})", f"(m{2 * order} - m{order} * m{order}) / pow(m2, {order})"
    return f"""WITH {rows}, means AS (SELECT grp, sample, count(*)::DOUBLE AS n, avg(x) AS mean FROM rows GROUP BY grp, sample),
moments AS (SELECT grp, sample, any_value(n) AS n, any_value(mean) AS mean, {powers} FROM rows JOIN means USING (grp, sample) GROUP BY grp, sample),
each AS (SELECT grp, sample, {u} AS u, ({v}) / n AS v FROM moments)
SELECT {order} AS "order", a.sample::INTEGER AS sample, round((a.u - b.u) / sqrt(a.v + b.v), 5) AS t FROM each a JOIN each b USING (sample) WHERE a.grp = 0 AND b.grp = 1"""


GROUPED = f"{LONG}, rows AS (SELECT class % 2 AS grp, sample, x::DOUBLE AS x FROM long)"


def ttest_order(order: int):
    def run(spark, d):
        rows = stats.by_group(traces_of(spark, d), F.get("labels", F.lit(0)) % 2)
        return metrics.ttest_of(rows, order).where(F.col("order") == order).withColumn("t", F.round("t", 5))

    return run


for k in (1, 2, 3):
    query(f"ttest_o{k}", ttest_sql(GROUPED, k))(ttest_order(k))


@query("ttest_dense", ttest_sql(GROUPED, 3))
def ttest_dense(spark, d):
    """Third order from dense partial moments, one pass over the vectors."""
    return metrics.ttest(stats.dense_moments(traces_of(spark, d), F.get("labels", F.lit(0)) % 2, 6), 3).where(F.col("order") == 3).withColumn("t", F.round("t", 5))


@query("moments_merge", ttest_sql(GROUPED, 2))
def moments_merge(spark, d):
    """Moments of three batches merged by the shift rule, then the second-order statistic."""
    t = traces_of(spark, d)
    parts = [stats.central_moments(stats.by_group(t.where(F.col("trace_id") % 3 == k), F.get("labels", F.lit(0)) % 2), 4) for k in range(3)]
    return metrics.ttest(stats.merge_moments(*parts), 2).where(F.col("order") == 2).withColumn("t", F.round("t", 5))


@query("ttest_documents", ttest_sql("rows AS (SELECT quality AS grp, 0 AS sample, n_chars::DOUBLE AS x FROM documents JOIN labels USING (doc_id))", 1))
def ttest_documents(spark, d):
    joined = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rows = joined.select(F.col("quality").cast("int").alias("grp"), F.lit(0).alias("sample"), F.col("n_chars").cast("double").alias("x"))
    return metrics.ttest_of(rows, 1).withColumn("t", F.round("t", 5))


def mttest_sql(tuples: list[list[int]], d: int) -> str:
    values = ", ".join(f"({i}, {t})" for i, t in enumerate(tuples))
    product = " * ".join(f"(v[t.points[{j + 1}] + 1] - m[t.points[{j + 1}] + 1])" for j in range(d))
    scale = " * ".join(f"s[t.points[{j + 1}] + 1]" for j in range(d))
    mu, sq = ("avg(p) / sqrt(any_value(scale))", "avg(p * p) / any_value(scale)") if d > 2 else ("avg(p)", "avg(p * p)")
    return f"""WITH {LONG}, wide AS (SELECT vec_id, class % 2 AS grp, list(x::DOUBLE ORDER BY sample) AS v FROM long GROUP BY vec_id, class),
stat AS (SELECT class % 2 AS grp, sample, avg(x) AS m, var_pop(x) AS s FROM long GROUP BY ALL), st AS (SELECT grp, list(m ORDER BY sample) AS m, list(s ORDER BY sample) AS s FROM stat GROUP BY grp),
t(tuple_id, points) AS (VALUES {values}), products AS (SELECT grp, tuple_id, {product} AS p, {scale} AS scale FROM wide JOIN st USING (grp), t),
each AS (SELECT grp, tuple_id, count(*)::DOUBLE AS n, {mu} AS mu, {sq} AS sq FROM products GROUP BY grp, tuple_id)
SELECT a.tuple_id, round((a.mu - b.mu) / sqrt((a.sq - a.mu * a.mu) / a.n + (b.sq - b.mu * b.mu) / b.n), 5) AS t FROM each a JOIN each b USING (tuple_id) WHERE a.grp = 0 AND b.grp = 1"""


def mttest_order(tuples: list[list[int]], d: int):
    def run(spark, path):
        return metrics.mttest(stats.tuple_moments(traces_of(spark, path), F.get("labels", F.lit(0)) % 2, tuples), d).withColumn("t", F.round("t", 5))

    return run


query("mttest_d2", mttest_sql(TUPLES2, 2))(mttest_order(TUPLES2, 2))
query("mttest_d3", mttest_sql(TUPLES3, 3))(mttest_order(TUPLES3, 3))


@query("mttest_merge", mttest_sql(TUPLES3, 3))
def mttest_merge(spark, d):
    """States of three batches merged by the shift rule."""
    t = traces_of(spark, d)
    parts = [stats.tuple_moments(t.where(F.col("trace_id") % 3 == k), F.get("labels", F.lit(0)) % 2, TUPLES3) for k in range(3)]
    return metrics.mttest(stats.merge_tuple_moments(*parts, d=3), 3).withColumn("t", F.round("t", 5))


def cpa_sql(value: str) -> str:
    return f"""WITH {STATE}, models AS (SELECT c AS value, s AS sample, bit_count(c)::DOUBLE + s * c / 64.0 AS m FROM (SELECT unnest(range(16)) AS c), (SELECT unnest(range(64)) AS s)),
spread AS (SELECT sample, avg(m) AS mm, var_pop(m) AS mv FROM models GROUP BY sample),
met AS (SELECT k AS key, state.sample, (state.s - state.n * totals.s / totals.n) * (m - mm) AS term, totals.n, totals.s, totals.ss, mv
  FROM state JOIN totals USING (sample), (SELECT unnest(range(16)) AS k) JOIN models ON models.sample = state.sample AND models.value = {value} JOIN spread ON spread.sample = state.sample)
SELECT 0 AS var, key::INTEGER AS key, sample::INTEGER AS sample, round(sum(term) / ((any_value(n) - 1) * sqrt(any_value(mv) * (any_value(n) * any_value(ss) - any_value(s) * any_value(s)) / (any_value(n) * (any_value(n) - 1)))), 6) + 0.0 AS rho FROM met GROUP BY key, sample"""


def cpa_kind(kind: str):
    def run(spark, d):
        classes = spark.range(16).select(F.lit(0).alias("var"), F.col("id").cast("int").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sample"))
        table = classes.withColumn("m", F.bit_count("class") + F.col("sample") * F.col("class") / F.lit(64.0))
        return metrics.cpa(stats.class_state(traces_of(spark, d)), table, 16, kind).withColumn("rho", F.round("rho", 6) + F.lit(0.0))

    return run


query("cpa_xor", cpa_sql("xor(k, state.class)"))(cpa_kind("xor"))
query("cpa_add", cpa_sql("(k + state.class) % 16"))(cpa_kind("add"))


@query("cpa_best_key", f"WITH r AS ({cpa_sql('xor(k, state.class)')}), p AS (SELECT key, max(abs(rho)) AS peak FROM r GROUP BY key) SELECT 0 AS var, key, peak FROM p ORDER BY peak DESC, key LIMIT 1")
def cpa_best_key(spark, d):
    return metrics.best_key(cpa_kind("xor")(spark, d))


PAIRS = f"""{STATE}, pts(pos, sample) AS (VALUES {", ".join(f"({i}, {p})" for i, p in enumerate(POINTS))}),
cut AS (SELECT vec_id, pos, x FROM long JOIN pts USING (sample)), pairs AS (SELECT a.pos AS i, b.pos AS j, count(*) AS n, sum(a.x * b.x)::DOUBLE AS sxy FROM cut a JOIN cut b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY ALL),
dev AS (SELECT class, pos, state.n, state.s - state.n * totals.s / totals.n AS d, totals.s AS sall FROM state JOIN totals USING (sample) JOIN pts USING (sample)),
sb AS (SELECT a.pos AS i, b.pos AS j, sum(a.d * b.d / a.n) AS s_b, any_value(a.sall) AS si, any_value(b.sall) AS sj FROM dev a JOIN dev b ON a.class = b.class AND a.pos <= b.pos GROUP BY ALL)"""


@query("poi_scatter", f"WITH {PAIRS} SELECT i::INTEGER AS i, j::INTEGER AS j, n, sxy::BIGINT AS sxy FROM pairs")
def poi_scatter(spark, d):
    return stats.pair_scatter(traces_of(spark, d), POINTS)


@query("poi_scatter_relational", f"WITH {PAIRS} SELECT i::INTEGER AS i, j::INTEGER AS j, n, sxy::BIGINT AS sxy FROM pairs")
def poi_scatter_relational(spark, d):
    return stats.pair_scatter(traces_of(spark, d), POINTS, dense=False)


def scatter_query(column: str):
    def run(spark, d):
        t, (own,) = sources.prune(traces_of(spark, d), [POINTS])
        return metrics.lda_scatter(stats.class_state(t), stats.pair_scatter(t, own), own).select("i", "j", F.round(column, 2).alias(column))

    return run


query("lda_sb", f"WITH {PAIRS} SELECT i::INTEGER AS i, j::INTEGER AS j, round(s_b, 2) AS s_b FROM sb")(scatter_query("s_b"))
query("lda_sw", f"WITH {PAIRS} SELECT sb.i::INTEGER AS i, sb.j::INTEGER AS j, round(sxy - si * sj / n - s_b, 2) AS s_w FROM sb JOIN pairs ON sb.i = pairs.i AND sb.j = pairs.j")(scatter_query("s_w"))


@query("lda_mus", f"WITH {STATE} SELECT class, sample::INTEGER AS sample, round(s / n, 6) AS mu FROM state WHERE sample IN ({', '.join(map(str, POINTS))})")
def lda_mus(spark, d):
    t, (own,) = sources.prune(traces_of(spark, d), [POINTS])
    return stats.class_means(stats.class_state(t)).select("class", F.get(F.array(*map(F.lit, sorted(POINTS))), F.col("sample")).alias("sample"), F.round("mean", 6).alias("mu"))


def solved(spark, d, p=3):
    t = traces_of(spark, d, nv=2)
    table = shared.lda_solve(shared.lda_state(t, 10, [POINTS, POINTS[::-1]]), p)
    return t, shared.lda_models(table.where("var = 0"))


@query("lda_predict")
def lda_predict(spark, d):
    t, m = solved(spark, d)
    return models.lda_predict(t, m)


@query("lda_log2p")
def lda_log2p(spark, d):
    t, m = solved(spark, d)
    return models.lda_log2(t, m)


@query("lda_project_abs")
def lda_project_abs(spark, d):
    t, m = solved(spark, d)
    return models.lda_project(t, m).withColumn("value", F.transform("value", lambda x: F.round(F.abs(x), 6)))


@query("lda_select_vars")
def lda_select_vars(spark, d):
    t = traces_of(spark, d)
    t = t.withColumn("labels", F.array(F.get("labels", F.lit(0)), F.get("labels", F.lit(0))))
    table = shared.lda_solve(shared.lda_state(t, 10, [POINTS, POINTS[:4]]), 2)
    return models.lda_predict(t, shared.lda_models(shared.selected(table, [1, 0, 1])))


BITS = "bits AS (SELECT vec_id, i, CASE WHEN i = 0 THEN 1 ELSE 2 * ((label >> (i - 1)) & 1) - 1 END AS b FROM embeddings, (SELECT unnest(range(5)) AS i))"


@query("rlda_xtx", f"WITH {BITS} SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, sum(a.b * b.b)::BIGINT AS s FROM bits a JOIN bits b USING (vec_id) GROUP BY a.i, b.i")
def rlda_xtx(spark, d):
    """Normal equations: products of signed label bits."""
    return shared.rlda_state(traces_of(spark, d), 4).where("kind = 'bits'").select(F.col("b").alias("i"), F.posexplode("v").alias("j", "s"))


@query("rlda_xty", f"WITH {LONG}, {BITS} SELECT i::INTEGER AS i, sample::INTEGER AS sample, sum(b * x)::BIGINT AS s FROM bits JOIN long USING (vec_id) GROUP BY i, sample")
def rlda_xty(spark, d):
    return shared.rlda_state(traces_of(spark, d), 4).where("kind = 'cross'").select(F.col("b").alias("i"), F.posexplode("v").alias("sample", "s"))


def regression(spark, d):
    t = traces_of(spark, d)
    return t, shared.rlda_models(shared.rlda_solve(shared.rlda_state(t, 4), 3))[0]


@query("rlda_predict")
def rlda_predict(spark, d):
    t, m = regression(spark, d)
    return models.rlda_predict(t, m)


def inverse_sql(n: int, out: str) -> list[str]:
    """SQL columns, each from those before it, of the inverse of the symmetric matrix a00, a10, a11, ... by its Cholesky factor."""
    pairs, columns = [(i, j) for i in range(n) for j in range(i + 1)], []
    for i, j in pairs:
        less = "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
        columns.append(f"sqrt(a{i}{i}{less}) AS l{i}{i}" if i == j else f"(a{i}{j}{less}) / l{j}{j} AS l{i}{j}")
    for i, j in pairs:
        columns.append(f"1 / l{i}{i} AS k{i}{i}" if i == j else f"-({' + '.join(f'l{i}{m} * k{m}{j}' for m in range(j, i))}) / l{i}{i} AS k{i}{j}")
    return columns + [f"{' + '.join(f'k{m}{i} * k{m}{j}' for m in range(i, n))} AS {out}{i}{j}" for i, j in pairs]


#: Three samples, so that the projection keeps all of them and SQL can follow the solution.
RLDA_POINTS, RLDA_BITS, RADIUS, BUDGET = [5, 17, 40], 4, 0.12, 5
low = lambda i, j: f"{max(i, j)}{min(i, j)}"
RLDA = f"""wide AS (SELECT vec_id, label, 1 AS b0, {", ".join(f"2 * ((label >> {i}) & 1) - 1 AS b{i + 1}" for i in range(RLDA_BITS))}, {", ".join(f"CAST(trunc(embedding[{p + 1}]::DOUBLE * 4096) AS BIGINT) AS x{k}" for k, p in enumerate(RLDA_POINTS))} FROM embeddings),
sums AS (SELECT count(*)::DOUBLE AS n, {", ".join(f"sum(b{i} * b{j})::DOUBLE AS a{i}{j}" for i in range(5) for j in range(i + 1))}, {", ".join(f"sum(b{i} * x{s})::DOUBLE AS r{i}{s}" for i in range(5) for s in range(3))}, {", ".join(f"sum(x{s} * x{t})::DOUBLE AS t{s}{t}" for s in range(3) for t in range(s + 1))} FROM wide),
normal AS (SELECT *, {", ".join(inverse_sql(5, "v"))} FROM sums),
fitted AS MATERIALIZED (SELECT n, {", ".join(f"r{i}{s}" for i in range(5) for s in range(3))}, {", ".join(f"t{s}{t}" for s in range(3) for t in range(s + 1))}, {", ".join(f"{' + '.join(f'v{low(i, j)} * r{j}{s}' for j in range(5))} AS c{i}{s}" for i in range(5) for s in range(3))} FROM normal),
spread AS MATERIALIZED (SELECT {", ".join(f"c{i}{s}" for i in range(5) for s in range(3))}, {", ".join(f"(t{s}{t} - ({' + '.join(f'r{i}{s} * c{i}{t}' for i in range(5))})) / n AS a{s}{t}" for s in range(3) for t in range(s + 1))} FROM fitted),
metric AS MATERIALIZED (SELECT *, {", ".join(inverse_sql(3, "h"))} FROM spread),
means AS MATERIALIZED (SELECT c.class, {", ".join(f"c0{s}" + "".join(f" + (2 * ((c.class >> {i}) & 1) - 1) * c{i + 1}{s}" for i in range(RLDA_BITS)) + f" AS m{s}" for s in range(3))}, {", ".join(f"h{s}{t}" for s in range(3) for t in range(s + 1))} FROM metric, (SELECT unnest(range({1 << RLDA_BITS})) AS class) AS c)"""


def quadratic(a: str, b: str, x: str, y: str) -> str:
    """Squared distance of a.x0.. and b.y0.. in the metric h of b."""
    return " + ".join(f"({a}.{x}{s} - {b}.{y}{s}) * ({a}.{x}{t} - {b}.{y}{t}) * {b}.h{low(s, t)}" for s in range(3) for t in range(3))


SCORED = f"{RLDA}, scored AS MATERIALIZED (SELECT w.vec_id, w.label, m.class, {quadratic('w', 'm', 'x', 'm')} AS d FROM wide AS w, means AS m)"
CLUSTERED = f"""apart AS MATERIALIZED (SELECT a.class AS a, b.class AS b, {quadratic("a", "b", "m", "m")} AS d FROM means AS a, means AS b),
grid AS MATERIALIZED (SELECT list(row ORDER BY a) AS g FROM (SELECT a, list(d ORDER BY b) AS row FROM apart GROUP BY a)),
lead(i, found) AS (SELECT 0, [0] UNION ALL SELECT i + 1, CASE WHEN len(list_filter(found, lambda f: g[i + 2][f + 1] <= {RADIUS * RADIUS})) > 0 THEN found ELSE list_append(found, i + 1) END FROM lead, grid WHERE i < {(1 << RLDA_BITS) - 1}),
led AS (SELECT unnest(found) AS class FROM lead WHERE i = {(1 << RLDA_BITS) - 1}),
owned AS MATERIALIZED (SELECT a AS class_id, CASE WHEN a IN (SELECT class FROM led) THEN a ELSE arg_min(b, d) END AS leader FROM apart WHERE b <= a AND b IN (SELECT class FROM led) GROUP BY a)"""


def few_points(spark, d):
    """The regression on three samples, all of which the projection keeps."""
    t, _ = sources.prune(traces_of(spark, d), [RLDA_POINTS])
    return t, shared.rlda_models(shared.rlda_solve(shared.rlda_state(t, RLDA_BITS), 3))[0]


LDA_POINTS = [5, 17, 40]
#: Models of as many dimensions as points: scores follow from distances in the metric of the scatter within classes, which SQL inverts.
LDA_SCORED = f"""wide AS (SELECT vec_id, label, {", ".join(f"CAST(trunc(embedding[{p + 1}]::DOUBLE * 4096) AS BIGINT) AS x{k}" for k, p in enumerate(LDA_POINTS))} FROM embeddings),
classes AS MATERIALIZED (SELECT label AS class, count(*)::DOUBLE AS nc, {", ".join(f"avg(x{s}) AS m{s}" for s in range(3))}, {", ".join(f"sum(x{s} * x{t})::DOUBLE AS q{s}{t}" for s in range(3) for t in range(s + 1))} FROM wide GROUP BY label),
inside AS (SELECT {", ".join(f"sum(q{s}{t} - nc * m{s} * m{t}) / (sum(nc) - count(*)) AS a{s}{t}" for s in range(3) for t in range(s + 1))} FROM classes),
metric AS MATERIALIZED (SELECT *, {", ".join(inverse_sql(3, "h"))} FROM inside),
means AS MATERIALIZED (SELECT class, m0, m1, m2, {", ".join(f"h{s}{t}" for s in range(3) for t in range(s + 1))} FROM classes, metric),
scored AS MATERIALIZED (SELECT w.vec_id, w.label, m.class, {quadratic("w", "m", "x", "m")} AS d FROM wide AS w, means AS m)"""


def kept_model(spark, d):
    """A state of two batches, merged, stored and read again, solved by groups; the models stored and read again too."""
    t = traces_of(spark, d)
    parts = [shared.lda_state(t.where(F.col("trace_id") % 2 == k), 10, [LDA_POINTS]) for k in (0, 1)]
    return t, shared.lda_models(store(shared.lda_solve(store(shared.merge_states(*parts)), 3)))


@query("lda_predict_points", f"WITH {LDA_SCORED} SELECT vec_id AS trace_id, class::INTEGER AS class, round(exp(-0.5 * d) / sum(exp(-0.5 * d)) OVER (PARTITION BY vec_id), 6) AS p FROM scored")
def lda_predict_points(spark, d):
    return models.lda_predict(*kept_model(spark, d)).select("trace_id", F.posexplode("value").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("lda_log2p_points", f"WITH {LDA_SCORED}, p AS (SELECT vec_id, label, class, log2(exp(-0.5 * d) / sum(exp(-0.5 * d)) OVER (PARTITION BY vec_id)) AS l FROM scored) SELECT vec_id AS trace_id, round(l, 5) AS l FROM p WHERE class = label")
def lda_log2p_points(spark, d):
    return models.lda_log2(*kept_model(spark, d)).select("trace_id", F.round("value", 5).alias("l"))


@query("lda_project_norm", f"WITH {LDA_SCORED} SELECT w.vec_id AS trace_id, round({quadratic('w', 'm', 'x', 'zero')}, 5) AS norm FROM wide AS w, metric AS m".replace("m.zero0", "0").replace("m.zero1", "0").replace("m.zero2", "0"))
def lda_project_norm(spark, d):
    """Squared lengths of projections, which do not depend on the directions' signs or order."""
    return models.lda_project(*kept_model(spark, d)).select("trace_id", F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm"))


@query("shared_scatter", f"WITH {PAIRS} SELECT var, i::INTEGER AS i, j::INTEGER AS j, n, sxy::BIGINT AS sxy FROM pairs, (VALUES (0, 8), (1, 5)) AS v(var, size) WHERE j < size")
def shared_scatter(spark, d):
    """Sums of products of two variables' points, gathered from the tiles that both share."""
    state = shared.lda_state(traces_of(spark, d, nv=2), 10, [POINTS, POINTS[:5]])
    tiles = shared.by_variable(state).where("kind = 'tile'")
    flat = tiles.select("var", "n", F.explode(F.arrays_zip(F.flatten(F.transform("i", lambda i: F.transform("j", lambda j: F.struct(i.alias("i"), j.alias("j"))))).alias("at"), F.col("v"))).alias("e"))
    return flat.select("var", F.least("e.at.i", "e.at.j").alias("i"), F.greatest("e.at.i", "e.at.j").alias("j"), "n", F.col("e.v").alias("sxy")).distinct()


@query("rlda_predict_points", f"WITH {SCORED} SELECT vec_id AS trace_id, class::INTEGER AS class, round(exp(-0.5 * d) / sum(exp(-0.5 * d)) OVER (PARTITION BY vec_id), 6) AS p FROM scored")
def rlda_predict_points(spark, d):
    t, m = few_points(spark, d)
    return models.rlda_predict(t, m).select("trace_id", F.posexplode("value").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("rlda_clusters", f"WITH RECURSIVE {RLDA}, {CLUSTERED} SELECT class_id, leader::BIGINT AS leader, count(*) OVER (PARTITION BY leader) AS weight FROM owned")
def rlda_clusters(spark, d):
    """Every class with the leader it joins, and how many join it."""
    rows = few_points(spark, d)[1].cluster_rows(spark, RADIUS)
    return rows.join(rows.groupBy("leader").agg(F.count("*").alias("weight")), "leader")


@query(
    "rlda_information",
    f"""WITH RECURSIVE {SCORED}, {CLUSTERED}, weights AS (SELECT leader, count(*) AS w FROM owned GROUP BY leader),
ranked AS (SELECT s.vec_id, s.class AS leader, s.d, w.w, sum(w.w) OVER (PARTITION BY s.vec_id ORDER BY s.d, s.class) AS upto FROM scored AS s JOIN weights AS w ON s.class = w.leader),
near AS (SELECT r.vec_id, sum(exp(-0.5 * s.d)) AS e FROM ranked AS r JOIN owned AS o USING (leader) JOIN scored AS s ON s.vec_id = r.vec_id AND s.class = o.class_id WHERE r.upto < {BUDGET} GROUP BY r.vec_id),
far AS (SELECT vec_id, sum(w * exp(-0.5 * power(sqrt(d) + {RADIUS}, 2))) AS least, sum(w * exp(-0.5 * power(greatest(0.0, sqrt(d) - {RADIUS}), 2))) AS most FROM ranked WHERE upto >= {BUDGET} GROUP BY vec_id),
bounds AS (SELECT s.vec_id, log2(exp(-0.5 * s.d) / (coalesce(e, 0) + coalesce(most, 0))) AS l, log2(exp(-0.5 * s.d) / (coalesce(e, 0) + coalesce(least, 0))) AS h FROM scored AS s LEFT JOIN near USING (vec_id) LEFT JOIN far USING (vec_id) WHERE s.class = s.label)
SELECT count(*) AS n, round({RLDA_BITS} + avg(l), 6) AS lower, round({RLDA_BITS} + avg(h), 6) AS upper, round(stddev_pop(l), 6) AS deviation_lower, round(stddev_pop(h), 6) AS deviation_upper FROM bounds""",
)
def rlda_information(spark, d):
    t, m = few_points(spark, d)
    found = models.information(t, m.clustered(spark, RADIUS), BUDGET)
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("lower", "upper", "deviation_lower", "deviation_upper")))


WIDE_BITS, WIDE_LABEL = 32, "(vec_id * 2654435761) % 4294967296"
WIDE_COEFS = [[((7 * i + 5 * s) % 11 - 5) * 8.0 for i in range(WIDE_BITS + 1)] for s in range(3)]


@query(
    "rlda_wide_distance",
    f"SELECT vec_id AS trace_id, round({' + '.join(f'power(trunc(embedding[{p + 1}]::DOUBLE * 4096) - ({c[0]} + ' + ' + '.join(f'(2 * ((({WIDE_LABEL}) >> {i}) & 1) - 1) * {w}' for i, w in enumerate(c[1:])) + '), 2)' for p, c in zip(RLDA_POINTS, WIDE_COEFS, strict=True))}, 3) AS distance FROM embeddings",
)
def rlda_wide_distance(spark, d):
    """Labels of 32 bits under a given model: the distance to one class's mean, from four tables of 256 sums."""
    t, _ = sources.prune(traces_of(spark, d), [RLDA_POINTS])
    t = t.withColumn("labels", F.array(F.expr(WIDE_LABEL.replace("vec_id", "trace_id"))))
    model = models.RldaModel(WIDE_BITS, np.eye(3), np.array(WIDE_COEFS))
    return models.rlda_distances(t, model).select("trace_id", F.round("value", 3).alias("distance"))


@query(
    "bits_scalar",
    """WITH k AS (SELECT o_orderkey % 256 AS x, o_custkey % 256 AS y FROM orders)
SELECT xor(x, y)::BIGINT AS x_xor, (x & y)::BIGINT AS x_and, (x | y)::BIGINT AS x_or, xor(255::BIGINT, x)::BIGINT AS x_not, ((x + y) % 256)::BIGINT AS x_add, (((x - y) % 256 + 256) % 256)::BIGINT AS x_sub, ((x * y) % 256)::BIGINT AS x_mul,
bit_count(x::BIGINT)::INTEGER AS weight, (2 * ((x >> 2) & 1) - 1)::BIGINT AS bit3, count(*) AS n FROM k GROUP BY x, y""",
)
def bits_scalar(spark, d):
    k = read(spark, d, "orders").select((F.col("o_orderkey") % 256).alias("x"), (F.col("o_custkey") % 256).alias("y"))
    x, y = F.col("x"), F.col("y")
    g = k.groupBy("x", "y").agg(F.count("*").alias("n"))
    return g.select(x.bitwiseXOR(y).alias("x_xor"), x.bitwiseAND(y).alias("x_and"), x.bitwiseOR(y).alias("x_or"), S.bit_not(x, 256).cast("long").alias("x_not"), S.mod_add(x, y, 256).alias("x_add"), S.mod_sub(x, y, 256).alias("x_sub"), S.mod_mul(x, y, 256).alias("x_mul"), S.hamming_weight(x).alias("weight"), S.signed_bit(x, 3).cast("long").alias("bit3"), "n")


SCORES = "scores AS (SELECT user_id, list(total ORDER BY event_type) AS v FROM (SELECT user_id, event_type, sum(value) / 100.0 AS total FROM events GROUP BY ALL) GROUP BY user_id HAVING count(*) = 5)"


def score_lists(spark, d):
    g = read(spark, d, "events").groupBy("user_id", "event_type").agg((F.sum("value") / 100).alias("total"))
    lists = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "total"))).alias("x"))  # one entry for each event type
    return lists.where(F.size("x") == 5).select("user_id", F.transform("x", lambda s: s["total"]).alias("v"))


@query("softmax_scores", f"WITH {SCORES}, e AS (SELECT user_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM scores) SELECT user_id, " + ", ".join(f"round(e[{i + 1}] / list_sum(e), 6) AS p{i}" for i in range(5)) + " FROM e")
def softmax_scores(spark, d):
    return score_lists(spark, d).select("user_id", S.softmax(F.col("v")).alias("p")).select("user_id", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(5)))


@query("log2_softmax", f"WITH {SCORES} SELECT user_id, round((v[user_id % 5 + 1] - list_max(v)) * 1.4426950408889634 - log2(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS l FROM scores")
def log2_softmax(spark, d):
    return score_lists(spark, d).select("user_id", F.round(S.log2_softmax_at(F.col("v"), (F.col("user_id") % 5).cast("int")), 6).alias("l"))


NC = 16
BELIEFS = f"""raw AS (SELECT o_custkey % 8 AS e, o_orderkey % {NC} AS c, (o_orderkey // 7) % {NC} AS c2, o_totalprice::BIGINT % {NC} AS c3 FROM orders),
grid AS (SELECT e, c FROM (SELECT unnest(range(8)) AS e), (SELECT unnest(range({NC})) AS c)),
bx AS (SELECT g.e, g.c, (count(r.e) + 1.0) / (sum(count(r.e) + 1.0) OVER (PARTITION BY g.e)) AS p FROM grid g LEFT JOIN raw r ON r.e = g.e AND r.c = g.c GROUP BY g.e, g.c),
by_ AS (SELECT g.e, g.c, (count(r.e) + 1.0) / (sum(count(r.e) + 1.0) OVER (PARTITION BY g.e)) AS p FROM grid g LEFT JOIN raw r ON r.e = g.e AND r.c2 = g.c GROUP BY g.e, g.c)"""
#: Name -> (property, tables, SQL of w from x and y)
GRAPHS = {
    "bp_xor": ("PROPERTY w = x ^ y", "", "xor(x.c, y.c)"),
    "bp_and": ("PROPERTY w = x & y", "", "(x.c & y.c)"),
    "bp_or": ("PROPERTY w = x | y", "", "(x.c | y.c)"),
    "bp_not": ("PROPERTY w = !x", "", f"xor({NC - 1}::BIGINT, x.c)"),
    "bp_add": ("PROPERTY w = x + y", "", f"((x.c + y.c) % {NC})"),
    "bp_sub": ("PROPERTY w = x - y", "", f"((x.c - y.c + {NC}) % {NC})"),
    "bp_mul": ("PROPERTY w = x * y", "", f"((x.c * y.c) % {NC})"),
    "bp_lookup": ("PROPERTY w = t[x]", f"TABLE t = [{', '.join(str((5 * i * i + 3) % NC) for i in range(NC))}]", f"((5 * x.c * x.c + 3) % {NC})"),
    "bp_generic": ("PROPERTY g(w, x, y)", "GENERIC SINGLE g", f"((3 * x.c + y.c) % {NC})"),
}


def beliefs(spark, d):
    raw = read(spark, d, "orders").select((F.col("o_custkey") % 8).alias("e"), (F.col("o_orderkey") % NC).alias("x"), (F.floor(F.col("o_orderkey") / 7) % NC).alias("y"))
    out = None
    for node in ("x", "y"):
        counts = raw.groupBy("e", F.col(node).alias("c")).agg(F.count("*").alias("n"))
        lists = counts.groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))  # one entry for each class
        p = S.normalised(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(NC - 1).cast("long")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)) + F.lit(1.0)))
        rows = lists.select(F.col("e").alias("exec"), F.lit(node).alias("node"), p.alias("probs"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bp_query(name: str):
    prop, extra, _ = GRAPHS[name]
    unary = name in ("bp_not", "bp_lookup")

    def run(spark, d):
        text = "\n".join([f"NC {NC}", "VAR MULTI w", "VAR MULTI x", *([] if unary else ["VAR MULTI y"]), extra, prop])
        generic = {"g": [[(3 * x + y) % NC, x, y] for x in range(NC) for y in range(NC)]} if name == "bp_generic" else None
        given = beliefs(spark, d)
        given = given.where("node = 'x'") if unary else given
        found = infer(parse(text), given, ["w"], generic=generic)
        return found.select("exec", F.posexplode("probs").alias("class", "p")).withColumn("p", F.round("p", 6))

    sql = f"""WITH {BELIEFS}, w AS (SELECT x.e, {GRAPHS[name][2]} AS c, sum(x.p{"" if unary else " * y.p"}) AS p FROM bx x {"" if unary else "JOIN by_ y ON x.e = y.e"} GROUP BY ALL)
SELECT g.e AS exec, g.c::INTEGER AS class, round(coalesce(w.p, 0), 6) AS p FROM grid g LEFT JOIN w ON g.e = w.e AND g.c = w.c"""
    query(name, sql)(run)


for name in GRAPHS:
    bp_query(name)


@query(
    "bp_generic_multi",
    f"""WITH {BELIEFS}, w AS (SELECT x.e, (3 * x.c + y.c + x.e) % {NC} AS c, sum(x.p * y.p) AS p FROM bx x JOIN by_ y ON x.e = y.e GROUP BY ALL)
SELECT g.e AS exec, g.c::INTEGER AS class, round(coalesce(w.p, 0), 6) AS p FROM grid g LEFT JOIN w ON g.e = w.e AND g.c = w.c""",
)
def bp_generic_multi(spark, d):
    """A generic factor with an array of its own for each execution."""
    g = parse(f"NC {NC}\nVAR MULTI w\nVAR MULTI x\nVAR MULTI y\nGENERIC MULTI g\nPROPERTY g(w, x, y)")
    own = {e: [[(3 * x + y + e) % NC, x, y] for x in range(NC) for y in range(NC)] for e in range(8)}
    found = infer(g, beliefs(spark, d), ["w"], generic={"g": own})
    return found.select("exec", F.posexplode("probs").alias("class", "p")).withColumn("p", F.round("p", 6))


@query(
    "bp_acyclic_key",
    f"""WITH {BELIEFS}, m AS (SELECT x.e, xor(x.c, y.c) AS k, sum(x.p * y.p) AS p FROM bx x JOIN by_ y ON x.e = y.e GROUP BY ALL), l AS (SELECT k, sum(ln(p)) AS l FROM m GROUP BY k)
SELECT k::INTEGER AS class, round(exp(l - (SELECT max(l) FROM l)) / (SELECT sum(exp(l - (SELECT max(l) FROM l))) FROM l), 6) AS p FROM l""",
)
def bp_acyclic_key(spark, d):
    """A single key under x = k ^ y in every execution."""
    g = parse(f"NC {NC}\nVAR SINGLE k\nVAR MULTI x\nVAR MULTI y\nPROPERTY x = k ^ y")
    return infer(g, beliefs(spark, d), ["k"]).select(F.posexplode("probs").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("bp_loopy")
def bp_loopy(spark, d):
    g = parse(f"NC {NC}\nVAR MULTI w\nVAR MULTI x\nVAR MULTI y\nVAR MULTI z\nPROPERTY w = x ^ y\nPROPERTY z = w + x")
    return infer(g, beliefs(spark, d), ["w", "z"], iterations=6).withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))


@query("fg_sanity", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS broken_sum, count(*) FILTER (o_orderkey % 5 = 0) AS broken_logic FROM orders")
def fg_sanity(spark, d):
    """Rows that break a factor of a parsed graph: every seventh breaks the sum, every fifth the logic."""
    g = parse(f"NC {NC}\nVAR MULTI x\nVAR MULTI y\nVAR MULTI s\nVAR MULTI l\nVAR MULTI v\nPUB MULTI p\nTABLE t = [{', '.join(str((5 * i + 3) % NC) for i in range(NC))}]\nPROPERTY a: s = x + y + p\nPROPERTY b: l = !x & y\nPROPERTY c: y = t[v]")
    o = read(spark, d, "orders").select((F.col("o_orderkey") % NC).alias("x"), (F.col("o_custkey") % NC).alias("p"), "o_orderkey")
    o = o.withColumn("y", (F.col("p") * 5 + 3) % NC).withColumn("s", (F.col("x") + F.col("y") + F.col("p") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)) % NC)
    o = o.withColumn("l", (F.lit(NC - 1) - F.col("x")).bitwiseAND(F.col("y")).bitwiseXOR(F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(0)))
    return checked_rows(g, o.withColumn("v", F.col("p"))).agg(F.count("*").alias("n"), F.count_if(~F.col("a")).alias("broken_sum"), F.count_if(~F.col("b") | ~F.col("c")).alias("broken_logic"))


COSTS = """counts AS (SELECT 0 AS problem_id, 0 AS subkey, c_nationkey % 8 AS value, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 0, 1, length(c_mktsegment) % 8, count(*) FROM customer GROUP BY ALL
UNION ALL SELECT 0, 2, c_custkey % 7, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY ALL),
costs AS (SELECT problem_id, subkey, value, round(-ln(n / sum(n) OVER (PARTITION BY problem_id, subkey)), 6) AS cost FROM counts),
truth AS (SELECT problem_id, subkey, max(value) AS value FROM costs GROUP BY ALL)"""
HIST_BINS = 64


def costs_of(spark, d):
    c = read(spark, d, "customer")
    part = lambda k, v, rows: rows.groupBy(v.cast("long").alias("value")).agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("problem_id"), F.lit(k).alias("subkey"), "value", "n")
    counts = part(0, F.col("c_nationkey") % 8, c).unionByName(part(1, F.length("c_mktsegment") % 8, c)).unionByName(part(2, F.col("c_custkey") % 7, c.where("c_acctbal > 0")))
    total = F.sum("n").over(Window.partitionBy("problem_id", "subkey"))
    costs = counts.select("problem_id", "subkey", "value", F.round(-F.log(F.col("n") / total), 6).alias("cost"))
    return costs, costs.groupBy("problem_id", "subkey").agg(F.max("value").alias("value"))


@query(
    "rank_naive",
    f"""WITH {COSTS}, c0 AS (SELECT * FROM costs WHERE subkey = 0), c1 AS (SELECT * FROM costs WHERE subkey = 1), c2 AS (SELECT * FROM costs WHERE subkey = 2),
k AS (SELECT (SELECT cost FROM c0 JOIN truth USING (subkey, value)) + (SELECT cost FROM c1 JOIN truth USING (subkey, value)) + (SELECT cost FROM c2 JOIN truth USING (subkey, value)) AS key_cost)
SELECT 0 AS problem_id, count(*) FILTER (c0.cost + c1.cost + c2.cost <= key_cost) AS rank FROM c0, c1, c2, k""",
)
def rank_naive(spark, d):
    costs, truth = costs_of(spark, d)
    rank.checked(costs, truth)
    return rank.naive_rank(costs, truth, [0, 1, 2])


RANK_SQL = f"""WITH {COSTS}, low AS (SELECT subkey, min(cost) AS low FROM costs GROUP BY subkey), sh AS (SELECT subkey, value, cost - low AS cost FROM costs JOIN low USING (subkey)),
k AS (SELECT (SELECT cost FROM sh JOIN truth USING (subkey, value) WHERE subkey = 0) + (SELECT cost FROM sh JOIN truth USING (subkey, value) WHERE subkey = 1) + (SELECT cost FROM sh JOIN truth USING (subkey, value) WHERE subkey = 2) AS key_cost),
bs AS (SELECT key_cost / {HIST_BINS - 3}.0 AS size, key_cost FROM k), b AS (SELECT subkey, floor(cost / size + 0.5) AS bin FROM sh, bs WHERE floor(cost / size + 0.5) < {HIST_BINS}),
s AS (SELECT b0.bin + b1.bin + b2.bin AS bin FROM b b0, b b1, b b2 WHERE b0.subkey = 0 AND b1.subkey = 1 AND b2.subkey = 2 AND b0.bin + b1.bin < {HIST_BINS} AND b0.bin + b1.bin + b2.bin < {HIST_BINS}),
m AS (SELECT greatest(0, least({HIST_BINS - 1}, ceil(key_cost / size - 1.5))) AS lo, greatest(0, least({HIST_BINS - 1}, floor(key_cost / size + 1.5))) AS hi, least({HIST_BINS - 1}, floor(key_cost / size + 0.5)) AS mid FROM bs),
r AS (SELECT 1.0 + count(*) FILTER (bin < lo) AS least, count(*) FILTER (bin < mid) + ceil(count(*) FILTER (bin = mid) / 2.0) AS guess, count(*) FILTER (bin <= hi)::DOUBLE AS most FROM s, m)
SELECT 0 AS problem_id, least::DOUBLE AS least, greatest(least, guess)::DOUBLE AS estimate, greatest(least, most)::DOUBLE AS greatest FROM r"""


@query("rank_hist", RANK_SQL)
def rank_hist(spark, d):
    return rank.histogram_rank(*costs_of(spark, d), HIST_BINS)


@query("rank_exact", RANK_SQL)
def rank_exact(spark, d):
    return rank.histogram_rank(*costs_of(spark, d), HIST_BINS, "histbignum")


@query("rank_relational", RANK_SQL)
def rank_relational(spark, d):
    return rank.relational_histogram_rank(*costs_of(spark, d), [0, 1, 2], HIST_BINS)


@query("rank_partitioned", RANK_SQL)
def rank_partitioned(spark, d):
    """Histograms convolved in ranges of sixteen bins."""
    return rank.partitioned_histogram_rank(*costs_of(spark, d), [0, 1, 2], HIST_BINS, width=16)


MERGED = 64


@query(
    "rank_auto_merge",
    f"""WITH {COSTS}, sizes AS (SELECT subkey, max(value) + 1 AS size FROM costs GROUP BY subkey),
s AS (SELECT max(size) FILTER (subkey = 0) AS s0, max(size) FILTER (subkey = 1) AS s1, max(size) FILTER (subkey = 2) AS s2 FROM sizes),
g AS (SELECT s0, s1, s2, CASE WHEN s0 * s1 <= {MERGED} THEN 0 ELSE 1 END AS g1, CASE WHEN s0 * s1 <= {MERGED} THEN CASE WHEN s0 * s1 * s2 <= {MERGED} THEN 0 ELSE 1 END ELSE CASE WHEN s1 * s2 <= {MERGED} THEN 1 ELSE 2 END END AS g2 FROM s),
c0 AS (SELECT value, cost, value = (SELECT value FROM truth WHERE subkey = 0) AS t FROM costs WHERE subkey = 0), c1 AS (SELECT value, cost, value = (SELECT value FROM truth WHERE subkey = 1) AS t FROM costs WHERE subkey = 1),
c2 AS (SELECT value, cost, value = (SELECT value FROM truth WHERE subkey = 2) AS t FROM costs WHERE subkey = 2),
m AS (SELECT 0 AS grp, c0.value, c0.cost, c0.t FROM c0, g WHERE g1 <> 0 UNION ALL SELECT 0, c0.value * s1 + c1.value, c0.cost + c1.cost, c0.t AND c1.t FROM c0, c1, g WHERE g1 = 0 AND g2 <> 0
  UNION ALL SELECT 0, (c0.value * s1 + c1.value) * s2 + c2.value, c0.cost + c1.cost + c2.cost, c0.t AND c1.t AND c2.t FROM c0, c1, c2, g WHERE g2 = 0
  UNION ALL SELECT 1, c1.value, c1.cost, c1.t FROM c1, g WHERE g1 = 1 AND g2 = 2 UNION ALL SELECT 1, c1.value * s2 + c2.value, c1.cost + c2.cost, c1.t AND c2.t FROM c1, c2, g WHERE g1 = 1 AND g2 = 1
  UNION ALL SELECT g2, c2.value, c2.cost, c2.t FROM c2, g WHERE g2 = 2 OR g1 = 0 AND g2 = 1)
SELECT 0 AS problem_id, grp AS subkey, value::BIGINT AS value, round(cost, 5) AS cost, t AS is_true FROM m""",
)
def rank_auto_merge(spark, d):
    """Ragged subkeys merged up to 64 combinations."""
    costs, truth = rank.auto_merge(*costs_of(spark, d), MERGED)
    own = costs.join(truth.withColumn("is_true", F.lit(True)), ["problem_id", "subkey", "value"], "left")
    return own.select("problem_id", "subkey", "value", F.round("cost", 5).alias("cost"), F.coalesce("is_true", F.lit(False)).alias("is_true"))


@query("rank_merged_naive", ORACLE["rank_naive"])
def rank_merged_naive(spark, d):
    costs, truth = rank.auto_merge(*costs_of(spark, d), MERGED)
    return rank.naive_rank(costs, truth, [r.subkey for r in truth.select("subkey").distinct().orderBy("subkey").collect()])


WHOLE_SQL = f"""WITH {COSTS}, c AS (SELECT c0.cost + c1.cost + c2.cost AS cost, t0.value IS NOT NULL AND t1.value IS NOT NULL AND t2.value IS NOT NULL AS t FROM costs AS c0, costs AS c1, costs AS c2
  LEFT JOIN truth AS t0 ON t0.subkey = 0 AND t0.value = c0.value LEFT JOIN truth AS t1 ON t1.subkey = 1 AND t1.value = c1.value LEFT JOIN truth AS t2 ON t2.subkey = 2 AND t2.value = c2.value
  WHERE c0.subkey = 0 AND c1.subkey = 1 AND c2.subkey = 2),
k AS (SELECT max(cost) FILTER (t) - min(cost) AS key_cost, min(cost) AS low FROM c),
n AS (SELECT n, key_cost, low, key_cost / (n - 2) AS size FROM k, (SELECT (16 * power(2, i))::BIGINT AS n FROM range(23) AS x(i))),
m AS (SELECT *, greatest(0, least(n - 1, ceil(key_cost / size - 0.5))) AS lo, greatest(0, least(n - 1, floor(key_cost / size + 0.5))) AS mid FROM n),
b AS (SELECT n, lo, mid, floor((cost - low) / size + 0.5) AS bin FROM c, m),
r AS (SELECT n, 1.0 + count(*) FILTER (bin < lo) AS least, count(*) FILTER (bin < mid) + ceil(count(*) FILTER (bin = mid) / 2.0) AS guess, count(*) FILTER (bin <= mid)::DOUBLE AS most FROM b GROUP BY n),
a AS (SELECT n, 0 AS problem_id, least::DOUBLE AS least, greatest(least, guess)::DOUBLE AS estimate, greatest(least, most)::DOUBLE AS greatest FROM r)"""


@query("rank_scaled", f"{WHOLE_SQL} SELECT * EXCLUDE (n) FROM a WHERE n = {HIST_BINS}")
def rank_scaled(spark, d):
    """All subkeys merged, counts from below and above."""
    return rank.histogram_rank(*costs_of(spark, d), HIST_BINS, "scaledhist", rank.MERGE_TO)


@query("rank_scaled_convolved", RANK_SQL)
def rank_scaled_convolved(spark, d):
    """Subkeys convolved in ranges of sixteen bins, counts from below and above."""
    return rank.histogram_rank(*costs_of(spark, d), HIST_BINS, "scaledhist", width=16)


@query("rank_accuracy", f"{WHOLE_SQL} SELECT * EXCLUDE (n) FROM a WHERE log2(greatest) - log2(least) <= 0.5 OR n = {rank.MAX_BINS} ORDER BY n LIMIT 1")
def rank_accuracy(spark, d):
    return rank.accuracy_rank(*costs_of(spark, d), 0.5)


@query("simulated_snr")
def simulated_snr(spark, d):
    """A simulated trace for each order."""
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id"))
    return metrics.snr(stats.class_state(sources.leaking(ids, ns=8)))


def embeddings_stream(spark, d):
    """A table is a file here and a folder elsewhere; as a stream both are files that a pattern finds."""
    schema = read(spark, d, "embeddings").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/embeddings.parquet*")


@query("stream_moments_keyed", ttest_sql(GROUPED, 2))
def stream_moments_keyed(spark, d):
    """Moments by group and sample kept by a stream, one row a key, and the second-order statistic from them."""
    base = scratch_dir(spark)
    rows = embeddings_stream(spark, d).select((F.col("label") % 2).cast("int").alias("grp"), F.posexplode("embedding").alias("sample", "e")).select("grp", "sample", (F.col("e").cast("double") * 4096).cast("long").cast("double").alias("x"))
    stream_moments(rows, 4, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return metrics.ttest(read_moments(spark, f"{base}/state"), 2).where(F.col("order") == 2).withColumn("t", F.round("t", 5))


@query("stream_snr_equals_batch", f"WITH {SNR} SELECT var, sample::INTEGER AS sample, snr FROM snr")
def stream_snr_equals_batch(spark, d):
    """Embeddings replayed as a stream of micro-batches into the state table, then read out."""
    base = scratch_dir(spark)
    labels = embeddings_stream(spark, d).select(F.col("vec_id").alias("trace_id"), F.transform("embedding", lambda x: (x.cast("double") * 4096).cast("long")).alias("samples"), F.array("label").alias("labels"))
    stream_class_state(labels, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return metrics.snr(read_class_state(spark, f"{base}/state")).withColumn("snr", F.round("snr", 6))


@query("events_windowed", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS s, round(sum(value * value), 6) AS ss FROM events GROUP BY ALL")
def events_windowed(spark, d):
    return windowed(read(spark, d, "events")).select("start", "event_type", "n", F.round("s", 6).alias("s"), F.round("ss", 6).alias("ss"))


@query("key_rank", f"WITH {BELIEFS} SELECT e AS exec, c::INTEGER AS class, rank() OVER (PARTITION BY e ORDER BY round(p, 9) DESC)::INTEGER AS rank FROM bx")
def key_rank(spark, d):
    """The rank of each class in each execution's distribution."""
    return rank.class_ranks(beliefs(spark, d).where("node = 'x'"))


@query("cumulative_histogram", "WITH h AS (SELECT floor(l_quantity / 5)::BIGINT AS bin, count(*) AS c FROM lineitem GROUP BY 1) SELECT bin, c, sum(c) OVER (ORDER BY bin)::BIGINT AS up_to FROM h")
def cumulative_histogram(spark, d):
    h = read(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("c"))
    return rank.cumulative(h)


@query(
    "distribution_functions",
    f"""WITH {BELIEFS} SELECT g.e AS exec, g.c::INTEGER AS class, round(x.p, 6) AS xor5, round(a.p, 6) AS add3, round(n.p, 6) AS neg, round(power(b.p, 1) / sum(b.p) OVER (PARTITION BY g.e), 6) AS norm
FROM grid g JOIN bx b ON b.e = g.e AND b.c = g.c JOIN bx x ON x.e = g.e AND x.c = xor(g.c, 5) JOIN bx a ON a.e = g.e AND a.c = (g.c - 3 + {NC}) % {NC} JOIN bx n ON n.e = g.e AND n.c = ({NC} - g.c) % {NC}""",
)
def distribution_functions(spark, d):
    """Distributions of x ^ 5, x + 3 and -x, and the regularised one."""
    b = beliefs(spark, d).where("node = 'x'")
    lists = b.select("exec", S.xor_constant(F.col("probs"), F.lit(5), NC).alias("x"), S.add_constant(F.col("probs"), F.lit(3), NC).alias("a"), S.negated(F.col("probs"), NC).alias("n"), S.regularised(F.col("probs")).alias("r"))
    return lists.select("exec", F.posexplode(F.arrays_zip("x", "a", "n", "r")).alias("class", "v")).select("exec", "class", *(F.round(F.col(f"v.{c}"), 6).alias(o) for c, o in (("x", "xor5"), ("a", "add3"), ("n", "neg"), ("r", "norm"))))


#: Factor, operand, place, flipped, public, multi
EDGES = [("a", "x", 0, False, False, True), ("a", "k", 1, False, False, False), ("a", "p", 2, False, True, True), ("b", "y", 0, False, False, True), ("b", "x", 1, False, False, True), ("c", "z", 0, True, False, True), ("c", "x", 1, False, False, True), ("c", "y", 2, True, False, True)]


@query(
    "factor_graph_edges",
    f"""WITH n AS (SELECT count(DISTINCT o_custkey) AS execs FROM orders), e(factor, operand, place, flipped, public, multi) AS (VALUES {", ".join(str(e) for e in EDGES)})
SELECT factor, operand, place::INTEGER AS place, flipped, public, CASE WHEN public THEN 0 WHEN multi THEN execs ELSE 1 END AS messages, execs > 1 AS cyclic FROM e, n""",
)
def factor_graph_edges(spark, d):
    """The edges of a parsed graph, how many messages each has with an execution for every customer, and whether there is a cycle."""
    g = parse(f"NC {NC}\nVAR SINGLE k\nVAR MULTI x\nVAR MULTI y\nVAR MULTI z\nPUB MULTI p\nTABLE t = [{', '.join(str(NC - 1 - i) for i in range(NC))}]\nPROPERTY a: x = k ^ p\nPROPERTY b: y = t[x]\nPROPERTY c: z = !x | y")
    rows = [(f.name, o.name, i, o.flip, o.name in g.publics, bool(g.variables.get(o.name)), g.is_cyclic(1), g.is_cyclic(2)) for f in g.factors.values() for i, o in enumerate(f.operands)]
    edges = spark.createDataFrame(rows, "factor string, operand string, place int, flipped boolean, public boolean, multi boolean, once boolean, often boolean")
    execs = read(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("execs"))
    messages = F.when(F.col("public"), F.lit(0)).when(F.col("multi"), F.col("execs")).otherwise(F.lit(1)).cast("long")
    return edges.crossJoin(F.broadcast(execs)).select("factor", "operand", "place", "flipped", "public", messages.alias("messages"), F.when(F.col("execs") > 1, F.col("often")).otherwise(F.col("once")).alias("cyclic"))  # one row


@query(
    "bp_single_public",
    f"""WITH {BELIEFS}, l AS (SELECT g.c AS k, sum(ln(greatest(bx.p, 1e-40))) AS l FROM grid g JOIN bx ON bx.e = g.e AND bx.c = xor(xor(g.c, g.e % {NC}), 9) GROUP BY g.c)
SELECT k::INTEGER AS class, round(exp(l - (SELECT max(l) FROM l)) / (SELECT sum(exp(l - (SELECT max(l) FROM l))) FROM l), 6) AS p FROM l""",
)
def bp_single_public(spark, d):
    """A single key under x = k ^ p ^ c with public p in every execution and one public c."""
    g = parse(f"NC {NC}\nVAR SINGLE k\nVAR MULTI x\nPUB MULTI p\nPUB SINGLE c\nPROPERTY x = k ^ p ^ c")
    given = beliefs(spark, d).where("node = 'x'")
    shown = given.select("exec", F.lit("p").alias("node"), (F.col("exec") % NC).cast("int").alias("value")).unionByName(spark.createDataFrame([(None, "c", 9)], "exec long, node string, value int"))
    return infer(g, given, ["k"], publics=shown).select(F.posexplode("probs").alias("class", "p")).withColumn("p", F.round("p", 6))
