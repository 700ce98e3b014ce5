"""Mixing sources to target weights by iterative proportional fitting, by DataFrame functions alone.

Documents fall into cells (source, language, topic). The cells' token weights are raked: in turn,
the weights of each source, language and topic are scaled to that marginal's target share, a fixed
number of rounds. A document is then kept with its cell's probability: the raked share of the token
budget over the tokens that the cell has. Where that exceeds 1 the whole cell is kept, and what it
cannot give is asked of the other cells in proportion, again and again, so that the expected tokens
still meet the budget. The draw is a hash of the id, so it repeats.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, store

DIMENSIONS = ("source", "lang", "topic")
#: Topic -> what a text of it contains, the first that fits.
TOPICS = (("table", " | "), ("contact", "@"), ("legal", "icense"))
WORD = "[^ \t\n\r]+"
#: Up to so many cells are raked in one task, where windows need no exchange; of more, each round is a plan of its own.
ONE_TASK = 50_000


@dataclass(frozen=True)
class Mix:
    """Target shares are the corpus's own to the power ``temper`` (below 1 evens them out), unless ``targets`` names them; ``budget`` is the share of all tokens to keep."""

    temper: float = 0.7
    budget: float = 0.8
    rounds: int = 10
    fills: int = 8
    targets: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()


def topic_of(text: Column) -> Column:
    topic = F.when(F.length(text) < 500, "short").otherwise("prose")
    for name, part in reversed(TOPICS):
        topic = F.when(F.contains(text, F.lit(part)), name).otherwise(topic)
    return topic


def weighed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, tokens): words and an end mark are counted; nulls are the empty category."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    category = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), category(source_col).alias("source"), category(lang_col).alias("lang"), topic_of(text).alias("topic"), (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("tokens"))


def target_shares(cells: DataFrame, dimension: str, mix: Mix) -> DataFrame:
    """(dimension, target): shares that sum to 1. Categories that named targets leave out get none."""
    named = dict(mix.targets).get(dimension)
    if named:
        total = sum(share for _, share in named)
        return cells.sparkSession.sql("VALUES " + ", ".join(f"('{str(k).replace(chr(39), chr(39) * 2)}', {float(v) / total}D)" for k, v in named)).toDF(dimension, "target")
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).withColumn("t", F.pow(F.col("t").cast("double"), F.lit(mix.temper)))
    return own.crossJoin(F.broadcast(own.agg(F.sum("t").alias("all_t")))).select(dimension, (F.col("t") / F.col("all_t")).alias("target"))  # one row


def raked(cells: DataFrame, mix: Mix) -> DataFrame:
    """Cells with (share, probability). ``cells`` has the dimensions and tokens, one row each.

    All rounds in one plan with exchanges would cost the driver memory by rounds and partitions.
    """
    scratch, few = Scratch(cells.sparkSession), cells.count() <= ONE_TASK
    cells = cells.coalesce(1) if few else cells
    fitted = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        fitted = fitted.join(target_shares(cells, d, mix).withColumnRenamed("target", f"to_{d}"), d, "left").fillna(0.0, [f"to_{d}"])
    fitted = scratch.last(fitted)
    fitted = fitted.coalesce(1) if few else fitted
    for _ in range(mix.rounds):
        for d in DIMENSIONS:
            fitted = fitted.withColumn("w", F.coalesce(F.col("w") * F.try_divide(F.col(f"to_{d}"), F.sum("w").over(Window.partitionBy(d))), F.lit(0.0)))
        if not few:
            fitted = scratch.last(fitted)
    fitted = scratch.last(fitted.select(*DIMENSIONS, "tokens", "w"))
    sums = fitted.agg(F.sum("tokens").alias("tokens"), F.sum("w").alias("w")).first()
    wanted = mix.budget * float(sums.tokens or 0)
    share = F.col("w") / sums.w if sums.w else F.lit(0.0)
    fitted = fitted.withColumn("share", share).withColumn("asked", wanted * F.col("share") / F.col("tokens"))
    factor = 1.0
    for _ in range(mix.fills):  # two sums at a time reach the driver
        p = F.col("asked") * factor
        r = fitted.agg(F.sum(F.when(p < 1, p * F.col("tokens")).otherwise(0.0)).alias("free"), F.sum(F.when(p < 1, 0).otherwise(F.col("tokens"))).alias("whole")).first()
        more = max(1.0, (wanted - r.whole) / r.free) if r.free else 1.0
        factor *= more
        if more == 1.0:
            break
    return fitted.select(*DIMENSIONS, "tokens", "share", F.least(F.lit(1.0), F.col("asked") * factor).alias("probability"))


def marginal_errors(cells: DataFrame, mix: Mix, column: str = "share") -> DataFrame:
    """(dimension, category, target, got): each marginal's target share and what the cells' ``column`` sums to."""
    out = []
    for d in DIMENSIONS:
        got = cells.groupBy(d).agg(F.sum(column).alias("got")).join(target_shares(cells, d, mix), d, "left")
        out.append(got.select(F.lit(d).alias("dimension"), F.col(d).alias("category"), F.coalesce("target", F.lit(0.0)).alias("target"), "got"))
    return reduce(DataFrame.unionAll, out)


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from the id's hash."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_documents(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every row.

    Null sources and languages are the empty category, null texts count one token. Rows that share
    an id are kept or left together if they share a cell; null ids draw as one. Very long texts
    count whole. ``probability`` is rounded, the draw is not. Other columns are not read; an empty
    table gives an empty result.
    """
    mix = mix or Mix()
    rows = weighed(df, id_col, text_col, source_col, lang_col)
    cells = store(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    fitted = store(raked(cells, mix).select(*DIMENSIONS, "probability"))
    return rows.join(fitted, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"), (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample_documents(df: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of ``df`` (columns of documents, others stay) that the mix keeps; odd rows as in ``mix_documents``."""
    mix = mix or Mix()
    cells = store(weighed(df).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    fitted = store(raked(cells, mix).select(F.struct(*DIMENSIONS).alias("cell"), "probability"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cell = F.struct(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic"))
    met = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), cell.alias("cell"), draw(F.col("doc_id")).alias("draw")).join(fitted, "cell")
    return met.where(F.col("draw") < F.col("probability")).select(*(F.col("row")[c].alias(c) for c in df.columns))


def oracle_sql(mix: Mix | None = None) -> str:
    """The same in DuckDB's SQL over ``documents``, for tempered targets."""
    mix = mix or Mix()
    topic = "CASE " + " ".join(f"WHEN contains(x, '{part}') THEN '{name}'" for name, part in TOPICS) + " WHEN length(x) < 500 THEN 'short' ELSE 'prose' END"
    parts = [f"""rows AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(x, '[^ \\t\\n\\r]+')) + 1 AS tokens
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL)"""]
    for d in DIMENSIONS:
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(t, {mix.temper}) / sum(pow(t, {mix.temper})) OVER () AS target FROM (SELECT {d}, sum(tokens) AS t FROM cells GROUP BY {d}))")
    parts.append("f0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells)")
    k = 0
    for _ in range(mix.rounds):
        for d in DIMENSIONS:
            parts.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (w * target / sum(w) OVER (PARTITION BY f.{d}) AS w) FROM f{k} AS f JOIN t_{d} USING ({d}))")
            k += 1
    parts.append(f"p0 AS MATERIALIZED (SELECT source, lang, topic, tokens, {mix.budget} * sum(tokens) OVER () AS wanted, {mix.budget} * sum(tokens) OVER () * w / sum(w) OVER () / tokens AS q, 1.0::DOUBLE AS f FROM f{k})")
    for k in range(mix.fills):
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT c.* REPLACE (f * greatest(1.0, coalesce((wanted - whole) / nullif(free, 0), 1.0)) AS f) FROM p{k} AS c, (SELECT sum(CASE WHEN q * f < 1 THEN q * f * tokens ELSE 0 END) AS free, sum(CASE WHEN q * f < 1 THEN 0 ELSE tokens END) AS whole FROM p{k}))")
    parts.append(f"fitted AS (SELECT source, lang, topic, least(1.0, q * f) AS p FROM p{mix.fills})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(p, 6) AS probability, ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT / 4294967296.0 < p AS kept
FROM rows JOIN fitted USING (source, lang, topic)"""
