"""URL filters: explicit rules first, then a path-template tree per host, by DataFrame functions alone.

Template: each run of digits in a path is a wildcard. The segments of each host's paths are then
walked level by level, at any depth: where the children of a node have fewer than ``CHILD_SUPPORT``
urls each on average (and are ``MANY`` at least), their names say nothing and become one wildcard; the
statistic does not depend on the size of the crawl. Nodes with fewer than ``MANY`` shapes below them
can have no wildcard any more and keep what follows as it stands, so there are as many rounds as
segments that ``MANY`` shapes of a host share. Each round's rows are written and read again.

Labels are the verdicts of the rules (urls that a rule fits). Templates with one parent are siblings.
Each is tested against all others together (two-proportion test at ``SIMILAR`` standard deviations):
those that do not differ are one branch, those with a greater share of blocked labels and those with a
smaller one are two more, and each of the three is split so once again. A branch's counts are pooled. A
template is rejected when its branch has ``SUPPORT`` labels at least and its smoothed purity reaches
``REJECT``.

The tree is built from urls aggregated to (host, template) counts, and siblings meet their totals in
plain equi-joins, without windows, so a host with a third of all urls costs what its templates cost and
Spark can split it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

CHILD_SUPPORT, MANY = 3.0, 3
#: Levels that the SQL for DuckDB follows; the walk itself has no limit.
SQL_LEVELS = 8
SIMILAR = 1.0
SUPPORT = 5
REJECT = 0.8
PRIOR, STRENGTH = 0.5, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix). Configuration, a short list.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where the url is null or has no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains, and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later, longer ones stand outside
        own_host, own_path = split_rule(text)
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def walked(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, n_block, n_allow, depth, parent, template) of leaves (host, shape, urls, n_block, n_allow)."""
    rows, level, done = leaves.withColumn("s", F.split(F.regexp_replace("shape", "^/", ""), "/")).withColumn("prefix", F.lit("")), 0, []
    while True:
        child, last, before = F.get("s", F.lit(level)), F.size("s") == level + 1, ["prefix"] if level else []
        node = ["host", "prefix"]
        children = rows.groupBy(*node, child.alias("child")).agg(F.sum("urls").alias("n"), F.count("*").alias("shapes"))
        nodes = children.groupBy(*node).agg(F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("shapes").alias("shapes"))
        few = F.col("shapes") < MANY
        name = F.when((F.col("children") >= MANY) & (F.col("n") < CHILD_SUPPORT * F.col("children")), F.lit("*")).otherwise(child)
        rest = lambda leave: F.array_join(F.concat(F.array(*before), F.slice("s", F.lit(level + 1), F.greatest(F.lit(0), F.size("s") - level - leave))), "/")
        step = rows.join(nodes, node).select(
            "host", "shape", "urls", "n_block", "n_allow", "s", (few | last).alias("ended"),
            F.when(few, rest(1)).otherwise(F.col("prefix")).alias("parent"),
            F.when(few, rest(0)).otherwise(F.concat_ws("/", *before, name)).alias("prefix"),
        )
        step = scratch.store(step)
        done.append(step.where("ended").select("host", "shape", "n_block", "n_allow", F.size("s").alias("depth"), "parent", F.col("prefix").alias("template")))
        rows, level = step.where("not ended").drop("parent", "ended"), level + 1
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, done)


SIBLINGS = ["host", "depth", "parent"]
#: SQL of a template's side of its siblings: 0 where its labels do not differ from all others' (or there are none on either side).
SIDE = f"""CASE WHEN n = 0 OR all_n = n THEN 0 WHEN power(b / n - (all_b - b) / (all_n - n), 2) <= {SIMILAR * SIMILAR} * (all_b / all_n) * (1 - all_b / all_n) * (1 / n + 1 / (all_n - n)) THEN 0
  WHEN b / n < (all_b - b) / (all_n - n) THEN -1 ELSE 1 END"""


def pooled_branches(done: DataFrame) -> DataFrame:
    """(host, depth, parent, template, n_block, n_allow, purity, rejected): each template with its branch's counts."""
    nodes = done.groupBy(*SIBLINGS, "template").agg(F.sum("n_block").cast("double").alias("b"), F.sum(F.col("n_block") + F.col("n_allow")).cast("double").alias("n"))
    for key in ("first", "second"):
        own = [*SIBLINGS, *([] if key == "first" else ["first"])]
        totals = nodes.groupBy(*own).agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
        nodes = nodes.join(totals, own).withColumn(key, F.expr(SIDE)).drop("all_b", "all_n")
    own = [*SIBLINGS, "first", "second"]
    totals = nodes.groupBy(*own).agg(F.sum("b").alias("n_block"), F.sum(F.col("n") - F.col("b")).alias("n_allow"))
    purity = (F.col("n_block") + PRIOR * STRENGTH) / (F.col("n_block") + F.col("n_allow") + STRENGTH)
    judged = nodes.join(totals, own).withColumn("purity", purity).withColumn("rejected", (F.col("n_block") + F.col("n_allow") >= SUPPORT) & (purity >= REJECT))
    return judged.select(*SIBLINGS, "template", "n_block", "n_allow", "purity", "rejected")


def template_tree(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, n_block, n_allow, purity, rejected) of (host, shape, verdict or null)."""
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(f"n_{v}")
    leaves = scratch.store(urls.groupBy("host", "shape").agg(F.count("*").alias("urls"), count("block"), count("allow")))
    done = walked(leaves, scratch)
    return scratch.store(done.drop("n_block", "n_allow").join(scratch.store(pooled_branches(done)), [*SIBLINGS, "template"]).drop("depth", "parent"))


def judge(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    The verdict is the longest fitting rule's, else block where the url's template is rejected,
    else allow. Null and malformed urls have empty host and path and are judged like any other.
    Rows and ids may repeat; very long urls are taken whole, a segment is never cut; ties cannot
    arise, as siblings are tested one by one; other columns are not read; an empty table gives an
    empty result.
    """
    scratch = Scratch(df.sparkSession)
    host, path = host_and_path(F.col("url"))
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = pages.select("*", rule.alias("rule"), verdict.alias("ruled"), F.regexp_replace("path", "[0-9]+", "*").alias("shape"))
    tree = template_tree(ruled.select("host", "shape", F.col("ruled").alias("verdict")), scratch)
    joined = ruled.join(tree.select("host", "shape", "template", "purity", "rejected"), ["host", "shape"], "left")
    return scratch.last(joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity")))


def oracle_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same in DuckDB's SQL over ``pages``."""
    cases = {"rule": "", "ruled": ""}
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own_host, own_path = split_rule(text)
        fits = f"(host = '{own_host}' OR ends_with(host, '.{own_host}')) AND starts_with(path, '{own_path}')"
        cases["rule"] += f" WHEN {fits} THEN '{text}'"
        cases["ruled"] += f" WHEN {fits} THEN '{what}'"
    parts = [f"""cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE{cases["rule"]} END AS rule, CASE{cases["ruled"]} END AS ruled, regexp_replace(path, '[0-9]+', '*', 'g') AS shape FROM parsed),
leaves AS (SELECT host, shape, count(*) AS urls, count(*) FILTER (ruled = 'block') AS n_block, count(*) FILTER (ruled = 'allow') AS n_allow, string_split(regexp_replace(shape, '^/', ''), '/') AS s FROM ruled GROUP BY host, shape),
l0 AS MATERIALIZED (SELECT *, false AS ended, '' AS parent, '' AS prefix FROM leaves)"""]
    for i in range(SQL_LEVELS):
        kept = "prefix || '/' || " if i else ""
        rest = lambda leave: f"array_to_string({'[prefix] || ' if i else ''}s[{i + 1}:len(s) - {leave}], '/')"  # noqa: B023, E731
        parts.append(f"""w{i} AS (SELECT host, prefix, count(DISTINCT s[{i + 1}]) AS k, sum(urls) AS n, count(*) AS shapes FROM l{i} WHERE NOT ended GROUP BY host, prefix),
l{i + 1} AS MATERIALIZED (SELECT host, shape, urls, n_block, n_allow, s, true AS ended, parent, prefix FROM l{i} WHERE ended
  UNION ALL SELECT host, shape, urls, n_block, n_allow, s, shapes < {MANY} OR len(s) = {i + 1}, CASE WHEN shapes < {MANY} THEN {rest(1)} ELSE prefix END,
  CASE WHEN shapes < {MANY} THEN {rest(0)} ELSE {kept}CASE WHEN k >= {MANY} AND n < {CHILD_SUPPORT} * k THEN '*' ELSE s[{i + 1}] END END FROM l{i} JOIN w{i} USING (host, prefix) WHERE NOT ended)""")
    parts.append(f"""named AS (SELECT host, shape, len(s) AS depth, parent, prefix AS template, n_block, n_allow FROM l{SQL_LEVELS}),
pooled AS (SELECT host, depth, parent, template, sum(n_block)::DOUBLE AS b, sum(n_block + n_allow)::DOUBLE AS n FROM named GROUP BY ALL),
first AS (SELECT * EXCLUDE (all_b, all_n), {SIDE} AS first FROM (SELECT *, sum(b) OVER w AS all_b, sum(n) OVER w AS all_n FROM pooled WINDOW w AS (PARTITION BY host, depth, parent))),
second AS (SELECT * EXCLUDE (all_b, all_n), {SIDE} AS second FROM (SELECT *, sum(b) OVER w AS all_b, sum(n) OVER w AS all_n FROM first WINDOW w AS (PARTITION BY host, depth, parent, first))),
totals AS (SELECT *, sum(b) OVER w AS n_block, sum(n - b) OVER w AS n_allow FROM second WINDOW w AS (PARTITION BY host, depth, parent, first, second)),
judged AS (SELECT *, (n_block + {PRIOR * STRENGTH}) / (n_block + n_allow + {STRENGTH}) AS purity FROM totals)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN j.n_block + j.n_allow >= {SUPPORT} AND j.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, n.template, round(j.purity, 6) AS purity
FROM ruled AS r LEFT JOIN named AS n ON r.host = n.host AND r.shape = n.shape LEFT JOIN judged AS j ON j.host = n.host AND j.depth = n.depth AND j.parent = n.parent AND j.template = n.template""")
    return "WITH " + ",\n".join(parts)
