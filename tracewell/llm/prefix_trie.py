"""Prefix trie of conversations, aggregated by heavy-path decomposition.

Conversations are first rebuilt: the first h original turns of the conversation that opens its
hundred, then their own turns after the first h (h is a checksum of the id). A prefix is named by its
depth and by the polynomial sum of its turns' digests times powers of a fixed base, modulo 2^127 - 1.
Such sums are put together from pieces, so a conversation of any length is numbered and fingerprinted
by many tasks: turns are range-partitioned by (conversation, turn), each task scans its own rows, and
the two conversations at a partition's ends get what lies before them from one row for each task. The
same sums give a rebuilt prefix from those of its two parts; texts are read once and never shuffled.

Nodes are the distinct prefixes. Each node's heavy child is the one with the most conversations
(ties: the smaller conv_id), so that a light edge at least halves them and no leaf lies below more
than log2(conversations) light edges. A heavy path ends in one leaf: it is the part of that leaf's
conversation below its last light edge. Paths are arrays in blocks of ``BLOCK`` nodes; suffix sums
along the arrays, with later blocks' totals added, give every subtree of a path at once, and the
path's total is attached to its parent. Paths with the most light edges above come first, so there
are as many rounds as light edges on the deepest way, each a job over its own paths only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, scratch_dir

P = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"base of prefix polynomials").digest()[:16], "big") % P
INVERSE = pow(BASE, -1, P)
#: Turns that a rebuilt conversation takes over: below HEADS; conversations share a first one by HUNDRED.
HEADS, HUNDRED = 6, 100
#: Nodes of a path in one array.
BLOCK = 1024
#: Ids in one piece of a node's list of ends.
PIECE = 4096
ZERO = bytes(16)
NODE = ["depth", "node"]


def digests(df: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_chars): 128 bits of SHA-256 over role and text, apart by the role's length; null ids are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    return df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"))


def heads_of(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def table_of(columns: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


SCANNED = [("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("n_chars", pa.int64())]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and sums before and after each turn, as far as this partition knows; then a row without n_chars for its first and its last conversation."""
    part, conv, first, totals = TaskContext.get().partitionId(), None, True, []
    n = sum_ = 0
    power = 1
    for batch in batches:
        ids, turns, chars = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "digest", "n_chars"))
        pos, before, after = [], [], []
        for c, digest in zip(ids, turns, strict=True):
            if c != conv:
                if first and conv is not None:
                    totals.append((conv, n, sum_))
                    first = False
                conv, n, sum_, power = c, 0, 0, 1
            pos.append(n)
            before.append(sum_.to_bytes(16, "big"))
            sum_ = (sum_ + int.from_bytes(digest, "big") * power) % P
            after.append(sum_.to_bytes(16, "big"))
            power = power * BASE % P
            n += 1
        yield table_of([ids, [part] * len(ids), pos, before, after, chars], SCANNED)
    if conv is not None:
        totals.append((conv, n, sum_))
    if totals:
        yield table_of([[c for c, _, _ in totals], [part] * len(totals), [n for _, n, _ in totals], [ZERO] * len(totals), [s.to_bytes(16, "big") for _, _, s in totals], [None] * len(totals)], SCANNED)


def carried(ends: list[tuple[int, int, int, bytes]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(conv_id, part) -> turns and sum in earlier partitions, where there are any; from two rows a partition."""
    found, conv, n, sum_ = {}, None, 0, 0
    for c, part, count, total in sorted(ends):
        if c != conv:
            conv, n, sum_ = c, 0, 0
        if n:
            found[c, part] = (n, sum_)
        sum_ = (sum_ + int.from_bytes(total, "big") * pow(BASE, n, P)) % P
        n += count
    return found


def turns_of(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, before, after, n_chars) of every original turn: its place from 0, and the prefix sums around it."""
    order = ["conv_id", "turn", "digest"]  # ascending puts nulls first
    narrow = scratch.store(digests(df))
    local = scratch.store(narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, "conv_id long, part int, pos long, before binary, after binary, n_chars long"))
    ends = [tuple(r) for r in local.where("n_chars is null").select("conv_id", "part", "pos", "after").collect()]  # two rows for each task
    more = carried(ends)
    rows = local.where("n_chars is not null")
    if not more:
        return rows.drop("part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, pos, before, after, chars = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n, _ in SCANNED)
            for i, key in enumerate(zip(conv, part, strict=True)):
                if key in more:
                    n, sum_ = more[key]
                    power = pow(BASE, n, P)
                    pos[i] += n
                    before[i], after[i] = (((sum_ + int.from_bytes(x, "big") * power) % P).to_bytes(16, "big") for x in (before[i], after[i]))
            yield table_of([conv, pos, before, after, chars], [x for x in SCANNED if x[0] != "part"])

    return rows.mapInArrow(place, "conv_id long, pos long, before binary, after binary, n_chars long")


def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns' sums behind another head: minus what was cut, times the shift's power, plus the head's sum."""
    shift = {k: pow(INVERSE, -k, P) if k < 0 else pow(BASE, k, P) for k in range(-HEADS, HEADS + 1)}
    as_int = lambda b: int.from_bytes(b, "big")
    for batch in batches:
        row = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        power = [shift[m - h] for m, h in zip(row["m"], row["h"], strict=True)]
        sums = [[((as_int(x) - as_int(cut)) * k + as_int(head)) % P for x, cut, k, head in zip(row[side], row["cut"], power, row["head_sum"], strict=True)] for side in ("before", "after")]
        depth = [m + pos - h + 1 for m, pos, h in zip(row["m"], row["pos"], row["h"], strict=True)]
        columns = [row["conv_id"], depth, *([x.to_bytes(16, "big") for x in s] for s in sums), row["n_chars"], [d == n for d, n in zip(depth, row["turns"], strict=True)]]
        yield table_of(columns, [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("node", pa.binary()), ("n_chars", pa.int64()), ("ends", pa.bool_())])


def visits_of(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent, node, n_chars, ends): a row for each prefix of each rebuilt conversation, the root included."""
    h = heads_of(F.col("conv_id"))
    opening = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "before", "after", "n_chars"))  # five rows a conversation at most
    convs = scratch.store(turns.groupBy("conv_id").agg(F.count("*").alias("own"), F.max(F.when(F.col("pos") == h, F.col("before"))).alias("cut"), F.sort_array(F.collect_list(opening)).alias("first")).withColumn("h", h))
    heads = convs.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("opens"), F.col("first").alias("open_turns"))
    info = convs.drop("first").withColumn("opens", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads, "opens", "left")  # a hundred conversations meet a head, two around 0
    head = F.when(F.col("open_turns").isNotNull() & (F.col("h") > 0), F.slice("open_turns", F.lit(1), F.greatest(F.col("h"), F.lit(1)))).otherwise(F.slice("open_turns", 1, 0))
    info = info.withColumn("head", F.coalesce(head, F.array().cast("array<struct<pos:bigint,before:binary,after:binary,n_chars:bigint>>"))).withColumn("m", F.size("head"))
    info = info.withColumn("head_sum", F.coalesce(F.try_element_at("head", F.lit(-1))["after"], F.lit(ZERO))).withColumn("turns", F.col("m") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h")))
    info = scratch.store(info.select("conv_id", "h", "m", "turns", "head", "head_sum", F.coalesce("cut", F.lit(ZERO)).alias("cut")))
    root = info.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(ZERO).alias("node"), F.lit(0).cast("long").alias("n_chars"), (F.col("turns") == 0).alias("ends"))
    opened = info.select("conv_id", "turns", F.explode("head").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), F.col("t.before").alias("parent"), F.col("t.after").alias("node"), "t.n_chars", (F.col("t.pos") + 1 == F.col("turns")).alias("ends"))
    own = turns.where(F.col("pos") >= h).join(info.drop("head"), "conv_id").select("conv_id", "pos", "before", "after", "n_chars", "h", "m", "turns", "head_sum", "cut")
    own = own.mapInArrow(moved, "conv_id long, depth long, parent binary, node binary, n_chars long, ends boolean")
    return scratch.store(root.unionAll(opened).unionAll(own))


def tree_of(visits: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, node, parent, conv_id, n_convs, n_children, saved, parent_conv_id, light), one row a node; the root is light."""
    nodes = scratch.store(visits.groupBy(*NODE).agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars")))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min(F.struct(-F.col("n_convs"), F.col("conv_id"))).alias("heavy"))
    nodes = nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = scratch.store(nodes.select(*NODE, "parent", "conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), F.col("heavy.conv_id").alias("heavy_conv_id")))
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "heavy_conv_id")
    lower = nodes.where("depth > 0").drop("heavy_conv_id").join(above, ["depth", "parent"]).withColumn("light", F.col("conv_id") != F.col("heavy_conv_id")).drop("heavy_conv_id")
    root = nodes.where("depth = 0").drop("heavy_conv_id").withColumns({"parent_conv_id": F.lit(None).cast("long"), "light": F.lit(True)})
    return scratch.store(root.unionByName(lower))


def paths_of(visits: DataFrame, tree: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Every node once, with its heavy path (the leaf's conv_id), the path's top and level (light edges above); and the greatest level."""
    leaves = tree.where("n_children = 0").select("conv_id")
    down = scratch.store(visits.select("conv_id", *NODE).join(leaves, "conv_id").withColumnRenamed("conv_id", "path").join(tree, NODE))
    tops = down.groupBy("path").agg(F.max(F.when(F.col("light"), F.col("depth"))).alias("top"), F.count_if(F.col("light") & (F.col("depth") > 0)).cast("int").alias("level"))
    path = scratch_dir(visits.sparkSession)
    down.join(tops, "path").where(F.col("depth") >= F.col("top")).write.partitionBy("level").parquet(path)
    scratch.paths.append(path)
    rows = visits.sparkSession.read.parquet(path)
    return rows, rows.agg(F.max("level")).first()[0]


def suffix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of each node of a path's block: of the block from it on, and of all later blocks."""
    for batch in batches:
        nodes = batch.column(batch.schema.get_field_index("nodes"))
        sizes = nodes.value_lengths().to_numpy(zero_copy_only=False)
        flat = nodes.flatten()
        cuts = np.cumsum(sizes)[:-1]
        arrays = [pa.array(c) if isinstance(c, np.ndarray) else c for c in flat.flatten()]
        names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
        for name in ("n_leaves", "saved_tokens"):
            later = batch.column(batch.schema.get_field_index(f"later_{name}")).to_pylist()
            own = np.split(arrays[names.index(name)].to_numpy(zero_copy_only=False), cuts)
            arrays[names.index(name)] = pa.array(np.concatenate([np.cumsum(v[::-1])[::-1] + more for v, more in zip(own, later, strict=True)]) if len(own) and len(flat) else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(arrays, names)


ROUND = "depth long, node binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, at_top boolean"


def subtree_sums(paths: DataFrame, deepest: int, scratch: Scratch) -> list[DataFrame]:
    """The nodes of each level of paths with n_leaves and saved_tokens of their subtrees, deepest first."""
    found: list[DataFrame] = []
    columns = [c.split()[0] for c in ROUND.split(", ")]
    for level in range(deepest, -1, -1):
        rows = paths.where(F.col("level") == level).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved"), "at_top": F.col("depth") == F.col("top")})
        if found:
            hung = found[-1].where("at_top").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            rows = rows.join(hung, NODE, "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0).cast("long")), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0).cast("long"))})
        blocks = rows.groupBy("path", F.expr(f"depth div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("nodes"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))  # at most BLOCK nodes
        later = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumns({f"later_{c}": F.coalesce(F.sum(c).over(later), F.lit(0).cast("long")) for c in ("n_leaves", "saved_tokens")})
        found.append(scratch.store(blocks.select("nodes", "later_n_leaves", "later_saved_tokens").mapInArrow(suffix_sums, ROUND)))
    return found


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a node as comma-joined ids, PIECE of them at most."""
    kinds = [("depth", pa.int64()), ("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]
    key, ids, out = None, [], [[], [], [], []]

    def flush() -> None:
        for column, value in zip(out, (*key, ids[0], ",".join(map(str, ids))), strict=True):
            column.append(value)
        ids.clear()

    for batch in batches:
        for depth, node, conv in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if ids and ((depth, node) != key or len(ids) >= PIECE):
                flush()
            key = (depth, node)
            ids.append(conv)
        yield table_of(out, kinds)
        out = [[], [], [], []]
    if ids:
        flush()
        yield table_of(out, kinds)


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces in order, as a stream."""
    kinds = [("depth", pa.int64()), ("node", pa.binary()), ("ends_sha256", pa.string())]
    key = state = None
    for batch in batches:
        out: list[list] = [[], [], []]
        for depth, node, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NODE, "ids")), strict=True):
            if (depth, node) != key:
                if key:
                    for column, value in zip(out, (*key, state.hexdigest()), strict=True):
                        column.append(value)
                key, state = (depth, node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield table_of(out, kinds)
    if key:
        yield table_of([[key[0]], [key[1]], [state.hexdigest()]], kinds)


def end_hashes(visits: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the conversations that end at a node. A node's ids are joined by many tasks; the hash itself is a chain, so a node's joined pieces stream through one."""
    ended = visits.where("ends").select(*NODE, "conv_id")
    joined = ended.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pieces, "depth long, node binary, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashes, "depth long, node binary, ends_sha256 string")


def prefix_trie(df: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    ``df`` has conv_id, turn, role, text; other columns are not read. Turns are ordered by turn, null
    first; rows of one turn by their digest, repeated rows all count. Null roles and texts are empty;
    rows without conv_id are left out. Very long texts are only hashed and counted, very long
    conversations are cut over tasks. An empty table gives an empty result, no root. Sums beyond a
    long raise.
    """
    scratch = Scratch(df.sparkSession)
    visits = visits_of(turns_of(df, scratch), scratch)
    tree = tree_of(visits, scratch)
    paths, deepest = paths_of(visits, tree, scratch) if visits.head(1) else (None, -1)
    if paths is None:
        return df.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    summed = None
    for level in subtree_sums(paths, deepest, scratch):
        summed = level if summed is None else summed.unionAll(level)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    done = summed.join(end_hashes(visits), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return scratch.last(done)


def oracle_sql(table: str = "conversations") -> str:
    """The same in DuckDB's SQL: prefixes as joined digests, subtrees by each node's own ancestors."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step}), 4294967295)"
    return f"""WITH own AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, n_chars
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM {table} WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT conv_id, {crc} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own)),
head AS (SELECT c.conv_id, o.pos, o.digest, o.n_chars FROM convs AS c JOIN own AS o ON o.conv_id = c.conv_id - c.conv_id % {HUNDRED} WHERE o.pos < c.h),
sized AS (SELECT c.conv_id, c.h, (SELECT count(*) FROM head AS x WHERE x.conv_id = c.conv_id) AS m FROM convs AS c),
rebuilt AS (SELECT * FROM head UNION ALL SELECT o.conv_id, s.m + o.pos - s.h, o.digest, o.n_chars FROM own AS o JOIN sized AS s USING (conv_id) WHERE o.pos >= s.h),
visits AS MATERIALIZED (SELECT conv_id, pos + 1 AS depth, n_chars, sha256(string_agg(digest, '') OVER w) AS node, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS ends FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS MATERIALIZED (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n_chars) AS saved, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM visits GROUP BY depth, node),
edges AS MATERIALIZED (SELECT n.depth, n.node, v.node AS parent FROM nodes AS n JOIN visits AS v ON v.conv_id = n.conv_id AND v.depth = n.depth - 1),
children AS MATERIALIZED (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM edges GROUP BY ALL),
sums AS (SELECT a.depth, a.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes AS n LEFT JOIN children AS c USING (depth, node) JOIN visits AS a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes AS n JOIN sums AS s USING (depth, node) LEFT JOIN children AS c USING (depth, node) LEFT JOIN edges AS e USING (depth, node) LEFT JOIN nodes AS p ON p.depth = e.depth - 1 AND p.node = e.parent"""
