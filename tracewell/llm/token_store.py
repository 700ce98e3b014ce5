"""Token ids of whole documents in canonical Huffman blocks.

Written: the tokens of all documents in ascending doc_id order, cut into shards (one task's range
of ids) and blocks (whole documents, about ``BLOCK_TOKENS`` tokens). A block is decoded on its own:
its payload is a bit string, most significant bit first, and ``checkpoints`` holds the bit offset
of every ``STRIDE``-th token, so that a reader starts at many places at once. One code book for
all blocks, from the counts of ids over all documents: code lengths limited to ``MAX_BITS`` by
package-merge, codes canonical, so the lengths alone are stored.

On disk, below one folder: ``codebook`` (token, length) and ``blocks`` (shard, block, shard_start,
doc_ids, doc_tokens, checkpoints, payload), both as Parquet written by Spark's committer, which
survives lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._common import documents_of, scratch_dir, text_rows, worker_cache

MAX_BITS = 20
BLOCK_TOKENS = 1 << 17
STRIDE = 128
END_ID = 2
BLOCK_SCHEMA = "shard int, block int, shard_start long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary"
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])


def limited_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    n, merged, is_leaf = len(used), leaves, [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_leaf.append(order < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[used[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ids by (length, id) get consecutive codes."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    per_length = np.bincount(lengths[used], minlength=MAX_BITS + 2)
    at = 0
    for size in range(1, len(per_length)):
        code <<= size - last
        last = size
        k = int(per_length[size])
        codes[used[at : at + k]] = np.arange(code, code + k, dtype=np.uint64)
        code += k
        at += k
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(id << 5 | length for each value of the next ``bits`` bits, bits)."""
    used = np.flatnonzero(lengths)
    bits = int(lengths.max(initial=1))
    used = used[np.lexsort((used, lengths[used]))]
    table = np.repeat(used.astype(np.uint32) << np.uint32(5) | lengths[used].astype(np.uint32), 1 << (bits - lengths[used].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << bits) - len(table), np.uint32) + (table[-1] if len(table) else 1)]), bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every STRIDE-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word = start >> 5
    value = codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    words = (int(end[-1]) + 31 >> 5) + 1 if len(ids) else 0
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    payload = (high + low[:words]).astype(np.uint32).astype(">u4").tobytes()
    return payload[: (int(end[-1]) + 7) // 8] if len(ids) else b"", start[::STRIDE]


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], totals: list[int], table: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of each block; all checkpoints of all blocks are decoded side by side."""
    raw = np.frombuffer(b"".join(payloads) + b"\0" * 8, np.uint8)
    base = np.cumsum([0, *map(len, payloads)])[:-1] * 8
    at = np.concatenate([c + b for c, b in zip(checkpoints, base, strict=True)]).astype(np.int64) if payloads else np.zeros(0, np.int64)
    window = np.zeros(len(raw) - 3, np.uint32)
    for k in range(4):
        window |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    last, mask = len(window) - 1, np.uint32((1 << bits) - 1)
    out = np.empty((STRIDE, len(at)), np.uint32)
    for k in range(STRIDE):
        bits_left = (32 - bits - (at & 7)).astype(np.uint32)
        got = table[(window[np.minimum(at >> 3, last)] >> bits_left) & mask]
        out[k] = got >> np.uint32(5)
        at += got & np.uint32(31)
    lanes = np.cumsum([0, *map(len, checkpoints)])
    return [out[:, a:b].T.reshape(-1)[:n] for a, b, n in zip(lanes, lanes[1:], totals, strict=False)]


def encode_documents(df: DataFrame, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned bytes, two or four an id, with ``end_id`` after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"bpe:{tokenizer}:{special_as_text}", lambda: bpe.Encoder(tokenizer, special_as_text=special_as_text))
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        kind = "<u2" if max(encoder.size, end_id or 0) <= 1 << 16 else "<u4"
        for doc_ids, texts in text_rows(batches, "doc_id", "text"):
            ids = [np.frombuffer(x + tail, "<u4").astype(kind).tobytes() for x in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array([int(kind[-1])] * len(ids), pa.int32())], ["doc_id", "ids", "width"])

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, width int")


def token_counts(encoded: DataFrame) -> DataFrame:
    """(token, n) over all documents; each task sends one row for each id it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for ids, width in text_rows(batches, "ids", "width"):
            if ids:
                part = np.bincount(np.frombuffer(b"".join(ids), f"<u{width[0]}"), minlength=len(total))
                part[: len(total)] += total
                total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    return encoded.select("ids", "width").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Encode every whole text and write ``codebook`` and ``blocks`` below ``path``.

    Null texts count as empty: the end id alone. Special tokens' strings in a text become those
    tokens, as in the library, unless ``special_as_text``. Very long texts are encoded whole. Rows
    that share an id stand side by side, null ids first. An empty table writes no blocks. Other
    columns are not read.
    """
    tokenizer = tokenizer or bpe.default_tokenizer()
    spark = df.sparkSession
    encode_documents(df, tokenizer, end_id, id_col, text_col, special_as_text).write.option("compression", "zstd").parquet(f"{path}/encoded")
    encoded = spark.read.schema("doc_id long, ids binary, width int").parquet(f"{path}/encoded")
    counted = token_counts(encoded).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r.token for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r.token] = r.n
    lengths = limited_lengths(counts)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "token int, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes = TaskContext.get().partitionId(), canonical_codes(lengths)
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = block = before = 0

        def flush() -> pa.RecordBatch:
            payload, marks = pack(np.concatenate(parts).astype(np.int64), lengths, codes)
            row = [[shard], [block], [before], [doc_ids], [[len(p) for p in parts]], [marks.tolist()], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

        for got, ids, width in text_rows(batches, "doc_id", "ids", "width"):
            for d, x, w in zip(got, ids, width, strict=True):
                doc_ids.append(d)
                parts.append(np.frombuffer(x, f"<u{w}"))
                held += len(parts[-1])
                if held >= BLOCK_TOKENS:
                    yield flush()
                    before, block, held, doc_ids, parts = before + held, block + 1, 0, [], []
        if doc_ids:
            yield flush()

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove(spark, f"{path}/encoded")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files below ``path``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers.
    """
    book = spark.read.schema("token int, length int").parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r.token for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.token] = r.length
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    ends = stored.select("shard", (F.col("shard_start") + F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end"))
    offset, offsets = 0, {}
    for r in ends.groupBy("shard").agg(F.max("end").alias("n")).orderBy("shard").collect():  # one row for each writing task
        offsets[r.shard] = offset
        offset += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = decode_table(lengths)
        names = ("shard", "shard_start", "doc_ids", "doc_tokens", "checkpoints", "payload")
        for shard, before, doc_ids, doc_tokens, marks, payload in text_rows(batches, *names, rows=16):
            decoded = unpack(payload, [np.array(m, np.int64) for m in marks], [sum(n) for n in doc_tokens], table, bits)
            for s, b, own, sizes, ids in zip(shard, before, doc_ids, doc_tokens, decoded, strict=True):
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(own, pa.int64()), pa.array(starts + (offsets[s] + b)), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_digests(df: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the documents' ids to ``path`` (a new shared folder unless given), then read the files back as digests."""
    path = path or scratch_dir(df.sparkSession)
    write_tokens(df, path, tokenizer)
    return read_tokens(df.sparkSession, path, with_ids=False)
