"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

A document's fingerprint has one bit per bit of a 64-bit shingle hash, set where more than half of
its shingle hashes (repeats included) have it. Fingerprints that differ in at most two bits are
linked; components of links are the groups.

Candidates: the 64 bits are cut into three segments of 22, 21 and 21 bits, each padded to a 23-bit
word. The perfect binary Golay code (23, 12, 7) puts every 23-bit word within distance 3 of exactly
one codeword. The fuzzy keys of a word are the indices of the codewords to which the word and its
23 neighbours decode: one key, or six. Two words that differ in at most two bits have a common
neighbour, so they share a key. Pigeonhole: two errors leave one of three segments whole, and the
next segment has at most two, so a linked pair always shares (segment i exactly, a fuzzy key of
segment i + 1). No link is lost.

Buckets: a bucket of two is a pair, verified at once. The members of larger buckets are linked
without listing pairs: each emits the 65 words within one bit of it; two fingerprints differ in at
most two bits if and only if they meet in such a word, and all that meet in one differ in at most
two, so a star over each meeting word keeps every link. Work stays proportional to the number of
distinct fingerprints whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, documents_of, store, text_rows, worker_cache

#: Fixed values of the binary Golay code: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, length 23, 12 information bits.
GOLAY_POLYNOMIAL = 0b110001110101
GOLAY_LENGTH, GOLAY_BITS = 23, 12
#: (first bit, width) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42


def golay_table() -> np.ndarray:
    """The codeword index to which each 23-bit word decodes, for all 2^23 words."""
    words = np.zeros(1 << GOLAY_BITS, np.uint32)
    index = np.arange(1 << GOLAY_BITS, dtype=np.uint32)
    for b in range(GOLAY_BITS):
        words ^= np.where(index >> b & 1, np.uint32(GOLAY_POLYNOMIAL << b), np.uint32(0))
    single = np.left_shift(np.uint32(1), np.arange(GOLAY_LENGTH, dtype=np.uint32))
    errors = {0}
    for _ in range(3):
        errors |= {e ^ int(s) for e in errors for s in single}
    table = np.zeros(1 << GOLAY_LENGTH, np.uint16)
    for e in errors:  # 2048 patterns of weight 3 or less: the balls round the codewords tile the space
        table[words ^ np.uint32(e)] = index
    return table


def fuzzy_keys(words: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each distinct codeword index near each 23-bit word."""
    flips = np.concatenate([[0], np.left_shift(1, np.arange(GOLAY_LENGTH))]).astype(np.uint32)
    near = np.sort(table[words.astype(np.uint32)[:, None] ^ flips], axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, at = np.nonzero(new)
    return rows, near[rows, at]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle, repeats included; fewer words: of the whole sequence."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[i : i + step])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit number; 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_rows(batches, "doc_id", "text"):
            fps = np.array([majority(shingle_hashes(t, width)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def bucket_keys(reps: DataFrame) -> DataFrame:
    """(key, fp, rid) of (fp, rid): segment i exactly with each fuzzy key of the next segment, for each i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache("golay", golay_table)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                signed, rid = (part.column(part.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("fp", "rid"))
                fp = signed.view(np.uint64)
                cut = [(fp >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in SEGMENTS]
                for s, whole in enumerate(cut):
                    rows, near = fuzzy_keys(cut[(s + 1) % len(cut)], table)
                    key = (np.uint64(s) << np.uint64(34)) | (whole[rows] << np.uint64(12)) | near.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(signed[rows]), pa.array(rid[rows])], ["key", "fp", "rid"])

    return reps.select("fp", "rid").mapInArrow(run, "key long, fp long, rid long")


def differ_at_most(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def links(reps: DataFrame) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints at most two bits apart, by their representatives.

    ``reps`` has (fp, rid), fp distinct. Fingerprints that meet in a crowded bucket get a star in
    place of all their pairs; components are the same.
    """
    first, last = F.min(F.struct("fp", "rid")), F.max(F.struct("fp", "rid"))
    buckets = store(bucket_keys(reps).groupBy("key").agg(F.count("*").alias("n"), first.alias("x"), last.alias("y")).where("n > 1"))
    pairs = buckets.where("n = 2").where(differ_at_most(F.col("x.fp"), F.col("y.fp"), 2)).select(F.col("x.rid").alias("u"), F.col("y.rid").alias("v"))
    crowded = bucket_keys(reps).join(buckets.where("n > 2").select("key"), "key", "left_semi").select("fp", "rid").distinct()
    ball = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = crowded.select("rid", F.explode(ball).alias("z")).groupBy("z").agg(F.collect_set("rid").alias("members")).where(F.size("members") > 1)  # a ball has 65 words: at most 65 members
    stars = met.select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
    both = pairs.unionByName(stars).where("u <> v")
    return both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of (a, b) edges.

    Alternating large-star and small-star rounds; each round is checkpointed, nothing but a count
    and a checksum reaches the driver.
    """
    work = Scratch(edges.sparkSession)
    edges = work.store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.where("m > n").join(least, "n").select(F.col("least").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smaller = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("least"))
        hops = large.join(smaller, F.col("b") == F.col("n")).select(F.explode(F.array(F.struct(F.col("least").alias("a"), F.col("a").alias("b")), F.struct(F.col("least").alias("a"), F.col("n").alias("b")))).alias("e")).select("e.*")
        edges = work.last(hops.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint and the smallest doc_id of its group.

    Null or wordless texts have fingerprint zero and link like any other. Rows with a null id get
    the group of the rows that share their fingerprint, or null without such rows. Repeated rows
    come back as often as they came. An empty table gives an empty result. Other columns are not
    read. Ids are meant to be unique; rows that share an id are one node.
    """
    work = Scratch(df.sparkSession)
    prints = work.store(fingerprints(df, id_col, text_col, width))
    reps = work.store(prints.groupBy("fp").agg(F.min("doc_id").alias("rid")))
    roots = components(links(reps.where("rid is not null")))
    groups = reps.join(roots, reps.rid == roots.node, "left").select("fp", F.coalesce("root", "rid").alias("component_id"))
    return work.last(prints.join(groups, "fp").select("doc_id", "fp", "component_id"))


#: The wide form: 64-bit words of a fingerprint, its 23-bit segments that give keys, min-hashes that go with each segment.
WIDE_WORDS, WIDE_SEGMENTS, MINS = 8, 12, 2
#: Words of the long form that decides between members of crowded buckets.
LONG_WORDS = 32
#: Standard deviations beyond the expected distance at which a pair is still verified.
MARGIN = 3.5
#: Members of a bucket that meet in one task.
BLOCK = 1024
#: Words of the bitmap that keeps texts which nobody asks for out of a shuffle.
SLOTS = 1 << 17
ODD = np.random.default_rng(11).integers(1, 1 << 63, (2, LONG_WORDS + WIDE_SEGMENTS * MINS), dtype=np.uint64) | np.uint64(1)
WORDS = [f"f{k}" for k in range(WIDE_WORDS)]


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th of several independent hashes of a hash."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * ODD[0, i]
        return (x ^ (x >> np.uint64(29))) * ODD[1, i]


def max_bits(similarity: float, words: int = WIDE_WORDS) -> int:
    """Bits of a wide fingerprint that may differ: the expectation at that Jaccard similarity and MARGIN deviations.

    The angle between sets of one size has the cosine 2s / (1 + s); each bit differs with its share of pi.
    """
    p, n = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 64 * words
    return int(n * p + MARGIN * (n * p * (1 - p)) ** 0.5)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(shingles: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """The words of a set's fingerprint: each distinct shingle counts once."""
    return np.array([majority(mixed(shingles, k)) for k in range(words)], np.uint64)


def wide_keys(words: np.ndarray, shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The keys of one text: for each segment its fuzzy keys, each with the segment's own min-hashes.

    Twelve bits alone would fill buckets with strangers; texts share min-hashes as often as they are similar.
    """
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")[: WIDE_SEGMENTS * GOLAY_LENGTH].reshape(WIDE_SEGMENTS, GOLAY_LENGTH)
    rows, near = fuzzy_keys(bits @ (1 << np.arange(GOLAY_LENGTH, dtype=np.uint32)), table)
    mins = np.array([[mixed(shingles, LONG_WORDS + s * MINS + j).min() for j in range(MINS)] for s in range(WIDE_SEGMENTS)])
    with np.errstate(over="ignore"):
        key = near.astype(np.uint64) + np.uint64(1 << GOLAY_BITS) * rows.astype(np.uint64)
        for j in range(MINS):
            key = mixed(key * ODD[1, j] + mins[rows, j], j)
    return key


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, f0 .. f7, keys) of every whole text: its shingle set by digest, the set's fingerprint and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = worker_cache("golay", golay_table)
        for ids, texts in text_rows(batches, "doc_id", "text"):
            words, keys, digests = np.zeros((len(ids), WIDE_WORDS), np.uint64), [np.zeros(0, np.uint64)] * len(ids), []
            for i, t in enumerate(texts):
                own = shingle_set(t, width)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                if len(own):
                    words[i] = wide_fingerprint(own)
                    keys[i] = wide_keys(words[i], own, table)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(WIDE_WORDS)), lists], ["doc_id", "digest", *WORDS, "keys"])

    return docs.mapInArrow(run, "doc_id long, digest binary, " + ", ".join(f"{n} long" for n in WORDS) + ", keys array<long>")


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}"))) for n in WORDS), F.lit(0))


def near_enough(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b, bits): the pairs whose fingerprints ``prints`` (rid, words) are not too far apart."""
    words = F.struct(*WORDS)
    both = pairs.join(prints.select(F.col("rid").alias("a"), words.alias("x")), "a").join(prints.select(F.col("rid").alias("b"), words.alias("y")), "b")
    return both.select("a", "b", distance("x", "y").alias("bits")).where(F.col("bits") <= max_bits(similarity))


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The (a, b) whose texts' whole shingle sets have at least the similarity: |x and y| / |x or y|, nothing estimated.

    Texts travel, not sets: they are smaller, and compress. Rows come by their a, so its set is built once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for a, b, s, t in text_rows(batches, "a", "b", "s", "t"):
            keep = []
            for i, node in enumerate(a):
                if node != last:
                    last, x = node, shingle_set(s[i], width)
                y = shingle_set(t[i], width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], ["a", "b"])

    both = pairs.select("a", "b").join(texts.toDF("b", "t"), "b").join(texts.toDF("a", "s"), "a")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows that come sorted by (key, block), many at a time; a group may span batches."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        same = (now["key"] == now["key"][-1]) & (now["block"] == now["block"][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
        if last or held and (held[-1]["key"][-1], held[-1]["block"][-1]) != (now["key"][0], now["block"][0]):
            held.append({n: c[:last] for n, c in now.items()})
            yield {n: np.concatenate([h[n] for h in held]) for n in now}
            held = []
        held.append({n: c[last:] for n, c in now.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def long_fingerprints(texts: DataFrame, width: int) -> DataFrame:
    """(rid, size, long): each text's set size and its fingerprint of 2048 bits, the short one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in text_rows(batches, "doc_id", "text"):
            sets = [shingle_set(t, width) for t in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_fingerprint(s, LONG_WORDS).tobytes() for s in sets], pa.binary())], ["rid", "size", "long"])

    return texts.mapInArrow(run, "rid long, size long, long binary")


def padded(lists: np.ndarray) -> np.ndarray:
    """Lists of keys as rows of one table, with zeros after each."""
    sizes = np.array([len(k) for k in lists], np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(lists) if len(lists) else []
    return out.view(np.uint64)


def open_members(members: DataFrame) -> DataFrame:
    """(key, rid, root, n, largest) of (key, rid, root): members of buckets with several roots, their number and the largest root."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("largest"))
    return members.join(sizes.where("roots > 1").drop("roots"), "key")


def open_pairs(opened: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b, bits), a < b: near pairs of one bucket whose roots differ, by sizes and long fingerprints.

    A pair that shares several open buckets comes from the one with its smallest common key alone.
    A text meets its fingerprint once, with the list of its open buckets (it has at most 72 keys).

    The members of the bucket's largest root are not compared with each other, so a group that is
    connected costs its size, not its square. A bucket is dealt out over blocks of its members;
    members of other roots go to each of its blocks.
    """
    limit = max_bits(similarity, LONG_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches):
            words = np.frombuffer(b"".join(g["long"]), np.uint64).reshape(-1, LONG_WORDS)
            keys = padded(g["own_keys"])
            rid, root, size, key = g["rid"], g["root"], g["size"], g["key"].view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero((g["key"][1:] != g["key"][:-1]) | (g["block"][1:] != g["block"][:-1])) + 1, [len(words)]]).tolist()
            found = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                at, own = lo + np.flatnonzero(g["roams"][lo:hi]), lo + np.flatnonzero(~g["roams"][lo:hi])
                for x in at.tolist():
                    y = own[(root[own] != root[x]) & (np.minimum(size[own], size[x]) >= similarity * np.maximum(size[own], size[x]) - 1e-6)]
                    bits = np.bitwise_count(words[y] ^ words[x]).sum(axis=1, dtype=np.int64)
                    near = np.flatnonzero(bits <= limit)
                    smaller = keys[x][(keys[x] > 0) & (keys[x] < key[x])]
                    near = near[~np.isin(keys[y[near]], smaller).any(axis=1)]
                    if len(near):
                        found.append((np.minimum(rid[y[near]], rid[x]), np.maximum(rid[y[near]], rid[x]), bits[near]))
            if found:
                pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32))], ["a", "b", "bits"])

    own = opened.groupBy("rid", "root").agg(F.collect_list(F.struct("key", "n", "largest")).alias("open"))
    dealt = prints.join(own, "rid").select("rid", "root", "size", "long", F.col("open.key").alias("own_keys"), F.explode("open").alias("o")).select("*", "o.*")
    blocks, what = F.ceil(F.col("n") / BLOCK).cast("int"), ("rid", "root", "size", "long", "own_keys")
    here = dealt.select("key", F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("block"), F.lit(False).alias("roams"), *what)
    everywhere = dealt.where("root <> largest").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("roams"), *what)
    met = here.unionByName(everywhere).repartition("key", "block").sortWithinPartitions("key", "block")
    return met.mapInArrow(run, "a long, b long, bits int").distinct()


def nearest(pairs: DataFrame) -> DataFrame:
    """For each end of the pairs the nearest other end, so that a few verified pairs connect most."""
    ends = pairs.select("a", "b", "bits", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.min(F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    known = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return known.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "bits")


def bitmap_place(doc_id: Column) -> tuple[Column, Column]:
    """(slot, bit) of an id in a bitmap of SLOTS words."""
    h = F.pmod(F.xxhash64(doc_id), F.lit(64 * SLOTS))
    return F.floor(h / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))


def bitmap_of(nodes: DataFrame) -> DataFrame:
    """(slot, word): the bits of these ids' hashes; SLOTS rows at most, whatever their number, and so safe to broadcast."""
    slot, bit = bitmap_place(F.col("doc_id"))
    return nodes.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("word"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct (doc_id, text) of the documents with these distinct ids.

    A bitmap keeps most other texts out of the shuffle; the join decides. It is an inner one, as a
    semi-join would be pushed below the bitmap and shuffle every text.
    """
    slot, bit = bitmap_place(F.col("doc_id"))
    likely = docs.withColumn("slot", slot).join(F.broadcast(bitmap_of(nodes)), "slot").where(F.col("word").bitwiseAND(bit) != 0).select("doc_id", "text")
    return likely.join(nodes, "doc_id").distinct()


def similar_groups(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): components of texts whose sets of distinct shingles are at least that similar.

    Candidates come from fingerprints of 512 bits over distinct shingles. At a similarity of 0.8 about
    fifteen bits in a hundred differ, so that some of twelve 23-bit segments has two errors or fewer
    almost surely and its fuzzy keys meet; each goes with two min-hashes of the text. Recall is 0.99
    of pairs at 0.8 and more above (tests hold it against brute force). Pairs not too far apart as fingerprints are
    verified by the exact Jaccard similarity of their texts' whole shingle sets.

    Members of a bucket first meet its smallest id, mostly the same in all buckets of a group: the
    nearest such pair of each text is verified first, the others where they would still connect
    something. Then all pairs of a bucket that are not connected yet are compared, by fingerprints of
    2048 bits, and those near enough are verified, the nearest first again: nothing is capped, and connected groups are not listed by pairs. Texts with the same set
    are one from the start. Odd rows are treated as in ``near_duplicates``; wordless texts are one group.
    """
    docs, work = documents_of(df, id_col, text_col), Scratch(df.sparkSession)
    prints = work.store(sketches(docs, width))
    reps = work.store(prints.groupBy("digest").agg(F.min("doc_id").alias("rid")))
    known = work.store(prints.join(reps.where("rid is not null").select(F.col("rid").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "rid"))
    keys = known.select("rid", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("leader")).where("n > 1")
    members = work.store(keys.join(buckets, "key"))
    edges = roots = None

    def connect(found: DataFrame) -> None:
        nonlocal edges, roots
        new = verified(found, texts, width, similarity)
        edges = work.store(new if edges is None else edges.unionByName(new))
        roots = work.store(components(edges))

    led = work.store(near_enough(members.where("rid <> leader").select(F.col("leader").alias("a"), F.col("rid").alias("b")).distinct(), known, similarity))
    texts = work.store(texts_of(docs, led.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    connect(nearest(led))
    connect(apart(led, roots))
    crowded = members.where("n > 2").join(roots, F.col("rid") == roots.node, "left").select("key", "rid", F.coalesce("root", "rid").alias("root"))  # the pair of a bucket of two is among the led
    opened = work.store(open_members(crowded))
    if not opened.isEmpty():
        texts = work.store(texts_of(docs, opened.select(F.col("rid").alias("doc_id")).distinct()))
        rest = work.store(open_pairs(opened, long_fingerprints(texts, width), similarity).join(led.select("a", "b"), ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            connect(nearest(rest))
            connect(apart(rest, roots))
    groups = reps.join(roots, reps.rid == roots.node, "left").select("digest", F.coalesce("root", "rid").alias("component_id"))
    return work.last(prints.select("doc_id", "digest").join(groups, "digest").select("doc_id", "component_id"))


def keep_one_of_each(df: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df``, all columns, without those whose group of similar texts holds a smaller doc_id.

    Only rows whose id may be among the dropped ones, by a bitmap, are shuffled.
    """
    groups = similar_groups(df, width, similarity)
    dropped = groups.where("doc_id > component_id").select("doc_id").distinct()
    marked = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("doc_id"))
    slot, bit = bitmap_place(F.col("doc_id"))
    known = marked.withColumn("slot", slot).join(F.broadcast(bitmap_of(dropped)), "slot", "left")
    likely = F.coalesce(F.col("word").bitwiseAND(bit) != 0, F.lit(False))
    rows = known.where(~likely).select("row").unionByName(known.where(likely).join(dropped, "doc_id", "left_anti").select("row"))
    return rows.select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
