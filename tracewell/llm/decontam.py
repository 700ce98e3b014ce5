"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are sequences of words (lower-cased, cut at white space; letters of scripts written without
blanks are words of their own). A CGK random walk embeds a sequence: step j writes the word under a
pointer, and a random bit of (repetition, j, word) moves the pointer on or leaves it. Sequences at a
small edit distance fall in step again after an edit, so their embeddings differ in few places. The
walk over a window as long as the item takes twice as many steps as the item's size class has words
(classes are powers of two), so it covers the item's size. A repetition samples a few steps of its
own walk; its hash is the words written there. Repetition r starts the item's window at its r-th
longest word, as rare words make few candidates; a document's windows start wherever such a word
stands. Windows that share a repetition's hash with an item are verified: the smallest number of
word insertions, deletions and substitutions between the item and any stretch of the window, by
bit-parallel dynamic programming, must be at most ``max_edits`` of its words.

The number of repetitions is raised until ``target_recall`` of randomly edited copies of the items
themselves, at the full edit rate and among other items' words, are candidates. Items with copies
that are still missed after ``MAX_REPETITIONS``, and items below ``min_words``, are found without
loss: by pigeonhole, of one more piece than edits allowed at least one piece stands unchanged in
the document. Blocks of items of bounded size are indexed by tasks and stored. As many of these
indexes as AT_ONCE bytes hold go to the executors at a time and meet all documents in one narrow
pass, without a shuffle; only a benchmark whose indexes are larger takes another pass.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, documents_of, give_back, small_batches, store, text_rows

SAMPLES = 2
MAX_REPETITIONS = 32
#: Scripts written without blanks: Thai to Tibetan and Burmese, Khmer, kana, Han; a letter is a word.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
PIECES = re.compile(f"{UNSPACED.pattern}|[^\\s{UNSPACED.pattern[1:-1]}]+")
BLOCK_ITEMS, BLOCK_CHARS = 5000, 4_000_000
#: Words of the copies by which a size class's repetitions are chosen, about.
COPY_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    lower = (text or "").lower()
    return PIECES.findall(lower) if UNSPACED.search(lower) else lower.split()


def edit_distance_within(item: dict[int, int], n: int, window: list[int]) -> tuple[int, int]:
    """(least edit distance between the item and any stretch of the window, where that stretch ends).

    ``item`` maps a word to the bits of its places among the item's ``n`` words (Myers' algorithm,
    search form).
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for at, word in enumerate(window, 1):
        eq = item.get(word, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        right, left = minus | ~(h | plus) & full, plus & h
        score += (1 if right & top else 0) - (1 if left & top else 0)
        right, left = (right << 1) & full, (left << 1) & full
        plus, minus = left | ~(v | right) & full, right & v
        if score < best:
            best, end = score, at
    return best, end


ONE = np.uint64(1)
#: Blocks of 64 steps, and words of a vocabulary, up to which a walk's moves are kept rather than made anew.
KEPT_BLOCKS, KEPT_WORDS = 4, 1 << 19
#: Steps times words up to which a walk's moves are kept a byte each.
UNPACKED = 1 << 20


def random_bits(tokens: np.ndarray, seed: int, block: int) -> np.ndarray:
    """64 bits for each word: whether the walk ``seed`` moves on from it at the steps of a block of 64. No table of all steps is needed."""
    with np.errstate(over="ignore"):
        x = tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed + block * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Repetition:
    """One walk of one size class: the seed of its moves, the sampled steps, where windows start, hashes and their windows."""

    seed: int
    samples: np.ndarray
    anchors: np.ndarray
    keys: np.ndarray
    places: list[tuple[int, int]]
    tables: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    def moves(self, tokens: np.ndarray, block: int) -> tuple[np.ndarray, bool]:
        """(64 bits for each word of the vocabulary, True), kept for the first blocks of steps; else for each of the tokens, False."""
        if block not in self.tables and (len(self.tables) >= KEPT_BLOCKS or len(self.anchors) > KEPT_WORDS):
            return random_bits(tokens, self.seed, block), False
        if block not in self.tables:
            self.tables[block] = random_bits(np.arange(len(self.anchors)), self.seed, block)
        return self.tables[block], True

    def unpacked(self) -> np.ndarray:
        """(steps, words): whether the walk moves on, up to the last sampled step; for few words and steps."""
        if -1 not in self.tables:
            steps = np.arange(int(self.samples[-1]) + 1)
            bits = np.stack([random_bits(np.arange(len(self.anchors)), self.seed, b) for b in range(int(steps[-1]) // 64 + 1)])
            self.tables[-1] = ((bits[steps // 64] >> (steps % 64).astype(np.uint64)[:, None]) & ONE).astype(np.int8)
        return self.tables[-1]

    def hashes(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The sampled words of the walks from the positions ``at``, as one number each."""
        spot, key, until = at.copy(), np.zeros(len(at), np.uint64), int(self.samples[-1])
        tokens = np.concatenate([tokens, np.full(until + 1, tokens[-1])])  # walks go on at the last word
        wanted, small = set(self.samples.tolist()), (until + 1) * len(self.anchors) <= UNPACKED
        table, moves, by_word = self.unpacked() if small else None, np.zeros(0, np.uint64), True
        for j in range(until + 1):
            word = tokens.take(spot)
            if j in wanted:
                key = (key ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            if table is not None:
                spot += table[j].take(word)
                continue
            if j % 64 == 0:
                moves, by_word = self.moves(tokens, j // 64)
            bits = moves.take(word if by_word else spot)
            bits >>= np.uint64(j % 64)
            bits &= ONE
            spot += bits.view(np.int64)
        return key

    def candidates(self, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start of its window) that share a hash."""
        at = np.flatnonzero(self.anchors.take(tokens))
        if len(at) and len(self.keys):
            hashed = self.hashes(tokens, at)
            low, high = np.searchsorted(self.keys, hashed), np.searchsorted(self.keys, hashed, "right")
            for p in np.flatnonzero(high > low).tolist():
                for k in range(low[p], high[p]):
                    item, offset = self.places[k]
                    yield item, int(at[p]) - offset


@dataclass
class Index:
    """Items of one block, the repetitions of their size classes and the pieces of items that are found by these."""

    item_ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    repetitions: list[Repetition]
    pieces: dict[int, list[tuple[int, int, tuple[int, ...], int]]]  # rarest word of a piece -> (item, offset of the piece, the piece, place of the word in it)
    piece_words: np.ndarray
    slack: list[int]

    def candidates(self, tokens: np.ndarray) -> set[tuple[int, int]]:
        """(item, start of its window) of every repetition and every piece."""
        found = {c for r in self.repetitions for c in r.candidates(tokens)}
        for at in np.flatnonzero(self.piece_words.take(tokens)).tolist() if self.pieces else ():
            for item, offset, piece, place in self.pieces[int(tokens[at])]:
                low = at - place
                if low >= 0 and tuple(tokens[low : low + len(piece)].tolist()) == piece:
                    found.add((item, low - offset))
        return found

    def tokens(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))

    def matches(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item -> (distance, word where the best stretch ends), for each item within the edit bound."""
        tokens = self.tokens(text)
        if not len(tokens):
            return {}
        best: dict[int, tuple[int, int]] = {}
        for item, start in sorted(self.candidates(tokens)):
            n = len(self.words[item])
            slack = self.slack[item]
            if item in best and best[item][0] == 0:
                continue
            low, high = max(0, start - slack), min(len(tokens), start + n + slack)
            distance, end = edit_distance_within(self.masks(item), n, tokens[low:high].tolist())
            if distance <= slack and (item not in best or (distance, low + end) < best[item]):
                best[item] = (distance, low + end)
        return best

    def masks(self, item: int) -> dict[int, int]:
        known = self.__dict__.setdefault("_masks", {})
        if item not in known:
            own: dict[int, int] = {}
            for i, w in enumerate(self.words[item].tolist()):
                own[w] = own.get(w, 0) | 1 << i
            known[item] = own
        return known[item]


def build_index(items: list[tuple[int, str]], max_edits: float, min_words: int, target_recall: float, seed: int = 7) -> Index:
    """Index of a block's items; repetitions as the target recall needs."""
    kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in kept for w in ws}), 1)}
    coded = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws in kept]
    length = np.array([0, *map(len, sorted(vocabulary))])
    slack = [int(max_edits * len(c)) if len(c) >= min_words else 0 for c in coded]
    index = Index([i for i, _ in kept], coded, vocabulary, [], {}, np.zeros(len(vocabulary) + 1, bool), slack)
    rng = np.random.default_rng(seed)
    lost: list[int] = [i for i, c in enumerate(coded) if len(c) < min_words]
    for size in sorted({len(c).bit_length() - 1 for c in coded if len(c) >= min_words}):
        own = [i for i, c in enumerate(coded) if len(c) >= min_words and len(c).bit_length() - 1 == size]
        new, missed = repetitions_of(own, coded, size, length, max_edits, target_recall, rng)
        index.repetitions += new
        lost += missed
    for i in lost:
        item, n = coded[i].tolist(), len(coded[i])
        cuts = np.linspace(0, n, slack[i] + 2).astype(int).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            place = int(length[item[a:b]].argmax())
            index.pieces.setdefault(item[a + place], []).append((i, a, tuple(item[a:b]), place))
            index.piece_words[item[a + place]] = True
    return index


def repetitions_of(own: list[int], coded: list[np.ndarray], size: int, length: np.ndarray, max_edits: float, target_recall: float, rng: np.random.Generator) -> tuple[list[Repetition], list[int]]:
    """(repetitions of the items ``own`` of one size class, those of them with copies that all miss)."""
    steps, n_words = 2 << size, len(length)
    few = max(2, min(400 // len(own), COPY_WORDS // (len(own) << size)))  # copies of each, fewer of long items
    copies = [(i, edited(coded[i], max_edits, rng, n_words)) for i in own for _ in range(few)]
    inside = {i: max(1, len(coded[i]) - (1 << size) // 2) for i in own}
    offsets = {i: np.argsort(-length[coded[i][: inside[i]]], kind="stable") for i in own}
    out: list[Repetition] = []
    missing = copies
    while len(out) < MAX_REPETITIONS and (len(out) < 4 or len(missing) > (1 - target_recall) * len(copies)):
        r = len(out)
        samples = np.concatenate([[0], np.sort(rng.choice(np.arange(1, steps), SAMPLES, replace=False, p=early(steps)))])
        one = Repetition(int(rng.integers(1 << 63)), samples, np.zeros(n_words, bool), np.zeros(0, np.uint64), [])
        rows = []
        for i in own:
            o = int(offsets[i][r % len(offsets[i])])
            rows.append((int(one.hashes(np.append(coded[i], 0), np.array([o]))[0]), i, o))
            one.anchors[coded[i][o]] = True
        rows.sort()
        one.keys, one.places = np.array([k for k, _, _ in rows], np.uint64), [(i, o) for _, i, o in rows]
        out.append(one)
        missing = [(i, c) for i, c in missing if i not in {x for x, _ in one.candidates(c)}]
    return out, sorted({i for i, _ in missing}) if len(missing) > (1 - target_recall) * len(copies) else []


def early(steps: int) -> np.ndarray:
    """Weights of the steps 1 to steps - 1: every step of the window may be sampled, early ones, before most edits, more often."""
    w = 1.0 / np.arange(1, steps)
    return w / w.sum()


def edited(item: np.ndarray, rate: float, rng: np.random.Generator, n_words: int) -> np.ndarray:
    """A copy with ``rate`` of its words substituted, deleted or doubled, among other words of the vocabulary."""
    places = np.sort(rng.integers(0, len(item), int(rate * len(item))))
    parts, done = [rng.integers(0, n_words, 8)], 0
    for at, what, other in zip(places.tolist(), rng.integers(3, size=len(places)).tolist(), rng.integers(0, n_words, len(places)).tolist(), strict=True):
        parts.append(item[done : max(done, at)])
        parts.append(np.array([[other], [], [item[at], other]][what], np.int64))
        done = max(done, at + 1)
    return np.concatenate([*parts, item[done:], rng.integers(0, n_words, len(item) + 8)])


INDEXED = "block int, part int, payload binary"
#: Bytes of a row of a stored index, and of the indexes that go to the executors at a time.
PART, AT_ONCE = 1 << 24, 1 << 26


def stored_indexes(benchmark: DataFrame, max_edits: float, min_words: int, target_recall: float, scratch: Scratch, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(block, part, payload): the indexes of all blocks, built by tasks and stored; items are dealt to blocks by their hash."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.count("*").alias("items"), F.sum(F.length("t")).alias("chars")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-(size["chars"] or 0) // BLOCK_CHARS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "i", "t")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(block: int, items: list) -> Iterator[pa.RecordBatch]:
            raw = pickle.dumps(plain(build_index(items, max_edits, min_words, target_recall)), protocol=5)
            for k, a in enumerate(range(0, len(raw), PART)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([k], pa.int32()), pa.array([raw[a : a + PART]], pa.binary())], ["block", "part", "payload"])

        now, items = None, []
        for blocks, ids, texts in text_rows(batches, "block", "i", "t"):
            for block, i, t in zip(blocks, ids, texts, strict=True):
                if block != now and items:
                    yield from built(now, items)
                    items = []
                now = block
                items.append((i, t))
        if items:
            yield from built(now, items)

    return scratch.store(dealt.mapInArrow(build, INDEXED))


def rounds_of(stored: DataFrame) -> Iterator[list[Index]]:
    """Indexes of as many blocks as AT_ONCE bytes hold, one at least: what the driver and each executor have at a time."""
    held, sizes = [], 0
    for r in stored.groupBy("block").agg(F.sum(F.length("payload")).alias("n")).orderBy("block").collect():  # two numbers a block
        if held and sizes + r.n > AT_ONCE:
            yield loaded(stored, held)
            held, sizes = [], 0
        held.append(r.block)
        sizes += r.n
    if held:
        yield loaded(stored, held)


def loaded(stored: DataFrame, blocks: list[int]) -> list[Index]:
    rows = stored.where(F.col("block").isin(blocks)).orderBy("block", "part").collect()
    return [from_plain(pickle.loads(b"".join(r.payload for r in rows if r.block == b))) for b in blocks]  # noqa: S301  our own table


def plain(index: Index) -> tuple:
    """The index as arrays, lists and dictionaries, to be stored."""
    return (index.item_ids, index.words, index.vocabulary, [(r.seed, r.samples, r.anchors, r.keys, r.places) for r in index.repetitions], index.pieces, index.piece_words, index.slack)


def from_plain(x: tuple) -> Index:
    return Index(*x[:3], [Repetition(*r) for r in x[3]], *x[4:])


def find(df: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, min_words: int = 8, target_recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word): each item that a document holds within the edit bound.

    ``distance`` is the least word edit distance found; ``end_word`` counts the words up to the end
    of that stretch. Null and empty texts hold nothing; items with fewer than ``min_words`` words
    must stand there word by word, as similar phrases occur by chance; items without a word are in
    no text. Very long items are indexed and verified whole, in time that grows with the square of
    their words. Items with one text under several ids are found under each; of stretches at one
    distance the first counts. Rows of documents may repeat, and come back as often; very long texts are searched whole; other columns are not read;
    an empty table on either side gives an empty result.
    """
    docs, scratch = documents_of(df, id_col, text_col), Scratch(df.sparkSession)
    schema = "doc_id long, item_id long, distance int, item_words int, end_word int"

    def searched(held: list[Index]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in text_rows(batches, "doc_id", "text"):
                rows = [(d, index.item_ids[i], k, len(index.words[i]), end) for d, t in zip(ids, texts, strict=True) for index in held for i, (k, end) in sorted(index.matches(t).items())]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "item_id", "distance", "item_words", "end_word"])

        return run

    stored, found = stored_indexes(benchmark, max_edits, min_words, target_recall, scratch, item_col), []
    for held in rounds_of(stored):
        found.append(scratch.store(docs.mapInArrow(searched(held), schema)))
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    return scratch.last(reduce(DataFrame.unionAll, found)) if len(found) > 1 else scratch.only(found[0])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, min_words: int = 8, target_recall: float = 0.95, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns whatever their names, whose text holds no item.

    Null and empty texts and rows with a null id stay, repeated rows stay as often as they come; an
    empty table on either side changes nothing.
    """

    def kept(held: list[Index]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                    yield part.filter(pa.array([not any(index.matches(t) for index in held) for t in texts], pa.bool_()))
            give_back()

        return run

    small_batches(df.sparkSession)
    stored = stored_indexes(benchmark, max_edits, min_words, target_recall, Scratch(df.sparkSession))
    for k, held in enumerate(rounds_of(stored)):
        df = (store(df) if k else df).mapInArrow(kept(held), df.schema)
    return df
