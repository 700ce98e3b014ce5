"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of up to three bytes counts which byte followed. A byte's
probability in a context is its count over (count of the context + distinct bytes seen there);
a byte not seen there costs an escape, distinct over the same sum, and goes to the context
shortened by its first byte; below the empty context all 256 bytes are equally likely. A context
that a language never saw costs nothing and goes to the shorter one. Statistics are frozen after
learning, so a text's code length in a language is an exact sum over its bytes; the language with
the shortest code is predicted. Letters are lower-cased first.

Frozen trees of all languages are laid out as one automaton: a table from the last three bytes to
the longest context that any tree holds, and the code length of each byte there in each language.
Where that table would have more than ``MAX_CELLS`` cells, as with very many languages or letters,
the same lengths come from the sorted counts themselves: slower, nothing cut.

The classifier is fitted on a bounded sample: per language, of the distinct texts the
``per_language`` ones with the smallest text hashes, as far as they hold ``total_chars`` characters
in all; texts of any length are drawn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents_of, store, text_rows, worker_cache

ORDER = 3
STEP = 1 << 20
MAX_CELLS = 12_000_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass(frozen=True)
class SampleBound:
    """Documented bound of the fit."""

    per_language: int = 400
    total_chars: int = 4_000_000


@dataclass(frozen=True)
class Trees:
    """Counts of (context, byte) by language, as sorted arrays; ``symbols`` maps a byte to its number, 0 for bytes never seen."""

    languages: tuple[str, ...]
    symbols: np.ndarray
    grams: tuple[tuple[tuple[np.ndarray, np.ndarray], ...], ...]  # [language][order] -> (gram number, count)
    key: str

    @property
    def n_symbols(self) -> int:
        return int(self.symbols.max(initial=0)) + 1


def learn(texts: dict[str, list[str]]) -> Trees:
    """Trees of each language's texts."""
    raw = {lang: [np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), np.uint8) for t in own if t] for lang, own in sorted(texts.items())}
    raw = {lang: own for lang, own in raw.items() if own}
    seen = np.zeros(256, bool)
    for own in raw.values():
        for b in own:
            seen[b] = True
    symbols = np.where(seen, np.cumsum(seen), 0).astype(np.int64)
    n = int(seen.sum()) + 1
    grams = []
    for own in raw.values():
        per_order = []
        joined = np.concatenate([np.concatenate([np.zeros(ORDER, np.int64), symbols[b]]) for b in own])
        for k in range(ORDER + 1):
            code = np.zeros(len(joined) - ORDER, np.int64)
            whole = np.ones(len(code), bool)
            for j in range(ORDER - k, ORDER + 1):
                part = joined[j : len(joined) - ORDER + j]
                code = code * n + part
                whole &= part > 0
            per_order.append(np.unique(code[whole], return_counts=True))
        grams.append(tuple(per_order))
    mark = hashlib.sha256(repr((tuple(raw), symbols.tolist())).encode())  # of all that is learnt: workers keep tables by it
    for per in grams:
        for g, c in per:
            mark.update(g.tobytes() + c.tobytes())
    return Trees(tuple(raw), symbols, tuple(grams), mark.hexdigest())


def cells_of(trees: Trees) -> int:
    """Cells of the automaton's table."""
    n = trees.n_symbols
    return n * len(trees.languages) * sum(len(np.unique(np.concatenate([per[k][0] // n for per in trees.grams]))) for k in range(ORDER + 1) if trees.grams)


def automaton(trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(state of each triple of symbols, code length in bits by state * symbols + symbol and language)."""
    n, langs = trees.n_symbols, len(trees.languages)
    contexts = []  # by order: numbers of the contexts that any tree holds
    for k in range(ORDER + 1):
        codes = np.concatenate([per[k][0] // n for per in trees.grams]) if trees.grams else np.zeros(0, np.int64)
        contexts.append(np.unique(codes))
    start = np.cumsum([0, *map(len, contexts)])
    cost = np.full((int(start[-1]) or 1, n, max(langs, 1)), 8.0, np.float32)
    states = np.zeros(n**ORDER, np.int32)
    for k, own in enumerate(contexts):
        if not len(own):
            continue
        if k:  # begin with the shorter context's lengths
            shorter = contexts[k - 1]
            parent = np.searchsorted(shorter, own % n ** (k - 1))
            cost[start[k] : start[k + 1]] = cost[start[k - 1] + parent]
            states.reshape(-1, n**k)[:, own] = np.arange(start[k], start[k + 1])  # every triple that ends in the context
        for i, per in enumerate(trees.grams):
            gram, count = per[k]
            at = np.minimum(np.searchsorted(own, gram // n), len(own) - 1)
            kept = own[at] == gram // n
            at, symbol, count = at[kept], (gram % n)[kept], count[kept]
            seen = np.bincount(at, count, len(own))
            distinct = np.bincount(at, minlength=len(own))
            block = cost[start[k] : start[k + 1], :, i]
            here = seen > 0
            block[here] += -np.log2(distinct[here] / (seen[here] + distinct[here]))[:, None]
            block[at, symbol] = -np.log2(count / (seen[at] + distinct[at]))
    return states, cost.reshape(-1, max(langs, 1))


def sparse_tables(trees: Trees) -> list[list[tuple[np.ndarray, ...]]]:
    """By language and order: sorted grams and counts, sorted contexts with how often they were seen and how many bytes followed."""
    out = []
    for per in trees.grams:
        rows = []
        for gram, count in per:
            context, first, distinct = np.unique(gram // trees.n_symbols, return_index=True, return_counts=True)
            rows.append((gram, count, context, np.add.reduceat(count, first) if len(first) else count, distinct))
        out.append(rows)
    return out


def sparse_costs(x: np.ndarray, trees: Trees, tables: list[list[tuple[np.ndarray, ...]]]) -> np.ndarray:
    """Code length of each symbol from the fourth on, by language, straight from the counts."""
    n, here = trees.n_symbols, x[ORDER:]
    each = np.full((len(here), len(tables)), 8.0, np.float32)
    context, whole = np.zeros(len(here), np.int64), np.ones(len(here), bool)
    for k in range(ORDER + 1):
        if k:
            before = x[ORDER - k : len(x) - k]
            context = before * n ** (k - 1) + context
            whole &= before > 0
        for i, rows in enumerate(tables):
            gram, count, known, seen, distinct = rows[k]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            met = whole & (known[at] == context)
            place = np.minimum(np.searchsorted(gram, context * n + here), len(gram) - 1)
            held = met & (gram[place] == context * n + here)
            total = (seen + distinct)[at]
            each[:, i] += np.where(met, -np.log2(distinct[at] / total), 0.0).astype(np.float32)
            each[held, i] = -np.log2(count[place[held]] / total[held])
    return each


def code_lengths(texts: list[str], trees: Trees, states: np.ndarray, cost: np.ndarray, tables: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bits by text and language, bytes by text); with ``tables`` from them in place of the automaton."""
    n = trees.n_symbols
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    bits, size = np.zeros((len(texts), len(tables) if tables else cost.shape[1])), np.array([len(r) for r in raw], np.int64)
    held: list[tuple[int, bytes]] = []
    pad = b"\0" * ORDER
    nothing = np.zeros(ORDER, np.int64)

    def flush() -> None:
        parts = []
        for _, part in held:
            parts += [nothing if part[:ORDER] == pad else trees.symbols[np.frombuffer(part[:ORDER], np.uint8)], trees.symbols[np.frombuffer(part[ORDER:], np.uint8)]]
        x = np.concatenate(parts)
        if tables:
            each = sparse_costs(x, trees, tables)
        else:
            state = states[(x[: -ORDER] * n + x[1 : 1 - ORDER]) * n + x[2:-1]]
            each = cost[state.astype(np.int64) * n + x[ORDER:]]
        first = np.cumsum([0, *(len(part) for _, part in held)])[:-1]
        sums = np.add.reduceat(np.concatenate([each, np.zeros((ORDER, each.shape[1]), np.float32)]), np.stack([first, first + [len(p) - ORDER for _, p in held]], 1).reshape(-1), axis=0, dtype=np.float64)[::2]
        for (i, part), s in zip(held, sums, strict=True):
            if len(part) > ORDER:
                bits[i] += s
        held.clear()

    waiting = 0
    for i, r in enumerate(raw):
        for a in range(0, len(r), STEP):
            part = (pad if not a else r[a - ORDER : a]) + r[a : a + STEP]
            held.append((i, part))
            waiting += len(part)
            if waiting >= STEP:
                flush()
                waiting = 0
    if held:
        flush()
    return bits, size


def has_letter(text: str | None) -> bool:
    found = LETTER.search(text or "")
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def smallest_hashes(keyed: DataFrame, most: int) -> dict[str, list[tuple[int, int]]]:
    """(h, size) of each language's ``most`` smallest h, ascending, of (lang, h, size) with h distinct in a language.

    A language may hold most rows, so none is gathered in a task: hashes spread evenly, and those below
    the value that about twice ``most`` do not exceed reach the driver. Languages where that gives too few ask for more.
    """
    left, found, factor = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.count("*").alias("n")).collect()}, {}, 2
    while left:
        below = [(lang, min((1 << 63) - 1, (factor * most << 64) // n - (1 << 63))) for lang, n in left.items()]
        limits = keyed.sparkSession.createDataFrame(below, "lang string, below long")
        got: dict[str, list[tuple[int, int]]] = {lang: [] for lang in left}
        for r in keyed.join(F.broadcast(limits), "lang").where("h <= below").select("lang", "h", "size").collect():  # a row for each language is broadcast
            got[r.lang].append((r.h, r.size))
        for lang, own in got.items():
            if len(own) >= min(most, left[lang]):
                found[lang] = sorted(own)[:most]
                del left[lang]
        factor *= 2
    return found


def fit(df: DataFrame, bound: SampleBound | None = None, text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Learn from the rows whose text and language are not null."""
    bound = bound or SampleBound()
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    keyed = store(rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max(F.length("text")).cast("long").alias("size")))
    drawn = []
    for lang, own in sorted(smallest_hashes(keyed, bound.per_language).items()):
        ends = np.cumsum([size for _, size in own])
        drawn += [(lang, h) for i, (h, _) in enumerate(own) if not i or ends[i] <= bound.total_chars]
    if not drawn:
        return learn({})
    chosen = df.sparkSession.createDataFrame(drawn, "lang string, h long")
    texts: dict[str, list[str]] = {}
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])  # per_language rows for each language
    for r in sorted(found.groupBy("lang", "h").agg(F.first("text").alias("text")).collect()):
        texts.setdefault(r.lang, []).append(r.text)
    return learn(texts)


def predict(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt; ties go to
    the first language by name. The score is the language's share when code lengths count as those
    of thirty-two bytes at most, so that it stays comparable between short and long texts.
    Repeated rows and other columns change nothing.
    """

    dense = cells_of(trees) <= MAX_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, cost, tables = worker_cache(f"ppm:{trees.key}", lambda: (*automaton(trees), None) if dense else (np.zeros(0), np.zeros((0, 0)), sparse_tables(trees)))
        for ids, texts in text_rows(batches, "doc_id", "text"):
            bits, size = code_lengths([t or "" for t in texts], trees, states, cost, tables)
            known = np.array([bool(trees.languages) and has_letter(t) for t in texts])
            best = bits.argmin(axis=1)
            scale = np.minimum(1.0, 32 / np.maximum(size, 1))
            share = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * scale[:, None]).sum(axis=1)
            lang = [trees.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            rate = bits.min(axis=1) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, rate, 0.0))], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
