"""Byte-level BPE ids of whole texts by the tokenizers library, remembering what it returned for words.

The library spends most of its time on bookkeeping for each call, and words repeat. Texts whose
characters lie below U+0250 are cut into the tokenizer's own first pieces with array operations:
its pattern looks at nothing but whether characters are letters, numbers, white space or others.
Pieces are looked up by a 64-bit hash in an open-addressing table of ids and compared, character by
character, with the piece that was stored; those not seen before go through the library together,
and so do those whose hash another piece has taken. All other texts go through it whole, and so do
texts that hold the string of a special token, and every text where the tokenizer's file names a
normalizer, another cut into pieces or another model than this way of cutting stands for. Both ways
give the same ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The tokenizer's letters, numbers and white space below U+0250, and its contractions.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzªµº" + "".join(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7))
NUMBERS = "0123456789²³¹¼½¾"
SPACES = "\t\n\v\f\r \x85\xa0"
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

LIMIT = 0x250
OTHER, LETTER, NUMBER, SPACE, END = range(5)
KINDS = np.full(LIMIT + 1, OTHER, np.uint8)
for _kind, _chars in ((LETTER, LETTERS), (NUMBER, NUMBERS), (SPACE, SPACES)):
    KINDS[[ord(c) for c in _chars]] = _kind
KINDS[LIMIT] = END
BASE = 0xD1342543DE82EF95  # odd
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 1 << 18
#: Characters of remembered pieces at which the table starts anew.
POOL_CHARS = 1 << 25
RAMP = np.arange(STEP, dtype=np.int32)


def default_tokenizer() -> str:
    """The name under which the tokenizer's file is looked up on each machine."""
    return "byte_bpe_50k.json"


def resolve(tokenizer: str) -> str:
    """A path as it is; a bare name by the installed package of public tokenizers."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where the tokenizer's first pieces start in code points below LIMIT; LIMIT itself parts texts and belongs to none."""
    kind = KINDS[points]
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == SPACE
    before_word = np.zeros(len(kind), bool)  # the last white space before something else starts a piece
    before_word[:-1] = space[:-1] & ~space[1:] & (kind[1:] != END)
    start |= before_word
    joins = before_word & (points == 32)  # and a blank there belongs to what follows
    start[1:] &= ~joins[:-1]
    quotes = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    for at in quotes.tolist():  # no blank before, a letter after
        word = "".join(map(chr, points[at + 1 : at + 3].tolist()))
        size = next((len(c) for c in CONTRACTIONS if word.startswith(c)), 0)
        if size:
            start[at + 1] = False
            if at + 1 + size < len(start):
                start[at + 1 + size] |= kind[at + 1 + size] == LETTER
    start &= kind != END
    return np.flatnonzero(start)


def byte_level(setup: dict) -> bool:
    """Whether a tokenizer's file maps the bytes of a text as it stands to characters, so that ids stand for bytes."""
    cut = setup.get("pre_tokenizer") or {}
    return setup.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")


def cut_stands_for(setup: dict) -> bool:
    """Whether ``piece_starts`` finds the pieces that a tokenizer with this file would, each coded by itself."""
    model = setup.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    own = byte_level(setup) and setup["pre_tokenizer"].get("use_regex", True)
    return bool(own and model.get("type") == "BPE" and plain and not setup.get("truncation") and not setup.get("padding"))


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Bounded: the table starts anew when it holds ``room`` pieces.

    Special tokens' strings in a text become those tokens, as in the library, unless ``special_as_text``.
    """

    def __init__(self, tokenizer: str, room: int = 1 << 21, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(resolve(tokenizer))
        self.lib.encode_special_tokens = special_as_text
        added = self.lib.get_added_tokens_decoder()
        found = [t.content for t in added.values() if not (special_as_text and t.special)]
        self.marked = re.compile("|".join(map(re.escape, found)) or "(?!)")
        setup = json.loads(self.lib.to_str())
        self.byte_level, self.cuts = byte_level(setup), cut_stands_for(setup)
        vocab = self.lib.get_vocab()
        self.size = max(vocab.values(), default=-1) + 1
        self.n_bytes = np.zeros(self.size, np.int64)  # byte-level: a character of an entry stands for a byte
        for token, i in vocab.items():
            self.n_bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        self.room = max(room, STEP)  # one step's pieces always fit
        self.bits = (2 * self.room - 1).bit_length()
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(STEP + 1, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(STEP + 1, pow(BASE, -1, 1 << 64), np.uint64))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.held = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.pooled = 0
        self.begin = np.zeros(1 << 12, np.int32)
        self.length = np.zeros(1 << 12, np.int32)
        self.chars = np.zeros(1 << 14, np.uint16)
        self.n_chars = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, wanted: list[str]) -> list[np.ndarray]:
        """The ids of each piece. Those that start with a blank go through the library side by side and are cut where their bytes end."""
        out: list = [None] * len(wanted)
        spaced = [i for i, p in enumerate(wanted) if p[0] == " " and len(p) > 1]
        for a in range(0, len(spaced), 256):
            group = spaced[a : a + 256]
            (ids,) = self._library(["".join([wanted[i] for i in group])])
            ends = np.cumsum(self.n_bytes[ids])
            want = np.cumsum([len(wanted[i].encode()) for i in group])
            at = np.searchsorted(ends, want)
            if len(ids) and at[-1] < len(ends) and (ends[at] == want).all():
                for i, x, y in zip(group, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist(), strict=True):
                    out[i] = ids[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._library([wanted[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash's ids, or -1."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        place = np.where(got == hashes, self.slots[at], -1)
        open_ = np.flatnonzero((got != hashes) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.keys[at[open_]]
            hit = got == hashes[open_]
            place[open_[hit]] = self.slots[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return place

    def _append(self, pieces: list[str]) -> np.ndarray:
        """The places of these pieces, whose characters and ids are added."""
        ids, n = self._pieces(pieces), len(pieces)
        size, length = np.fromiter(map(len, ids), np.int64, n), np.fromiter(map(len, pieces), np.int64, n)
        until, last = self.pooled + int(size.sum()), self.n_chars + int(length.sum())
        self.first, self.count, self.pool = grown(self.first, self.held + n), grown(self.count, self.held + n), grown(self.pool, until)
        self.begin, self.length, self.chars = grown(self.begin, self.held + n), grown(self.length, self.held + n), grown(self.chars, last)
        new = slice(self.held, self.held + n)
        self.first[new], self.count[new] = self.pooled + np.cumsum(size) - size, size
        self.begin[new], self.length[new] = self.n_chars + np.cumsum(length) - length, length
        self.pool[self.pooled : until] = np.concatenate(ids)
        self.chars[self.n_chars : last] = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        self.held, self.pooled, self.n_chars = self.held + n, until, last
        return np.arange(new.start, new.stop)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Add distinct hashes that the table lacks."""
        number, mask = self._append(pieces), (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, one = np.unique(at[free], return_index=True)
            own = free[one]
            self.keys[at[own]] = hashes[own]
            self.slots[at[own]] = number[own]
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = (at[left] + (self.keys[at[left]] != 0)) & mask

    def _strangers(self, place: np.ndarray, length: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Pieces that differ from what is stored in their places; ``points`` are all pieces' characters in order."""
        same = self.length[place] == length
        until = np.cumsum(length)
        if same.all():
            at = np.repeat((self.begin[place] - (until - length)).astype(np.int32), length)
            at += RAMP[: len(at)]
            other = np.flatnonzero(self.chars.take(at) != points)
            return np.unique(np.searchsorted(until, other, "right"))
        sure = np.flatnonzero(same)
        inside = np.repeat(same, length)
        return np.union1d(np.flatnonzero(~same), sure[self._strangers(place[sure], length[sure], points[inside])])

    def _encode_step(self, joined: str, points: np.ndarray, text_starts: np.ndarray) -> list[bytes]:
        if max(self.held - self.room, self.n_chars - POOL_CHARS) > 0:
            self._clear()
        starts = piece_starts(points)
        after = np.append(starts[1:], len(points))
        ends = np.where(points[after - 1] == LIMIT, after - 1, after)
        while len(ends) and (more := np.flatnonzero((ends > starts) & (points[np.maximum(ends - 1, 0)] == LIMIT))).size:
            ends[more] -= 1  # empty texts between
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint32(1)).astype(np.uint64) * self.power[: len(points)])])
            hashes = ((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)) * MIX
            hashes ^= hashes >> np.uint64(31)
            hashes *= MIX
        hashes[hashes == 0] = 1
        place = self._find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.held + len(new) > self.room:
                self._clear()
                new, at = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            spans = zip(starts[missing[at]].tolist(), ends[missing[at]].tolist(), strict=True)
            self._learn(new, [joined[a:b] for a, b in spans])
            place = self._find(hashes)
        odd = self._strangers(place, ends - starts, points.astype(np.uint16)[KINDS[points] != END])
        if len(odd):
            place[odd] = self._append([joined[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
        size = self.count[place].astype(np.int64)
        until = np.cumsum(size)
        flat = np.arange(until[-1] if len(until) else 0) + np.repeat(self.first[place] - (until - size), size)
        ids = self.pool[flat].astype("<u4")
        cuts = np.concatenate([[0], until])[np.searchsorted(starts, np.append(text_starts, len(points)))].tolist()
        raw = memoryview(ids).cast("B")
        return [bytes(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text; of none for null."""
        out: list[bytes] = [b""] * len(texts)
        held: list[int] = []
        chars = 0

        def flush() -> None:
            joined = chr(LIMIT).join(texts[i] for i in held)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            sizes = np.array([len(texts[i]) for i in held])
            starts = np.cumsum(sizes + 1) - sizes - 1
            for i, ids in zip(held, self._encode_step(joined, points, starts), strict=True):
                out[i] = ids

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or self.marked.search(text) or len(text) >= STEP or not (text.isascii() or np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < LIMIT):
                out[i] = self._library([text])[0].astype("<u4").tobytes()
                continue
            if chars + len(text) + len(held) >= STEP:
                flush()
                held, chars = [], 0
            held.append(i)
            chars += len(text)
        if held:
            flush()
        return out


def grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])
