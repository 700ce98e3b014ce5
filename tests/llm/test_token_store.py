import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import bpe, token_counts, token_store

R = random.Random(4)
TEXTS = [
    None, "", " ", "a  b", "  lead", "x ", "it's we'll 's", "'sx'rex 've!'s", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext| >", "\n\n\na", "tab\tx y\r\n", "é¼ ²3 日本語", "don’t ’s", "word " * 5000,
    *("".join(R.choice(" \n\t'sreldvtm19,.!éß²\xa0\x85aB_ɏɐ") for _ in range(R.randrange(1, 60))) for _ in range(400)),
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.resolve("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    encoder = bpe.Encoder("byte_bpe_50k.json")
    for _ in range(2):  # the second time from the table
        for text, got in zip(TEXTS, encoder.encode(TEXTS), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library(text), text


def test_special_strings_as_text():
    t = Tokenizer.from_file(bpe.resolve("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "plain"]
    for text, got in zip(texts, bpe.Encoder("byte_bpe_50k.json", special_as_text=True).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_through_the_library(tmp_path):
    """A file with a normalizer, another cut or another model is not cut here."""
    word = Tokenizer.from_file(bpe.resolve("word_bpe_49k.json"))
    for change in (None, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path, own = bpe.resolve("word_bpe_49k.json"), word
        if change:
            path = str(tmp_path / f"{next(iter(change))}.json")
            with open(bpe.resolve("byte_bpe_50k.json")) as f, open(path, "w") as g:
                json.dump(json.load(f) | change, g)
            own = Tokenizer.from_file(path)
        encoder = bpe.Encoder(path)
        assert not encoder.cuts
        texts = [t for t in TEXTS if t]
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    assert bpe.Encoder("byte_bpe_50k.json").cuts


def test_table_starts_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 64)
    encoder = bpe.Encoder("byte_bpe_50k.json", room=64)
    for text, got in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text), text


def brute_optimal(counts, limit):
    """Least total length of a prefix code of bounded depth, by the coin collector's problem over explicit lists."""
    coins = []
    for level in range(limit, 0, -1):
        row = sorted([(c, {i: 1}) for i, c in enumerate(counts)] + coins, key=lambda x: x[0])
        coins = []
        for a, b in zip(row[::2], row[1::2], strict=False):
            merged = dict(a[1])
            for k, v in b[1].items():
                merged[k] = merged.get(k, 0) + v
            coins.append((a[0] + b[0], merged))
        last = row
    del level
    total = {}
    for _, own in last[: 2 * len(counts) - 2]:
        for k, v in own.items():
            total[k] = total.get(k, 0) + v
    return sum(counts[k] * v for k, v in total.items())


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_code_lengths_are_optimal_and_complete(limit):
    r = np.random.default_rng(limit)
    for n in (2, 3, 9, 14):
        counts = r.integers(1, 1000, n) ** 2
        lengths = token_store.limited_lengths(counts, limit).astype(int)
        assert lengths.max() <= limit and sum(2.0**-x for x in lengths) == 1
        assert int((counts * lengths).sum()) == brute_optimal(counts.tolist(), limit)
    assert token_store.limited_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    ids = np.minimum(r.geometric(0.01, 5000), 3000).astype(np.int64)
    lengths = token_store.limited_lengths(np.bincount(ids))
    codes = token_store.canonical_codes(lengths)
    table, bits = token_store.decode_table(lengths)
    blocks = [ids[:1], ids[1:700], ids[700:]]
    packed = [token_store.pack(b, lengths, codes) for b in blocks]
    for got, want in zip(token_store.unpack([p for p, _ in packed], [m for _, m in packed], list(map(len, blocks)), table, bits), blocks, strict=True):
        assert (got == want).all()


def test_files_give_back_every_document(spark, tmp_path, library, monkeypatch):
    rows = [(7 * i % 419, t, i, "clash") for i, t in enumerate(TEXTS)] + [(3, "twice", 0, ""), (3, "twice", 0, ""), (None, "no id", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(5)
    path = f"file://{tmp_path}/out"
    token_store.write_tokens(docs, path)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    known, at = {}, 0
    for d, t, *_ in rows:
        known.setdefault(d, []).append([*library(t), 2])
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)
    for r in got:
        assert r.start == at and r.ids in known[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.token_digests(docs, path=f"file://{tmp_path}/none").count() == 0


def test_token_counts_by_lines_and_rules(spark, library):
    texts = [None, "", "one line", "a b\nc  d\n\n", "é\n日本\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    got = token_counts.count_tokens(docs).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(library(t)) and own[-1].end == len(t or "")
        assert [r.end for r in own] == ([j + 1 for j, c in enumerate(t or "") if c == "\n"] + [len(t or "")] * (not (t or "").endswith("\n")))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_boundary_tokens_follow_the_rule():
    sizes, ends = np.array([2, 3, 1, 4]), np.array([3, 4, 10])  # the second token lies in all three sections: 1, 1 and 1 byte
    assert token_counts.attribute(sizes, ends, "start")[0].tolist() == [2, 0, 2]
    assert token_counts.attribute(sizes, ends, "majority")[0].tolist() == [2, 0, 2]
    assert np.allclose(token_counts.attribute(sizes, ends, "split")[0], [4 / 3, 1 / 3, 7 / 3])
    assert token_counts.attribute(sizes, ends, "split")[1].tolist() == [1, 1, 1]
    sizes, ends = np.array([3, 3]), np.array([1, 6])
    assert token_counts.attribute(sizes, ends, "start")[0].tolist() == [1, 1]
    assert token_counts.attribute(sizes, ends, "majority")[0].tolist() == [0, 2]


def test_pieces_of_one_hash_keep_their_own_ids():
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2^64."""
    encoder = bpe.Encoder(bpe.default_tokenizer())
    for n in (1024, 2048, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        for texts in ([word], [other], [other + " x", "y " + word, word + " " + other + " " + word]):
            want = [np.array(e.ids, "<u4").tobytes() for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
            assert encoder.encode(texts) == want
