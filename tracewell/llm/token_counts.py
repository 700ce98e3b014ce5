"""Token counts of the sections or fields of documents.

A whole document is encoded once. In a byte-level vocabulary an id stands for a fixed number of
bytes, so running sums of those give each token's span; the spans are joined with the sections'
byte intervals by binary search. A token that crosses a boundary is allocated by an explicit rule:

``start``     to the section of its first byte
``majority``  to the section with most of its bytes, the first among equals
``split``     to each section by its share of the bytes
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import small_batches, text_rows, worker_cache

RULES = ("start", "majority", "split")


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens of which a part lies outside) of each section.

    ``sizes`` are the tokens' bytes in order, ``ends`` the sections' ends in bytes, ascending; the
    last is the document's.
    """
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.minimum(np.searchsorted(ends, start, "right"), len(ends) - 1)
    last = np.minimum(np.searchsorted(ends, np.maximum(stop - 1, start), "right"), len(ends) - 1)
    crossing = np.flatnonzero(first != last)
    whole = first == last
    counts = np.bincount(first[whole], minlength=len(ends)).astype(np.float64)
    cut = np.zeros(len(ends), np.int64)
    for t in crossing.tolist():
        own = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[own], stop[t]) - np.maximum(np.concatenate([[0], ends])[own], start[t])
        cut[own[share > 0]] += 1
        if rule == "start":
            counts[first[t]] += 1
        elif rule == "majority":
            counts[own[share.argmax()]] += 1
        else:
            counts[own] += share / share.sum()
    return counts, cut


def count_tokens(df: DataFrame, tokenizer: str | None = None, fields: tuple[str, ...] = (), rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): one row for each section of every document.

    Without ``fields`` the sections are the text's lines, each with its newline. With ``fields``
    the document is these columns joined by newlines, each with the newline after it. Start and
    end count code points of the document. Null texts and fields count as empty; a document
    without a byte has one empty section. Very long texts are encoded whole; ties of ``majority``
    go to the first section. Rows and ids may repeat; other columns are not read; an empty table
    gives an empty result. The tokenizer must be byte-level and change no text.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    tokenizer = tokenizer or bpe.default_tokenizer()
    small_batches(df.sparkSession)
    names = fields or (text_col,)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"bpe:{tokenizer}", lambda: bpe.Encoder(tokenizer))
        if not encoder.byte_level:
            raise ValueError(f"{tokenizer}: ids of this tokenizer do not stand for bytes of the text")
        for ids, *columns in text_rows(batches, "doc_id", *(f"f{i}" for i in range(len(names)))):
            texts = ["\n".join(parts) for parts in zip(*columns, strict=True)]
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            lengths = []
            for text, parts, coded in zip(texts, zip(*columns, strict=True), encoder.encode(texts), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                if fields:
                    ends = np.cumsum([len(p.encode()) + 1 for p in parts])
                    ends[-1] -= 1
                else:
                    ends = np.flatnonzero(raw == 10) + 1
                    if not len(ends) or ends[-1] < len(raw):
                        ends = np.append(ends, len(raw))
                counts, cut = attribute(encoder.n_bytes[np.frombuffer(coded, "<u4")], ends, rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends] if len(raw) else np.zeros(len(ends), np.int64)
                for held, new in zip(out, (np.arange(len(ends)), np.concatenate([[0], chars[:-1]]), chars, counts, cut), strict=True):
                    held.append(new)
                lengths.append(len(ends))
            joined = [np.concatenate(x) for x in out]
            who = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), lengths)))
            yield pa.RecordBatch.from_arrays([who, *(pa.array(c, t) for c, t in zip(joined, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")
