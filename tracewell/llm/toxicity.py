"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence scores p = sigmoid(b + sum of the weights of its distinct words' features); a document scores
1 - prod(1 - p) over its sentences (noisy-or). Only documents carry labels: weights maximise the
labels' likelihood under the noisy-or, so that blame settles on the sentences that explain it.
Features of a word are the word itself and its first four, five and six letters.

The classifier is fitted on a bounded sample (``SampleBound``): of the distinct labelled texts of
each class, those with the smallest text hashes. Everything else, scoring above all, covers whole
texts and all rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents_of, give_back, small_batches, text_rows

SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class SampleBound:
    """Documented bound of the fit: texts of a class, and their characters in all; texts of any length are drawn."""

    per_class: int = 3000
    total_chars: int = 6_000_000


def within(drawn: list, total: int) -> list:
    """The first of the drawn rows whose sizes stay within the total, one at least."""
    chars, out = 0, []
    for r in drawn:
        chars += r.size
        if out and chars > total:
            break
        out.append(r)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    """The word, and each shorter beginning of it marked with a star."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def sentences_of(text: str) -> Iterator[set[str]]:
    """The distinct words of each sentence, lower-cased."""
    for sentence in SENTENCE.findall(text.lower()):
        yield set(WORD.findall(sentence))


def fit_noisy_or(texts: list[str], labels: np.ndarray, weight: np.ndarray, rounds: int = 250, rate: float = 0.1, l1: float = 1e-3, min_bags: int = 5, max_features: int = 20_000) -> ToxicityModel:
    """Weights of features from documents and their labels.

    Kept are features that occur in ``min_bags`` documents at least and significantly more often in
    positive ones. Full-batch Adam with soft thresholding; the bias starts low, as most sentences
    are clean. Texts are read twice, so that only counts and kept features are held.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, labels.tolist(), strict=True):
        seen[y].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    gain = {}
    for f, k in seen[1].items():
        if k + seen[0][f] >= min_bags:
            a, c, pooled = k / n1, seen[0][f] / n0, (k + seen[0][f]) / (n0 + n1)
            z = (a - c) / np.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n0 + 1 / n1))
            if z > 3:
                gain[f] = z
    del seen
    kept = sorted(gain, key=lambda f: (-gain[f], f))[:max_features]
    index = {f: i for i, f in enumerate(kept)}
    at_sentence, at_feature, bag_of = array("i"), array("i"), array("i")
    for b, text in enumerate(texts):
        for words in sentences_of(text):
            for w in words:
                for f in features(w):
                    if f in index:
                        at_sentence.append(len(bag_of))
                        at_feature.append(index[f])
            bag_of.append(b)
    if not kept:
        return ToxicityModel({}, -20.0)
    rows, cols, bag_at = (np.frombuffer(x, np.int32) for x in (at_sentence, at_feature, bag_of))
    w, b = np.zeros(len(kept)), -6.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, w[cols], len(bag_at))
        bag = np.bincount(bag_at, np.logaddexp(0, z), len(labels))
        pull = np.where(labels == 1, -1 / np.expm1(np.clip(bag, 1e-6, 500)), 1.0) * weight / total
        g = pull[bag_at] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cols, g[rows], len(kept)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b = b - step[-1]
    return ToxicityModel({f: float(x) for f, x in zip(kept, w, strict=True) if x != 0}, float(b))


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: SampleBound) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most ``2 * per_class`` distinct texts, and the number of distinct texts of each class."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("size"))  # whole texts of any length
    distinct = keyed.join(marks, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    counts = {int(r.toxic): r.n for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [r for c in (0, 1) for r in within(distinct.where(F.col("toxic") == c).orderBy("h").limit(bound.per_class).select("doc_id", "h", "toxic", "size").collect(), bound.total_chars)]
    if not drawn:
        return [], counts
    chosen = documents.sparkSession.createDataFrame([(r.doc_id, r.h, r.toxic) for r in drawn], "doc_id long, h long, toxic int")
    texts = documents.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("h"))  # at most 2 * per_class rows are broadcast
    rows = texts.groupBy("h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    return sorted((r.text, r.toxic) for r in rows), counts


def fit(df: DataFrame, labels: DataFrame, bound: SampleBound | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the rows of ``df`` that ``labels`` (id, 0 or 1) marks. Conflicting labels count as toxic; null ones not at all."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    sample, counts = labelled_sample(documents_of(df, id_col, text_col), marks, bound or SampleBound())
    y = np.array([label for _, label in sample], int)
    if len(set(y.tolist())) < 2:
        return ToxicityModel({}, -20.0)
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 1) / drawn[1], counts.get(0, 1) / drawn[0])
    return fit_noisy_or([text for text, _ in sample], y, weight)


class Weights(dict):
    """Word to the sum of its features' weights, filled as words come; bounded."""

    def __init__(self, model: ToxicityModel, room: int = 150_000):
        self.model, self.room = model.weights, room

    def __missing__(self, word: str) -> float:
        if len(self) >= self.room:
            self.clear()
        known = self.model
        self[word] = x = sum(known[f] for f in features(word) if f in known)
        return x


def score_text(text: str, weights: Weights, bias: float, offending: float = 0.5) -> tuple[float, list[dict]]:
    """(score, offending sentences with start, end and score; code points)."""
    lower = text.lower()
    if len(lower) != len(text):  # keep offsets: letters whose lower case is longer stay
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    clean, log_clean, spans, find, weigh = -np.logaddexp(0, bias), 0.0, [], WORD.findall, weights.__getitem__
    for m in SENTENCE.finditer(lower):
        words = find(m.group())
        if any(map(weigh, words)):  # a word counts once in a sentence
            z = sum(map(weigh, set(words)))
            q = -np.logaddexp(0, z + bias)
            p = -np.expm1(q)
            if p >= offending:
                spans.append({"start": m.start(), "end": m.end(), "score": float(p)})
            log_clean += q
        else:
            log_clean += clean
    return abs(float(np.expm1(log_clean))), spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sentences): of every whole text, with the spans of offending sentences.

    Null, empty and wordless texts have no sentence and score 0. Repeated rows score alike, each
    on its own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for ids, texts in text_rows(batches, "doc_id", "text"):
            got = [score_text(t or "", weights, model.bias) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], SPANS)], ["doc_id", "score", "sentences"])

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def drop_toxic(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns whatever their names, whose text scores below the threshold.

    Null, empty and wordless texts and rows with a null id stay; very long texts are scored whole;
    repeated rows stay or go together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array([score_text(t or "", weights, model.bias)[0] < threshold for t in texts], pa.bool_()))
        weights.clear()
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
