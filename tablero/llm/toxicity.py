"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is a bag of sentences. Sentence s is toxic with probability p(s), a logistic function of the words and word beginnings that it
holds, and the document is toxic with probability 1 - prod(1 - p(s)) (noisy-or). Sentences without any known feature share at most ``PLAIN`` of
that probability, however many there are, so that length alone makes no text toxic. Weights are fitted to the document labels
through that formula, so that the model itself has to find which sentences carry the label; the same p(s) then locates them.

Training sees at most ``SAMPLE`` different labelled documents of the table, those with the smallest digests of id and text, and only rows whose crc32(id) mod 3
is not 1; they are written once to the shared folder. Features are hashed in the tasks that hold the texts; features are screened by counting documents, and only screened features reach the driver:
at most ``2**BITS`` numbers and, per sampled document, the sentences that hold one. Fitting is proximal gradient descent with an L1 penalty (a
feature must explain about ``PENALTY`` documents before it counts) and a small share of wrong labels built in. Scoring is one pass over whole texts.

Results for odd input: a null or empty text, or one without words, has score 0. Without usable labels every score is
that of the prior, at most ``PLAIN``. A repeated label counts once (the larger wins), a null label or one without a document not at all. Repeated rows
are learned from once and give one result row each; a null id is not held out and not trained on. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.llm.common import keyed, sampled, written

#: Labelled documents that training uses at most.
SAMPLE = 20_000
BITS = 20
#: Lengths of word beginnings.
STEMS = (3, 4, 5, 6)
#: A feature is screened in if it occurs in so many documents, so many of them toxic, and so many times as often toxic as the average.
MIN_DOCS, MIN_TOXIC, LIFT = 3, 2, 3.0
PENALTY, WRONG, STEPS, PRIOR = 0.2, 0.02, 300, -7.0
#: Log-odds that a sentence without any known feature keeps at most.
HIGHEST = -5.0
#: The share in a document's score that all its sentences without known features have together at most.
PLAIN = 0.1
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    return [crc32(f"w{word}".encode()) & mask, *(crc32(f"{k}{word[:k]}".encode()) & mask for k in STEMS if len(word) > k)]


class Known(dict):
    """Word to those of its features that a model uses; emptied when it has met a million words."""

    def __init__(self, used: frozenset[int] | None):
        super().__init__()
        self.used = used

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 1_000_000:
            self.clear()
        found = self[word] = tuple(x for x in features(word) if self.used is None or x in self.used)
        return found


def sentences(text: str, known: Known) -> Iterator[tuple[int, int, list[int]]]:
    """Start, end and sorted features of every sentence that holds a word."""
    for found in SENTENCE.finditer(text.lower() if len(text.lower()) == len(text) else text):
        words = WORD.findall(found.group())
        if words:
            own: set[int] = set()
            for word in words:
                own.update(known[word])
            yield found.start(), found.end(), sorted(own)


@dataclass
class Model:
    """Weights by feature, and the log-odds of a sentence without any."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = PRIOR

    def sentence(self, own: list[int]) -> float:
        return 1.0 / (1.0 + float(np.exp(-min(30.0, self.bias + sum(self.weights[x] for x in own)))))


def fit(bags: list[tuple[int, int, list[list[int]]]], counts: dict[int, tuple[int, int]], steps: int = STEPS, penalty: float = PENALTY, wrong: float = WRONG) -> Model:
    """From (label, number of sentences, features of those sentences that hold any) per document, and per feature the
    numbers of documents and of toxic documents. Those give the first weights: from zero weights the noisy-or has hardly any slope."""
    if not bags or not any(label for label, _, _ in bags):
        return Model()
    label = np.array([x[0] for x in bags], dtype=float)
    plain = np.array([count - len(rows) for _, count, rows in bags], dtype=float)
    doc = np.repeat(np.arange(len(bags)), [len(rows) for _, _, rows in bags])
    sizes = [len(row) for _, _, rows in bags for row in rows]
    names, column = np.unique(np.array([x for _, _, rows in bags for row in rows for x in row], dtype=np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    docs_of, toxic_of = np.array([counts[x] for x in names.tolist()], dtype=float).reshape(-1, 2).T
    base = min(label.mean(), 1 - 1e-9)
    weights = np.maximum(0, np.log((toxic_of + 0.5) / (docs_of - toxic_of + 0.5)) - np.log(base / (1 - base)))
    step, bias, most = 1.0 / (0.25 * docs_of + 1.0), PRIOR, float(np.log1p(-PLAIN))
    for _ in range(steps):
        z = bias + np.bincount(row, weights=weights[column], minlength=len(sizes))
        rest = -plain * np.logaddexp(0, bias)
        none = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(bags)) + np.maximum(rest, most)
        toxic = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        seen = wrong + (1 - 2 * wrong) * toxic
        slope = (label / seen - (1 - label) / (1 - seen)) * (1 - 2 * wrong) * (1 - toxic)
        own = slope[doc] / (1 + np.exp(-z))
        weights = weights + step * np.bincount(column, weights=own[row], minlength=len(names))
        weights = np.clip(np.sign(weights) * np.maximum(0, np.abs(weights) - penalty * step), -12, 12)
        bias = min(HIGHEST, bias + (own.sum() + (slope * plain)[rest > most].sum() / (1 + np.exp(-bias))) / len(bags))
    used = weights != 0
    return Model(dict(zip(names[used].tolist(), weights[used].tolist(), strict=True)), float(bias))


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """The model from the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = keyed(docs, key, text).withColumnRenamed(key, "key").withColumn("digest", F.xxhash64("text"))
    # Only ids and digests meet the labels; what is drawn from them has at most SAMPLE rows of three numbers, small enough for every task by definition.
    here = texts.select("key", "digest").distinct().join(known, "key")
    chosen = sampled(here, sample, "key", "digest")
    rows = written(texts.join(F.broadcast(chosen), ["key", "digest"]).dropDuplicates(["key", "digest"]).select("toxic", "text"))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Known(None)
        for batch in batches:
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sorted({x for _, _, found in sentences(value.as_py(), memo) for x in found})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([label] * len(own), pa.int32())], ["feature", "toxic"])

    sizes = rows.agg(F.count("*"), F.sum("toxic")).first()
    base = (sizes[1] or 0) / max(1, sizes[0])
    counted = rows.mapInArrow(every, "feature int, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    screened = counted.where((F.col("n") >= MIN_DOCS) & (F.col("bad") >= MIN_TOXIC) & (F.col("bad") >= F.col("n") * min(1.0, LIFT * base)))
    counts = {row[0]: (row[1], row[2]) for row in screened.select("feature", "n", "bad").collect()}
    used = frozenset(counts)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Known(used)
        for batch in batches:
            out: list[tuple[int, list[list[int]]]] = []
            for value in batch.column(1):
                own = [found for _, _, found in sentences(value.as_py(), memo)]
                out.append((len(own), [x for x in own if x]))
            arrays = [batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "n", "found"])

    return fit([tuple(row) for row in rows.mapInArrow(bags, "toxic int, n long, found array<array<int>>").collect()], counts)


def judge(text: str, model: Model, memo: Known, base: float) -> tuple[float, list[dict]]:
    """The score of one text, and its offending sentences."""
    none, plain, own = 0.0, 0, []
    for start, end, names in sentences(text, memo):
        if not names:
            plain += 1
            continue
        p = model.sentence(names)
        none += float(np.log1p(-min(p, 1 - 1e-12)))
        if p >= 0.5:
            own.append({"start": start, "end": end, "score": p})
    return float(-np.expm1(none + max(plain * np.log1p(-base), np.log1p(-PLAIN)))), own


def score_of(model: Model):
    """The score as a column function of a text column (null: as empty)."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, base = Known(frozenset(model.weights)), model.sentence([])
        for column in texts:
            yield pd.Series([judge(text or "", model, memo, base)[0] for text in column], dtype="float64")

    return score


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text held_out, score, predicted, and the offending sentences (start and end in characters, and their own score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Known(frozenset(model.weights))
        base = model.sentence([])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for value in batch.column(1):
                score, own = judge(value.as_py(), model, memo, base)
                scores.append(score)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(found, spans)], ["key", "held_out", "score", "offending"])

    rows = keyed(docs, key, text).withColumn("held_out", held_out(key))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, offending array<struct<start: long, end: long, score: double>>")
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
