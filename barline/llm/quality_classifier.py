"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, then softmax.

Every word and every character n-gram (3 and 4 bytes, inside a word and its
borders) is hashed to one of ``BUCKETS`` learned vectors.  A document is the
mean of its vectors; a softmax layer over that mean gives the probability of
each label.  Vectors and softmax are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows that are not held out.

A word seen among the seven before it counts as the marker ``again`` and one
equal to its predecessor as ``twice`` besides, so that repetition has vectors
of its own.

The softmax of two labels over a mean is a logistic function of a mean of
numbers, one per bucket.  Scoring therefore sends one float per bucket to the
tasks, a table of fixed size, and reads each text once.

Defined cases: null and empty texts have no features and get the score of the
bias alone; labels other than 0 and 1 and null labels teach nothing; a document
labelled twice takes its smallest label; with no row of one label the score is
0.5 everywhere.  Repeated rows are scored each.  Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import common, tokens

#: Number of learned vectors.
BUCKETS = 1 << 16
DIM = 12
EPOCHS = 12
RATE = 0.6
#: Training rows taken of each label, and the longest text among them: the classifier's documented sample.
SAMPLE_PER_LABEL = 1500
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3

_MARKS = 2


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) arrays of every feature of the texts, one pair per kind of feature."""
    starts, ends, rows = tokens.word_spans(data, offsets)
    if not len(starts):
        return []
    room = np.uint64(BUCKETS - _MARKS)
    h = tokens.hash_spans(data, starts, ends)
    out = [((h % room).astype(np.int64), rows)]
    again = np.zeros(len(h), bool)
    for k in range(1, 8):
        same = (h[k:] == h[:-k]) & (rows[k:] == rows[:-k])
        again[k:] |= same
        if k == 1:
            twice = np.flatnonzero(same) + 1
            out.append((np.full(len(twice), BUCKETS - 1), rows[twice]))
    again = np.flatnonzero(again)
    out.append((np.full(len(again), BUCKETS - 2), rows[again]))
    # n-grams over the words, each word with one border byte on either side
    size = ends - starts + 2
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    text = np.full(int(at[-1]), 32, np.uint32)
    inner = np.ones(len(text), bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    text[inner] = data[~tokens.IS_SEPARATOR[data]]
    owner = np.repeat(rows, size)
    code = text.copy()
    for k in (1, 2, 3):
        code = code[:-1] * np.uint32(0x01000193) + text[k:]
        if k >= 2:
            # the last k - 1 borders inside an n-gram would mean that it spans two words
            whole = np.ones(len(code), bool)
            for j in range(1, k):
                whole &= inner[j : j + len(code)]
            c = code[whole] ^ np.uint32(k * 0x3C6EF35F & 0xFFFFFFFF)
            c = (c ^ (c >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            c ^= c >> np.uint32(13)
            out.append(((c % np.uint32(BUCKETS - _MARKS)).astype(np.int64), owner[: len(code)][whole]))
    return out


@dataclass
class Model:
    """One number per bucket (its vector against the difference of the two softmax columns) and a bias."""

    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi, data, offsets in tokens.pieces(column):
            total = np.zeros(hi - lo)
            count = np.zeros(hi - lo)
            for bucket, rows in features(data, offsets):
                total += np.bincount(rows, weights=self.weight[bucket], minlength=hi - lo)
                count += np.bincount(rows, minlength=hi - lo)
            logit = self.bias + total / np.maximum(count, 1)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def sparse(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct buckets and the share each has of the text's features."""
    out = []
    for lo, hi, data, offsets in tokens.pieces(column):
        found = features(data, offsets)
        for k in range(hi - lo):
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
        if not found:
            continue
        key = np.concatenate([rows * BUCKETS + bucket for bucket, rows in found])
        key, n = np.unique(key, return_counts=True)
        edge = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
        for k in range(hi - lo):
            a, b = edge[k], edge[k + 1]
            if b > a:
                out[lo + k] = (key[a:b] % BUCKETS, (n[a:b] / n[a:b].sum()).astype(np.float32))
    return out


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """The learned vectors with the output layer folded in; even scores where only one label occurs."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    vectors, out, bias = learned(texts, labels, epochs, rate, seed)
    weight = vectors @ (out[:, 1] - out[:, 0])
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]))


def learned(
    texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output layer and bias by stochastic gradient descent over the documents, one at a time.

    A step on one document moves each of its vectors by its share; ``rate`` is
    divided by the sum of squared shares, which makes a step on a long text as
    long as one on a short one.
    """
    docs = sparse(texts)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            bucket, share = docs[i]
            step = rate * (1 - steps / total)
            steps += 1
            mean = share @ vectors[bucket]
            z = mean @ out + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[labels[i]] -= 1
            back = out @ error
            if len(bucket):
                vectors[bucket] -= (step / float(share @ share) * 0.5 * share[:, None]) * back
            out -= (0.1 * step) * np.outer(mean, error)
            bias -= (0.02 * step) * error
    return vectors, out, bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``SAMPLE_PER_LABEL`` rows of each label, none of them held out.

    The ids of the sample come first (its size is a parameter, so they are
    broadcast); the texts are read by one scan and cross to the driver as text.
    Texts above ``SAMPLE_CHARS`` characters do not enter the fit; of the texts that
    share an id the smallest does.
    """
    marks = (
        labels.filter(F.col("quality").isin(0, 1) & ~common.held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    picked = None
    for label in (0, 1):
        part = marks.filter(F.col("quality") == label).orderBy(*order).limit(SAMPLE_PER_LABEL)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
        .orderBy("doc_id")
        .toArrow()
    )
    return fit(rows.column("text").combine_chunks(), rows.column("quality").to_numpy().astype(int))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """All columns of the documents, and the probability of label 1; an input column of that name gives way."""
    docs = docs.drop(score)
    sent = common.sent(docs.sparkSession, model)
    at = docs.columns.index("text")

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = sent.value.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, score])

    return docs.mapInArrow(score_batches, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    score = common.fresh("score")
    return scored(docs, train(docs, labels), score).filter(F.col(score) >= threshold).drop(score)


@common.query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored(docs, model).select(
        "doc_id",
        common.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
