"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to ``BUCKETS``.  Two
multinomials are estimated over the buckets with additive smoothing: one from
the trusted documents, one from the whole corpus.  A document's ratio is the
mean over its n-grams of log p(trusted) - log p(corpus), which makes it free of
the text's length.  A document is kept if the base rules pass and the ratio
reaches ``THRESHOLD``; the verdict depends on nothing but the tables.

The base rules: a document fails with fewer than 50 words, or if more than half
of its words lie in a three-word window found twice or more in it.

N-grams are counted inside the tasks, which send at most ``BUCKETS`` numbers
each; the sums (a table of fixed size) are broadcast to the pass that judges.
Only texts of trusted documents are shuffled, to meet their marks.

Defined cases: a null or empty text has no words and fails the base rules; a
text without n-grams has the ratio 0; with no trusted rows both multinomials
are the corpus's and every ratio is 0.  A document marked twice is trusted if
any mark says so.  Repeated rows are counted and judged each.  Extra columns of
the input stay in ``judged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import common, tokens

BUCKETS = 1 << 16
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Lowest mean log ratio of a kept document.
THRESHOLD = -0.15
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_BLANK = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def buckets(hashes: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every word and every pair of words."""
    pairs, first = tokens.windows(hashes, rows, 2)
    n = np.uint64(BUCKETS)
    return [((hashes % n).astype(np.int64), rows), ((pairs % n).astype(np.int64), rows[first])]


def repeated_words(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    window, first = tokens.windows(hashes, rows, 3)
    key = tokens.mix(window + rows[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    at = first[twice]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(rows[covered], minlength=n).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANK.encode()):
            seen.add(line)
    return n


def base_counts(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    chars = ~tokens.IS_SEPARATOR[data] & ((data & 0xC0) != 0x80)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    of_rows = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "word_chars": of_rows(total(chars)),
        "n_symbols": of_rows(total(_SYMBOL[data])),
        "n_dup_lines": np.array(
            [duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64
        ),
        "n_repeat_words": repeated_words(hashes, rows, n),
    }


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """bucket and the number of its n-grams; every task sends at most ``BUCKETS`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in tokens.pieces(batch.column(0)):
                starts, ends, rows = tokens.word_spans(data, offsets)
                for bucket, _ in buckets(tokens.hash_spans(data, starts, ends), rows):
                    total += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias(name))


def multinomials(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio of every bucket.  ``trusted`` has the ids of the trusted documents, each once."""
    # The filter keeps the texts of other documents out of the shuffle that the exact join needs.
    likely = common.likely_in(docs.select("doc_id", "text"), "doc_id", trusted)
    texts = likely.join(trusted.select("doc_id").hint("merge"), "doc_id")
    sums = bucket_counts(docs, "n").join(bucket_counts(texts, "n_trusted"), "bucket", "left").fillna(0)
    sums = sums.toArrow()  # at most BUCKETS rows
    total = np.zeros((2, BUCKETS))
    total[0][sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    total[1][sums.column("bucket").to_numpy()] = sums.column("n_trusted").to_numpy()
    if not total[1].any():
        total[1] = total[0]
    total += SMOOTHING
    log = np.log(total / total.sum(1, keepdims=True))
    return (log[1] - log[0]).astype(np.float32)


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents with the base counts, ``base_failed``, ``ratio`` and ``kept``."""
    sent = common.sent(docs.sparkSession, multinomials(docs, trusted))  # BUCKETS floats
    at = docs.columns.index("text")
    names = [*COUNTS, "base_failed", "ratio", "kept"]
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"the documents already have {sorted(clash)}")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, np.int64)] for name in COUNTS} | {"ratio": []}
            for lo, hi, data, offsets in tokens.pieces(batch.column(at)):
                starts, ends, rows = tokens.word_spans(data, offsets)
                hashes = tokens.hash_spans(data, starts, ends)
                for name, values in base_counts(data, offsets, hashes, rows).items():
                    parts[name].append(values)
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for bucket, row in buckets(hashes, rows):
                    total += np.bincount(row, weights=sent.value[bucket], minlength=hi - lo)
                    n += np.bincount(row, minlength=hi - lo)
                parts["ratio"].append(total / np.maximum(n, 1))
            got = {name: np.concatenate(v) if v else np.zeros(0) for name, v in parts.items()}
            words = got["n_words"]
            failed = (words < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEATED_PERCENT * words)
            ratio = np.round(got["ratio"], 9)
            kept = ~failed & (ratio >= threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(ratio), pa.array(kept)],
                [*batch.schema.names, *names],
            )

    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    added = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that any label calls good."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


@common.query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, trusted_ids(common.table(spark, sf_dir, "labels"))).drop("text")
