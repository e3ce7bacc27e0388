"""Benchmark decontamination by latent semantic retrieval.

1. All passages are written once as the buckets (``BUCKETS``) of their hashed
   words and how often each occurs.  Word frequencies over the whole corpus give
   every bucket its inverse frequency.
2. A distributed randomised singular value decomposition of TF-IDF passages:
   a Gaussian start, then power steps.  Each step is one job in which the tasks
   multiply their own rows and the products are summed by blocks of buckets; the
   driver orthonormalises a ``BUCKETS x RANK`` matrix, whose size is fixed.  The
   rows are all passages of all documents and every benchmark item, weighted up
   so that the space spans what is searched for.
3. All passages of all documents (windows of 8, 16, 32 and 64 words, every
   quarter of that) are projected and compared by cosine with the items of like
   length; lengths that no item calls for are left out.  An item longer than
   the longest passage is compared by overlapping parts of that length.  Pairs
   from the item's own least cosine up are candidates: it is what variants of
   the item with ``REPLACED`` of the words replaced, planted among words of the
   corpus, reach in all but ``MISSED`` of the trials, and ``COSINE`` at most.  The
   items are the stated query set and go through in blocks.
4. The candidates of one item that lie near one another make one region of the
   text, wide enough for the item to begin or end in any of them.  It is a leak
   if on some stretch of the region (96 words, or twice the item's words where
   that is more) the longest common subsequence with the item has ``WHOLE`` of
   the item's words, or ``PART`` of them while the stretch holds ``ANSWER`` of
   the words of the item's answer (its last sentence).  Dropped, added and
   replaced words only shorten the subsequence.

The corpus is read twice, once for step 1 and once for steps 3 and 4, without a
shuffle of texts.

Defined cases: null and empty texts and items have no passage and match
nothing; an item of one sentence is its own answer; documents and items that
repeat are reported each; an empty benchmark leaves everything.  Extra columns
stay in ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common, tokens

BUCKETS = 1 << 15
RANK = 80
EXTRA = 16
POWER_STEPS = 2
#: Weight of an item's rows; beyond so many documents its square grows with their number.
ITEM_WEIGHT = 3.0
ITEM_DOCS = 1500
#: Passages in a written row and in one multiplication.
_ROW, _TIMES = 48, 24
#: Words between stretches that are judged.
STEP = 16
#: Words of the passages; the next starts a quarter of that further on.
LENGTHS = (8, 16, 32, 64)
#: Least words of the stretches that are judged, and their length in items.
STRETCH = 6 * STEP
SPREAD = 2
COSINE = 0.75
#: Trials with each item for its least cosine, the share of words they replace, and the trials that may fall below.
TRIALS = 20
REPLACED = 0.3
MISSED = 1
WHOLE = 0.65
PART = 0.45
ANSWER = 0.8
ITEM_BLOCK = 4096
SEED = 7
_BLOCK = 128


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def corpus_weights(made: DataFrame) -> np.ndarray:
    """Inverse frequency of every bucket over all words of all documents, from their ``passages``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for batch in batches:
            bucket, times = (np.frombuffer(b"".join(c.to_pylist()), k) for c, k in zip(batch.columns, (np.uint16, np.uint8), strict=True))
            total += np.bincount(bucket, times, BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found].astype(np.int64))], ["bucket", "n"])

    counts = made.select("bucket", "times").mapInArrow(count, "bucket long, n long")
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS)
    n[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return np.log((n.sum() + BUCKETS) / (n + 1)).astype(np.float32)


def passage_counts(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive passages of ``size`` words: their buckets, how often each occurs, and how many buckets each passage has."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    words = np.diff(np.append(np.flatnonzero(place % size == 0), len(rows)))
    wide = np.full((len(words), size), BUCKETS, np.uint16)
    wide[np.arange(size) < words[:, None]] = word_buckets(hashes)
    wide.sort(axis=1)
    bucket, passage = wide[wide < BUCKETS], np.repeat(np.arange(len(words)), words)
    at = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (passage[1:] != passage[:-1])]))
    times = np.diff(np.append(at, len(bucket)))
    return bucket[at], times.astype(np.uint8), np.bincount(passage[at], minlength=len(words)).astype(np.uint8)


def passages(docs: DataFrame) -> DataFrame:
    """bucket, times, distinct: ``passage_counts`` of all texts, packed, ``_ROW`` passages or fewer in a row."""

    def packed(data: np.ndarray, edge: np.ndarray) -> pa.Array:
        offsets = (edge * data.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tokens.pieces(batch.column(0), limit=1 << 17):
                data = folded(data)
                starts, ends, row = tokens.word_spans(data, offsets)
                if not len(starts):
                    continue
                bucket, times, distinct = passage_counts(tokens.hash_spans(data, starts, ends), row, LENGTHS[-1])
                edge = np.append(np.arange(0, len(distinct), _ROW), len(distinct))
                inner = np.concatenate([[0], np.cumsum(distinct, dtype=np.int64)])[edge]
                yield pa.RecordBatch.from_arrays(
                    [packed(bucket, inner), packed(times, inner), packed(distinct, edge)], ["bucket", "times", "distinct"]
                )

    return docs.select("text").mapInArrow(run, "bucket binary, times binary, distinct binary")


def gram_times(rows: DataFrame, weight, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, where A has a TF-IDF row of unit length times ``scale`` for every passage; summed over tasks by blocks of buckets."""
    sent = common.sent(rows.sparkSession, basis)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, idf = sent.value, weight.value
        total, rank, held = np.zeros_like(q), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in batches:
            for scale, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bucket, times, distinct = (np.frombuffer(x, k) for x, k in zip(packed, (np.uint16, np.uint8, np.uint8), strict=True))
                edge = np.concatenate([[0], np.cumsum(distinct, dtype=np.int64)])
                passage = np.repeat(np.arange(len(distinct)), distinct)
                value = times * idf[bucket]
                value = value * (scale / np.sqrt(np.add.reduceat(value * value, edge[:-1])))[passage]
                # a dense matrix of few passages and the buckets that they have
                for lo in range(0, len(distinct), _TIMES):
                    n = min(_TIMES, len(distinct) - lo)
                    part = slice(edge[lo], edge[lo + n])
                    held[bucket[part]] = True
                    own = np.flatnonzero(held)
                    held[own] = False
                    rank[own] = np.arange(len(own))
                    a = np.zeros((n, len(own)), np.float32)
                    a[passage[part] - lo, rank[bucket[part]]] = value[part]
                    total[own] += a.T @ (a @ q.take(own, axis=0))
        blocks = total.reshape(-1, _BLOCK, q.shape[1])
        some = np.flatnonzero(blocks.any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "part"]
        )

    def add(key, table):
        parts = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("part").to_pylist()], axis=0)
        return pa.table({"block": [key[0].as_py()], "part": pa.array([parts.astype(np.float32).tobytes()], pa.binary())})

    kind = "block long, part binary"
    got = rows.select("scale", "bucket", "times", "distinct").mapInArrow(multiply, kind).groupBy("block").applyInArrow(add, kind).toArrow()
    common.take_back(sent)
    out = np.zeros((BUCKETS // _BLOCK, _BLOCK, basis.shape[1]))
    for k, part in zip(got.column("block").to_pylist(), got.column("part").to_pylist(), strict=True):
        out[k] = np.frombuffer(part, np.float32).reshape(_BLOCK, -1)
    return out.reshape(BUCKETS, -1)


def latent_space(docs: DataFrame, items: DataFrame, weight, made: DataFrame | None = None) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages, ``BUCKETS x RANK``; ``made``: the written passages, removed afterwards."""
    if made is None:
        made = common.settle(passages(docs), "passages")
    # Every task gives a sum of the size of the basis, so there are few more than cores.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, len(made.inputFiles()) // 16)
    up = ITEM_WEIGHT * max(1.0, docs.count() / ITEM_DOCS) ** 0.5
    rows = made.coalesce(tasks).withColumn("scale", F.lit(1.0)).unionByName(passages(items.coalesce(1)).withColumn("scale", F.lit(up)))
    product = np.random.default_rng(SEED).standard_normal((BUCKETS, RANK + EXTRA))
    for _ in range(POWER_STEPS):
        product = gram_times(rows, weight, np.linalg.qr(product)[0].astype(np.float32))
    common.release(made)
    basis, inner = np.linalg.qr(product)
    return (basis @ np.linalg.svd(inner)[0][:, :RANK]).astype(np.float32)


@dataclass
class Item:
    item_id: object
    words: int
    masks: dict[int, int]
    answer: frozenset[int]

    def __post_init__(self) -> None:
        own = sorted(self.answer.union(self.masks))
        #: The different words of the item and its answer, ascending, and how often the item has each.
        self.vocabulary = np.array(own, np.uint64), np.array([self.masks.get(w, 0).bit_count() for w in own], np.int64)

    @property
    def stretch(self) -> int:
        """Words of the stretches of text that the item is judged on, in whole steps."""
        return max(STRETCH, -(-SPREAD * self.words // STEP) * STEP)


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def common_subsequence(masks: dict[int, int], words: list[int], n: int) -> int:
    """Length of the longest common subsequence, one machine word operation for each word of the passage."""
    row = (1 << n) - 1
    full = row
    for w in words:
        m = masks.get(w)
        if m is not None:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def lengths_for(n: int) -> list[int]:
    """The passage lengths that an item or part of ``n`` words is compared with."""
    return [x for x in LENGTHS if 0.6 * n < x <= 1.5 * n] or [LENGTHS[0]]


def range_of_lengths(used: dict) -> list[int]:
    return [x for x in LENGTHS if min(used) <= x <= max(used)]


def joined(sums: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Each row and the one ``k`` further on, if that is of the same text."""
    out = sums.copy()
    if len(sums) > k:
        out[:-k] += sums[k:]
        other = np.flatnonzero(owner[k:] != owner[:-k])
        out[other] = sums[other]
    return out


def projected(projection: np.ndarray, buckets: np.ndarray, step: np.ndarray, unit: int) -> np.ndarray:
    """Sums of the words' projections from each step up to the next, ``unit`` words or fewer.

    Some steps at a time: the rows of all words are many times their sums.
    """
    out = np.empty((len(step), projection.shape[1]), projection.dtype)
    end = np.append(step[1:], len(buckets))
    for lo in range(0, len(step), _BLOCK):
        at, to, sums = step[lo : lo + _BLOCK], end[lo : lo + _BLOCK], out[lo : lo + _BLOCK]
        projection.take(buckets[at], axis=0, out=sums, mode="clip")
        for k in range(1, unit):
            row = projection.take(buckets.take(at + k, mode="clip"), axis=0, mode="clip")
            row[np.flatnonzero(at + k >= to)] = 0
            sums += row
    return out


def least_cosine(projection: np.ndarray, draw: np.ndarray, buckets: np.ndarray, vector: np.ndarray, rng) -> float:
    """What variants of an item reach among words of the corpus; ``draw`` is the running share of each bucket."""
    n, wide = len(buckets), max(lengths_for(len(buckets)))
    words = np.searchsorted(draw, rng.random((TRIALS, n + 2 * wide)), side="right").clip(max=BUCKETS - 1)
    kept = np.where(rng.random((TRIALS, n)) < REPLACED, words[:, wide : wide + n], buckets)
    words[:, wide : wide + n] = kept
    sums = np.zeros((TRIALS, words.shape[1] + 1, projection.shape[1]), np.float32)
    np.cumsum(projection[words], axis=1, out=sums[:, 1:])
    best = np.zeros(TRIALS)
    for length in lengths_for(n):
        places = (np.arange(0, words.shape[1] - length + 1 - length // 4, length // 4)[None, :] + rng.integers(0, length // 4, (TRIALS, 1)))
        trial = np.arange(TRIALS)[:, None]
        passage = sums[trial, places + length] - sums[trial, places]
        best = np.maximum(best, ((passage @ vector) / np.maximum(np.linalg.norm(passage, axis=2), 1e-9)).max(axis=1))
    return min(COSINE, float(np.sort(best)[MISSED]))


@dataclass
class Index:
    """Projection of words, the items and their projected parts.

    Of each part its item, words and least cosine; if not given, items have one part each and ``COSINE``.
    """

    projection: np.ndarray
    items: list[Item]
    vectors: np.ndarray
    part_of: np.ndarray | None = None
    sizes: np.ndarray | None = None
    least: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.part_of is None:
            self.part_of = np.arange(len(self.items))
            self.sizes = np.array([min(i.words, LENGTHS[-1]) for i in self.items], np.int64)
            self.least = np.full(len(self.items), COSINE, np.float32)
        self.by_length = {x: np.array([k for k, n in enumerate(self.sizes.tolist()) if x in lengths_for(n)], np.int64) for x in LENGTHS}
        self.by_length = {x: k for x, k in self.by_length.items() if len(k)}
        self.stretches = np.array([i.stretch for i in self.items], np.int64)

    def leaks(self, column: pa.Array) -> list[list[tuple]]:
        """Per text: (item_id, cosine, common words, item words, answer words found) of its leaks, best passage of each item."""
        out: list[list[tuple]] = []
        for lo, hi, data, offsets in tokens.pieces(column, limit=1 << 18):
            found: list[dict] = [{} for _ in range(hi - lo)]
            for k, item, cosine, text in self._candidates(folded(data), offsets):
                got = self._judge(item, text)
                if got is None:
                    continue
                best = found[k].get(item)
                if best is None or (got, cosine) > best:
                    found[k][item] = (got, cosine)
            for one in found:
                rows = []
                for item, ((lcs, answered), cosine) in sorted(one.items()):
                    i = self.items[item]
                    rows.append((i.item_id, round(float(cosine), 4), lcs, i.words, answered))
                out.append(rows)
        return out

    def _candidates(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """(row, item, best cosine, words) of every region of a text in which an item may lie."""
        starts, ends, rows = tokens.word_spans(data, offsets)
        if not len(starts) or not self.items:
            return
        hashes = tokens.hash_spans(data, starts, ends)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        last = np.append(first[1:], len(rows))
        text = np.repeat(np.arange(len(first)), last - first)
        place = np.arange(len(rows)) - first[text]
        unit = min(self.by_length) // 4
        step = np.flatnonzero(place % unit == 0)
        total = projected(self.projection, word_buckets(hashes), step, unit)
        for k in (1, 2):
            total = joined(total, text[step], k)
        hits = []
        for length in range_of_lengths(self.by_length):
            if length in self.by_length:
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), 1e-9)
                chosen = self.by_length[length]
                for block in range(0, len(chosen), ITEM_BLOCK):
                    parts = chosen[block : block + ITEM_BLOCK]
                    close = total @ self.vectors[parts].T
                    close /= norm[:, None]
                    p, i = np.divmod(np.flatnonzero(close >= self.least[parts]), len(parts))
                    hits.append((text[step[p]], self.part_of[parts[i]], step[p], step[p] + length, close[p, i]))
            # passages of twice the length, half as many
            both = joined(total, text[step], 4)
            keep = place[step] % (length // 2) == 0
            total, step = both[keep], step[keep]
        for t, item, begin, end, cosine in self._regions(hits, first, last):
            yield int(rows[first[t]]), item, cosine, hashes[begin:end]

    def _regions(self, hits: list[tuple], first: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
        """Hits of an item, each widened by a stretch on both sides within its text; those that meet are one."""
        text, item, begin, end, cosine = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(text):
            return
        reach = self.stretches[item]
        begin = first[text] + np.maximum(begin - reach - first[text], 0) // STEP * STEP
        end = np.minimum(end + reach, last[text])
        order = np.lexsort((begin, item, text))
        text, item, begin, end, cosine = (x[order] for x in (text, item, begin, end, cosine))
        group = np.cumsum(np.concatenate([[False], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) * (int(last[-1]) + 1)
        reached = np.maximum.accumulate(group + end)
        edge = np.flatnonzero(np.concatenate([[True], (group + begin)[1:] > reached[:-1]]))
        columns = text[edge], item[edge], begin[edge], np.maximum.reduceat(end, edge), np.maximum.reduceat(cosine, edge)
        yield from zip(*(x.tolist() for x in columns), strict=True)

    def _judge(self, item: int, words: np.ndarray) -> tuple[int, int] | None:
        """The most common words and answer words of an accepted stretch."""
        it = self.items[item]
        # Words that the item has not never count, and a subsequence has no word more often than either side.
        own, times = it.vocabulary
        place = np.searchsorted(own, words)
        held = (own.take(place, mode="clip") == words).nonzero()[0]
        if len(held) < PART * it.words or np.minimum(np.bincount(place[held], minlength=len(own)), times).sum() < PART * it.words:
            return None
        known = words[held].tolist()
        if common_subsequence(it.masks, known, it.words) < PART * it.words:
            return None
        best = None
        stride = max(STEP, it.words // 4)
        for at in range(0, max(1, len(words) - it.stretch + stride), stride):
            lo, hi = np.searchsorted(held, (at, at + it.stretch)).tolist()
            if hi - lo < PART * it.words:
                continue
            part = known[lo:hi]
            lcs = common_subsequence(it.masks, part, it.words)
            if lcs < PART * it.words:
                continue
            answered = len(it.answer.intersection(part))
            if lcs >= WHOLE * it.words or answered >= ANSWER * len(it.answer):
                best = max(best or (0, 0), (lcs, answered))
        return best


def _hashes(text: str) -> np.ndarray:
    data = folded(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = tokens.word_spans(data, np.array([0, len(data)]))
    return tokens.hash_spans(data, starts, ends)


def parts(n: int) -> list[tuple[int, int]]:
    """Begin and end of the parts an item of ``n`` words is searched by: the longest passage, every half of it, up to the end."""
    size = LENGTHS[-1]
    return [(at, at + size) for at in [*range(0, n - size, size // 2), n - size]] if n > size else [(0, n)]


def build(docs: DataFrame, benchmark: DataFrame) -> Index:
    """Fit the space and project the items.  The benchmark is the stated query set and is held whole by every task."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text")
    rows = items.toArrow()
    common.bounded_batches(spark)
    made = common.settle(passages(docs), "passages")
    weight = corpus_weights(made)
    space = latent_space(docs, items, common.sent(spark, weight), made)
    projection = space * weight[:, None]
    share = np.cumsum(np.exp(-weight.astype(np.float64)))
    draw, rng = share / share[-1], np.random.default_rng(SEED)
    made, vectors, part_of, sizes, least = [], [], [], [], []
    for item_id, text in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
        h = _hashes(text)
        if not len(h):
            continue
        masks: dict[int, int] = {}
        for k, w in enumerate(h.tolist()):
            masks[w] = masks.get(w, 0) | 1 << k
        made.append(Item(item_id, len(h), masks, frozenset(_hashes(last_sentence(text)).tolist())))
        for begin, end in parts(len(h)):
            v = projection[word_buckets(h[begin:end])].sum(0)
            vectors.append(v / max(float(np.linalg.norm(v)), 1e-9))
            part_of.append(len(made) - 1)
            sizes.append(end - begin)
            least.append(least_cosine(projection, draw, word_buckets(h[begin:end]), vectors[-1], rng))
    vectors = np.array(vectors, np.float32).reshape(len(vectors), RANK)
    return Index(
        projection.astype(np.float32), made, vectors, np.array(part_of, np.int64), np.array(sizes, np.int64), np.array(least, np.float32)
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_words, item_words, answer_words of every document that holds an item."""
    sent = common.sent(docs.sparkSession, build(docs, benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_words"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(d, *x) for d, found in zip(ids, sent.value.leaks(batch.column(1)), strict=True) for x in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = "doc_id long, item_id long, cosine double, lcs_words long, item_words long, answer_words long"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    sent = common.sent(docs.sparkSession, build(docs, benchmark))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in sent.value.leaks(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@common.query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, common.table(spark, sf_dir, "benchmark"))
