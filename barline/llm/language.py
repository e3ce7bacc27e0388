"""Language by hierarchical discrimination: the family first, then the language within it.

Every text becomes a vector of hashed byte n-grams (1 to 3 bytes of letters,
case folded) of unit length.  One-versus-one linear support vector machines
choose the family; one-versus-one machines trained only on the languages of a
family choose the language inside it, where close relatives share most of
their spelling.  Both levels are decided by votes, ties by summed margins.

Machines are trained in numpy (Pegasos with averaged weights) on a bounded
sample: about ``SAMPLE_PER_LANG`` rows of each language, chosen by a hash of
their id among rows that are not held out.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a null language teaches nothing; a language outside ``FAMILIES`` is a family
of its own; with a single learned language every text with letters gets it;
with none, everything is ``und``.  Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import common, tokens

BUCKETS = 1 << 12
#: Texts whose vectors are held at once.
ROWS = 256
#: Training rows of each language, in expectation, and the longest text among them.
SAMPLE_PER_LANG = 500
SAMPLE_CHARS = 20_000
EPOCHS = 20
PENALTY = 1e-5
UNKNOWN = "und"

#: Family of each language code.
FAMILIES = {
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic",
    "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance",
    "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "mk": "slavic", "pl": "slavic",
    "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
    "bn": "indic", "gu": "indic", "hi": "indic", "mr": "indic", "ne": "indic", "pa": "indic", "ur": "indic",
    "az": "turkic", "kk": "turkic", "tr": "turkic", "uz": "turkic",
    "ar": "semitic", "he": "semitic", "ja": "japonic", "ko": "koreanic", "zh": "sinitic",
}

# Letters fold to lower case, bytes of other scripts stay, all else is a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    return FAMILIES.get(lang, lang)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of unit length for every text (zero where a text has no letter bytes)."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, np.float32)
    if len(data):
        text = _FOLD[data]
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        text[1:][upper] += 32
        row = np.repeat(np.arange(n), np.diff(offsets))
        code = np.zeros(len(text), np.uint32)
        wide = text.astype(np.uint32)
        for k in (1, 2, 3):
            m = len(text) - k + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(257) + wide[k - 1 :]
            h = (code ^ np.uint32(k << 24)) * np.uint32(0x9E3779B1)
            h = ((h >> np.uint32(11)) ^ h) % np.uint32(BUCKETS)
            # blanks in the middle and runs of blanks say nothing; neither does the next text
            keep = (row[:m] == row[k - 1 :]) & ((text[:m] != 32) | (text[k - 1 :] != 32))
            if k == 3:
                keep &= text[1 : m + 1] != 32
            counts += np.bincount(row[:m][keep] * BUCKETS + h[keep], minlength=n * BUCKETS).astype(np.float32)
    x = np.sqrt(counts.reshape(n, BUCKETS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """A linear support vector machine for y = +1 / -1, both classes of equal weight: hinge loss, averaged steps."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1] + 1, np.float64)
    mean = np.zeros_like(w)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    groups = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    rounds = epochs * max(len(g) for g in groups)
    batch, steps = 16, 0
    for t in range(1, rounds // batch + 2):
        pick = np.concatenate([rng.choice(g, batch) for g in groups])
        xs, ys = x[pick], y[pick]
        wrong = ys * (xs @ w) < 1
        rate = 4.0 / (1 + 0.02 * t)
        w *= 1 - rate * PENALTY
        if wrong.any():
            w += rate / len(pick) * (ys[wrong] @ xs[wrong])
        if t > rounds // batch // 2:
            mean += w
            steps += 1
    mean /= max(steps, 1)
    return mean[:-1].astype(np.float32), float(mean[-1])


@dataclass
class Ballot:
    """One-versus-one machines among names."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str]) -> Ballot:
        names, y = sorted(set(y)), np.array(y)
        pairs = list(combinations(range(len(names)), 2))
        if not pairs:
            return cls(names)
        fitted = []
        for a, b in pairs:
            part = (y == names[a]) | (y == names[b])
            fitted.append(machine(x[part], np.where(y[part] == names[a], 1.0, -1.0)))
        return cls(names, pairs, np.stack([w for w, _ in fitted], 1), np.array([b for _, b in fitted]))

    def vote(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner, and its weakest support as a number in (0, 1)."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weight + self.bias
        votes = np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            won = margin[:, k] >= 0
            soft = np.tanh(margin[:, k]) * 1e-3
            votes[:, a] += won + soft
            votes[:, b] += ~won - soft
        best = votes.argmax(1)
        support = np.ones(len(x))
        for k, (a, b) in enumerate(self.pairs):
            signed = np.where(best == a, margin[:, k], np.where(best == b, -margin[:, k], np.inf))
            support = np.minimum(support, 1 / (1 + np.exp(-np.clip(2 * signed, -30, 30))))
        return best, support


@dataclass
class Model:
    families: Ballot | None
    within: dict[str, Ballot]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores = np.zeros(len(column))
        for lo, hi, data, offsets in tokens.pieces(column, rows=ROWS):
            best = np.full(hi - lo, UNKNOWN, object)
            lettered = has_letters(data, offsets)
            if self.families is not None and lettered.any():
                x = vectors(data, offsets)
                family, support = self.families.vote(x)
                for k, name in enumerate(self.families.names):
                    own = np.flatnonzero((family == k) & lettered)
                    if len(own):
                        ballot = self.within[name]
                        lang, inner = ballot.vote(x[own])
                        best[own] = np.array(ballot.names, object)[lang]
                        scores[lo + own] = np.minimum(support[own], inner)
            langs += best.tolist()
        return langs, scores


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    if len(data):
        plain = (_FOLD[data] != 32) & (data < 128)
        total = np.concatenate([[0], np.cumsum(plain)])
        out = total[offsets[1:]] > total[offsets[:-1]]
        for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            out[k] = any(ch.isalpha() for ch in text)
    return out


def fit(column: pa.Array, langs: list[str]) -> Model:
    if not langs:
        return Model(None, {})
    x = np.concatenate([vectors(data, offsets) for _, _, data, offsets in tokens.pieces(column, rows=ROWS)])
    family = [family_of(v) for v in langs]
    within = {}
    for name in sorted(set(family)):
        own = [i for i, f in enumerate(family) if f == name]
        within[name] = Ballot.fit(x[own], [langs[i] for i in own])
    return Model(Ballot.fit(x, family), within)


def train(docs: DataFrame) -> Model:
    """Fit on a hash sample of the labelled rows; rates come from counts over all of them."""
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~common.held_out(F.col("doc_id"))
        & (F.length("text") <= SAMPLE_CHARS)
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return fit(pa.array([], pa.string()), [])
    rate = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, SAMPLE_PER_LANG / n))])
    rows = common.sampled(known, F.col("doc_id"), rate[F.col("lang")]).orderBy("doc_id", "lang", "text").toArrow()
    return fit(rows.column("text").combine_chunks(), rows.column("lang").to_pylist())


def predicted(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of the documents, the predicted language and a score in [0, 1]; input columns of those names give way."""
    docs = docs.drop(lang, score)
    sent = common.sent(docs.sparkSession, model)  # (families + pairs) x BUCKETS floats
    at = docs.columns.index("text")

    def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, lang, score]
            )

    added = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return docs.mapInArrow(batches_out, T.StructType([*docs.schema.fields, *added]))


@common.query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs)
    return predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
