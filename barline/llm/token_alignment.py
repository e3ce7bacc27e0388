"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes in their own ways.  Byte offsets where a token
of either side ends cut both sequences into groups; every token of a group is
linked with every token of the other side in it.

*Encoding.*  A space between a non-blank and another character is where both
tokenizers start anew, so texts are cut there into units and each distinct unit
of a block is encoded once (the first ``MEMO`` units of a worker stay known).
Units and their ids are kept in Arrow and numpy arrays, a few tens of bytes each;
Python strings and lists exist for ``UNITS`` of them at a time.

*Merging.*  The token ends of a block's documents are two sorted lists.
Diagonals at equal distances through their merge grid are searched by halving,
all at once, and cut the merge into pieces of ``WORK`` ends each, whatever the
lengths of the documents.  A piece finds its common ends and numbers the groups
inside it on its own; stitching adds the groups of earlier pieces and gives a
token whose twin ended the piece before to that piece's last group.

*Counts.*  A block of documents is one row: its distinct id pairs with the number
of its documents that hold them, and for each document the places of its pairs
in that list.  Pairs are counted over the corpus from the blocks' lists, and only
these lists meet the counts, so a pair that every document has is one row for
each block.  A block is some ``BLOCK`` bytes of text (or one document); its
tokens are laid out for ``PART`` bytes of it at a time (or one document).  Rows of
whole blocks are wide, so they are written in row groups of some ``ROW_GROUP`` bytes.

Defined cases: a text that is null, empty or not given back byte for byte by
both tokenizers has no tokens and all zeros; every row is a document of its own,
also where rows repeat or share an id; a null id stays null; columns other than
``doc_id`` and ``text`` take no part.  The tokenizer files lie in ``TOKENIZERS``
on every machine.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common

TOKENIZERS = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Bytes of text in a block and in a part of it, ends in a piece of the merge, pairs unfolded at once, units a worker remembers.
BLOCK, PART, WORK, AT_ONCE, MEMO = 1 << 22, 1 << 19, 1 << 16, 1 << 18, 1 << 18
#: Units that are Python strings at once.
UNITS = 1 << 13
#: Bytes of the written blocks that a task holds before it writes them out.
ROW_GROUP = 1 << 24
#: Longer units are encoded anew each time.
UNIT = 64
ID_BITS = 20

BLOCKS = (
    "block long, pair array<long>, pair_docs array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, groups_sha256 array<string>, ends array<long>, at array<int>, times array<long>"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def arrow(schema: str) -> pa.Schema:
    """The Arrow form of the few types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    one = lambda k: pa.list_(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k]
    return pa.schema([(name, one(kind)) for name, kind in fields])


# --- encoding -------------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_AFTER_GAP = re.compile(r"(?<=[^ ])(?<=\S)(?= )|(?<=[^ ])(?= \S)")
_ODD_GAP = re.compile(r"  |\s \s")


def units(text: str) -> list[str]:
    """Parts of space+text that both tokenizers encode apart from each other."""
    if text[0] != " " and not _ODD_GAP.search(text):
        return [" " + u for u in text.split(" ")]
    return _AFTER_GAP.split(" " + text)


class Encoder:
    """Ids of both tokenizers for units, and the bytes behind each id."""

    def __init__(self, folder: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = (os.path.join(folder, f) for f in FILES)
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.space = [self.b.piece_to_id("▁")]
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.tables = (
            Table({i: bytes(map(letters.__getitem__, token)) for token, i in vocabulary.items()}),
            Table(
                {
                    i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                    for i, p in enumerate(pieces)
                }
            ),
        )
        self.memo = pa.array([], pa.string())
        #: Of A and B: the ids of all known units end to end, and how many each has.
        self.kept = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * 2

    def encoded(self, new: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: the units' ids end to end, and how many each has."""
        flat, sizes = ([], []), ([], [])
        for lo in range(0, len(new), UNITS):
            some = new[lo : lo + UNITS].to_pylist()
            of_a = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)]
            of_b = [y or self.space for y in self.b.encode([u[1:] for u in some], num_threads=1)]
            for k, lists in enumerate((of_a, of_b)):
                sizes[k].append(np.fromiter(map(len, lists), np.int64, len(lists)))
                flat[k].append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes[k][-1].sum())))
        none = np.zeros(0, np.int32), np.zeros(0, np.int64)
        return [(np.concatenate([none[0], *f]), np.concatenate([none[1], *n])) for f, n in zip(flat, sizes, strict=True)]

    def known(self, wanted: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The row of each unit, all different, among rows of ids; for A and B: the ids end to end, and how many each row has."""
        place = pc.index_in(wanted, value_set=self.memo)
        at = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        row = place.fill_null(0).to_numpy().astype(np.int64)
        row[at] = len(self.memo) + np.arange(len(at))
        new = wanted.take(pa.array(at))
        rows = [tuple(np.concatenate(x) for x in zip(old, add, strict=True)) for old, add in zip(self.kept, self.encoded(new), strict=True)]
        short = np.flatnonzero(pc.utf8_length(new).to_numpy(zero_copy_only=False) <= UNIT)[: max(0, MEMO - len(self.memo))]
        if len(short):
            stay = np.concatenate([np.arange(len(self.memo)), len(self.memo) + short])
            self.memo = pa.concat_arrays([self.memo, new.take(pa.array(short))])
            self.kept = [(gathered(flat, (np.cumsum(n) - n)[stay], n[stay]), n[stay]) for flat, n in rows]
        return row, rows


class Table:
    """The bytes of every id, end to end."""

    def __init__(self, entries: dict[int, bytes]):
        rows = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.width = np.array([len(r) for r in rows])
        self.start = np.cumsum(self.width) - self.width
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.data, self.start[ids], self.width[ids])


@functools.cache
def encoder(folder: str) -> Encoder:
    return Encoder(folder)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def given_back(raw: np.ndarray, size: np.ndarray, table: Table, ids: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each text of ``size`` bytes whether its tokens' bytes are those of the text."""
    ends = np.concatenate([[0], np.cumsum(tokens)])
    width = np.concatenate([[0], np.cumsum(table.width[ids])])[ends]
    good = np.diff(width) == size
    of = np.repeat(np.arange(len(size)), np.where(good, size, 0))
    wrong = raw[np.repeat(good, size)] != table.joined(ids[np.repeat(good, tokens)])
    good[of[wrong]] = False
    return good


def cut(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of the texts, the place among them of every unit, and how many units each text has."""
    counts, chunks, some = np.zeros(len(texts), np.int64), [], []
    for k, text in enumerate(texts):
        own = units(text) if text else []
        counts[k] = len(own)
        some += own
        if len(some) >= UNITS:
            chunks.append(pa.array(some, pa.string()))
            some = []
    chunks.append(pa.array(some, pa.string()))
    every = pa.concat_arrays(chunks).dictionary_encode()
    return every.dictionary, every.indices.to_numpy(), counts


def laid_out(texts: list[str | None], unit: np.ndarray, counts: np.ndarray, rows: list, tables: tuple[Table, Table]) -> tuple:
    """What ``encode`` gives; ``unit``: the row of ids of each unit, ``counts``: units of each text."""
    raw = np.frombuffer("".join(" " + t for t in texts if t).encode(), np.uint8)
    size = np.fromiter((len(t.encode()) + 1 if t else 0 for t in texts), np.int64, len(texts))
    sides, good = [], np.ones(len(texts), bool)
    for (flat, start, length), table in zip(rows, tables, strict=True):
        n = length[unit]
        ids = gathered(flat, start[unit], n)
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        sides.append((ids, np.diff(upto)))
        good &= given_back(raw, size, table, *sides[-1])
    out = []
    for (ids, tokens), table in zip(sides, tables, strict=True):
        ids = ids[np.repeat(good, tokens)]
        out += [ids, table.width[ids], np.where(good, tokens, 0)]
    return tuple(out)


def parts(texts: list[str | None], limit: int) -> list[tuple[int, int]]:
    """First and end of consecutive texts of ``limit`` bytes or less together, or of a single longer one."""
    size = np.cumsum(np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts)))
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def encoded_parts(texts: list[str | None], tokenizers: Encoder, limit: int) -> Iterator[tuple]:
    """Each part's first and end text and what ``encode`` gives for it; units are encoded once for all parts."""
    distinct, at, counts = cut(texts)
    row, rows = tokenizers.known(distinct)
    rows = [(flat, np.cumsum(n) - n, n) for flat, n in rows]
    upto = np.concatenate([[0], np.cumsum(counts)])
    for lo, hi in parts(texts, limit):
        yield lo, hi, laid_out(texts[lo:hi], row[at[upto[lo] : upto[hi]]], counts[lo:hi], rows, tokenizers.tables)


def encode(texts: list[str | None], tokenizers: Encoder) -> tuple:
    """For A and B: ids, byte widths, tokens of each text.  A text without tokens has 0 of both."""
    ((_, _, out),) = encoded_parts(texts, tokenizers, 1 << 62)
    return out


# --- merging --------------------------------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of each side lie before every ``work``-th step of their merge (A first where equal)."""
    step = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    lo, hi = np.maximum(0, step - len(b)), np.minimum(step, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        take = open_.copy()
        take[open_] = a[mid[open_]] <= b[step[open_] - 1 - mid[open_]]
        lo, hi = np.where(take, mid + 1, lo), np.where(open_ & ~take, mid, hi)
    return lo, step - lo


def piece(a: np.ndarray, b: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common ends of one piece and the group, counted inside it, of its tokens; ``following``: B's next end."""
    ahead = np.concatenate([b, following])
    at = np.searchsorted(ahead, a)
    common_ends = a[ahead[np.minimum(at, len(ahead) - 1)] == a] if len(ahead) else a[:0]
    return common_ends, np.searchsorted(common_ends, a), np.searchsorted(common_ends, b)


def groups(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A and every B token, from their increasing byte ends over the same bytes."""
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    i, j = diagonals(a, b, work)
    before, last = 0, -1
    for k in range(len(i) - 1):
        mine = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
        cuts, in_a, in_b = piece(a[mine[0]], b[mine[1]], b[j[k + 1] : j[k + 1] + 1])
        of_a[mine[0]], of_b[mine[1]] = in_a + before, in_b + before
        if len(in_b) and b[j[k]] == last:
            of_b[j[k]] -= 1
        before, last = before + len(cuts), cuts[-1] if len(cuts) else last
    return of_a, of_b


def linked(doc: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, id, id) keys in order, and how often each is linked.  ``doc``, ``n_a``, ``n_b``: of each group."""
    first_a, first_b, pairs = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def note(d, x, y, times):
        key = (d.astype(np.int64) << (2 * ID_BITS)) | (x.astype(np.int64) << ID_BITS) | y.astype(np.int64)
        found.append(summed(key, times))

    small = np.flatnonzero(pairs <= 4096)
    upto = np.cumsum(pairs[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        g = small[lo:hi]
        n = pairs[g]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(n_b[g], n)
        x, y = a[np.repeat(first_a[g], n) + step // width], b[np.repeat(first_b[g], n) + step % width]
        note(np.repeat(doc[g], n), x, y, np.ones(len(x), np.int64))
        lo = hi
    for g in np.flatnonzero(pairs > 4096):
        x, nx = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        rows = max(1, AT_ONCE // len(y))
        for k in range(0, len(x), rows):
            some = x[k : k + rows]
            times = (nx[k : k + rows, None] * ny[None, :]).ravel()
            note(np.full(len(times), doc[g]), np.repeat(some, len(y)), np.tile(y, len(some)), times)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(times, first) if len(first) else times


@functools.cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Digits of every id, from the left, and how many they are."""
    texts = [str(k).encode() for k in range(1 << 17)]
    wide = np.zeros((len(texts), 7), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(t.ljust(6) for t in texts), np.uint8).reshape(-1, 6)
    return wide, np.array([len(t) for t in texts])


def digests(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, groups_of: np.ndarray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;...`` of every document; ``groups_of``: its number of groups."""
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    g_a, g_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + (last_b - n_b)[g_a]] = a
    ids[np.arange(len(b)) + last_a[g_b]] = b
    mark[last_a + last_b - n_b - 1] = ord("|")
    mark[last_a + last_b - 1] = ord(";")
    table, length = _decimals()
    wide, size = table[ids], length[ids]
    wide[np.arange(len(ids)), size] = mark
    raw = wide[np.arange(wide.shape[1]) <= size[:, None]].tobytes()
    byte = np.concatenate([[0], np.cumsum(size + 1)])
    out, token, group = [], 0, 0
    for n in groups_of.tolist():
        if n == 0:
            out.append("")
            continue
        group += n
        upto = int(last_a[group - 1] + last_b[group - 1])
        out.append(hashlib.sha256(raw[byte[token] : byte[upto] - 1]).hexdigest())
        token = upto
    return out


def align_part(encoded: tuple, texts: int, work: int) -> tuple:
    """(document, id, id) keys, how often each is linked, and for each text its tokens of A and B, groups, links and digest."""
    a, wide_a, tokens_a, b, wide_b, tokens_b = encoded
    of_a, of_b = groups(np.cumsum(wide_a, dtype=np.int64), np.cumsum(wide_b, dtype=np.int64), work)
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    doc = np.repeat(np.arange(texts), tokens_a)[np.cumsum(n_a) - 1] if n else np.zeros(0, np.int64)
    key, times = linked(doc, a, b, n_a, n_b)
    groups_of = np.bincount(doc, minlength=texts)
    links = np.bincount(doc, n_a * n_b, texts).astype(np.int64) if n else np.zeros(texts, np.int64)
    return key, times, tokens_a, tokens_b, groups_of, links, digests(a, b, n_a, n_b, groups_of) if n else [""] * texts


def align(ids: list[int | None], texts: list[str | None], tokenizers: Encoder, work: int = WORK) -> dict[str, list]:
    """One block: see the module's text."""
    made = []
    for lo, hi, encoded in encoded_parts(texts, tokenizers, PART):
        key, *rest = align_part(encoded, hi - lo, work)
        made.append((key + (lo << 2 * ID_BITS), *rest))
    *columns, digest = zip(*made, strict=True)
    key, times, tokens_a, tokens_b, groups_of, links = map(np.concatenate, columns)
    pair, at = np.unique(key & ((1 << 2 * ID_BITS) - 1), return_inverse=True)
    return {
        "pair": pair,
        "pair_docs": np.bincount(at, minlength=len(pair)),
        "doc_id": ids,
        "n_a": tokens_a,
        "n_b": tokens_b,
        "n_groups": groups_of,
        "n_links": links,
        "groups_sha256": list(chain.from_iterable(digest)),
        "ends": np.searchsorted(key >> (2 * ID_BITS), np.arange(len(texts)), side="right"),
        "at": at,
        "times": times,
    }


# --- over the corpus --------------------------------------------------------------------------------------------------


def blocks(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row for each block of documents, in the scan's own tasks."""
    schema = arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, tokenizers = TaskContext.get().partitionId() << 32, encoder(folder)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(), dtype=np.int64)
            # Equal shares, so that a batch of little more than a block makes no small one.
            share = -(-int(size[-1]) // max(1, round(size[-1] / BLOCK))) if len(size) else 0
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + share, side="right")))
                row = align(ids[lo:hi].to_pylist(), column[lo:hi].to_pylist(), tokenizers)
                arrays = [pa.array([number], pa.int64())]
                arrays += [
                    pa.ListArray.from_arrays(pa.array([0, len(row[f.name])], pa.int32()), pa.array(row[f.name], f.type.value_type))
                    for f in schema
                    if f.name != "block"
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                del row, arrays
                pa.default_memory_pool().release_unused()
                number, lo = number + 1, hi

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def counted(made: DataFrame) -> DataFrame:
    """of_block, at, n, best: for each pair of each block how many documents hold it, and whether no pair of its A id has more."""
    held = made.select("block", F.posexplode(F.arrays_zip("pair", "pair_docs")).alias("at", "p"))
    held = held.select("block", "at", F.col("p.pair").alias("pair"), F.col("p.pair_docs").alias("docs"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    # At most one row for each id of B.
    of_a = Window.partitionBy(F.shiftright("pair", ID_BITS))
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))
    return held.join(counts.hint("merge"), "pair").select(F.col("block").alias("of_block"), "at", "n", "best")


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and the alignment's measures of every row of ``docs``."""
    common.bounded_batches(docs.sparkSession)
    made = common.settle(blocks(docs, folder), "alignment", row_group=ROW_GROUP)
    each = made.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ends", "at", "times")
    schema = arrow(RESULT)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        at = right.column("at").to_numpy()
        count[at] = right.column("n").to_numpy()
        best[at] = right.column("best").to_numpy(zero_copy_only=False)
        flat = lambda name: left.column(name).combine_chunks().flatten()
        ends, at, times = (flat(k).to_numpy() for k in ("ends", "at", "times"))
        sums = {}
        for name, value in (("n_best", best), ("count_sum", count)):
            total = np.concatenate([[0], np.cumsum(value[at] * times)])[np.concatenate([[0], ends])]
            sums[name] = pa.array(np.diff(total))
        return pa.table([sums[f.name] if f.name in sums else flat(f.name) for f in schema], schema=schema)

    return each.groupBy("block").cogroup(counted(made).groupBy("of_block")).applyInArrow(finish, RESULT)


@common.query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(common.table(spark, sf_dir, "documents"))
