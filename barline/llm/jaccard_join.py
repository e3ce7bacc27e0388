"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds the hashes of its distinct shingles of ``rule.words``
words.  Two sets of n and m shingles link when 100 * intersection >= percent *
union, that is when they share at least T = ceil(percent (n + m) / (100 +
percent)).  Documents with equal sets are one class, and everything below runs
on classes.

1. A scan counts, over all documents, how often each hashed shingle occurs (a
   table of ``LOADS`` counters, added up over tasks in a tree) and gives every
   document its class.
2. Inverted lists.  Every class puts its rarest ``n - ceil(n percent / 100) +
   SHARED`` shingles into the lists; two linked classes share at least ``SHARED``
   of them, whatever the counters say.  Lists with one class are dropped.  Longer
   ones are cut by size, as a link needs sizes within ``percent`` of each other:
   each class joins the two groups of its size step, and linked classes meet in
   that of the larger step of the two.
3. Search.  The members of a group are indexed in blocks of bounded size, and a
   query is answered against a block by DivideSkip: of the query's inverted
   lists in the block the L longest are set aside, the rest are merged by a heap
   that skips what cannot reach T - L occurrences, and candidates are probed in
   the long lists by binary search until they reach T or cannot.
   First the smallest and the largest class of every group meet the others, if
   they share ``SHARED`` groups.  Groups whose classes are then connected need no
   more (a group of a thousand near copies costs a thousand comparisons, not half
   a million).  What is left open falls into regions of classes that share open
   groups; in each, every class outside the largest connected part is a query
   against all blocks, first over the listed shingles alone, where T is
   ``SHARED``: in one round for the likeliest partner in each other component, which
   joins what belongs together, in a second one for all that is left.  Candidates
   must pass the parity bits of their sets before any set travels, and are then
   searched in whole sets.
4. Components over the links, the smallest doc_id of each, back to documents.

No list is held in one task: blocks are cut by the number of shingles, and
minimums, maximums and counts are summed inside the tasks before they meet.
Shingles and classes are 64-bit hashes; among 3e10 documents a few dozen pairs
of different sets are expected to share a class hash.

Defined cases: null and empty texts have no shingles, link with nothing and are
their own component; a text of fewer words than a shingle is one shingle of its own kind;
rows with equal texts share a component even if they repeat a doc_id; a null
doc_id takes no part in the minimum; an empty table gives no rows.  Extra
columns do not take part.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common, tokens
from barline.llm.graph import components

#: Counters of shingle frequency; they only order lists, so links do not depend on their number.  More for a larger corpus.
LOADS = 1 << 22
_LOAD_BLOCKS = 256
#: Counter tables that one task adds up at once.
FAN_IN = 64
#: Listed shingles that linked classes have in common at least.
SHARED = 3
#: How often classes that cannot link are taken out of the open groups; what is left does not lose a link, whatever the number.
OPEN_ROUNDS = 2
#: Bits of the filter that tells a scan which classes are wanted.
FILTER_BITS = 1 << 22
#: Parity bits of a set.
PARITY_BITS = 2048
#: Shingles indexed by one block.
BLOCK_SHINGLES = 200_000
#: Weight of a probe against a merge step, as measured by the method's authors.
PROBE_COST = 0.0085


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least similarity in percent."""

    words: int = 5
    percent: int = 80

    def overlap(self, n: int, m: int) -> int:
        """Shingles that sets of n and m share at least if they link."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def rarest(self, n: np.ndarray) -> np.ndarray:
        """How many of its shingles a set of n lists; sets too small for any unequal partner list none.

        Of the c = ceil(n percent / 100) shingles that a link needs at least, the
        first ``shared`` in any order are among the first n - c + ``shared``.
        """
        return np.where(n * (100 - self.percent) >= self.percent, n + (-n * self.percent) // 100 + self.shared, 0)

    @property
    def shared(self) -> int:
        """``SHARED``, or what the smallest set with an unequal partner needs if that is less."""
        least = -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1
        return max(1, min(SHARED, -(-least * self.percent // 100)))

    def step(self, n: Column) -> Column:
        """Sizes of linked sets are in the same or in neighbouring steps."""
        return F.floor(F.log(n.cast("double")) / F.lit(-math.log(self.percent / 100)) * (1 - 1e-9)).cast("int")

    def differences(self, total):
        """In how many shingles linked sets with ``total`` together differ at most."""
        return total + 2 * ((-self.percent * total) // (100 + self.percent))

    def near(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)


def sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, offsets into them, class) of every text; shingles of a text are distinct and ascending."""
    n = len(offsets) - 1
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, rows = tokens.word_spans(data, offsets)
    hashes = tokens.hash_spans(data, starts, ends)
    window, first = tokens.windows(hashes, rows, n_words)
    row = rows[first]
    words = np.bincount(rows, minlength=n)
    for few in range(1, n_words):
        short, at = tokens.windows(hashes, rows, few)
        own = words[rows[at]] == few
        window = np.concatenate([window, tokens.mix(short[own] + np.uint64(few))])
        row = np.concatenate([row, rows[at[own]]])
    order = np.lexsort((window, row))
    window, row = window[order], row[order]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (row[1:] != row[:-1])
    window, row = window[new], row[new]
    size = np.bincount(row, minlength=n)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=at[1:])
    sums = np.zeros(len(window) + 1, np.uint64)
    np.cumsum(tokens.mix(window ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    cls = tokens.mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))
    return window, at, cls.view(np.int64)


def scan_rows(batches: Iterator[pa.RecordBatch], rule: Rule, task: int) -> Iterator[pa.RecordBatch]:
    """The scan of one task.  Shingles are counted in place, piece by piece: besides its counters it holds what one piece takes."""
    loads = np.zeros(LOADS, np.uint32)
    for batch in batches:
        size, cls, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.binary())]
        for _, _, data, offsets in tokens.pieces(batch.column(1)):
            window, at, c = sets(data, offsets, rule.words)
            size.append(np.diff(at))
            cls.append(c)
            bits.append(parities(window, at))
            np.add.at(loads, (window % np.uint64(LOADS)).astype(np.int64), np.uint32(1))
        n, c = np.concatenate(size), np.concatenate(cls)
        yield _scan_rows(batch.column(0), batch.column(2), pa.array(n), pa.array(c, mask=n == 0), pa.concat_arrays(bits), None, None)
    parts = loads.reshape(_LOAD_BLOCKS, -1)
    some = np.flatnonzero(parts.any(axis=1))
    none = pa.nulls(len(some), pa.int64())
    packed = pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())
    yield _scan_rows(none, pa.array(np.full(len(some), task)), none, none, None, pa.array(some.astype(np.int64)), packed)


def scan(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per document (doc_id, key, n, cls, parity), and each task's shingle counters as rows of (block, task, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan_rows(batches, rule, TaskContext.get().partitionId())

    key = F.xxhash64("doc_id", "text").alias("key")
    return docs.select(F.col("doc_id").cast("long"), "text", key).mapInArrow(
        run, "doc_id long, key long, n long, cls long, parity binary, block long, part binary"
    )


def _scan_rows(doc_id, key, n, cls, bits, block, part) -> pa.RecordBatch:
    bits = pa.nulls(len(n), pa.binary()) if bits is None else bits
    block = pa.nulls(len(n), pa.int64()) if block is None else block
    part = pa.nulls(len(n), pa.binary()) if part is None else part
    names = ["doc_id", "key", "n", "cls", "parity", "block", "part"]
    return pa.RecordBatch.from_arrays([doc_id, key, n, cls, bits, block, part], names)


def load_table(scanned: DataFrame) -> np.ndarray:
    """The counters of all tasks, added in a tree of ``FAN_IN``; the result has a fixed size."""

    def add(key, table):
        total = np.zeros(LOADS // _LOAD_BLOCKS, np.uint64)
        for part in table.column("part"):
            total += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table({"block": [key[0].as_py()], "task": [key[1].as_py()], "part": pa.array([packed], pa.binary())})

    rows = scanned.filter("block is not null").select("block", F.col("key").alias("task"), "part")
    last = rows.agg(F.max("task")).first()[0] or 0
    while last >= 0:
        upper = F.floor(F.col("task") / FAN_IN).alias("task")
        rows = rows.select("block", upper, "part").groupBy("block", "task").applyInArrow(add, "block long, task long, part binary")
        last = last // FAN_IN or -1
    got = rows.toArrow()
    out = np.zeros((_LOAD_BLOCKS, LOADS // _LOAD_BLOCKS), np.uint16)
    for k, part in zip(got.column("block").to_pylist(), got.column("part").to_pylist(), strict=True):
        out[k] = np.minimum(np.frombuffer(zlib.decompress(part), np.uint32), 0xFFFF)
    return out.reshape(-1)


def postings(docs: DataFrame, loads: np.ndarray, rule: Rule) -> DataFrame:
    """token, n, cls: the rarest shingles of every set, as many as any linked set must share ``rule.shared`` of."""
    sent = common.sent(docs.sparkSession, loads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tokens.pieces(batch.column(0)):
                window, at, cls = sets(data, offsets, rule.words)
                size = np.diff(at)
                row = np.repeat(np.arange(len(size)), size)
                load = sent.value[(window % np.uint64(LOADS)).astype(np.int64)]
                order = np.lexsort((window, load, row))
                place = np.arange(len(window)) - np.repeat(at[:-1], size)
                taken = order[place < rule.rarest(size)[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window[taken].view(np.int64)), pa.array(size[row[taken]]), pa.array(cls[row[taken]])],
                    ["token", "n", "cls"],
                )

    return docs.select("text").mapInArrow(run, "token long, n long, cls long")


def fetch(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """cls and shingles of the wanted classes, once each; the scan knows them by a filter of fixed size."""
    bit = F.pmod("cls", F.lit(FILTER_BITS))
    words = wanted.groupBy(F.floor(bit / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    got = words.toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = common.sent(docs.sparkSession, bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in tokens.pieces(batch.column(0)):
                window, at, cls = sets(data, offsets, rule.words)
                b = cls.view(np.int64) % FILTER_BITS
                hit = (sent.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)
                size = np.diff(at)
                rows = [k for k in np.flatnonzero((hit > 0) & (size > 0)) if int(cls[k]) not in seen]
                if not rows:
                    continue
                rows = [k for i, k in enumerate(rows) if int(cls[k]) not in seen and not seen.add(int(cls[k]))]
                values = pa.array([window[at[k] : at[k + 1]].view(np.int64) for k in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), values], ["cls", "shingles"])

    found = docs.select("text").mapInArrow(run, "cls long, shingles array<long>")
    return found.join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])


def parities(shingles: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each set and each remainder of the hash, whether an odd number of its shingles has it."""
    out = np.zeros((len(at) - 1, PARITY_BITS // 8), np.uint8)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (shingles % np.uint64(PARITY_BITS)).astype(np.int64)
    np.bitwise_xor.at(out, (row, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    return pa.array(list(map(bytes, out)), pa.binary())


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(id, lists that hold it) for ids in at least ``need`` of the ascending lists."""
    at = [0] * len(lists)
    heap = [(ids[0], k) for k, ids in enumerate(lists)]
    heapify(heap)
    while heap:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            yield top, len(popped)
            for k in popped:
                at[k] += 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            # what is below the new top is in fewer than ``need`` lists
            for k in popped:
                at[k] = bisect_left(lists[k], heap[0][0], at[k])
        for k in popped:
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


class Block:
    """Inverted lists over the shingles of some sets."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = [len(m) for m in members]
        self.lists: dict[int, list[int]] = {}
        if members:
            token = np.concatenate(members)
            owner = np.repeat(np.arange(len(members)), self.sizes)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else []
            groups = np.split(owner, edge[1:]) if len(token) else []
            self.lists = {t: g.tolist() for t, g in zip(token[edge].tolist() if len(token) else [], groups, strict=True)}

    def search(self, query: np.ndarray, rule: Rule | int) -> list[int]:
        """Members that link with the query, or that hold as many of its shingles as ``rule`` says."""
        n = len(query)
        lists = [self.lists[t] for t in query.tolist() if t in self.lists]
        least = rule if isinstance(rule, int) else -(-rule.percent * n // 100)
        if not n or len(lists) < least:
            return []
        lists.sort(key=len, reverse=True)
        n_long = min(int(least / (PROBE_COST * math.log(len(lists[0]) + 1) + 1)), least - 1)
        long, short = lists[:n_long], lists[n_long:]
        out = []
        for member, count in merge_skip(short, least - n_long):
            need = rule if isinstance(rule, int) else rule.overlap(n, self.sizes[member])
            left = n_long
            for ids in long:
                if count >= need or count + left < need:
                    break
                k = bisect_left(ids, member)
                count += k < len(ids) and ids[k] == member
                left -= 1
            if count >= need:
                out.append(member)
        return out


def search_blocks(rows: DataFrame, rule: Rule | int, link: Rule | None, best: bool) -> DataFrame:
    """Links (a, b) of every task's queries and members; rows are (task columns k1, k2, k3, is_query, cls, shingles).

    With ``link``, ``shingles`` are a part of a set of ``size`` and ``parity`` in the
    component ``label``; what is found must be able to link by these and lie in
    another component.  ``best``: of each other component the likeliest only.
    """

    def run(_, table):
        cls = table.column("cls").to_numpy()
        query = table.column("is_query").to_numpy(zero_copy_only=False)
        flat = table.column("shingles").combine_chunks()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.chunk(0)
        at, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        one = [values[at[k] : at[k + 1]] for k in range(len(flat))]
        members = np.flatnonzero(~query)
        block = Block([one[k] for k in members])
        if link:
            size = table.column("size").to_numpy()
            label = table.column("label").to_numpy()
            bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint8).reshape(len(cls), -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(query):
            hit = members[np.array(block.search(one[k], rule), np.int64)]
            hit = hit[cls[hit] != cls[k]]
            if link:
                near = 100 * np.minimum(size[hit], size[k]) >= link.percent * np.maximum(size[hit], size[k])
                hit = hit[near & (label[hit] != label[k])]
                flips = np.bitwise_count(bits[hit] ^ bits[k]).sum(axis=1)
                likely = flips <= link.differences(size[hit] + size[k])
                hit, flips = hit[likely], flips[likely]
                if best and len(hit):
                    hit = hit[np.lexsort((cls[hit], flips))]
                    hit = hit[np.unique(label[hit], return_index=True)[1]]
            a.append(np.full(len(hit), cls[k]))
            b.append(cls[hit])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("k1", "k2", "k3").applyInArrow(run, "a long, b long")


def search_plan(
    index: DataFrame, queries: DataFrame, shingle_sets: DataFrame, key: list[str], rule: Rule | int, link: Rule | None = None, best: bool = False
) -> DataFrame:
    """Search each key's queries against its members, both cut into blocks by their number of shingles.

    ``index`` and ``queries`` have the key columns, cls and n.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.ceil((F.sum("n") + 1) / BLOCK_SHINGLES).cast("int").alias(name))

    sizes = common.settle(cut(index, "_blocks").join(cut(queries, "_queries"), key), "blocks")

    def dealt(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("cls", F.lit(17)), F.col(own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        names = ("k2", "k3") if is_query else ("k3", "k2")
        return (
            df.join(sizes, key)
            .withColumn(names[0], mine)
            .withColumn(names[1], theirs)
            .select(F.xxhash64(*key).alias("k1"), "k2", "k3", F.lit(is_query).alias("is_query"), "cls")
        )

    rows = dealt(index, "_blocks", "_queries", False).unionByName(dealt(queries, "_queries", "_blocks", True))
    return search_blocks(rows.join(shingle_sets, "cls"), rule, link, best)


def parity_of(scanned: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and parity bits of the wanted classes (and a few others), once each."""
    known = common.likely_in(scanned.filter("cls is not null").select("cls", "parity"), "cls", wanted)
    return common.settle(known.groupBy("cls").agg(F.first("parity").alias("parity")), "parity")


def may_link(pairs: DataFrame, scanned: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (leader, _n, cls, n) without those whose parity bits show too many differences to link.

    A bit tells whether the set has an odd number of shingles of one hash
    remainder; each difference flips one bit, so sets differ by at least as many
    shingles as bits.  Whole sets then travel only for pairs that are likely links.
    """
    pairs = common.settle(pairs, "pairs")
    bits = parity_of(scanned, pairs.select("cls").union(pairs.select("leader")).distinct())
    near = bits.select(F.col("cls").alias("leader"), F.col("parity").alias("_a"))
    both = pairs.join(bits.withColumnRenamed("parity", "_b"), "cls").join(near, "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("_a", "_b"))
            flips = np.bitwise_count(a ^ b).sum(axis=1)
            total = batch.column("n").to_numpy() + batch.column("_n").to_numpy()
            most = rule.differences(total)
            names = ["leader", "_n", "cls", "n"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names).filter(pa.array(flips <= most))

    return both.select("leader", "_n", "cls", "n", "_a", "_b").mapInArrow(run, "leader long, _n long, cls long, n long")


def link_classes(docs: DataFrame, scanned: DataFrame, rule: Rule) -> DataFrame:
    """node, label: the component of every class that links with another class."""
    rows = common.settle(postings(docs, load_table(scanned), rule), "postings")
    one = F.struct("n", "cls")
    contested = rows.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi")
    contested = common.settle(contested.select("token"), "contested")
    step = rule.step(F.col("n"))
    groups = (
        common.likely_in(rows, "token", contested)
        .join(contested, "token")
        .select("token", F.explode(F.array(step, step + 1)).alias("step"), "n", "cls")
        .distinct()
    )
    groups = common.settle(groups, "groups")
    common.release(rows, contested)
    ends = groups.groupBy("token", "step").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count("*").alias("classes"))
    ends = common.settle(ends.filter("lo <> hi"), "ends")
    met = common.settle(groups.join(ends, ["token", "step"]), "met")
    common.release(groups, ends)

    # The smallest and the largest class of every group against all others of the group.
    met = met.withColumn("end", F.explode(F.array("lo", "hi")))
    apart = (F.col("cls") != F.col("end")["cls"]) & ~((F.col("cls") == F.col("lo")["cls"]) & (F.col("end") == F.col("hi")))
    pairs = met.filter(apart & rule.near(F.col("n"), F.col("end")["n"]))
    pairs = pairs.filter(F.col("step") == F.greatest(rule.step(F.col("n")), rule.step(F.col("end")["n"])))
    pairs = pairs.select(F.col("end")["cls"].alias("leader"), F.col("end")["n"].alias("_n"), "cls", "n")
    links = common.settle(linked_pairs(docs, may_link(counted(pairs, rule), scanned, rule), rule), "links")
    met = met.filter(F.col("end") == F.col("lo")).drop("end")

    # What is left open; a smaller group may be one of those that two classes share.
    label = components(links)
    state = met.select("token", "step", "n", "cls", "classes").join(label.select(F.col("node").alias("cls"), "label"), "cls", "left")
    state = state.withColumn("label", F.coalesce("label", "cls"))
    for _ in range(OPEN_ROUNDS):
        state = common.settle(still_open(state, rule), "open")
    if state.isEmpty():
        return label
    # Classes that share open groups are searched together once, however many groups they share.
    first = state.groupBy("token", "step").agg(F.min("cls").alias("a"))
    region = components(state.join(first, ["token", "step"]).select("a", F.col("cls").alias("b")).distinct())
    # Of a class as one row, its shingles in open groups: classes of two components that link share ``rule.shared`` of these.
    lists = state.groupBy("cls").agg(F.max("n").alias("size"), F.collect_set("token").alias("shingles"))
    lists = lists.join(region.select(F.col("node").alias("cls"), F.col("label").alias("region")), "cls")
    lists = common.settle(lists.join(parity_of(scanned, lists.select("cls")), "cls"), "lists")
    # The likeliest link to each other component first, which joins what belongs together; then all that is still possible.
    for best in (True, False):
        found = region_pairs(lists, label, rule, best)
        links = common.settle(links.unionByName(linked_pairs(docs, found, rule)), "links")
        label = components(links)
    return label


def still_open(state: DataFrame, rule: Rule) -> DataFrame:
    """Rows (token, step, n, cls, classes, label) of groups with classes of several components, less the classes that cannot link there.

    Every group that linked classes of two components share is open, and they
    share ``rule.shared`` of one step.  So a class with fewer has no link to find,
    and neither has one in groups of two alone, whose classes have met.  Without
    these classes other groups may not be open any more.
    """
    sides = state.groupBy("token", "step").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b")
    state = state.join(sides.select("token", "step"), ["token", "step"])
    own = Window.partitionBy("cls", "step")
    state = state.withColumn("_times", F.count("*").over(own)).withColumn("_most", F.max("classes").over(own))
    return state.filter((F.col("_times") >= rule.shared) & (F.col("_most") > 2)).drop("_times", "_most")


def region_pairs(lists: DataFrame, label: DataFrame, rule: Rule, best: bool) -> DataFrame:
    """Pairs (leader, _n, cls, n) that may link across components of a region: classes outside its largest part against all."""
    known = lists.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    known = common.settle(known, "known")
    main = known.groupBy("region", "label").agg(F.count("*").alias("c"))
    main = main.groupBy("region").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    index = known.select("region", "cls", F.size("shingles").alias("n"), "label")
    queries = index.join(main, "region").filter(F.col("label") != F.col("main")).select("region", "cls", "n")
    sets_ = known.select("cls", "shingles", "parity", "size", "label")
    found = search_plan(index.drop("label"), queries, sets_, ["region"], rule.shared, rule, best)
    sizes = known.select("cls", F.col("size").alias("n"))
    found = found.join(sizes.withColumnRenamed("cls", "a").withColumnRenamed("n", "_n"), "a").join(sizes.withColumnRenamed("cls", "b"), "b")
    # Both ways round it is one pair; the side with the larger hash leads.
    sides = F.sort_array(F.array(F.struct(F.col("a").alias("cls"), F.col("_n").alias("n")), F.struct(F.col("b").alias("cls"), "n")))
    found = found.select(sides.alias("s")).select(F.col("s")[1]["cls"].alias("leader"), F.col("s")[1]["n"].alias("_n"), F.col("s")[0]["cls"].alias("cls"), F.col("s")[0]["n"].alias("n"))
    return found.distinct()


def counted(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (leader, _n, cls, n) that stand there ``rule.shared`` times, whichever side leads."""
    turned = F.col("leader") > F.col("cls")
    both = F.struct("leader", "_n", "cls", "n")
    times = pairs.groupBy(F.when(turned, F.col("cls")).otherwise(F.col("leader")).alias("x"), F.when(turned, F.col("leader")).otherwise(F.col("cls")).alias("y"))
    return times.agg(F.min(both).alias("p"), F.count("*").alias("times")).filter(F.col("times") >= rule.shared).select("p.*")


def linked_pairs(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Those of the different pairs (leader, _n, cls, n) that link, as (a, b)."""
    index = common.settle(pairs, "likely")
    leaders = index.select("leader", F.col("leader").alias("cls"), F.col("_n").alias("n")).distinct()
    shingle_sets = common.settle(fetch(docs, index.select("cls").union(index.select("leader")).distinct(), rule), "sets")
    return search_plan(index.select("leader", "cls", "n"), leaders, shingle_sets, ["leader"], rule)


def resolved(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, cls of every document) and (cls, label, component_id, members of every class)."""
    common.bounded_batches(docs.sparkSession)
    scanned = common.settle(scan(docs, rule), "scan")
    own = scanned.filter("block is null").select("doc_id", "key", "n", "cls")
    label = link_classes(docs, scanned, rule).select(F.col("node").alias("cls"), "label")
    classes = own.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    named = common.settle(classes.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "named")
    groups = named.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("copies").alias("members"))
    by_class = named.select("cls", "label").join(common.settle(groups, "groups"), "label")
    return own, common.settle(by_class, "classes")


def joined(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id, n_members: one row per document."""
    own, classes = resolved(docs, rule)
    return own.join(classes, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("n_members"),
    )


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each component, that of the smallest id, and every document without words; own columns."""
    own, classes = resolved(docs, rule)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = own.join(classes, "cls").groupBy("label").agg(F.min(order)["key"].alias("_key"))
    key = common.fresh("key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    chosen = common.settle(first, "chosen").select(F.col("_key").alias(key))
    kept = keyed.join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)
    return kept.unionByName(docs.filter(wordless))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents
), sh AS (
  SELECT doc_id, len(w) AS nw, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words
), sets AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS c, s FROM sh
), reps AS (
  SELECT c, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM sets WHERE n > 0 GROUP BY c
), post AS (
  SELECT rep, n, unnest(s) AS t FROM reps WHERE n >= 9
), links AS (
  SELECT a.rep AS x, b.rep AS y
  FROM post a JOIN post b ON a.t = b.t AND a.rep <> b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 19 * count(*) >= 9 * (a.n + b.n)
), reach(x, y) AS (
  SELECT rep, rep FROM reps UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (
  SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x
), final AS (
  SELECT s.doc_id, s.n AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
  FROM sets s LEFT JOIN reps r ON s.c = r.c AND s.n > 0 LEFT JOIN comp k ON k.rep = r.rep
)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id,
  CASE WHEN n_shingles = 0 THEN 1 ELSE count(*) FILTER (WHERE n_shingles > 0) OVER (PARTITION BY component_id) END AS n_members
FROM final
"""


@common.query("op6_jaccard_join", SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents").select("doc_id", "text"), Rule(words=3, percent=90))
