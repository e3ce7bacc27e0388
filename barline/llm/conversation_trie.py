"""Prefix trie of conversations by vertical bitmaps.

A node is a sequence of first turns; its members are the conversations that
start with it.

*Positions.*  Turns are numbered by the two-level scan over (conversation, turn),
so a conversation of any length is spread over tasks.

*Pieces.*  A conversation is cut into pieces of ``SEGMENT`` turns.  A node is known
by the sum of the digests of its (position, role, text) in four lanes of 32 bits,
so a piece needs only its own digests and the sum before it.

*Bitmaps.*  A shard is a range of conversations.  It indexes every (position, turn)
as a bitset over its pieces.  Depth first, a node's bitset loses its ended pieces;
the lowest remaining one names a next turn, whose posting, intersected with the
node's bitset, is a child; what is left names the next child.  Popcounts, smallest
members and lists of ended conversations are the shard's part of a node, and parts
merge by key.

*Subtrees.*  Every node is owned by its smallest member, and what a conversation
owns is one stretch of its path.  The nodes below a node are owned by its members,
each wholly but for the owner's own nodes above, so a subtree's sum is the sum of
its members' totals (the same bitmaps again) less what the owner owns above it.
No pass goes level by level.

*Ends.*  Shards are ranges in order, so the ended conversations of a node are the
shards' lists one after another.  Lists that cross shards are streamed through
SHA-256 in that order and never held as a whole.

Defined cases: turns are in order of (turn, role, MD5 of role and text), null
turns first; null role and text are empty; repeated rows are turns of their own; rows with a null
conv_id take no part; an empty table has no nodes, not even the root; other
columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common
from barline.operators import series

#: Turns of a piece; turns of a shard on average.
SEGMENT, SHARD = 512, 1 << 15
#: A conversation is rebuilt with the first turns of the one whose id is its own rounded down to this.
BLOCK, HEADS = 100, 6
LANES = 4
#: Rows of a batch that a task gives back.
ROWS = 1 << 14

PIECES = "conv_id long, segment int, ends boolean, base array<long>, digests array<binary>, chars array<long>"
NODES = "key binary, parent binary, depth long, chars long, n long, low long, ended_from long, ended string"


# --- conversations as sequences of digests --------------------------------------------------------------------------


def turns(table: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_hash, chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length sets role and text apart.
    told = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = table.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role_text"),
        told.alias("turn_hash"),
        F.length(text).cast("long").alias("chars"),
    )
    # Texts do not travel: equal turns of one role stand in the order of their digests.
    order = [F.asc_nulls_first("turn"), "role_text", "turn_hash"]
    placed = series.row_index(rows, ["conv_id"], order, "pos")
    return placed.select("conv_id", "pos", "turn_hash", "chars")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and every conv_id with its number of turns."""
    lengths = placed.groupBy("conv_id").agg(F.max("pos").alias("own"))
    own = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads_wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    of = lengths.select("conv_id", "own", own.alias("leader"), heads_wanted.alias("h"))
    leaders = lengths.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("leader"), F.col("own").alias("led"))
    of = of.join(leaders, "leader", "left")
    of = of.withColumn("shared", F.least("h", F.coalesce("led", F.lit(0))))
    plan = common.settle(of.select("conv_id", "leader", "h", "shared", (F.col("shared") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "plan")
    first = placed.filter((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEADS))
    first = first.select(F.col("conv_id").alias("leader"), "pos", "turn_hash", "chars")
    # At most BLOCK conversations and HEADS - 1 turns meet under a leader.
    heads = plan.select("conv_id", "leader", "shared").join(first, "leader").filter(F.col("pos") <= F.col("shared"))
    rest = placed.join(plan.select("conv_id", "h", "shared"), "conv_id").filter(F.col("pos") > F.col("h"))
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "turn_hash", "chars")
    return heads.select("conv_id", "pos", "turn_hash", "chars").unionByName(rest), plan.select("conv_id", "length")


def _lane(digest: Column, k: int) -> Column:
    return F.conv(F.substring(F.hex(digest), 8 * k + 1, 8), 16, 10).cast("long")


def lane_sum(k: int) -> Column:
    total = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + _lane(x["digest"], k))
    return F.coalesce(total, F.lit(0))


def pieces(sequences: DataFrame, lengths: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for each ``size`` turns of a conversation (one for a conversation without turns), written."""
    digest = F.unhex(F.md5(F.concat(F.col("turn_hash"), F.lit(":"), F.col("pos").cast("string")).cast("binary")))
    rows = sequences.withColumns({"segment": F.floor((F.col("pos") - 1) / size).cast("int"), "digest": digest})
    packed = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    count = F.ceil(F.col("length") / size).cast("int")
    all_segments = lengths.select("conv_id", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("segment"), count.alias("n"))
    packed = all_segments.join(packed, ["conv_id", "segment"], "left")
    long_ones = packed.filter(F.col("n") > 1).select("conv_id", "segment", *[lane_sum(k).alias(f"s{k}") for k in range(LANES)])
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    mod = F.lit(1 << 32)
    bases = long_ones.select("conv_id", "segment", F.array(*[F.coalesce(F.sum(F.col(f"s{k}") % mod).over(before), F.lit(0)) % mod for k in range(LANES)]).alias("base"))
    packed = packed.join(bases, ["conv_id", "segment"], "left")
    out = packed.select(
        "conv_id",
        "segment",
        (F.col("segment") >= F.col("n") - 1).alias("ends"),
        F.coalesce("base", F.array(*[F.lit(0).cast("long")] * LANES)).alias("base"),
        F.coalesce(F.transform("t", lambda x: x["digest"]), F.array().cast("array<binary>")).alias("digests"),
        F.coalesce(F.transform("t", lambda x: x["chars"]), F.array().cast("array<long>")).alias("chars"),
    )
    return common.settle(out, "pieces")


# --- the bitmaps of one shard -----------------------------------------------------------------------------------------


class Shard:
    """Pieces of a range of conversations, in order, and the postings of their turns."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table.column("segment").to_numpy(), table.column("conv_id").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        self.conv = table.column("conv_id").to_pylist()
        self.segment = table.column("segment").to_pylist()
        self.ends = table.column("ends").to_pylist()
        self.digests = table.column("digests").to_pylist()
        self.chars = table.column("chars").to_pylist()
        self.keys = []
        for base, own in zip(table.column("base").to_pylist(), self.digests, strict=True):
            lanes = np.frombuffer(b"".join(own), ">u4").reshape(-1, LANES).astype(np.uint32)
            sums = np.cumsum(np.concatenate([np.array([base], np.uint32), lanes]), axis=0, dtype=np.uint32)
            raw = sums.astype(">u4").tobytes()
            self.keys.append([raw[k : k + 16] for k in range(0, len(raw), 16)])
        self.postings: dict[bytes, int] = {}
        for i, own in enumerate(self.digests):
            bit = 1 << i
            for digest in own:
                self.postings[digest] = self.postings.get(digest, 0) | bit

    def roots(self) -> list[tuple[int, int, int]]:
        """(bitset, a member, depth inside the segment): the pieces that go on from one node."""
        groups: dict[tuple[int, bytes], int] = {}
        for i, keys in enumerate(self.keys):
            at = self.segment[i], keys[0]
            groups[at] = groups.get(at, 0) | 1 << i
        return [(bits, (bits & -bits).bit_length() - 1, 0) for bits in groups.values()]

    def nodes(self) -> Iterator[tuple[int, int, int, int]]:
        """(bitset, lowest member, depth in the segment, bitset of the ended) depth first; starts of later segments are left out."""
        stack = self.roots()
        while stack:
            bits, low, depth = stack.pop()
            done, left = 0, bits
            children = []
            while left:
                bit = left & -left
                one = bit.bit_length() - 1
                if depth == len(self.digests[one]):
                    done |= bit
                    left ^= bit
                    continue
                child = bits & self.postings[self.digests[one][depth]]
                left &= ~child
                children.append((child, one, depth + 1))
            if depth or self.segment[low] == 0:
                yield bits, low, depth, done
            stack.extend(reversed(children))

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            bit = bits & -bits
            yield bit.bit_length() - 1
            bits ^= bit


def _batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])

    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield batch()
            held.clear()
    if held:
        yield batch()


def shards(cut: DataFrame, number: int) -> DataFrame:
    """Ranges of conversations, a partition each."""
    return cut.repartitionByRange(number, "conv_id", "segment")


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A shard: bounded by the number of shards."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    return table if table is not None and table.num_rows else None


def local_nodes(size: int):
    """The shard's part of every node (see ``NODES``); pieces have ``size`` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is not None:
            yield from _batches(_node_rows(Shard(table), size), list(zip(names, kinds, strict=True)))

    binary, number = pa.binary(), pa.int64()
    kinds = [binary, binary, number, number, number, number, number, pa.string()]
    names = [f.split(" ")[0] for f in NODES.split(", ")]
    return run


def _node_rows(shard: Shard, size: int) -> Iterator[tuple]:
    for bits, low, depth, done in shard.nodes():
        # A piece that ends its segment goes on in the next one unless it is the conversation's last.
        ended = [shard.conv[i] for i in shard.members(done) if shard.ends[i]] if done else []
        yield (
            shard.keys[low][depth],
            shard.keys[low][depth - 1] if depth else None,
            shard.segment[low] * size + depth,
            shard.chars[low][depth - 1] if depth else 0,
            bits.bit_count(),
            shard.conv[low],
            ended[0] if ended else None,
            ",".join(map(str, ended)) if ended else None,
        )


def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, weight, leaves: over the shard's members of every node."""
    table = _whole(batches)
    if table is None:
        return
    shard = Shard(table.drop_columns(["weight", "leaf"]))
    of = dict(zip(table.column("conv_id").to_pylist(), zip(table.column("weight").to_pylist(), table.column("leaf").to_pylist(), strict=True), strict=True))

    def rows() -> Iterator[tuple]:
        for bits, low, depth, _ in shard.nodes():
            sums = [of[shard.conv[i]] for i in shard.members(bits)]
            yield shard.keys[low][depth], sum(w for w, _ in sums), sum(n for _, n in sums)

    yield from _batches(rows(), [("key", pa.binary()), ("weight", pa.int64()), ("leaves", pa.int64())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lists, which come in order."""
    def rows() -> Iterator[tuple]:
        key, state = None, None
        for batch in batches:
            for at, text in zip(batch.column("key").to_pylist(), batch.column("ended").to_pylist(), strict=True):
                if at != key:
                    if state is not None:
                        yield key, state.hexdigest()
                    key, state = at, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state is not None:
            yield key, state.hexdigest()

    yield from _batches(rows(), [("key", pa.binary()), ("ends_sha256", pa.string())])


# --- over all shards --------------------------------------------------------------------------------------------------


def trie(table: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row for each node: see the module's text."""
    placed = common.settle(turns(table), "turns")
    number = max(1, -(-placed.count() // shard))
    cut = pieces(*rebuilt(placed), segment)
    parts = common.settle(shards(cut, number).mapInArrow(local_nodes(segment), NODES), "parts")
    nodes = parts.groupBy("key").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("chars").alias("chars"),
        F.sum("n").alias("n_convs"),
        F.min("low").alias("conv_id"),
        F.count("ended").alias("n_lists"),
        F.max("ended").alias("ended"),
    )
    children = parts.filter("parent is not null").select("parent", "key").distinct().groupBy(F.col("parent").alias("key"))
    nodes = nodes.join(children.agg(F.count("key").alias("n_children")), "key", "left").fillna(0, ["n_children"])
    nodes = common.settle(nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    owned = nodes.groupBy("conv_id").agg(
        F.sum("weight").alias("weight"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.min("depth").alias("from_depth"),
    )
    owned = common.settle(owned, "owned")
    weighed = cut.join(owned.select("conv_id", "weight", "leaf"), "conv_id", "left").fillna(0, ["weight", "leaf"])
    sums = shards(weighed, number).mapInArrow(local_sums, "key binary, weight long, leaves long")
    sums = sums.groupBy("key").agg(F.sum("weight").alias("below"), F.sum("leaves").alias("n_leaves"))
    # What the owner owns above a node; only shared nodes weigh anything.
    shared = nodes.filter("n_convs > 1").select("conv_id", "depth", "weight", "key")
    above = series.running(shared, ["conv_id"], ["depth"], {"above": series.Run("sum", F.col("weight"), inclusive=False)})
    above = above.select("key", "above")

    # The parent is the owner's own, but for the first node that a conversation owns.
    first = nodes.join(owned.select("conv_id", "from_depth"), "conv_id").filter("depth = from_depth and parent is not null")
    owners = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("owner"))
    first = first.select("key", "parent").join(owners.hint("merge"), "parent").select("key", "owner")

    # Lists in one shard are hashed as they are; the others in a stream, in order.
    crossing = nodes.filter("n_lists > 1").select("key")
    lists = parts.filter("ended is not null").select("key", "ended_from", "ended").join(crossing, "key")
    streamed = lists.repartition("key").sortWithinPartitions("key", "ended_from").mapInArrow(_hashed, "key binary, ends_sha256 string")

    out = nodes.join(sums, "key").join(above, "key", "left").join(first, "key", "left").join(streamed, "key", "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("parent").isNotNull(), F.coalesce("owner", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.when(F.col("n_convs") > 1, F.col("below") - F.coalesce("above", F.lit(0))).otherwise(0).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.coalesce("ended", F.lit("")), 256)).alias("ends_sha256"),
    )


_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
  ) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS leader, count(*) AS n, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda x, y: list_reduce(
      list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
  ), 4294967295) % 6 AS h
  FROM t GROUP BY conv_id
), b AS (
  SELECT c.conv_id, c.leader, c.h, least(c.h, coalesce(l.n, 0)) AS shared FROM c LEFT JOIN c AS l ON l.conv_id = c.leader
), seq AS (
  SELECT b.conv_id, t.pos, role, text FROM b JOIN t ON t.conv_id = b.leader AND t.pos <= b.h
  UNION ALL
  SELECT b.conv_id, t.pos - b.h + b.shared, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos > b.h
), path AS (
  SELECT conv_id, pos AS depth, length(text) AS chars, md5(string_agg(sha256(length(role) || ':' || role || text), '')
    OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS key
  FROM seq
  UNION ALL SELECT conv_id, 0, 0, '' FROM b
), node AS (
  SELECT key, depth, count(*) AS n_convs, min(conv_id) AS conv_id, max(chars) AS chars FROM path GROUP BY key, depth
), up AS (
  SELECT DISTINCT p.key, q.key AS parent FROM path p JOIN path q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1
), kids AS (
  SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent
), whole AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)
), below AS (
  SELECT a.key, sum((u.n_convs - 1) * u.chars) AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
  FROM whole u JOIN path a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.key
), ended AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM path WHERE (conv_id, depth) IN (SELECT (conv_id, max(depth)) FROM path GROUP BY conv_id) GROUP BY key
)
SELECT whole.conv_id, whole.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, whole.n_convs::BIGINT AS n_convs,
  whole.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole JOIN below USING (key) LEFT JOIN up USING (key) LEFT JOIN node p ON p.key = up.parent LEFT JOIN ended USING (key)
"""


@common.query("op13_conversation_trie", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))
