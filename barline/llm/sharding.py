"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an
offset and a step from two hashes of its name; a prime size makes each order a
permutation).  The shards take turns; at its turn a shard claims the first slot
of its order that is still free.  The filled table is nearly even, and a shard
that leaves or joins moves little besides its own share.

The table has a fixed number of rows, so it is broadcast; placing a document is
one hash and one lookup.

Defined cases: a null doc_id is placed by its text, a null text as an empty one;
rows with one id go to one shard; shard names may come in any order (the table
depends on the set of names); no shards, repeated names or more shards than
slots are errors.  Extra columns stay; one named as
the answer's columns is replaced by it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common

#: Prime, and over a hundred times the number of shards: no shard has 1 % more slots than another.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(names: tuple[str, ...] | list[str], slots: int = SLOTS) -> list[str]:
    """The shard of every slot."""
    order = sorted(names)
    if not order or len(set(order)) != len(order) or len(order) > slots or not is_prime(slots):
        raise ValueError("shards: distinct names, at least one, no more than a prime number of slots")
    wanted = [preference(name, slots)[0] for name in order]
    step = [preference(name, slots)[1] for name in order]
    table: list[str | None] = [None] * slots
    free = slots
    while True:
        for k, name in enumerate(order):
            at = wanted[k]
            while table[at] is not None:
                at = (at + step[k]) % slots
            table[at] = name
            wanted[k] = (at + step[k]) % slots
            free -= 1
            if not free:
                return table  # type: ignore[return-value]


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    key = F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.coalesce(text, F.lit(""))))
    return F.pmod(key, F.lit(slots)).cast("int")


def placed(docs: DataFrame, names=SHARDS, slots: int = SLOTS, shard: str = "shard", slot: str | None = None) -> DataFrame:
    """All columns of the documents and the shard of each."""
    at = slot or common.fresh("slot")
    docs = docs.drop(shard, at)
    # As an Arrow table: rows of Python objects would start Python workers of their own on every executor.
    rows = pa.table({at: pa.array(range(slots), pa.int32()), shard: fill(names, slots)})
    table = docs.sparkSession.createDataFrame(rows)
    out = docs.withColumn(at, slot_of(F.col("doc_id"), F.col("text"), slots)).join(F.broadcast(table), at)
    own = [c for c in docs.columns if c not in (shard, slot)]
    return out.select(*own, *([at] if slot else []), shard)


def write_shards(docs: DataFrame, path: str, shard: str = "shard", files: int = 16) -> None:
    """One folder for each shard with about ``files`` files, its rows spread evenly over them."""
    part = common.fresh("part")
    spread = docs.withColumn(part, F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(files)))
    spread.repartition(shard, part).drop(part).write.partitionBy(shard).parquet(path)


@common.query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return placed(docs, slot="slot").select("doc_id", "slot", "shard")
