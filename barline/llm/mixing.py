"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weighted share of all words, held at ``MOST`` times
what the source has; what is above goes to the others by weight until none is
above.  A document of a source is wanted ``target / source size`` times: a whole
number of copies and a fraction.  Pivotal rounding makes the fractions 0 or 1.
Two documents of a source exchange word mass, in one direction or the other
with the odds that keep both expectations, until one of them is integral; the
other goes on to meet the next.  Mass is conserved, so the words a source gives
differ from its target by less than half of one document: only the last one
left in a source is rounded by itself, to the nearer side.

The exchanges form a tree of fixed shape.  Documents are dealt by a hash of
their id to ``BUCKETS`` buckets; within a bucket each source leaves at most one
fractional document; these residuals meet in groups of ``FAN_IN`` until one is
left for each source.  A hot source is thereby spread over all buckets, no task
holds more than one fractional document at a time, and the draws depend on ids
and the seed alone, so a rerun, a retry and another partitioning agree.

Defined cases: a null text has size 0; a document of size 0 gets the whole
copies and no fraction; null sources form one source, ranked last; rows that
share doc_id, source and size are taken the same number of times each; with no
words at all every target is 0.  Extra columns do not take part; ``mixed``
returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common

#: A source gives at most this many times its words, a document this many times its own.
MOST = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
BUCKETS = 1024
FAN_IN = 32
SALTS = 64
SEED = 20
_MASK = (1 << 64) - 1

ROW = "source string, doc_id long, size long, times long, whole long, part double, bucket long, draw long, done boolean"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one small row per source, ranked in one window over the sources alone."""
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(ranked) - 1) % len(WEIGHTS) + 1)
    every = Window.partitionBy()
    # From the source that fills up first: it is full if its limit is below its share of what is left.
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("weight", weight)
        .withColumn("limit", F.lit(float(MOST)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("limit") * F.col("weights") <= F.col("left") * F.col("weight"))
        .withColumn("spare", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("spare") * F.col("weight") / F.col("open")))
        .select("source", "source_size", "target")
    )


def _draw(a: int, b: int, level: int) -> float:
    """A number in [0, 1) for the meeting of two documents."""
    h = ((a & _MASK) * 0x9E3779B97F4A7C15 + (b & _MASK) * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9) & _MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((h ^ (h >> 31)) >> 11) / float(1 << 53)


def _settled(part: float) -> bool:
    return part < 1e-12 or part > 1 - 1e-12


def meet(a: dict, b: dict, level: int) -> None:
    """Move word mass between two fractional documents until one of them is integral."""
    wa, wb = a["size"] * a["times"], b["size"] * b["times"]
    into_a = min(wa * (1 - a["part"]), wb * b["part"])
    into_b = min(wa * a["part"], wb * (1 - b["part"]))
    mass = into_a if _draw(a["draw"], b["draw"], level) * (into_a + into_b) < into_b else -into_b
    a["part"] += mass / wa
    b["part"] -= mass / wb


def rounding(level: int, last: bool):
    """The pass over rows sorted by bucket and source: every row leaves once, at most one of each group undecided."""

    def decide(row: dict) -> dict:
        row["whole"] += int(row["part"] >= 0.5)
        row["part"], row["done"] = 0.0, True
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            for row in batch.to_pylist():
                if held is not None and (held["bucket"], held["source"]) != (row["bucket"], row["source"]):
                    out.append(decide(held) if last else held)
                    held = None
                if row["size"] == 0:
                    row["part"] = 0.0
                if _settled(row["part"]):
                    out.append(decide(row))
                    continue
                if held is None:
                    held = row
                    continue
                meet(held, row, level)
                if _settled(row["part"]):
                    out.append(decide(row))
                    if _settled(held["part"]):
                        out.append(decide(held))
                        held = None
                else:
                    out.append(decide(held))
                    held = row
            yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([decide(held) if last else held], schema)

    return run


def mix(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size, times, source_size, target, copies for rows of (doc_id, source, size)."""
    units = common.settle(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "sizes")
    goal = common.settle(targets(units), "targets")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = goal.select(F.col("source").alias("_source"), "source_size", "target", salts.alias("_salt"))
    draw = F.xxhash64("doc_id", "source", "size", F.lit(SEED))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        units.withColumn("draw", draw)
        .withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
        .join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.pmod("bucket", F.lit(SALTS)) == F.col("_salt")))
        .withColumn("whole", F.floor(wanted + 1e-12).cast("long"))
        .withColumn("part", F.greatest(wanted - F.col("whole"), F.lit(0.0)))
        .withColumn("done", F.lit(False))
        .select("source", "doc_id", "size", "times", "whole", "part", "bucket", "draw", "done")
    )
    decided = None
    level, groups = 0, BUCKETS
    while True:
        by = ["bucket"] if level == 0 else ["source", "bucket"]
        placed = rows.repartition(*by).sortWithinPartitions("bucket", "source", F.desc("size"), "doc_id", "draw")
        result = common.settle(placed.mapInArrow(rounding(level, groups == 1), ROW), "rounded")
        done = result.filter("done")
        decided = done if decided is None else decided.unionByName(done)
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
        rows = result.filter("not done").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        level += 1
    found = decided.select("doc_id", "source", "size", "times", F.col("whole").alias("copies"), F.pmod("draw", F.lit(SALTS)).alias("_s"))
    return found.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt"))).select(
        "doc_id", "source", "size", "times", "source_size", "target", "copies"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as many times as it has copies, with its own columns."""
    size, copies = common.fresh("size"), common.fresh("copies")
    sized = docs.withColumn(size, n_words(F.col("text")))
    plan = mix(sized.select("doc_id", "source", F.col(size).alias("size")))
    plan = plan.filter("copies > 0").select(*[F.col(c).alias(f"_{c}{copies}") for c in ("doc_id", "source", "size", "copies")])
    same = [
        F.col(a).eqNullSafe(F.col(f"_{b}{copies}")) for a, b in (("doc_id", "doc_id"), ("source", "source"), (size, "size"))
    ]
    joined = sized.join(plan, same[0] & same[1] & same[2])
    times = F.explode(F.sequence(F.lit(1), F.col(f"_copies{copies}")))
    return joined.withColumn(copies, times).select(*docs.columns)


@common.query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    plan = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )
