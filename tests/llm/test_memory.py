"""What a task of the pipeline's first stages holds, whatever the number and length of its texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import prose

from barline.llm import common, jaccard_join, quality_classifier, sharding, tokens


def batches(n: int, words: int = 300) -> list[pa.RecordBatch]:
    """Some megabytes of texts, as the scan gets them."""
    rng = random.Random(3)
    texts = [prose(rng, words, 50_000) for _ in range(n)]
    ids = pa.array(range(n), pa.int64())
    return [pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], ["doc_id", "text", "key"])]


def peak(run) -> float:
    """MB that numpy and Python hold at most while it runs, tables that stay between calls not counted."""
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scan_holds_its_counters_and_one_piece():
    given = batches(2000)
    assert given[0].column(1).nbytes > 4e6
    counters = jaccard_join.LOADS * 4 / 1e6
    assert peak(lambda: sum(b.num_rows for b in jaccard_join.scan_rows(given, jaccard_join.Rule(5, 80), 0))) < counters + 40


def test_scores_hold_one_piece():
    given = batches(2000)[0].column(1)
    model = quality_classifier.Model(np.ones(quality_classifier.BUCKETS, np.float32), 0.0)
    assert peak(lambda: model.scores(given)) < 40


def test_scan_counts_every_shingle():
    """Counters are those of all sets, and sets do not depend on how a column is cut."""
    given = batches(150)
    text = given[0].column(1)
    whole = np.concatenate([jaccard_join.sets(d, o, 5)[0] for _, _, d, o in tokens.pieces(text, limit=1 << 30)])
    want = np.bincount((whole % np.uint64(jaccard_join.LOADS)).astype(np.int64), minlength=jaccard_join.LOADS)
    got = np.zeros((jaccard_join._LOAD_BLOCKS, jaccard_join.LOADS // jaccard_join._LOAD_BLOCKS), np.uint32)
    import zlib

    for batch in jaccard_join.scan_rows(given, jaccard_join.Rule(5, 80), 0):
        for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if block is not None:
                got[block] = np.frombuffer(zlib.decompress(part), np.uint32)
    assert np.array_equal(got.reshape(-1), want)


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('some words ', 1000) text")
    common.bounded_batches(spark)
    sizes = docs.mapInArrow(lambda rows: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in rows), "n long").collect()
    assert sum(r.n for r in sizes) > 3000 * 11_000 and max(r.n for r in sizes) < 2 * common.BATCH_BYTES


def test_slots_need_no_python_workers(spark):
    docs = spark.range(3).selectExpr("id doc_id", "'some words' text")
    out = sharding.placed(docs, slot="slot")
    assert "LogicalRDD" not in out._jdf.queryExecution().toString()
    assert [t for _, t in out.select("slot", "shard").dtypes] == ["int", "string"]
