"""The stages against plain forms of their decisions, each over what the one before kept."""

import shutil
from collections import Counter

import corpus_pipeline
import pytest
from helpers import SCHEMA, corpus, frame, words
from test_decontamination import brute
from test_jaccard_join import near_copies, plain

from barline.llm import common, decontamination, jaccard_join, mixing, quality_classifier, sharding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with near copies, junk and leaked items, and the tables that the stages read."""
    at = tmp_path_factory.mktemp("corpus")
    rows = near_copies(11)
    items = [(k, rows[4 * k + 2][1][:300] if words(rows[4 * k + 2][1]) else "no such words here at all") for k in range(3)]
    rows += [(6000 + k, "###&&& !!! $$$ " * 30 + f"x{k}", "en", "s1", 1) for k in range(30)]
    rows += [(7000 + k, f"before {k} some words " + items[k % 3][1] + f" after {k} other words", "en", "s2", 1) for k in range(3)]
    labels = [(r[0], 0 if (r[0] or 0) // 1000 == 6 else 1, 0) for r in rows if r[0] is not None and r[0] % 3]
    frame(spark, rows).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    yield str(at)
    shutil.rmtree(at, ignore_errors=True)


def test_every_stage_decides_over_its_own_input(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "mixing sources to target weights",
        "sharding",
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns + ["shard"] * (k == 4)
        seen.append([tuple(r) for r in docs.collect()])
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    good, distinct, clean, mixed, sharded = seen

    model = quality_classifier.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    import pyarrow as pa

    scores = model.scores(pa.array([r[1] for r in given], pa.string()))
    assert Counter(good) == Counter(r for r, s in zip(given, scores, strict=True) if s >= quality_classifier.THRESHOLD)
    assert not any(r[0] is not None and r[0] // 1000 == 6 for r in good)

    rule = jaccard_join.Rule(5, 80)
    groups = plain(list(set(good)), rule)
    assert Counter(r[0] for r in distinct if words(r[1]) and r[0] is not None) == Counter({c for d, n, c, _ in groups if n and c is not None})
    assert set(distinct) <= set(good)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute([(r[0], r[1]) for r in distinct], items)}
    kept = {r[0] for r in clean}
    assert len(leaked & kept) <= 0.1 * len(leaked) and {r[0] for r in distinct} - leaked <= kept

    plan = {}
    frame_ = frame(spark, clean, SCHEMA)
    for r in mixing.mix(frame_.select("doc_id", "source", mixing.n_words(frame_.text).alias("size"))).collect():
        plan[(r["doc_id"], r["source"], r["size"])] = r["copies"]
    want = Counter()
    for r in clean:
        want[r] += plan[(r[0], r[3], len(words(r[1])))]
    assert Counter(mixed) == +want
    assert Counter(r[:5] for r in sharded) == Counter(mixed) and {r[5] for r in sharded} <= set(sharding.SHARDS)


def test_run_gives_what_the_stages_give(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"] and got.count() > 0


def test_stages_give_back_what_they_held(spark, folder):
    """Two runs in one session: neither tables nor broadcasts nor the driver's memory pile up."""
    import os

    def resident():
        with open(f"/proc/{os.getpid()}/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    corpus_pipeline.run(spark, folder).count()
    tables, mb = len(common._PATHS), resident()
    corpus_pipeline.run(spark, folder).count()
    # What the first run's last stages left, the second one has freed; its own last table stays.
    assert len(common._PATHS) <= tables + 1 and len(corpus_pipeline._LEFT) <= 2
    assert resident() <= mb + 60


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_corpus_with_nulls_keeps_its_columns(spark):
    docs = frame(spark, corpus())
    assert mixing.mixed(docs).columns == docs.columns


def test_the_decontamination_stage_fits_its_space_on_all_words(spark, folder, monkeypatch):
    rows = [(k, f"doc{k} some words of its own", "en", "s1", 1) for k in range(2000)] + [(9000, "long text " * 2500, "en", "s1", 1)]
    seen, real = [], decontamination.gram_times

    def spy(rows, weight, basis):
        seen.append(rows.filter("scale = 1").rdd.map(lambda r: sum(r["times"]) if "times" in r else len(r["text"].split())).sum())
        return real(rows, weight, basis)

    monkeypatch.setattr(decontamination, "gram_times", spy)
    assert dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, frame(spark, rows), folder).count() == 2001
    assert set(seen) == {2000 * 6 + 5000}
