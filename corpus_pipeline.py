"""The corpus pipeline: documents in, a clean, mixed and sharded training set out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm import common, decontamination, jaccard_join, mixing, quality_classifier, sharding

#: Intermediate tables and broadcasts of the stage that ran last; the next one is given its written result and frees them.
_LEFT: list = []


def _stage(apply, first: bool = False):
    """A stage that gives back what the one before has left in the driver and in the shared folder."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        if not first:
            common.free(spark, _LEFT)
        with common.recorded() as made:
            out = apply(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    run.__doc__ = apply.__doc__
    return run


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, jaccard_join.Rule(words=5, percent=80))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and the shard of each."""
    return sharding.placed(docs)


STAGES = [
    ("quality classifier", _stage(good, first=True)),
    ("n-gram Jaccard join", _stage(distinct)),
    ("benchmark decontamination", _stage(uncontaminated)),
    ("mixing sources to target weights", _stage(mixed)),
    ("sharding", _stage(sharded)),
]

#: Trained models and random draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over the table that the one before has written."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.settle(docs, "stage")
            if k:
                common.release(given)
    return docs
