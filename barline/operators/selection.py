"""Top-k, Pareto front, ranking, deterministic splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.draws import mix
from barline.operators.quantiles import value_ranks

#: Parts of the merges of fronts, from the widest to the last.
MERGE_PARTS = (64, 8, 1)


def _front_of(points: np.ndarray) -> np.ndarray:
    """Front of one batch: the point of largest sum is never dominated, and
    drops all it dominates at once, so the loop runs once per front point."""
    front = []
    while len(points):
        best = points[np.argmax(points.sum(axis=1))]
        front.append(best)
        points = points[(points > best).any(axis=1)]
    return np.asarray(front).reshape(-1, points.shape[1])


def pareto_front(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Rows no other row dominates; every objective is maximised.

    Every task of the scan thins its rows to their front, so only fronts travel.
    They are merged in a tree, with a shuffle before each level: first by ranges of
    the sum of the objectives, where vectors that dominate each other lie apart by
    little, then by their hash into fewer parts.  A merge holds fronts only; the
    last one holds the answer, which is joined back to the rows.
    """
    objs = list(objectives)
    total = sum((F.col(o) for o in objs), F.lit(0.0))
    vectors = df.select(*[F.col(o).cast("double").alias(o) for o in objs]).na.drop()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((0, len(objs)))
        for b in batches:
            kept = _front_of(np.unique(np.vstack([kept, b.to_numpy(dtype=float)]), axis=0))
        if len(kept):
            yield pd.DataFrame(kept, columns=objs)

    schema = ", ".join(f"{o} double" for o in objs)
    front = vectors.mapInPandas(merge, schema)
    for level, parts in enumerate(MERGE_PARTS):
        spread = front.repartition(parts, *objs) if level else front.repartitionByRange(parts, total)
        front = spread.mapInPandas(merge, schema)
    keyed = front.select(*[F.col(o).alias(f"_f_{o}") for o in objs])
    on = [F.col(o).cast("double") == F.col(f"_f_{o}") for o in objs]
    return df.join(keyed, on, "left_semi")


def best_distinct(df: DataFrame, identity: Sequence[str], score: str, tie: str, limit: int) -> DataFrame:
    """Highest score per identical configuration, then the top ``limit``."""
    rest = [c for c in df.columns if c not in identity]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie)))
    one = df.groupBy(*identity).agg(best.alias("_b")).select(*identity, "_b.*")
    return one.orderBy(F.desc_nulls_last(score), tie).limit(limit)


def stratified_split(df: DataFrame, row_id: str, label: str, seed: int, test_share: float = 0.25, min_class: int = 4) -> DataFrame:
    """``split`` column: a quarter of each class to test, small classes to train.

    A class's test rows are those whose draw is among its lowest; the cut is the
    draw at that rank, found by the distributed rank, so a large class is never
    ordered in one task.
    """
    drawn = df.withColumn("_draw", F.struct(mix(F.col(row_id), 0, seed).alias("u"), F.col(row_id).alias("id")))
    ranks = value_ranks(drawn, [label], F.col("_draw"))
    size = ranks.groupBy(label).agg(F.max("n_le").alias("_n"))
    take = F.when(F.col("_n") < min_class, 0).otherwise(F.round(F.col("_n") * test_share))
    cut = ranks.join(size, label).filter(F.col("n_le") <= take).groupBy(label).agg(F.max("value").alias("_cut"))
    joined = drawn.join(cut, label, "left")
    chosen = F.coalesce(F.col("_draw") <= F.col("_cut"), F.lit(False))
    return joined.withColumn("split", F.when(chosen, "test").otherwise("train")).drop("_draw", "_cut")


def one_per_group(df: DataFrame, group: str, score: Column, tie: str) -> DataFrame:
    """Best row per group by score, as an aggregate."""
    best = F.max_by(F.struct(*df.columns), F.struct(score, -F.col(tie)))
    return df.groupBy(group).agg(best.alias("_b")).select("_b.*")


def ranked(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """Global rank of a small table (one row per asset)."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(w))
