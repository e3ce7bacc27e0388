"""Small-world graphs against brute force: exact on small tables, by recall on large ones."""

import math

import numpy as np
import pytest
from helpers import frame

from barline.llm import common, neighbour_graph


def brute(rows, k=20):
    """Every query's list by the definition, over cleaned rows {id: vector}."""
    out = []
    for q in sorted(i for i in rows if i % 20 == 0):
        score = {i: float(np.einsum("d,d->", rows[q], v)) for i, v in rows.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:k]
        out += [(q, r + 1, i, score[i]) for r, i in enumerate(best)]
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def by_twenty(v):
    return v % 20 == 0


def clean(pairs, length):
    rows = {}
    for i, v in pairs:
        if i is None or not v or len(v) != length or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        if i not in rows or v < rows[i]:
            rows[i] = v
    return {i: np.array(v, float) for i, v in rows.items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_tables_are_exact(spark, kind):
    rng = np.random.default_rng(4)
    cast = (lambda v: [float(np.float32(x)) for x in v]) if kind == "float" else (lambda v: [float(x) for x in v])
    pairs = [(k, cast(rng.normal(size=6))) for k in range(90)]
    pairs += [(100 + k, pairs[5][1]) for k in range(45)]  # copies, queries among them
    pairs += [(200 + k, cast(np.array(pairs[k][1]) * 1000.0 ** (k % 5 - 2))) for k in range(30)]  # norms far apart
    pairs += [(300, None), (320, []), (340, [0.0] * 6), (360, [math.nan] + [1.0] * 5), (380, [math.inf] * 6), (400, [None] + [1.0] * 5)]
    pairs += [(420, [1.0] * 5), (None, [1.0] * 6), pairs[3], (7, [-9.0] * 6), (-20, cast(rng.normal(size=6)))]
    docs = frame(spark, [(i, v, i, 1) for i, v in pairs], f"vec_id long, embedding array<{kind}>, rank long, score int")
    got = found(neighbour_graph.neighbours(docs.repartition(4), by_twenty))
    want = brute(clean(pairs, 6))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_fewer_candidates_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    docs = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.0, 2.0])], schema)
    assert found(neighbour_graph.neighbours(docs, by_twenty)) == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert found(neighbour_graph.neighbours(frame(spark, [(20, [1.0])], schema), by_twenty)) == []
    assert found(neighbour_graph.neighbours(frame(spark, [(3, [1.0]), (4, [2.0])], schema), by_twenty)) == []
    assert found(neighbour_graph.neighbours(frame(spark, [(3, None)], schema), by_twenty)) == []
    assert found(neighbour_graph.neighbours(frame(spark, [], schema), by_twenty)) == []


def test_recall_over_several_shards(spark, monkeypatch):
    """Clustered vectors of unequal norms; a hot vector that a third of the rows share."""
    monkeypatch.setattr(neighbour_graph, "shard_rows", lambda n, length: 500)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    v = centres[rng.integers(0, 30, 2400)] + rng.normal(size=(2400, 24)) * 0.4
    v *= np.exp(rng.normal(size=(2400, 1)))
    v[::3] = v[0]
    rows = {k: np.float32(x).astype(float) for k, x in enumerate(v)}
    docs = frame(spark, [(k, x.tolist()) for k, x in rows.items()], "vec_id long, embedding array<float>")
    got, want = found(neighbour_graph.neighbours(docs, by_twenty)), brute(rows)
    assert len(got) == len(want) and {(g[0], g[1]) for g in got} == {(w[0], w[1]) for w in want}
    assert len({g[::2][:2] for g in got} & {w[::2][:2] for w in want}) >= 0.9 * len(want)
    assert {g for g in got if g[0] % 60 == 0} == {w for w in want if w[0] % 60 == 0} or np.allclose(
        [g[3] for g in got if g[0] % 60 == 0], [w[3] for w in want if w[0] % 60 == 0]
    )


def test_query_on_sf01(spark):
    sf = "/root/testdata/sf0.1"
    got = found(common.PLANS["op12_neighbour_graph"](spark, sf))
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute(clean([(r.vec_id, r.embedding) for r in table], len(table[0].embedding)))
    assert len(got) == len(want)
    exact = {(w[0], w[2]): w[3] for w in want}
    hits = [g for g in got if (g[0], g[2]) in exact]
    assert len(hits) >= 0.9 * len(want)
    assert all(abs(exact[g[0], g[2]] - g[3]) < 1e-12 for g in hits)
    assert all(a[3] >= b[3] for a, b in zip(got, got[1:], strict=False) if a[0] == b[0])


def test_graph_is_the_same_after_storing():
    v = np.random.default_rng(6).normal(size=(700, 8))
    graph = neighbour_graph.build(v)
    again = neighbour_graph.restored(v, [neighbour_graph.flat(graph, k) for k in range(len(v))])
    assert len(graph.layers) == len(again.layers) > 1
    assert all((a.links == b.links).all() and (a.slot == b.slot).all() for a, b in zip(graph.layers, again.layers, strict=True))
    assert all(len(set(x[x >= 0])) == (x >= 0).sum() for layer in graph.layers for x in layer.links)
