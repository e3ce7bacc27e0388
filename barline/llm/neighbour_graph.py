"""Nearest neighbours by largest inner product: a navigable small-world graph per shard.

*Shards.*  Different vectors are dealt by their hash to shards of about
``32 sqrt(n)`` vectors (bounded by memory for long ones), so work for each query
grows with the square root of the table.  Vectors of one shard have norms
within a factor of two of each other: with one more component that makes all
norms equal, the largest inner product is the smallest angle, which is what the
graph is built for.

*Graph.*  Layers as in the hierarchical small-world graph: every node is in
layer 0, one in ``M`` in the layer above, and so on.  Nodes are linked to
candidates that are nearer to them than to any chosen before, both ways.  They
enter in batches that double; a whole batch walks the graph in lockstep as numpy
arrays.  A node is stored as a row with its neighbours as a flat array: ``2 M``
of layer 0, then ``M`` of each higher layer, -1 where there is none.

*Search.*  Queries stream past the graph of each shard, in groups of
``QUERIES``, and walk it in lockstep.  The best nodes of every walk are scored
again in double precision on the original vectors.  Shard results merge by a
bounded top list.

*Copies* are one node; it carries its smallest ids, which are all that a list of
``k`` can need.  A query vector that many rows share is searched once.

Defined cases: rows whose id is null, or whose vector is null, zero, empty or
holds null or non-finite components, take no part; neither do vectors of
another length than the most frequent one (the longer where equal); rows that
share an id count as one, with the smallest of their vectors; fewer than ``k``
candidates give as many rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import common

M = 16
#: Walk widths while building (layer 0, above) and searching; nodes opened at once.
BUILD, UPPER, SEARCH, STEP = 80, 8, 160, 4
#: Rows handled in lockstep, queries that pass a graph in one task.
BATCH, QUERIES = 256, 1 << 16
#: Vectors of a shard: this many times the root of their number, at least ``LEAST``, and no more than fit ``COMPONENTS``.
ROOTS, LEAST, COMPONENTS = 32, 2048, 1 << 22
SEED = 7


def shard_rows(n: int, length: int) -> int:
    return max(1, min(max(LEAST, int(ROOTS * n**0.5)), COMPONENTS // max(1, length)))


# --- the graph of one shard -------------------------------------------------------------------------------------------


@dataclass
class Layer:
    slot: np.ndarray
    links: np.ndarray


@dataclass
class Graph:
    """``points`` have equal norms; layers from the lowest to the top; node 0 is in all of them."""

    points: np.ndarray
    layers: list[Layer]


def level_points(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to a largest norm of 1, with the component that brings every norm to 1."""
    v = vectors.astype(np.float64)
    v /= max(float(np.abs(v).max(initial=0)), 1e-300)
    square = (v * v).sum(1)
    most = square.max(initial=0)
    v = np.concatenate([v, np.sqrt(np.maximum(0, most - square))[:, None]], 1)
    return (v / max(most, 1e-300) ** 0.5).astype(np.float32)


def walk(points: np.ndarray, layer: Layer, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple:
    """The ``width`` best nodes found for each query from its entries, best first (-1 where none)."""
    n, some = len(queries), np.arange(len(queries))
    seen = np.zeros((n, len(points) + 1), bool)  # the last place takes the missing
    seen[:, -1] = True
    seen[some[:, None], entries] = True
    ids, score, fresh = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
    k = min(width, entries.shape[1])
    ids[:, :k] = entries[:, :k]
    score[:, :k] = np.where(ids[:, :k] < 0, -np.inf, np.einsum("rkd,rd->rk", points[ids[:, :k]], queries))
    fresh[:, :k] = ids[:, :k] >= 0
    while len(some):
        waiting = np.where(fresh[some], score[some], -np.inf)
        take = min(STEP, width)
        pick = np.argpartition(-waiting, take - 1, axis=1)[:, :take]
        there = np.take_along_axis(waiting, pick, 1) > -np.inf
        goes = there.any(1)
        some, pick, there = some[goes], pick[goes], there[goes]
        if not len(some):
            break
        row = some[:, None]
        fresh[row, pick] = False
        near = np.where(there[:, :, None], layer.links[layer.slot[ids[row, pick]]], -1).reshape(len(some), -1)
        near = np.where(seen[row, near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[row, near] = True
        value = np.einsum("rkd,rd->rk", points[near], queries[some])
        value[near < 0] = -np.inf
        all_score = np.concatenate([score[some], value], 1)
        best = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        score[some] = np.take_along_axis(all_score, best, 1)
        ids[some] = np.take_along_axis(np.concatenate([ids[some], near], 1), best, 1)
        fresh[some] = np.take_along_axis(np.concatenate([fresh[some], near >= 0], 1), best, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def spread(points: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to it than to any taken before, then the best of the rest."""
    out = np.full((len(ids), most), -1)
    lines = max(1, (1 << 23) // (ids.shape[1] * points.shape[1]))
    for lo in range(0, len(ids), lines):
        some, own = ids[lo : lo + lines], score[lo : lo + lines]
        v = points[some]
        among = v @ v.transpose(0, 2, 1)
        taken, nearest = np.zeros(some.shape, bool), np.full(some.shape, -np.inf, np.float32)
        for c in range(some.shape[1]):
            ok = (own[:, c] > -np.inf) & (nearest[:, c] < own[:, c]) & (taken.sum(1) < most)
            taken[:, c] = ok
            nearest = np.where(ok[:, None], np.maximum(nearest, among[:, c]), nearest)
        rank = np.where(taken, 0, np.where(own > -np.inf, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        kept = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(some, order, 1), -1)
        out[lo : lo + lines, : kept.shape[1]] = kept
    return out


def connect(points: np.ndarray, layer: Layer, new: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
    """Link new nodes with their candidates and with each other, both ways."""
    width = layer.links.shape[1]
    if len(new) > 1:
        among = points[new] @ points[new].T
        np.fill_diagonal(among, -np.inf)
        k = min(M, len(new) - 1)
        best = np.argpartition(-among, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, new[best]], 1)
        score = np.concatenate([score, np.take_along_axis(among, best, 1)], 1)
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    chosen = spread(points, ids, score, M)
    layer.links[layer.slot[new], : min(M, width)] = chosen[:, :width]
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    value = np.einsum("ed,ed->e", points[source], points[target])
    order = np.lexsort((source, -value, target))
    source, target = source[order], target[order]
    ends, first = np.unique(target, return_index=True)
    at = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    stays = at < width  # the best that come in; no more could be kept
    line = np.repeat(np.arange(len(ends)), np.diff(np.append(first, len(target))))
    have = layer.links[layer.slot[ends]]
    more = np.full((len(ends), int(at[stays].max()) + 1), -1)
    more[line[stays], at[stays]] = source[stays]
    more = np.where((more[:, :, None] == have[:, None, :]).any(2), -1, more)
    every = np.concatenate([have, more], 1)
    mine = np.einsum("tkd,td->tk", points[every], points[ends])
    mine[every < 0] = -np.inf
    order = np.argsort(-mine, axis=1, kind="stable")
    every, mine = np.take_along_axis(every, order, 1), np.take_along_axis(mine, order, 1)
    full = (every >= 0).sum(1) > width
    kept = every[:, :width]
    if full.any():
        kept[full] = spread(points, every[full], mine[full], width)
    layer.links[layer.slot[ends]] = kept


def build(vectors: np.ndarray) -> Graph:
    """The graph over different vectors, in the order given."""
    n, points = len(vectors), level_points(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(SEED).random(n)) / np.log(M)).astype(int)
    level[:1] = level.max(initial=0)
    layers = []
    for k in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= k)
        slot = np.full(n, -1)
        slot[nodes] = np.arange(len(nodes))
        layers.append(Layer(slot, np.full((len(nodes), M if k else 2 * M), -1)))
    start = 1
    while start < n:
        new = np.arange(start, min(n, 2 * start, start + BATCH))
        entries = np.zeros((len(new), 1), int)
        for k in range(len(layers) - 1, -1, -1):
            ids, score = walk(points, layers[k], points[new], entries, UPPER if k else BUILD)
            here = level[new] >= k
            if here.any():
                connect(points, layers[k], new[here], ids[here], score[here])
            entries = ids
        start = int(new[-1]) + 1
    return Graph(points, layers)


def flat(graph: Graph, node: int) -> np.ndarray:
    """A node's neighbours in all its layers end to end."""
    return np.concatenate([x.links[x.slot[node]] for x in graph.layers if x.slot[node] >= 0])


def restored(vectors: np.ndarray, rows: list[np.ndarray]) -> Graph:
    """The graph from the stored arrays."""
    level = np.array([(len(r) - 2 * M) // M for r in rows])
    layers = []
    for k in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= k)
        slot = np.full(len(rows), -1)
        slot[nodes] = np.arange(len(nodes))
        lo = (M + k * M) if k else 0
        layers.append(Layer(slot, np.stack([rows[i][lo : M * (k + 2)] for i in nodes]).astype(np.int64)))
    return Graph(level_points(vectors), layers)


def nearest(graph: Graph, queries: np.ndarray) -> np.ndarray:
    """Nodes found for each query, -1 where fewer than ``SEARCH`` were reached."""
    q = queries.astype(np.float64)
    q /= np.abs(q).max(1, keepdims=True)
    q = np.concatenate([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros((len(q), 1))], 1).astype(np.float32)
    out = []
    for lo in range(0, len(q), BATCH):
        some = q[lo : lo + BATCH]
        ids = np.zeros((len(some), 1), int)
        for k in range(len(graph.layers) - 1, -1, -1):
            ids, _ = walk(graph.points, graph.layers[k], some, ids, UPPER if k else SEARCH)
        out.append(ids)
    return np.concatenate(out) if out else np.zeros((0, SEARCH), int)


def scored(vectors: np.ndarray, members: list[np.ndarray], queries: np.ndarray, found: np.ndarray, most: int) -> tuple:
    """(query, id, inner product) of each query's ``most`` best members among the nodes found, ties to smaller ids."""
    size = np.array([len(m) for m in members])
    first = np.cumsum(size) - size
    ids = np.concatenate(members)
    value = np.einsum("rkd,rd->rk", vectors[found].astype(np.float64), queries.astype(np.float64))
    row, col = np.nonzero(found >= 0)
    node, value = found[row, col], value[row, col]
    keep = best_of(row, value, ids[first[node]], most)
    row, node, value = row[keep], node[keep], value[keep]
    n = size[node]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    row, value, ids = np.repeat(row, n), np.repeat(value, n), ids[np.repeat(first[node], n) + step]
    keep = best_of(row, value, ids, most)
    return row[keep], ids[keep], value[keep]


def best_of(row: np.ndarray, value: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    order = np.lexsort((tie, -value, row))
    row = row[order]
    first = np.searchsorted(row, row)
    return order[np.arange(len(row)) - first < most]


# --- over the table ---------------------------------------------------------------------------------------------------


def matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def vectors_of(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec, length, band: the rows that take part.  ``band``: norms within a factor of two share it."""
    element = table.schema[embedding].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    schema = f"vec_id long, vec array<{kind}>, length int, band int"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            vec = batch.column(1)
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            length = pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(vec)), length)
            most = np.zeros(len(vec))
            if len(x):
                lists = np.flatnonzero(length)
                most[lists] = np.maximum.reduceat(np.abs(x), (np.cumsum(length) - length)[lists])
            good = (most > 0) & np.isfinite(most) & (length > 0)  # a null or NaN makes the maximum NaN
            share = x / np.where(good, most, 1)[of]
            norm = np.log2(np.where(good, most, 1)) + np.log2(np.maximum(1, np.bincount(of, share * share, len(vec)))) / 2
            band = np.floor(np.where(good, norm, 0) + 0.5).astype(np.int32)
            columns = [batch.column(0), vec, pa.array(length.astype(np.int32)), pa.array(band)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "length", "band"]).filter(pa.array(good))

    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("vec"))
    return rows.mapInArrow(clean, schema)


def distinct_rows(table: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """One row per id, all of the most frequent length, written; and that length."""
    rows = vectors_of(table, vec_id, embedding)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vec", "length", "band")).alias("v")).select("vec_id", "v.*")
    rows = common.settle(rows, "vectors")
    usual = rows.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = usual[0]["length"] if usual else 0
    return rows.filter(F.col("length") == length), length


def index(rows: DataFrame, length: int, copies: int) -> tuple[DataFrame, int]:
    """(shard, node, ids, vec, links) of every different vector, written; and the number of shards."""
    # Ranks up to a bound are cut inside the tasks, so a vector that a third of the rows share sends few of them.
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= copies)
    rows = common.settle(rows, "members")
    # One row for each power of two: at most the exponents that doubles have.
    bands = sorted(rows.filter("rank = 1").groupBy("band").count().collect())
    place, shards = [], 0
    for band, n in bands:
        own = -(-n // shard_rows(n, length))
        place += [F.lit(band), F.struct(F.lit(shards).alias("first"), F.lit(own).alias("own"))]
        shards += own
    if not shards:
        return rows.select(F.lit(0).alias("shard"), F.lit(0).alias("node"), F.array("vec_id").alias("ids"), "vec", F.array(F.lit(0)).alias("links")), 0
    at = F.element_at(F.create_map(*place), F.col("band"))
    shard = (at["first"] + F.pmod(F.xxhash64("vec"), at["own"].cast("long"))).cast("int")
    kind = rows.schema["vec"].dataType.simpleString()
    schema = f"shard int, node int, ids array<long>, vec {kind}, links array<int>"
    value = pa.float32() if "float" in kind else pa.float64()

    def make(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        v = matrix(table.column("vec"), length)
        ids = table.column("vec_id").to_numpy()
        _, first, of = np.unique(v, axis=0, return_index=True, return_inverse=True)
        order = np.random.default_rng(SEED).permutation(len(first))  # of vectors in order: the same on every run
        v = v[first[order]]
        node = np.argsort(order)[of.ravel()]
        by = np.lexsort((ids, node))
        ends = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(v)))])
        graph = build(v)
        links = [flat(graph, k) for k in range(len(v))]
        upto = np.concatenate([[0], np.cumsum([len(x) for x in links])])
        return pa.table(
            {
                "shard": pa.array(np.full(len(v), key[0].as_py()), pa.int32()),
                "node": pa.array(np.arange(len(v)), pa.int32()),
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[by])),
                "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * length, pa.int32()), pa.array(v.ravel(), value)),
                "links": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(links), pa.int32())),
            }
        )

    made = rows.select("vec_id", "vec", shard.alias("shard")).groupBy("shard").applyInArrow(make, schema)
    return common.settle(made, "graph"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, length: int, most: int) -> DataFrame:
    """(rep, vec_id, score): the best members of every shard for each row ``rep, vec`` of ``queries``."""
    groups = -(-max(1, queries.count()) // QUERIES)
    cell = (F.col("shard") * groups + F.col("part")).cast("int").alias("cell")
    no_ids = F.lit(None).cast("array<long>")
    nodes = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    nodes = nodes.select(cell, F.col("node").cast("long").alias("node"), "ids", "vec", "links", F.lit(None).cast("long").alias("rep"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(groups)))
    asked = asked.select(cell, F.lit(None).cast("long").alias("node"), no_ids.alias("ids"), "vec", F.lit(None).cast("array<int>").alias("links"), "rep")
    both = nodes.unionByName(asked).repartition(shards * groups, "cell").sortWithinPartitions("cell", F.asc_nulls_last("node"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"cell": None, "rows": [], "graph": None}

        def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                edge = np.flatnonzero(np.diff(cells, prepend=-1, append=-1)) if len(cells) else []
                for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                    yield int(cells[lo]), batch.slice(lo, hi - lo)

        for at, part in parts():
            if at != held["cell"]:
                held = {"cell": at, "rows": [], "graph": None}
            is_node = part.column("node").is_valid()
            nodes, asked = part.filter(is_node), part.filter(pa.compute.invert(is_node))
            if len(nodes):
                held["rows"].append(nodes.select(["ids", "vec", "links"]))
            if not len(asked):
                continue
            if held["graph"] is None:
                if not held["rows"]:
                    continue
                table = pa.Table.from_batches(held["rows"])
                v = matrix(table.column("vec"), length)
                lists = lambda name: table.column(name).combine_chunks()  # noqa: B023, E731
                split = lambda x: np.split(x.flatten().to_numpy(), x.offsets.to_numpy()[1:-1] - x.offsets.to_numpy()[0])
                held |= {"v": v, "ids": split(lists("ids")), "graph": restored(v, split(lists("links"))), "rows": []}
            rep, q = asked.column("rep").to_numpy(), matrix(asked.column("vec"), length)
            for lo in range(0, len(q), BATCH):
                some = q[lo : lo + BATCH]
                row, ids, score = scored(held["v"], held["ids"], some, nearest(held["graph"], some), most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[lo + row]), pa.array(ids), pa.array(score)], ["rep", "vec_id", "score"]
                )

    return both.mapInArrow(run, "rep long, vec_id long, score double")


def neighbours(table: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row where ``is_query(id column)`` holds."""
    rows, length = distinct_rows(table, vec_id, embedding)
    graphs, shards = index(rows, length, k + 1)
    if not shards:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.filter(is_query(F.col("vec_id"))).select("vec_id", "vec")
    queries = common.settle(asked.groupBy("vec").agg(F.min("vec_id").alias("rep")), "queries")
    hits = search(graphs, shards, queries, length, k + 1)
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
    hits = hits.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    hits = hits.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hits"))
    lists = queries.join(hits, "rep").select("vec", "hits")
    # A vector that many queries share meets one row here, so a hot side can be split.
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists.hint("merge"), "vec")
    near = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    own = own.select("query_id", F.posexplode(near).alias("at", "hit"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


@common.query("op12_neighbour_graph")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(common.table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
