"""Mixing and sharding."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import corpus, frame, words

from barline.llm import common, mixing, sharding


def plain_targets(sizes):
    """Share by weight, hold at three times the size, share what is above again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, list(names)
    while open_:
        left = total - sum(out.values())
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        full = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * sizes[s]
            open_.remove(s)
    return out


def check_mix(rows, got):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = plain_targets(dict(sizes))
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["source"]) for r in got))) == sorted(
        repr((r[0], len(words(r[1])), r[3])) for r in rows
    )
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    rows_of = Counter(map(repr, ((r[0], r[3], len(words(r[1]))) for r in rows)))
    most = max(rows_of.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most * largest[s] / 2 + 1e-6


def run(docs):
    plan = mixing.mix(docs.select("doc_id", "source", mixing.n_words(docs.text).alias("size")))
    rows = []
    for r in plan.collect():
        one = r.asDict() | {"taken": r["size"] * r["copies"]}
        rows += [one] * r["times"]
    return rows


@pytest.mark.parametrize("skew", [1, 40])
def test_mix_meets_targets(spark, skew):
    rng = random.Random(skew)
    rows = corpus(skew, 80)
    for k in range(200):
        rows.append((5000 + k, "w " * rng.randrange(1, 60), "en", f"t{rng.randrange(3)}", 1))
    rows += [(9000, "w " * 50 * skew, "en", "u", 1), (9001, "w", "en", "tiny", 1), (9002, "", "en", "empty", 0)]
    docs = frame(spark, rows)
    first, second = run(docs), run(docs.repartition(7))
    check_mix(rows, first)
    order = lambda out: sorted(map(repr, out))
    assert order(first) == order(second)


def test_mass_is_kept_and_expectation_too():
    rng = random.Random(1)
    total = 0.0
    for _ in range(20_000):
        a = {"size": 30, "times": 1, "part": 0.3, "draw": rng.getrandbits(63)}
        b = {"size": 70, "times": 1, "part": 0.6, "draw": rng.getrandbits(63)}
        mixing.meet(a, b, 0)
        assert abs(30 * a["part"] + 70 * b["part"] - 51) < 1e-9
        assert min(a["part"], b["part"], 1 - a["part"], 1 - b["part"]) < 1e-9
        total += a["part"]
    assert abs(total / 20_000 - 0.3) < 0.02


def test_mixed_repeats_rows_and_keeps_columns(spark):
    rows = corpus(3, 40)
    docs = frame(spark, [(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    copies = Counter()
    for r in run(docs):
        copies[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    found = Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in got.collect())
    assert found == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_mix_of_the_corpus(spark):
    sf = "/root/testdata/sf0.001"
    got = [r.asDict() for r in common.PLANS["op2_mixing"](spark, sf).collect()]
    check_mix([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], got)


def plain_fill(names, slots):
    """Every shard's whole permutation, and turns taken over them."""
    orders = []
    for name in sorted(names):
        d = hashlib.sha256(name.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order = [(first + k * step) % slots for k in range(slots)]
        assert len(set(order)) == slots
        orders.append((name, iter(order)))
    table = {}
    while True:
        for name, order in orders:
            for at in order:
                if at not in table:
                    table[at] = name
                    break
            if len(table) == slots:
                return [table[k] for k in range(slots)]


def test_table_is_that_of_whole_permutations():
    names = [f"n{k}" for k in range(7)]
    assert sharding.fill(names, 503) == plain_fill(names, 503) == sharding.fill(names[::-1], 503)


def test_table_is_even_and_stable():
    table = sharding.fill(sharding.SHARDS)
    sizes = Counter(table)
    assert len(sizes) == len(sharding.SHARDS) and max(sizes.values()) <= 1.01 * min(sizes.values())
    less = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, less, strict=True)) / len(table)
    assert 1 / 64 <= moved < 3 / 64
    for names, slots in (((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.fill(names, slots)


def test_every_row_is_placed_once(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumnRenamed("lang", "shard")
    got = sharding.placed(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        assert r["shard"] in sharding.SHARDS
        if r["doc_id"] is not None:
            assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert sharding.placed(docs.limit(0)).collect() == []


def test_corpus_is_spread(spark):
    sf = "/root/testdata/sf0.1"
    got = common.PLANS["op3_sharding"](spark, sf).groupBy("shard").count().collect()
    sizes = [r["count"] for r in got]
    assert sum(sizes) == 10_000 and len(sizes) == 64 and max(sizes) < 1.5 * sum(sizes) / 64


def test_written_shards(spark, tmp_path):
    docs = sharding.placed(frame(spark, corpus()))
    sharding.write_shards(docs, str(tmp_path / "out"), files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
