import random

import numpy as np
import pytest
from helpers import corpus, frame, prose, words
from oracle import compare, connect

from barline.llm import common, jaccard_join
from barline.llm.graph import components

RULE = jaccard_join.Rule(3, 90)


def shingles(text, size):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else zip(*(w[k:] for k in range(size)), strict=False))


def plain(rows, rule):
    """(doc_id, size, component, members) by comparing all pairs."""
    sets = [shingles(r[1], rule.words) for r in rows]
    at = list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b]):
                at[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    out = []
    for own in groups.values():
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids) if ids else None, len(own)) for k in own]
    return out


def near_copies(seed, n=40):
    """A large group of near copies that drift away from each other, short texts that differ by a word, and others."""
    rng = random.Random(seed)
    rows = corpus(seed, 40)
    base = prose(rng, 120).split()
    for k in range(n):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        if k % 9 == 0:
            base = w
        rows.append((2000 + k, " ".join(w), "en", "s0", 1))
    short = [f"a{k}" for k in range(14)]
    rows += [(3000 + k, " ".join(short[: 9 + k]), "en", "s0", 1) for k in range(6)]
    rows += [(3100, " ".join(short).upper(), "en", "s0", 1)]
    return rows


def same(a, b):
    order = lambda rows: sorted(map(repr, rows))
    assert order(a) == order(b)


@pytest.mark.parametrize(("seed", "rule"), [(1, RULE), (2, RULE), (3, jaccard_join.Rule())])
def test_components_are_those_of_all_pairs(spark, seed, rule, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 3000)  # several blocks for each group
    rows = near_copies(seed)
    got = [tuple(r) for r in jaccard_join.joined(frame(spark, rows), rule).collect()]
    same(got, plain(rows, rule))


def test_empty_table(spark):
    assert jaccard_join.joined(frame(spark, []), RULE).collect() == []
    assert jaccard_join.keep_one(frame(spark, [])).collect() == []


def test_keep_one_of_each_group(spark):
    rows = near_copies(5)
    rule = jaccard_join.Rule()
    docs = frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, cls string")
    kept = [tuple(r)[:5] for r in jaccard_join.keep_one(docs, rule).collect()]
    groups = plain([r for r in set(rows) if words(r[1])], rule)
    assert len([r for r in kept if words(r[1])]) == len({(c, m) if c is not None else (d, m) for d, _, c, m in groups})
    assert sorted(r[0] for r in kept if words(r[1]) and r[0] is not None) == sorted(
        {c for _, _, c, _ in groups if c is not None}
    )
    same([r for r in kept if not words(r[1])], [r for r in rows if not words(r[1])])


def test_search_finds_all_and_only_links():
    rng = random.Random(4)
    universe = np.arange(300)
    base = set(rng.sample(range(300), 60))
    sets = []
    for _ in range(120):
        s = set(base)
        for x in rng.sample(sorted(s), rng.randrange(6)):
            s.discard(x)
        s |= set(rng.sample(range(300), rng.randrange(6)))
        sets.append(np.array(sorted(universe[list(s)])))
    block = jaccard_join.Block(sets)
    for q in sets[:40]:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 90 * len(np.union1d(q, s))]
        assert sorted(block.search(q, RULE)) == want


def test_merge_skip_counts():
    rng = random.Random(2)
    for _ in range(50):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 20))) for _ in range(rng.randrange(1, 9))]
        for need in range(1, len(lists) + 1):
            want = {x: sum(x in s for s in lists) for x in range(30)}
            assert dict(jaccard_join.merge_skip(lists, need)) == {x: c for x, c in want.items() if c >= need}


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("(id * 37) % 301 as a", "((id + 1) * 37) % 301 as b")
    rows = components(edges).collect()
    assert len(rows) == 301 and {r["label"] for r in rows} == {0}


def test_against_sql(spark, sf_dir):
    name = "op6_jaccard_join"
    assert compare(common.PLANS[name](spark, sf_dir), connect(sf_dir), common.CHECKS[name]) is None


def test_document_without_id_does_not_win_its_group(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [(None, text, "en", "s", 1), (7, text, "en", "s", 1), (9, text + " more", "en", "s", 1), (None, "all alone here", "en", "s", 1)])
    assert sorted(map(repr, (r["doc_id"] for r in jaccard_join.keep_one(docs).collect()))) == ["7", "None"]


def test_classes_that_cannot_link_leave_the_open_groups(spark):
    rng = random.Random(12)
    groups = {(token, rng.randrange(2)): rng.sample(range(40), rng.choice((2, 2, 3, 5))) for token in range(150)}
    for token in range(150, 154):  # two components that share four groups
        groups[token, 0] = [40, 41, 42]
    groups[154, 0] = [43, 44, 45]  # three components that share one
    label = {cls: cls % 4 if cls < 40 else cls for cls in range(46)}
    rows = [(t, s, 20, c, len(g), label[c]) for (t, s), g in groups.items() for c in g]
    state = spark.createDataFrame(rows, "token long, step int, n long, cls long, classes long, label long")
    got = {tuple(r) for r in jaccard_join.still_open(state, RULE).select("token", "step", "cls").collect()}
    open_ = {g: m for g, m in groups.items() if len({label[c] for c in m}) > 1}
    for a in range(46):
        for b in range(a):
            for step in (0, 1):
                both = [g for g, m in open_.items() if g[1] == step and a in m and b in m]
                if label[a] != label[b] and len(both) >= RULE.shared and any(len(groups[g]) > 2 for g in both):
                    assert {(*g, c) for g in both for c in (a, b)} <= got
    assert {(t, 0, c) for t in range(150, 154) for c in (40, 41, 42)} <= got
    assert not {43, 44, 45} & {c for _, _, c in got}
