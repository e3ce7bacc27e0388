"""The prefix trie against plain dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from helpers import frame

from barline.llm import common, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(rows):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        leader = c - int(math.fmod(c, 100))  # as in SQL: towards zero
        path = own.get(leader, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = mine + sum(saved[k] for k in children[node])
        parent = members[node[:-1]][0] if node else None
        ids = ",".join(map(str, ends[node]))
        out.append((
            members[node][0], len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed=1):
    """Shared beginnings, copies, blocks with and without a leader, long ones, ties, nulls."""
    rng = random.Random(seed)
    say = lambda: rng.choice(["a", "b", "hello there", "é🙂", ""])
    rows = []
    for c in [*range(0, 60), *range(230, 260), 300, 399, 400, 1000, 1005]:
        n = rng.choice([1, 2, 3, 7, 8, 20])
        rows += [(c, t, rng.choice(["user", "assistant"]), say()) for t in range(n)]
    rows += [(c, t, "user", f"hot {t}") for c in range(500, 560) for t in range(9)]  # one conversation, many times
    rows += [(c, t, "user", "long" if t < 70 else say()) for c in (700, 701, 702) for t in range(100)]
    rows += [(800, None, None, None), (800, None, "user", "x"), (800, 1, "user", None), (800, 1, "user", "y"), (800, 1, "user", "y")]
    rows += [(None, 1, "user", "x"), (801, 5, "use", "rx"), (802, 5, "user", "x"), (-3, 1, "user", "z"), (-3, 2, "user", "z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("segment", "shard"), [(512, 1 << 15), (3, 40)])
def test_against_dictionaries(spark, segment, shard):
    rows = conversations()
    df = frame(spark, rows, SCHEMA).repartition(5)
    assert result(conversation_trie.trie(df, segment, shard)) == plain(rows)


def test_odd_tables(spark):
    assert conversation_trie.trie(frame(spark, [], SCHEMA)).count() == 0
    only_null = frame(spark, [(None, 1, "user", "x")], SCHEMA)
    assert conversation_trie.trie(only_null).count() == 0
    # A conversation whose turns all belong to its (absent) leader has none: it ends at the root.
    turnless = next(c for c in range(901, 1000) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(turnless, 1, "user", "x"), (turnless, 2, "user", "y")]
    assert result(conversation_trie.trie(frame(spark, rows, SCHEMA))) == plain(rows)
    assert len(plain(rows)) == 1
    clash = frame(spark, [(*r, 1, "k", 2) for r in conversations(2)], SCHEMA + ", depth int, key string, n_convs int")
    assert result(conversation_trie.trie(clash)) == plain(conversations(2))


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert result(common.PLANS["op13_conversation_trie"](spark, sf_dir)) == plain(rows)
