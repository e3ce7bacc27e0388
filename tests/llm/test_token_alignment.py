"""Cross-tokenizer alignment against whole-text encoding and plain loops."""

import hashlib
import json
import os
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from helpers import corpus, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barline.llm import common, token_alignment

A, B = (os.path.join(token_alignment.TOKENIZERS, f) for f in token_alignment.FILES)
ODD = [
    "a  b", "  a", "a ", " ", "   ", "a \n b", "a\n \nb", "\t\tx  \ty ", "x   y", "a▁b", "▁", "\x00 z", "<s> </s>",
    "<|endoftext|> <0x41>", "é ﬁ ǆ", "ab" * 400, "日本語 の テキスト", "🙂🙃 x", "don't we'll", "1234567 89", "x\r\n\r\n y", "﻿a b",
    "a   b", " \x1c a", "a\x1c b", "́a ́b", "==== ----", "a" * 3000,
]


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = token_alignment.byte_letters()
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}

    def encode(text):
        """(ids, token bytes) of both sides, or None where they do not give the text back."""
        if not text:
            return None
        raw = (" " + text).encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx = [bytes(letters[c] for c in names[i]) for i in x]
        by = [bytes([b.id_to_piece(i) and int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        return (x, bx, y, by) if b"".join(bx) == raw == b"".join(by) else None

    return encode


def plain(rows, encode):
    docs = []
    for doc_id, text in rows:
        got = encode(text)
        groups = []
        if got:
            x, bx, y, by = got
            ends_a, ends_b = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
            cuts = sorted(set(ends_a) & set(ends_b))
            groups = [([], []) for _ in cuts]
            for side, ids, ends in ((0, x, ends_a), (1, y, ends_b)):
                k = 0
                for i, e in zip(ids, ends, strict=True):
                    while cuts[k] < e:
                        k += 1
                    groups[k][side].append(i)
        docs.append((doc_id, groups, Counter((p, q) for ga, gb in groups for p in ga for q in gb)))
    count = Counter(pair for _, _, links in docs for pair in links)
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for pair, n in links.items() if count[pair] == best[pair[0]]), sum(n * count[pair] for pair, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_plain_loops(spark, whole):
    rows = [(r[0], r[1]) for r in corpus()] + [(5000 + k, t) for k, t in enumerate(ODD)] + [(5000, ODD[0]), (None, "a b c")]
    docs = frame(spark, rows, "doc_id long, text string").repartition(5)
    assert result(token_alignment.aligned(docs)) == sorted(plain(rows, whole), key=repr)


def test_block_borders_do_not_matter(spark, whole, monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 3, 80])) for _ in range(40)] + ODD
    encoder = token_alignment.encoder(token_alignment.TOKENIZERS)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 50)
    for work in (1, 2, 7, 1000):
        made = token_alignment.align(list(range(len(texts))), texts, encoder, work)
        want = plain(list(enumerate(texts)), whole)
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            assert list(made[name]) == [w[k + 1] for w in want], (work, name)
        assert made["groups_sha256"] == [w[-1] for w in want]


def test_pieces_have_equal_work():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(1, 5000, 3000)), np.arange(1, 5000)
    i, j = token_alignment.diagonals(a, b, 64)
    assert (np.diff(i + j)[:-1] == 64).all() and i[-1] == len(a) and j[-1] == len(b)
    assert all(a[p - 1] <= (b[q] if q < len(b) else a[p - 1]) for p, q in zip(i, j, strict=True) if p)


def test_wide_groups_are_counted_by_distinct_ids():
    rng = np.random.default_rng(2)
    n_a, n_b = np.array([300, 2, 1]), np.array([200, 3, 1])
    a, b = rng.integers(0, 40, 303), rng.integers(0, 30, 204)
    key, times = token_alignment.linked(np.array([0, 0, 1]), a, b, n_a, n_b)
    want = Counter((0, p, q) for p in a[:300] for q in b[:200]) + Counter((0, p, q) for p in a[300:302] for q in b[200:203])
    want[(1, a[302], b[203])] += 1
    bits = token_alignment.ID_BITS
    assert {(k >> 2 * bits, k >> bits & (1 << bits) - 1, k & (1 << bits) - 1): n for k, n in zip(key.tolist(), times.tolist(), strict=True)} == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n  ▁ab.1'é日"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_units_encode_like_whole_texts(whole, text):
    encoder = token_alignment.encoder(token_alignment.TOKENIZERS)
    a, _, n_a, b, _, n_b = token_alignment.encode([text], encoder)
    got = whole(text)
    assert (a.tolist(), b.tolist()) == ((got[0], got[2]) if got else ([], []))


def test_odd_tables(spark):
    empty = frame(spark, [], "doc_id long, text string, n_a long, at string")
    assert token_alignment.aligned(empty).count() == 0
    docs = frame(spark, [(1, None, 5, "x"), (2, "", 5, "x")], "doc_id long, text string, n_a long, at string")
    assert result(token_alignment.aligned(docs)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, sf_dir):
    df = common.PLANS["op11_token_alignment"](spark, sf_dir)
    assert df.columns == [f.split(" ")[0] for f in token_alignment.RESULT.split(", ")]
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_units_are_kept_in_arrays():
    """What a worker holds at most for a block, and keeps of it: tens of bytes for each unit, not Python objects."""
    rng = random.Random(5)
    texts = [prose(rng, 250, 200_000) for _ in range(1000)]
    encoder = token_alignment.Encoder(token_alignment.TOKENIZERS)
    token_alignment.align([0], texts[:1], encoder)
    tracemalloc.start()
    try:
        token_alignment.align(list(range(len(texts))), texts, encoder)
        kept, most = (x / 1e6 for x in tracemalloc.get_traced_memory())
    finally:
        tracemalloc.stop()
    assert sum(len(t) for t in texts) > 1.5e6 and kept < 20 and most < 150, (kept, most)


def test_wide_rows_are_written_in_small_row_groups(spark):
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "transform(sequence(1, 50000), x -> xxhash64(x, id)) a")
    path = common._PATHS[id(common.settle(rows, "wide", row_group=1 << 21))][1].removeprefix("file:")
    size = [g.total_byte_size for f in Path(path).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(size) > 12e6 and max(size) < 4e6
