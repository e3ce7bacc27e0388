import random

import numpy as np
import pyarrow as pa
from helpers import corpus, frame, prose, words

from barline.llm import common, decontamination as dec


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_subsequence_length():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 80))]
        b = [rng.randrange(6) for _ in range(rng.randrange(80))]
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert dec.common_subsequence(masks, b, len(a)) == plain_lcs(a, b)


def brute(rows, items):
    """Pairs that pass the rule on some stretch of the text, without any index."""
    fold = lambda t: [w.lower() for w in words(t)]
    found = set()
    for doc_id, text in rows:
        w = fold(text)
        for item_id, item in items:
            q = fold(item)
            if not q or len(set(q) & set(w)) < dec.PART * len(set(q)):
                continue
            answer = set(fold(dec.last_sentence(item)))
            for at in range(0, max(1, len(w)), dec.STEP):
                part = w[at : at + 6 * dec.STEP]
                lcs = plain_lcs(q, part)
                if lcs >= dec.WHOLE * len(q) or (lcs >= dec.PART * len(q) and len(answer & set(part)) >= dec.ANSWER * len(answer)):
                    found.add((doc_id, item_id))
                    break
    return found


def allowed(rows, items):
    """Pairs that pass the rule on a stretch of the item's own length, begun at any word (one step longer, every step)."""
    fold = lambda t: [w.lower() for w in words(t)]
    found = set()
    for item_id, item in items:
        q, answer = fold(item), set(fold(dec.last_sentence(item)))
        masks = {}
        for k, w in enumerate(q):
            masks[w] = masks.get(w, 0) | 1 << k
        stretch = max(96, 2 * len(q))
        for doc_id, text in rows:
            w = fold(text)
            for at in range(0, len(w), dec.STEP) if len(masks.keys() & set(w)) >= dec.PART * len(masks) else ():
                part = w[at : at + stretch + dec.STEP]
                lcs = dec.common_subsequence(masks, part, len(q))
                if lcs >= dec.WHOLE * len(q) or (lcs >= dec.PART * len(q) and len(answer & set(part)) >= dec.ANSWER * len(answer)):
                    found.add((doc_id, item_id))
                    break
    return found


def test_recall_of_paraphrases_that_keep_the_answer(spark):
    """Half of the words before the last sentence replaced, which alone decides then."""
    rng = random.Random(17)
    items = []
    for k in range(60):
        body, last = prose(rng, rng.randrange(24, 44), 3000).replace(".", ""), prose(rng, rng.randrange(6, 10), 3000).replace(".", "")
        items.append((k, f"{body}. {last}."))
    rows = [r for r in corpus(17, 80) if r[0] is not None and r[0] != 1005]
    for k, item in items:
        body, last = item.rstrip(".").rsplit(". ", 1)
        w = [x if rng.random() > 0.55 else f"other{rng.randrange(9999)}" for x in body.split()]
        rows.append((4000 + k, f"{prose(rng, rng.randrange(150))} {' '.join(w)}. {last}. {prose(rng, rng.randrange(150))}", "en", "s", 1))
    want = {(d, i) for d, i in brute([(r[0], r[1]) for r in rows], items) if d >= 4000}
    got = {(r["doc_id"], r["item_id"]) for r in dec.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 40 and len(got & want) >= 0.9 * len(want)


def planted(seed):
    """Items inside documents: whole, in capitals, with words dropped, replaced and added."""
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.randrange(16, 60), 3000)) for k in range(25)]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus(seed, 80)]
    for n, (k, item) in enumerate(items):
        w = item.split()
        how = n % 5
        if how == 1:
            w = [x.upper() for x in w]
        if how == 2:
            w = [x for x in w if rng.random() > 0.15]
        if how == 3:
            w = [x if rng.random() > 0.2 else f"new{rng.randrange(999)}" for x in w]
        if how == 4:
            w = [y for x in w for y in ([x, f"add{rng.randrange(999)}"] if rng.random() < 0.2 else [x])]
        before, after = prose(rng, rng.randrange(150)), prose(rng, rng.randrange(150))
        rows.append((4000 + n, f"{before} {' '.join(w)} {after}", "en", "s", 1))
    return rows, items


def test_recall_of_the_search_against_brute_force(spark):
    rows, items = planted(7)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dec.leaks(docs, bench).collect()}
    want = brute([(r[0], r[1]) for r in rows if r[0] is not None and r[0] != 1005], items)
    assert len(want) >= 23 and len(got & want) >= 0.9 * len(want)
    assert got <= allowed([(r[0], r[1]) for r in rows if r[0] is not None], items)
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] not in {d for d, _ in got})


def test_odd_items_and_tables(spark):
    rows, items = planted(8)
    docs = frame(spark, rows).withColumnRenamed("lang", "item_id")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "some words nobody has"), (3, items[0][1]), (3, items[0][1])], "item_id long, text string")
    got = dec.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(4000, 3)} and len(got) == 2
    assert dec.leaks(docs.limit(0), bench).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dec.leaks(docs, nothing).collect() == []
    assert dec.clean(docs, nothing).count() == len(rows)


def test_corpus(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r["doc_id"], r["item_id"]) for r in common.PLANS["op1_decontamination"](spark, sf).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)


def test_whole_text_is_searched():
    rng = random.Random(3)
    item = prose(rng, 40)
    text = prose(rng, 30_000) + " " + item
    column = pa.array([text, None, "", item])
    import numpy as np

    projection = np.random.default_rng(0).standard_normal((dec.BUCKETS, dec.RANK)).astype(np.float32)
    h = dec._hashes(item)
    masks = {}
    for k, w in enumerate(h.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    v = projection[dec.word_buckets(h)].sum(0)
    index = dec.Index(projection, [dec.Item(9, len(h), masks, frozenset(h.tolist()))], (v / np.linalg.norm(v))[None, :])
    assert [[x[0] for x in row] for row in index.leaks(column)] == [[9], [], [], [9]]


def whole(rows, items):
    """Pairs that pass the rule over the whole text, whatever the length of the item."""
    found = set()
    for doc_id, text in rows:
        w = [x.lower() for x in words(text)]
        for item_id, item in items:
            q = [x.lower() for x in words(item)]
            if len(set(q) & set(w)) < dec.PART * len(set(q)):
                continue
            answer, lcs = {x.lower() for x in words(dec.last_sentence(item))}, plain_lcs(q, w)
            if lcs >= dec.WHOLE * len(q) or (lcs >= dec.PART * len(q) and len(answer & set(w)) >= dec.ANSWER * len(answer)):
                found.add((doc_id, item_id))
    return found


def test_long_items_are_found(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 150 + 10 * k, 3000)) for k in range(26)]
    rows = [r for r in corpus(11, 80) if r[0] is not None and r[0] != 1005]
    for k, item in items:
        w = item.split()
        if k % 4 == 1:
            w = [x for x in w if rng.random() > 0.15]
        if k % 4 == 2:
            w = [x if rng.random() > 0.2 else f"new{rng.randrange(999)}" for x in w]
        if k % 4 == 3:
            w = [y for x in w for y in ([x, f"add{rng.randrange(999)}"] if rng.random() < 0.2 else [x])]
        rows.append((4000 + k, f"{prose(rng, rng.randrange(400))} {' '.join(w)} {prose(rng, rng.randrange(400))}", "en", "s", 1))
    got = {(r["doc_id"], r["item_id"]) for r in dec.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = whole([(r[0], r[1]) for r in rows], items)
    assert want == {(4000 + k, k) for k in range(26)}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_recall_by_length_with_thousands_of_items(spark):
    """Items of corpus words, some planted at random places in documents of sf0.1, verbatim or with 30 % of the words replaced."""
    rng = random.Random(13)
    read = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("doc_id % 4 = 0 and text is not null")
    texts = {r["doc_id"]: r["text"].split() for r in read.orderBy("doc_id").collect()}
    pool = [w for k, t in texts.items() if k % 40 == 0 for w in t]
    groups = ((6, 12), (13, 24), (25, 40), (41, 60))
    items = [(k, [rng.choice(pool) for _ in range(rng.randint(*groups[k % 4]))]) for k in range(2000)]
    homes = rng.sample(sorted(k for k, t in texts.items() if 80 < len(t) < 2000), 600)
    want = {}
    for n, (k, item) in enumerate(items[:600]):
        w = list(item) if n // 4 % 2 else [x if rng.random() > dec.REPLACED else rng.choice(pool) for x in item]
        at = rng.randrange(len(texts[homes[n]]))
        texts[homes[n]][at:at] = w
        if plain_lcs([x.lower() for x in item], [x.lower() for x in w]) >= dec.WHOLE * len(item):
            want.setdefault((k % 4, n // 4 % 2), set()).add((homes[n], k))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["item_id"]) for r in dec.leaks(docs, spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")).collect()}
    recall = {key: len(pairs & got) / len(pairs) for key, pairs in sorted(want.items())}
    assert min(recall.values()) >= 0.9, recall


def test_sample_is_filtered_by_all_tasks_of_the_scan(spark, monkeypatch):
    rows, items = planted(9)
    docs = frame(spark, rows).repartition(16)
    seen, settle = [], common.settle
    monkeypatch.setattr(common, "settle", lambda df, name="settled": seen.append(df.rdd.getNumPartitions()) or settle(df, name))
    monkeypatch.setattr(dec, "POWER_STEPS", 0)
    sent = spark.sparkContext.broadcast(dec.np.ones(dec.BUCKETS, dec.np.float32))
    dec.latent_space(docs, spark.createDataFrame(items, "item_id long, text string"), sent)
    assert seen == [16]


def index_of(*texts):
    items = []
    for item_id, text in enumerate(texts):
        h = dec._hashes(text)
        masks = {}
        for k, w in enumerate(h.tolist()):
            masks[w] = masks.get(w, 0) | 1 << k
        items.append(dec.Item(item_id, len(h), masks, frozenset(dec._hashes(dec.last_sentence(text)).tolist())))
    return dec.Index(np.zeros((dec.BUCKETS, 4), np.float32), items, np.zeros((len(items), 4), np.float32))


def test_regions_without_the_words_are_not_aligned(monkeypatch):
    rng = random.Random(9)
    item = " ".join(f"q{k}" for k in range(20)) + ". a b a c"
    index = index_of(item)
    calls, real = [], dec.common_subsequence
    monkeypatch.setattr(dec, "common_subsequence", lambda masks, words, n: calls.append(len(words)) or real(masks, words, n))
    # "a" stands in the item twice, so a hundred of them are two common words
    assert index._judge(0, dec._hashes(" ".join(["a", "x"] * 100))) is None and not calls
    for _ in range(50):
        region = rng.choices(item.split() + ["x", "y"] * 10, k=300)
        at = rng.randrange(280)
        region[at : at + 20] = item.split()[: rng.randrange(5, 21)]
        calls.clear()
        got = index._judge(0, dec._hashes(" ".join(region)))
        # only the item's words are walked over; the outcome is that of walking over all
        assert all(n <= sum(w in item.split() for w in region) for n in calls)
        best = None
        for first in range(0, max(1, 300 - index.items[0].stretch + dec.STEP), dec.STEP):
            part = region[first : first + index.items[0].stretch]
            lcs, answered = plain_lcs(item.split(), part), len(set("abc") & set(part))
            if lcs >= dec.WHOLE * 24 or (lcs >= dec.PART * 24 and answered >= dec.ANSWER * 3):
                best = max(best or (0, 0), (lcs, answered))
        assert got == best


def test_projected_sums():
    rng = np.random.default_rng(4)
    table = rng.standard_normal((50, 3)).astype(np.float32)
    lengths = rng.integers(1, 40, 60)
    place = np.concatenate([np.arange(n) for n in lengths])
    buckets = rng.integers(0, 50, len(place))
    for unit in (2, 4, 16):
        step = np.flatnonzero(place % unit == 0)
        want = np.add.reduceat(table[buckets].astype(np.float64), step, axis=0)
        assert np.allclose(dec.projected(table, buckets, step, unit), want, atol=1e-4)


def test_space_is_fitted_on_all_passages(spark, monkeypatch):
    """More documents than any sample of them and a long text: their words all enter, and a direction of the long text's alone is in the space."""
    rng = random.Random(19)
    rows = [(k, prose(rng, 12)) for k in range(2500)] + [(9000, " ".join(["zeta", "eta", "theta", "iota"] * 2500)), (9001, None), (9002, " ")]
    items = [(1, prose(rng, 20)), (2, prose(rng, 90))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    counted, real = [], dec.gram_times

    def spy(rows, weight, basis):
        counted.append(rows.rdd.map(lambda r: sum(r["times"]) if "times" in r else len(r["text"].split())).sum())
        return real(rows, weight, basis)

    monkeypatch.setattr(dec, "gram_times", spy)
    space = dec.latent_space(docs, bench, spark.sparkContext.broadcast(np.ones(dec.BUCKETS, np.float32)))
    assert set(counted) == {sum(len(words(t)) for _, t in rows + items)}
    own = np.zeros(dec.BUCKETS)
    own[dec.word_buckets(dec._hashes("zeta eta theta iota"))] = 0.5
    assert np.linalg.norm(own @ space) > 0.95
    assert np.allclose(space.T @ space, np.eye(dec.RANK), atol=1e-4)


def test_gram_times_is_that_of_the_dense_matrix(spark):
    rng = random.Random(20)
    rows = [(k, prose(rng, rng.choice([1, 5, 64, 65, 200]), 300)) for k in range(60)]
    idf = np.random.default_rng(1).uniform(0.5, 9, dec.BUCKETS).astype(np.float32)
    basis = np.random.default_rng(2).standard_normal((dec.BUCKETS, 5)).astype(np.float32)
    want = np.zeros((dec.BUCKETS, 5))
    for _, text in rows:
        h = dec.word_buckets(dec._hashes(text))
        for lo in range(0, len(h), 64):
            a = np.bincount(h[lo : lo + 64], minlength=dec.BUCKETS) * idf.astype(np.float64)
            a *= 2 / np.linalg.norm(a)
            want += np.outer(a, a @ basis)
    made = dec.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).selectExpr("*", "2d scale")
    assert np.allclose(dec.gram_times(made, spark.sparkContext.broadcast(idf), basis), want, atol=1e-3)
