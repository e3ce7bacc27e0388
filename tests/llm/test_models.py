"""The classifiers: held-out quality, and what odd rows get."""

import zlib

import numpy as np
import pyarrow as pa
from helpers import corpus, frame, prose, words

from barline.llm import common, language, quality_classifier, quality_rules


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = common.PLANS["op8_quality_classifier"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    assert (rows.held_out == rows.doc_id.map(held)).all()
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    tested = rows[rows.held_out].merge(marks, on="doc_id")
    assert (tested.predicted == tested.quality).mean() > 0.95


def test_scalar_scoring_is_the_softmax_of_the_mean_vector():
    texts = pa.array(["good text here", "bad ### text", "", None, "bad ### words ###", "good words here"])
    labels = np.array([1, 0, 1, 1, 0, 1])
    model = quality_classifier.fit(texts, labels, epochs=30)
    got = model.scores(texts)
    for (bucket, share), score in zip(quality_classifier.sparse(texts), got, strict=True):
        logit = model.bias + float(share @ model.weight[bucket]) if len(bucket) else model.bias
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-5
    assert got[1] < 0.5 < got[0] and ((0 <= got) & (got <= 1)).all()


def test_quality_odd_rows(spark):
    docs = frame(spark, corpus()).withColumnRenamed("n_chars", "score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.keep_good(docs, none).columns == docs.columns
    assert quality_classifier.keep_good(docs, none).count() == docs.count()
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    assert quality_classifier.keep_good(docs, marks, 0.0).count() == docs.count()
    assert quality_classifier.keep_good(docs.limit(0), marks).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = common.PLANS["op10_language"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    both = rows.merge(docs, on="doc_id")
    assert len(rows) == len(docs) and rows.score.between(0, 1).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.97


def test_language_odd_rows(spark):
    rows = [(k, "der die das und" if k % 2 else "les des une pour", "de" if k % 2 else "fr", "s", 1) for k in range(40)]
    rows += [(100, None, "de", "s", 1), (101, "", "de", "s", 1), (102, "12 ## 34", "de", "s", 1), (103, "слово", None, "s", 1)]
    rows += [(None, "der die", "de", "s", 1), (104, "die der und " * 3000, "zz", "s", 1)]
    docs = frame(spark, rows)
    model = language.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predicted(docs, model).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] != "und" and got[104][0] in ("de", "zz")
    assert sum(got[k][0] == ("de" if k % 2 else "fr") for k in range(40)) == 40
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predicted(docs, empty).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'de'"))
    assert {r["lang_pred"] for r in language.predicted(docs, one).collect()} == {"und", "de"}
    assert language.predicted(docs.limit(0), model).collect() == []


def plain_counts(text):
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {k for k, x in enumerate(windows) if windows.count(x) > 1}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        dup,
        len({k + d for k in again for d in range(3)}),
    )


def test_rules_count_as_the_plain_form(spark):
    rows = [r for r in corpus() if r[0] != 1005]
    rows += [
        (2000, "a b c a b c a b c\n" * 8, "en", "s", 1),
        (2001, "x\nx\n\n\n x\nx\n#*$%&|<>[]€\U0001d11e \xa0", "en", "s", 1),
        (2002, "the end of it " * 3 + prose(__import__("random").Random(3), 80), "en", "s", 1),
    ]
    docs = frame(spark, rows)
    trusted = spark.createDataFrame([(1,), (2,), (6,)], "doc_id long")
    got = quality_rules.judged(docs, trusted).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, repeat = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= quality_rules.THRESHOLD)


def test_ratio_is_the_mean_log_ratio(spark):
    import math

    rows = [(0, "a b", "en", "s", 1), (1, "a c", "en", "s", 1), (2, None, "en", "s", 1)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["ratio"] for r in quality_rules.judged(docs, spark.createDataFrame([(0,)], "doc_id long")).collect()}
    size = quality_rules.BUCKETS
    log = lambda t, r: math.log((t + 1) / (3 + size)) - math.log((r + 1) / (6 + size))
    assert abs(got[0] - (log(1, 2) + log(1, 1) + log(1, 1)) / 3) < 1e-5
    assert abs(got[1] - (log(1, 2) + log(0, 1) + log(0, 1)) / 3) < 1e-5
    assert got[2] == 0
    nobody = quality_rules.judged(docs, spark.createDataFrame([], "doc_id long")).collect()
    assert {r["ratio"] for r in nobody} == {0.0}
    assert quality_rules.judged(docs.limit(0), spark.createDataFrame([(0,)], "doc_id long")).collect() == []


def test_rules_keep_labelled_good(spark):
    sf = "/root/testdata/sf0.1"
    got = common.PLANS["op4_quality_rules"](spark, sf).toPandas()
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[~got.base_failed].merge(marks, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.999
    assert both[both.quality == 0].kept.mean() < 0.1


def test_scores_are_the_softmax_over_averaged_vectors():
    """Every n-gram's vector summed in plain loops, averaged, and put through the two-way softmax."""
    rng = np.random.default_rng(2)
    vocabulary = [f"word{k}" for k in range(60)]
    rows = [" ".join(rng.choice(vocabulary[: 40 if k % 2 else 60], rng.integers(1, 30))) + (" ###" if k % 2 else "") for k in range(60)]
    texts, labels = pa.array([*rows, "", None]), np.array([1 - k % 2 for k in range(62)])
    vectors, out, bias = quality_classifier.learned(texts, labels, epochs=3)
    got = quality_classifier.fit(texts, labels, epochs=3).scores(texts)
    for text, score in zip(texts.to_pylist(), got, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        grams = [int(b) for bucket, _ in quality_classifier.features(data, np.array([0, len(data)])) for b in bucket]
        mean = np.zeros(out.shape[0])
        for b in grams:
            mean += vectors[b].astype(float) / len(grams)
        z = [sum(mean[d] * float(out[d, c]) for d in range(len(mean))) + float(bias[c]) for c in (0, 1)]
        assert abs(score - np.exp(z[1]) / (np.exp(z[0]) + np.exp(z[1]))) < 1e-4


def test_quality_model_is_the_same_on_every_run(spark):
    rows = [(k % 50, f"text {k} " + ("good words" if k % 2 else "### !!!"), "en", "s", 1) for k in range(200)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    models = [quality_classifier.train(frame(spark, rows).repartition(n), marks) for n in (1, 7)]
    assert (models[0].weight == models[1].weight).all() and models[0].bias == models[1].bias


def test_languages_are_the_votes_of_their_family():
    """Family first, then the pairs inside it: margins and votes in plain loops."""
    rng = np.random.default_rng(3)
    stems = {"de": "der und ist nicht ein", "nl": "de het een niet van", "fr": "les des est pas une", "es": "los las es no una", "xx": "zzq qqz zqz"}
    said = [(lang, " ".join(rng.choice(words.split(), 12))) for lang, words in stems.items() for _ in range(30)]
    texts = pa.array([t for _, t in said])
    model = language.fit(texts, [lang for lang, _ in said])
    some = [*[t for _, t in said[::7]], "der les los de", "zzq der", "??", "", None]
    got = model.predict(pa.array(some))

    def winner(ballot, x):
        margins = {pair: sum(float(a) * float(b) for a, b in zip(x, ballot.weight[:, k], strict=True) if a) + float(ballot.bias[k]) for k, pair in enumerate(ballot.pairs)}
        votes = [0.0] * len(ballot.names)
        for (a, b), m in margins.items():
            votes[a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[b] += (m < 0) - 1e-3 * np.tanh(m)
        best = votes.index(max(votes))
        support = [1 / (1 + np.exp(-2 * (m if a == best else -m))) for (a, b), m in margins.items() if best in (a, b)]
        return ballot.names[best], min([1.0, *support])

    for text, lang, score in zip(some, *got, strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        x = language.vectors(data, np.array([0, len(data)]))[0]
        family, outer = winner(model.families, x)
        want, inner = winner(model.within[family], x)
        assert lang == want and abs(score - min(outer, inner)) < 1e-4


def test_columns_of_the_results_names_give_way(spark):
    docs = frame(spark, [(1, "some words", "en", "s", 1)]).withColumnRenamed("source", "score").withColumnRenamed("lang", "lang_pred")
    marks = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_classifier.scored(docs, quality_classifier.train(docs, marks)).columns == ["doc_id", "text", "lang_pred", "n_chars", "score"]
    model = language.fit(pa.array(["some words", "autre mots"]), ["en", "fr"])
    assert language.predicted(docs, model).columns == ["doc_id", "text", "n_chars", "lang_pred", "score"]
