"""Personal data and secrets: base spans against plain patterns, and what is added."""

import hashlib
import random
import re

import duckdb
from helpers import corpus, frame
from oracle import compare, connect

from barline.llm import common, pii, secrets

PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
SECRET = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        total += sum(divmod(int(c) * (1 + k % 2), 10))
    return total % 10 == 0


def fits(kind, m):
    hit = m.group()
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "assign":
        return len(m.group(2)) >= 8
    return len(hit) >= {"access": 16, "hex": 32}.get(kind, 0)


def plain(text, patterns, by_start):
    found = []
    for rank, (kind, pattern) in enumerate(patterns):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if fits(kind, m)]
    found.sort(key=lambda x: (x[0], x[1]) if by_start else (x[1], x[0]))
    return [f"{k}:{s}:{e}" for s, _, k, e in found]


def card(rng):
    head = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(head + str(k) for k in range(10) if luhn(head + str(k)))


def noisy(seed, n=120):
    """Texts full of near hits: made of the marks that the patterns turn on."""
    rng = random.Random(seed)
    marks = list("aA1 0.@+-() 9:=\"'") + ["token", "AKIA", "é€", "255.", "1.2.3.4", "deadbeef" * 4, "api_key", "x@y.z", "+1 (555) 010-9999 ", "\n"]
    rows = [(k, "".join(rng.choice(marks) for _ in range(rng.randrange(60))), "en", "s", 1) for k in range(n)]
    rows += [(n + k, f"pay {card(rng)} or {card(rng)[:-1]}x", "en", "s", 1) for k in range(20)]
    rows += [
        (500, "9" * 30_000 + " " + "1-" * 20_000 + "a" * 30_000 + "@" + ".b" * 20_000, "en", "s", 1),
        (501, "a@b.c_d@e.f-g@h.i 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 99999999999.1.1.1", "en", "s", 1),
        (502, "Token==abcdefgh passwd:'12345678' TOKEN = \"x\" ſecret=abcdefgh apiKey=abcdefgh", "en", "s", 1),
    ]
    return rows + corpus(seed, 20)


def test_pii_base_spans(spark):
    rows = noisy(1)
    got = pii.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((repr(r[0]), sha(",".join(plain(r[1], PII, False)))) for r in rows)
    assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in got) == want
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        base = [s for s in spans if s.split(":")[0] in pii.BASE]
        assert sha(",".join(base)) == r["base_sha256"] and len(spans) - len(base) == r["n_added"]
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in base)
    assert pii.report(frame(spark, [])).collect() == []


def test_pii_corpus(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in common.PLANS["op5_pii"](spark, sf).collect():
        want = ",".join(plain(docs[r["doc_id"]], PII, False))
        assert hashlib.sha256(want.encode()).hexdigest() == r["base_sha256"]


def test_trees_learn_context_and_reach_further_formats(spark):
    """Numbers after a trigger are checked cards and phones; a local number after one scores like them, one in a table does not."""
    rng = random.Random(5)
    rows = []
    for k in range(600):
        three = lambda: rng.randrange(100, 999)
        if k % 3 == 0:
            t = f"please call +1 {three()} {three()} {rng.randrange(1000, 9999)} today"
        elif k % 3 == 1:
            t = f"row x{three()} {three()} {rng.randrange(1000, 9999)}x rest"
        else:
            t = f"please call {three()} {three()} {rng.randrange(1000, 9999)} today"
        rows.append((k, t, "en", "s", 1))
    got = pii.report(frame(spark, rows)).collect()
    assert all(r["n_phone"] == (r["doc_id"] % 3 == 0) for r in got)
    assert all(r["n_added"] == 0 for r in got if r["doc_id"] % 3 == 1)


def test_local_numbers_are_added_however_many_there_are(spark):
    """Ten local numbers to a checked phone, some named and some by number plan; numbers inside codes are left; account numbers by mod 97."""
    rng = random.Random(6)
    rows = []
    for k in range(900):
        three, four = lambda: rng.randrange(200, 999), rng.randrange(1000, 9999)
        t = f"please call {three()} {three()} {four} today" if k % 2 else f"office in town {three()} {three()} {four} today"
        rows.append((k, t, "en", "s", 1))
    rows += [(1000 + k, f"please call +1 212 555 {rng.randrange(1000, 9999)} today", "en", "s", 1) for k in range(90)]
    rows += [(2000 + k, f"row x{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}x rest", "en", "s", 1) for k in range(300)]
    banks = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    rows += [(3000 + k, f"pay to {x} now", "en", "s", 1) for k, x in enumerate(banks)]
    rows += [(3100 + k, f"pay to {x[:-1]}7 now", "en", "s", 1) for k, x in enumerate(banks)]
    rows += [(3200, "joe (at) example (dot) com", "en", "s", 1), (3201, "seen at and. Of", "en", "s", 1)]
    got = {r["doc_id"]: r for r in pii.report(frame(spark, rows)).collect()}
    for k in range(900):
        assert got[k]["n_added"] == 1 and got[k]["spans"].startswith("local:")
    assert all(got[k]["n_added"] == 0 for k in got if 1000 <= k < 3000 or 3100 <= k < 3200 or k == 3201)
    assert [got[3000 + k]["spans"] for k in range(3)] == [f"bank:7:{7 + len(x)}" for x in banks]
    assert got[3200]["spans"] == "spoken:0:26"


def test_boosting_separates_a_small_table():
    table = [((d, 0, 0, 0, 0, 0, 0, 0, s, 0, t, g), 40 * (t and d > 2), 40 - 40 * (t and d > 2)) for d in range(5) for s in (0, 1) for t in (0, 1) for g in (0, 1)]
    start, trees = pii.boost(table)
    for x, p, n in table:
        score = start + sum(pii.walk(t, x) for t in trees)
        assert (score > 0) == (p > n)


def test_thresholds_are_the_lowest_precise_scores():
    model = (0.0, [(0, 0, -1.0, 1.0)])
    rank = len(pii.BASE)
    high, low = (1,) + (0,) * 11, (0,) * 12
    assert pii.thresholds([(high, rank, 95, 5), (low, rank, 0, 50)], model) == {rank: 1.0}
    assert pii.thresholds([(high, rank, 50, 50)], model) == {}
    assert pii.thresholds([(high, rank, 5, 0)], model) == {}


def test_secret_base_spans(spark):
    rows = noisy(2)
    got = secrets.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((repr(r[0]), sha(",".join(plain(r[1], SECRET, True)))) for r in rows)
    assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in got) == want
    for r in got:
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert sha(",".join(base)) == r["base_sha256"]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex"))
    assert secrets.report(frame(spark, [])).collect() == []


def test_ownership_separates_examples_from_live(spark):
    example, live = "ghp_" + "A" * 36, "ghp_" + "B" * 36
    rows = [(k, f"use {example} here é", "en", f"s{k}", 1) for k in range(5)]
    rows += [(10 + k, f"é {live}", "en", "mine", 1) for k in range(5)]
    rows += [(20, f"{live} and {example}", "en", None, 1), (21, f"token = '{'c' * 20}'", "en", "s1", 1)]
    rows += [(22, f"{live}", "en", None, 1), (22, f"{live}", "en", None, 1)]
    got = {r["doc_id"]: r for r in secrets.report(frame(spark, rows)).collect()}
    for k in range(5):
        assert (got[k]["spans"], got[k]["n_live"], got[k]["n_example"]) == ("", 0, 1)
        assert (got[10 + k]["spans"], got[10 + k]["n_live"]) == ("forge:2:42", 1)
    assert got[20]["spans"] == "forge:0:40" and got[20]["n_example"] == 1
    assert got[21]["n_assign"] == 1


def test_ownership_counts(spark):
    rows = [(k % 7, f"AKIA{'X' * (12 + k % 3)}", "en", f"s{k % 2}" if k % 5 else None, 1) for k in range(40)]
    found = secrets.scan(frame(spark, rows), "doc_id", "source")
    got = {r["digest"]: (r["owners"], r["repositories"]) for r in secrets.ownership(found).collect()}
    want = {}
    for d, t, _, s, _ in rows:
        own, repo = want.setdefault(hashlib.sha256(t.encode()).hexdigest(), (set(), set()))
        own.add(s)
        repo.add((s, d))
    assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}


def test_secrets_against_sql(spark, sf_dir, tmp_path):
    name = "op9_secrets"
    assert compare(common.PLANS[name](spark, sf_dir), connect(sf_dir), common.CHECKS[name]) is None
    more = [(900 + k, f"Bearer {'z' * 20} ghp_{'A' * 40} https://u:passw0rd{k}@h é sk_live_{'9' * 18}", "en", f"s{k}", 1) for k in range(4)]
    frame(spark, noisy(3) + more).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(common.PLANS[name](spark, str(tmp_path)), con, common.CHECKS[name]) is None


def test_spread_over_repositories_decides_too(spark):
    shared, own = "ghp_" + "C" * 36, "ghp_" + "D" * 36
    rows = [(k, f"clone with {shared}", "en", "hot", 1) for k in range(secrets.MOST_REPOSITORIES + 1)]
    rows += [(500 + k, f"deploy {own}", "en", "hot", 1) for k in range(secrets.MOST_REPOSITORIES)]
    got = {r["doc_id"]: r for r in secrets.report(frame(spark, rows)).collect()}
    assert all(got[k]["n_example"] == 1 and got[k]["spans"] == "" for k in range(secrets.MOST_REPOSITORIES + 1))
    assert all(got[500 + k]["n_live"] == 1 and got[500 + k]["spans"] == "forge:7:47" for k in range(secrets.MOST_REPOSITORIES))
    assert (got[0]["most_owners"], got[0]["most_repositories"]) == (1, secrets.MOST_REPOSITORIES + 1)
    assert (got[500]["most_owners"], got[500]["most_repositories"]) == (1, secrets.MOST_REPOSITORIES)


def test_pii_features_hold_no_label(spark):
    """Two spans that differ only in what a check or a naming word sees have the same features."""
    texts = [("x: 412 555 1234 y", "x: 112 055 1234 y"), ("visa 4111111111111111 ok", "visa 4111111111111112 ok"), ("at 10.0.0.255 ok", "at 10.0.0.999 ok")]
    rows = [(2 * k + j, t, "en", "s", 1) for k, pair in enumerate(texts) for j, t in enumerate(pair)]
    docs = frame(spark, rows)
    scanned = docs.select(docs.doc_id.alias("key"), pii.found(docs.text).alias("found"))
    got = {(r["key"], r["rank"]): tuple(r[f] for f in pii.FEATURES) for r in pii.candidates(scanned).collect()}
    for key, rank in got:
        assert got[key, rank] == got[key ^ 1, rank]
    assert {"trigger", "luhn", "octets"}.isdisjoint(pii.FEATURES)


def test_pii_on_planted_spans_that_the_rules_do_not_know(spark):
    """Numbers outside any plan and without a naming word, written like the checked ones: found; the same digits in tables: left."""
    rng = random.Random(8)
    d = lambda n, lo=0: "".join(str(rng.randrange(lo, 10)) for _ in range(n))
    rows, planted = [], set()
    for k in range(1500):
        known = f"2{d(2)} {rng.randrange(2, 10)}{d(2)} {d(4)}" if k % 20 else f"1{d(2)} {d(3)} {d(4)}"
        planted |= set() if k % 20 else {k}
        rows.append((k, f"Ask at desk: {known}, any day", "en", "s", 1))
    rows += [(5000 + k, f"a x{d(3)} {d(3)} {d(4)}x {d(6)} {d(5)} z", "en", "s", 1) for k in range(600)]
    got = {r["doc_id"]: r["n_added"] for r in pii.report(frame(spark, rows)).collect()}
    assert sum(got[k] > 0 for k in planted) >= 0.9 * len(planted)
    assert sum(got[k] > 0 for k in got if k >= 5000) <= 0.1 * 600


def test_pii_cost_grows_with_the_candidates(spark):
    """One text of 100,000 candidates."""
    text = " ".join(f"call {200 + k % 700} 555 {k % 9000 + 1000}," for k in range(50_000)) + " a@b.co" * 50_000
    rows = [(1, text, "en", "s", 1)] + [(k, f"call {200 + k % 700} 555 {k % 9000 + 1000},", "en", "s", 1) for k in range(2, 400)]
    got = {r["doc_id"]: (r["n_email"], r["n_added"]) for r in pii.report(frame(spark, rows)).collect()}
    assert got[1] == (50_000, 50_000) and all(got[k] == (0, 1) for k in range(2, 400))
