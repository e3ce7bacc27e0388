"""Personal data by candidate gradient boosting, with DataFrame functions alone.

Generators of high recall propose spans, which may overlap: the four base
formats and looser ones (spoken addresses, local phone numbers, identity and
bank numbers, long numbers, hexadecimal addresses).  A span of a base format
that passes its check is always reported.  For the others, boosted trees over
format and context features give a score, and a threshold for each generator,
calibrated on rows that the trees have not seen, selects what is reported.

There are no labels for personal data, so the trees learn from the corpus: a
candidate of a base format is positive if it passes its check; a looser one if
it stands free of letters and digits and passes the check of its own format (a
number plan, mod 97, Luhn, a known top level) or follows a word that names it.
Others are negative.  Labels do not depend on overlap.  A threshold is
calibrated on the candidates it can add, those outside base spans.  Features are
small integers of format and context.  What a generator's label looks at is left
out of its features: naming words, Luhn and the size of octets are no features at
all, and numbers of digits, brackets and points are 0 for the generators whose
checks read them (``HIDDEN``).  The trees see the edges, the mark before, the
digits and the capital around, so a candidate of like form in a like context
scores like a checked one.  A free span whose own check
leaves almost nothing to chance (mod 97; marked at signs before a known top
level) is added whatever its score.
Features take few values; the training set is the table of distinct feature
vectors with their positive and negative counts over all documents, whose size
is bounded by the product of those values.  The driver boosts over that table
and the trees return as one Column expression.

Texts are read once.  What remains of a text is its candidates with the lengths
and edges of the gaps between them; positions are running sums over the
candidates of one document, and overlaps are settled inside runs of spans that
touch, so a text's cost grows with its candidates.  Rows join on a 64-bit hash of
doc_id and text; among 3e10 documents a few dozen pairs are expected to share one
and then get each other's spans.

Defined cases: null and empty texts have no spans; rows with equal doc_id and
text get equal results; with no candidates or candidates of one label only, base
and proved spans alone are reported; spans count code points.  Extra columns do not take
part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm import common

ROUNDS = 30
SHRINK = 0.3
#: Share of accepted candidates that must be positive, on the calibration rows, and their least number.
PRECISION = 0.9
LEAST_ACCEPTED = 20
#: Characters of context on either side.
CONTEXT = 24

# Fixed formats.  Possessive repeats and the look behind keep the scan linear; they match what the plain forms match.
BASE = ("email", "ip", "card", "phone")
GENERATORS: dict[str, tuple[str, str]] = {
    # name: (what a text must contain, expression)
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "spoken": (
        r"(?:\(at\)|\[at\]|\x20at\x20)",
        r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
        r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}",
    ),
    "local": (r"[0-9][\x20).-]{1,2}[0-9]", r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])"),
    "identity": (r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "bank": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
    "number": (r"[0-9]{9}", r"(?<![0-9])[0-9]{9,30}(?![0-9])"),
    "hexaddress": (r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
KINDS = tuple(GENERATORS)
# What the looser formats are checked by: number plans, top levels, words before them that name them.
_PLANS = (r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$", r"^\([0-9]{2,4}\)[\x20.-]", r"^0[1-9][0-9]{0,2}[\x20.-]")
_TOP = r"(?i)(?:\.|\(dot\)\x20?|\[dot\]\x20?|\x20dot\x20)(?:com|org|net|edu|gov|mil|int|info|biz|name|io|dev|app|eu|uk|us|de|fr|es|it|nl|be|ch|at|pl|pt|se|dk|fi|no|ie|cz|ru|jp|cn|in|br|mx|ca|au|nz)$"
_MARKED = r"(?i)(?:\(at\)|\[at\])"
_IDENTITY = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
_HEXADDRESS = r"(?i)^(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):"
_CUES = {
    "spoken": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "local": r"(?i)\b(?:tel|phone|telephone|call|fax|mobile?|cell|dial|ring|telefono|t\u00e9l)\b",
    "identity": r"(?i)\b(?:ssn|social|identity|id)\b",
    "bank": r"(?i)\biban\b",
    "number": r"(?i)\b(?:acc(?:oun)?t|card|visa|ssn|konto|tarjeta|carte|passport|tel|phone|call|fax|mobile?)\b",
    "hexaddress": r"(?i)\b(?:ip|ipv6|addr|address|host)\b",
}
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FEATURES = ("digits", "letters", "space", "dot", "dash", "round", "left", "right", "mark", "around", "capital", "generator")
#: Generators whose labels look at a feature, and do not get it.
HIDDEN = {"digits": ("card", "phone", "local", "number"), "round": ("local",), "dot": ("email", "ip", "spoken"), "letters": ("bank",)}


def found(text: Column) -> Column:
    """For each generator with a match: its rank, the matches, and of the gaps around them the length and the edges."""

    def one(rank: int, needs: str, pattern: str) -> Column:
        gaps = F.transform(
            F.split(text, pattern, -1),
            lambda g: F.struct(
                F.length(g).alias("length"), F.left(g, F.lit(CONTEXT)).alias("head"), F.right(g, F.lit(CONTEXT)).alias("tail")
            ),
        )
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(text.rlike(needs), F.struct(F.lit(rank).alias("rank"), hits.alias("hits"), gaps.alias("gaps")))

    each = [one(k, *GENERATORS[name]) for k, name in enumerate(KINDS)]
    return F.filter(F.array(*each), lambda x: x.isNotNull() & (F.size(x["hits"]) > 0))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn's check of 12 to 19 digits."""
    marks = F.split(F.reverse(digits), "")
    doubled = F.transform(
        marks,
        lambda x, i: F.when(i % 2 == 1, x.try_cast("int") * 2 - F.when(x > "4", 9).otherwise(0)).otherwise(x.try_cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def octets_fit(hit: Column) -> Column:
    parts = F.split(hit, r"\.")
    return F.forall(parts, lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))


def checked(rank: Column, hit: Column) -> Column:
    """Whether a span of a base format passes its check."""
    n = F.length(digits_of(hit))
    return (
        F.when(rank == 0, True)
        .when(rank == 1, octets_fit(hit))
        .when(rank == 2, n.between(16, 19) & passes_luhn(digits_of(hit)))
        .when(rank == 3, n.between(8, 15))
        .otherwise(False)
    )


def passes_mod97(hit: Column) -> Column:
    """The check of international bank account numbers, of 15 to 34 characters."""
    plain = F.regexp_replace(hit, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, 5, 34), F.left(plain, F.lit(4)))
    rest = F.aggregate(
        F.regexp_extract_all(turned, F.lit("."), F.lit(0)),
        F.lit(0),
        lambda acc, x: (acc * F.when(x > "9", 100).otherwise(10) + F.position(x, F.lit(_ALPHABET)) - 1) % 97,
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def own_check(rank: Column, hit: Column) -> Column:
    """Whether a span of a looser format passes the check of that format."""
    is_ = lambda name: rank == KINDS.index(name)
    return (
        F.when(is_("spoken"), hit.rlike(_TOP))
        .when(is_("local"), hit.rlike("|".join(_PLANS)) & F.length(digits_of(hit)).between(8, 12))
        .when(is_("identity"), hit.rlike(_IDENTITY))
        .when(is_("bank"), passes_mod97(hit))
        .when(is_("number"), passes_luhn(digits_of(hit)))
        .when(is_("hexaddress"), hit.rlike(_HEXADDRESS))
        .otherwise(False)
    )


def proved(rank: Column, hit: Column) -> Column:
    """Whether the own check of a looser format leaves almost nothing to chance."""
    spoken = (rank == KINDS.index("spoken")) & hit.rlike(_MARKED) & hit.rlike(_TOP)
    return F.when(rank == KINDS.index("bank"), passes_mod97(hit)).otherwise(spoken)


def named(rank: Column, tail: Column) -> Column:
    """Whether the text before a span of a looser format names it."""
    out = F.lit(False)
    for name, words in _CUES.items():
        out = F.when(rank == KINDS.index(name), tail.rlike(words)).otherwise(out)
    return out


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per candidate: key, rank, start, end, base, its label, whether it is proved, and the features."""
    rows = (
        scanned.filter(F.size("found") > 0)
        .dropDuplicates(["key"])
        .select("key", F.explode("found").alias("f"))
        .select(
            "key",
            F.col("f.rank").alias("rank"),
            F.posexplode(
                F.arrays_zip(
                    F.slice(F.col("f.gaps"), F.lit(1), F.size("f.hits")).alias("before"),
                    F.col("f.hits").alias("hit"),
                    F.slice(F.col("f.gaps"), F.lit(2), F.size("f.hits")).alias("after"),
                )
            ).alias("pos", "c"),
        )
        .select("key", "rank", "pos", F.col("c.before").alias("before"), F.col("c.hit").alias("hit"), F.col("c.after").alias("after"))
    )
    own = Window.partitionBy("key", "rank").orderBy("pos")
    run = F.sum(F.col("before.length") + F.length("hit")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("end", run.cast("int")).withColumn("start", F.col("end") - F.length("hit"))
    n = F.length(digits_of(F.col("hit")))
    letters = F.length(F.regexp_replace("hit", "[^A-Za-z]", ""))
    step = lambda x, *cuts: sum(((x >= c).cast("int") for c in cuts), F.lit(0))
    has = lambda *marks: step(sum((F.col("hit").contains(m).cast("int") for m in marks), F.lit(0)), 1)
    side = lambda edge: F.when(edge == "", 0).when(edge.rlike(r"^[\x20\x09-\x0D]$"), 0).when(edge.rlike("^[A-Za-z0-9]$"), 2).otherwise(1)
    left, right = side(F.right(F.col("before.tail"), F.lit(1))), side(F.left(F.col("after.head"), F.lit(1)))
    unless = lambda name, x: F.when(F.col("rank").isin(*[KINDS.index(k) for k in HIDDEN[name]]), 0).otherwise(x).alias(name)
    tail, head = F.col("before.tail"), F.col("after.head")
    base, free = checked(F.col("rank"), F.col("hit")), (left != 2) & (right != 2)
    looser = free & (own_check(F.col("rank"), F.col("hit")) | named(F.col("rank"), F.col("before.tail")))
    return placed.select(
        "key",
        "rank",
        "start",
        "end",
        base.alias("base"),
        F.when(F.col("rank") < len(BASE), base).otherwise(looser).alias("positive"),
        ((F.col("rank") >= len(BASE)) & free & proved(F.col("rank"), F.col("hit"))).alias("proved"),
        unless("digits", step(n, 1, 7, 10, 12, 16, 20)),
        unless("letters", step(letters, 1, 6)),
        has(" ").alias("space"),
        unless("dot", has(".")),
        has("-").alias("dash"),
        unless("round", has("(", ")")),
        left.alias("left"),
        right.alias("right"),
        F.when(tail.rlike(r"[:=#]\x20?$"), 2).when(tail.rlike(r"[,;.(\[\x22]\x20?$"), 1).otherwise(0).alias("mark"),
        step(F.length(F.regexp_replace(F.concat(tail, head), "[^0-9]", "")), 1, 8).alias("around"),
        tail.rlike(r"\b[A-Z][A-Za-z]*[^A-Za-z]*$").cast("int").alias("capital"),
        F.greatest(F.col("rank") - len(BASE) + 1, F.lit(0)).alias("generator"),
    )


def with_overlap(rows: DataFrame) -> DataFrame:
    """Whether each candidate overlaps a checked base span of its document."""
    # Both frames end at the current row: a frame that begins there would be summed anew for every row.
    by_start, by_end = Window.partitionBy("key").orderBy("start"), Window.partitionBy("key").orderBy(F.desc("start"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_end.rangeBetween(Window.unboundedPreceding, 0))
    hit = (before > F.col("start")) | (after < F.col("end"))
    return rows.withColumn("overlaps", F.col("base") | F.coalesce(hit, F.lit(False)))


Tree = tuple  # (feature, cut, left, right) or a number


def boost(table: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting with trees of two levels over (features, positives, negatives)."""
    pos, neg = sum(p for _, p, _ in table), sum(n for _, _, n in table)
    start = math.log((pos + 1) / (neg + 1))
    score = [start] * len(table)
    cuts = [(f, c) for f in range(len(FEATURES)) for c in sorted({x[f] for x, _, _ in table})[:-1]]
    trees: list[Tree] = []
    for _ in range(rounds):
        grads = []
        for (_, p, n), s in zip(table, score, strict=True):
            q = 1 / (1 + math.exp(-s))
            grads.append((p - (p + n) * q, (p + n) * q * (1 - q)))

        def grow(rows: list[int], depth: int, grads=grads) -> Tree | float:
            g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
            best, gain = None, 1e-6
            for f, c in cuts if depth else ():
                lg = sum(grads[i][0] for i in rows if table[i][0][f] <= c)
                lh = sum(grads[i][1] for i in rows if table[i][0][f] <= c)
                here = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if here > gain:
                    best, gain = (f, c), here
            if best is None:
                return SHRINK * g / (h + 1)
            f, c = best
            low = [i for i in rows if table[i][0][f] <= c]
            high = [i for i in rows if table[i][0][f] > c]
            return (f, c, grow(low, depth - 1), grow(high, depth - 1))

        tree = grow(list(range(len(table))), 2)
        trees.append(tree)
        for i, (x, _, _) in enumerate(table):
            score[i] += walk(tree, x)
    return start, trees


def walk(tree: Tree | float, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, c, low, high = tree
        tree = low if x[f] <= c else high
    return tree


def as_column(model: tuple[float, list[Tree]]) -> Column:
    """The trees as one expression over the feature columns."""

    def one(tree: Tree | float) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, c, low, high = tree
        return F.when(F.col(FEATURES[f]) <= c, one(low)).otherwise(one(high))

    start, trees = model
    total = F.lit(start)
    for tree in trees:
        total = total + one(tree)
    return F.round(total, 6)


def thresholds(table: list[tuple[tuple[int, ...], int, int, int]], model) -> dict[int, float]:
    """For each generator beyond the base formats: the lowest score whose acceptance is precise enough; none, if there is none.

    Rows are (features, generator rank, positives, negatives) of the calibration documents.
    """
    start, trees = model
    out = {}
    for rank in range(len(BASE), len(KINDS)):
        scored = sorted(
            ((round(start + sum(walk(t, x) for t in trees), 6), p, n) for x, r, p, n in table if r == rank), reverse=True
        )
        p_sum = n_sum = 0
        for k, (s, p, n) in enumerate(scored):
            p_sum, n_sum = p_sum + p, n_sum + n
            last = k + 1 == len(scored) or scored[k + 1][0] < s
            if last and p_sum + n_sum >= LEAST_ACCEPTED and p_sum >= PRECISION * (p_sum + n_sum):
                out[rank] = s
    return out


def best_of_overlaps(added: DataFrame, span: Column) -> DataFrame:
    """key, x: the added spans that no better one overlaps (by score, then generator).

    Spans are cut into runs that touch; matches of one generator do not overlap,
    so runs are short, and only spans of one run are compared.
    """
    in_order = Window.partitionBy("key").orderBy("start", "end", "rank")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    runs = added.withColumn("_begins", begins)
    runs = runs.withColumn("_run", F.sum("_begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    s = runs.groupBy("key", "_run").agg(F.collect_list(span).alias("s"))
    beaten = lambda x: F.exists(
        "s",
        lambda y: (y["start"] < x["end"])
        & (x["start"] < y["end"])
        & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["rank"] < x["rank"]))),
    )
    return s.select("key", F.explode(F.filter("s", lambda x: ~beaten(x))).alias("x"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of base spans, all spans, number of added spans."""
    key = F.xxhash64("doc_id", "text").alias("key")
    empty_text = F.coalesce(F.col("text"), F.lit(""))
    scanned = common.settle(docs.select("doc_id", key, found(empty_text).alias("found")), "candidates")
    rows = common.settle(with_overlap(candidates(scanned)), "features")
    fold = F.crc32(F.col("key").cast("string")) % 5 == 0
    # thresholds are for what may be added: the calibration rows leave out what overlaps a base span
    used = rows.withColumn("calibration", fold).filter(~F.col("calibration") | ~F.col("overlaps"))
    counts = used.groupBy("calibration", "rank", *FEATURES).agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n")
    )
    table = [(r["calibration"], tuple(r[f] for f in FEATURES), r["rank"], r["p"], r["n"]) for r in counts.collect()]
    seen: dict[tuple[int, ...], list[int]] = {}
    for calibration, x, _, p, n in sorted(table):
        if not calibration:
            both = seen.setdefault(x, [0, 0])
            both[0] += p
            both[1] += n
    extra = F.col("proved")
    score = F.lit(0.0)
    if any(p for p, _ in seen.values()) and any(n for _, n in seen.values()):
        model = boost([(x, p, n) for x, (p, n) in sorted(seen.items())])
        score = as_column(model)
        for rank, least in thresholds([(x, r, p, n) for c, x, r, p, n in table if c], model).items():
            extra = extra | ((F.col("rank") == rank) & (F.col("score") >= least))
    accepted = rows.withColumn("score", score).withColumn("added", ~F.col("overlaps") & extra).filter(F.col("base") | F.col("added"))
    span = F.struct("rank", "start", "end", "added", "score").alias("x")
    chosen = best_of_overlaps(accepted.filter("added"), span).unionByName(accepted.filter(~F.col("added")).select("key", span))
    chosen = chosen.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("s"))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda s: F.array_join(
        F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    s = F.coalesce("s", F.array().cast("array<struct<rank:int,start:int,end:int,added:boolean,score:double>>"))
    base = F.filter(s, lambda x: ~x["added"])
    n_of = lambda k: F.size(F.filter(base, lambda x: x["rank"] == k)).cast("long")
    return scanned.select("doc_id", "key").join(chosen, "key", "left").select(
        "doc_id",
        *[n_of(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["added"])).cast("long").alias("n_added"),
    )


@common.query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
