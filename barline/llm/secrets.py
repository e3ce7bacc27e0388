"""Secrets by corpus-wide ownership.

Base candidates come from three fixed patterns, further ones from formats that
providers publish.  A candidate's secret value is hashed and its occurrences
over the whole corpus are counted by distinct owners (sources) and distinct
repositories (documents, each within its owner).  A value that more than
``MOST_OWNERS`` owners or more than ``MOST_REPOSITORIES`` repositories carry is a
widely copied example; another one stays with its owner and looks live.  Base
spans are always reported, further ones only if they look live.

Texts are read once; what leaves the tasks are spans and digests.  Counts are
taken in two steps (distinct pairs, then sums), so a value copied into a third
of all documents is summed inside the tasks.  Joined back, such a value is one row
against its carriers, a join whose hot side can be split.  Rows are told apart by
a 64-bit hash of what they hold; among 3e10 documents with secrets a few dozen
pairs are expected to share one.

Defined cases: null and empty texts have no spans; a null owner or repository
counts as one of its own; an overlap of spans of different kinds reports both;
rows with the same id are reported each.  Extra columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common, tokens

#: A value with more owners than this is a widely copied example.
MOST_OWNERS = 2
#: Nor is one with more repositories than this, whoever owns them, a secret of anyone.
MOST_REPOSITORIES = 50


def either_case(words: str) -> str:
    """A pattern's ASCII letters in either case, and no other letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Fixed patterns: name, expression, group that holds the secret, least length of that group.
BASE = (
    (
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Published formats.
FURTHER = (
    ("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("cloud", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("payment", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{16,})", 1, 16),
    ("login", r"://[!-.0-9;-?A-~]{1,64}:([!-.0-9;-?A-~]{8,64})@", 1, 8),
    ("pem", r"-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{16,}", 0, 0),
)
KINDS = tuple(k for k, *_ in BASE + FURTHER)
_COMPILED = [(rank, re.compile(pattern.encode()), group, least) for rank, (_, pattern, group, least) in enumerate(BASE + FURTHER)]
# A text without any of these bytes sequences holds no further candidate; most texts are passed over by one search.
_HINT = re.compile(rb"gh[opsur]_|xox[abprs]-|AIza|[rs]k_(?:live|test)_|eyJ|[Bb]earer\x20|://|-----BEGIN")


def candidates(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start byte, end byte, kind, secret value) of every candidate, by start and kind."""
    found = []
    hinted = _HINT.search(text) is not None
    for rank, pattern, group, least in _COMPILED:
        if rank >= len(BASE) and not hinted:
            break
        for m in pattern.finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), m.end(), rank, m.group(group)))
    return sorted(found, key=lambda x: (x[0], x[2]))


def scan(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """doc_id, owner, repository and the candidates of every document; spans in code points."""
    kind = "array<struct<start:int,rank:int,end:int,digest:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(
            pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("digest", pa.string())])
        )
        for batch in batches:
            spans: list[list[dict]] = []
            for _, _, data, offsets in tokens.pieces(batch.column(3)):
                raw = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = raw[a:b]
                    got = candidates(text)
                    if got:
                        # code points before each byte, only where there is something to say
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                        got = [
                            {"start": int(points[s]), "rank": k, "end": int(points[e]), "digest": hashlib.sha256(v).hexdigest()}
                            for s, e, k, v in got
                        ]
                    spans.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, of)], ["doc_id", "owner", "repository", "spans"])

    return docs.select(
        "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text"
    ).mapInArrow(run, f"doc_id long, owner string, repository string, spans {kind}")


def ownership(spans: DataFrame) -> DataFrame:
    """digest, owners, repositories: distinct carriers of each value over the corpus."""
    each = spans.select(F.explode("spans.digest").alias("digest"), "owner", "repository")
    named = each.select("digest", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    pairs = named.groupBy("digest", "owner", "repository").agg(F.count("*").alias("_n"))
    by_owner = pairs.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def report(
    docs: DataFrame, repository: str = "doc_id", owner: str = "source", most: int = MOST_OWNERS, spread: int = MOST_REPOSITORIES
) -> DataFrame:
    """One row per document: counts of base kinds, digest of the base spans, all spans, live and example counts,
    and the most owners and repositories that any of its values has."""
    found = common.settle(scan(docs, repository, owner), "secrets")
    owned = common.settle(ownership(found), "owned")
    example = (F.col("owners") > most) | (F.col("repositories") > spread)
    # Of the values of each document: which are examples, and the widest spread.  The spans of one document are one row.
    keyed = found.withColumn("_row", F.xxhash64("doc_id", "owner", "repository", "spans"))
    carried = (
        keyed.filter(F.size("spans") > 0)
        .select("_row", F.explode("spans.digest").alias("digest"))
        .distinct()
        .join(owned, "digest")
        .groupBy("_row")
        .agg(
            F.collect_set(F.when(example, F.col("digest"))).alias("_examples"),
            F.max("owners").alias("_owners"),
            F.max("repositories").alias("_repositories"),
        )
    )
    all_spans = keyed.join(carried, "_row", "left").withColumn("_examples", F.coalesce("_examples", F.array().cast("array<string>")))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        one = F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.array_join(one, ",")

    def of(kind: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == kind)).cast("long")

    is_example = lambda s: F.array_contains(F.col("_examples"), s["digest"])
    shown = F.filter("spans", lambda s: (s["rank"] < len(BASE)) | ~is_example(s))
    return all_spans.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(shown).alias("spans"),
        F.size(F.filter("spans", lambda s: ~is_example(s))).cast("long").alias("n_live"),
        F.size(F.filter("spans", is_example)).cast("long").alias("n_example"),
        F.coalesce("_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )


def _sql() -> str:
    """The same report in SQL: matches between their gaps, owners of each value, spans put together again."""
    found = []
    for rank, (_, pattern, group, least) in enumerate(BASE + FURTHER):
        quoted = "'" + pattern.replace("'", "''") + "'"
        found.append(
            f"SELECT rid, doc_id, source, {rank} AS rank, {least} AS least, regexp_extract_all(text, {quoted}) AS hits, "
            f"regexp_extract_all(text, {quoted}, {group}) AS secrets, regexp_split_to_array(text, {quoted}) AS gaps FROM docs"
        )
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    at = "coalesce(list_sum([length(x) for x in gaps[1:i]]), 0) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0)"
    written = "string_agg(span, ',' ORDER BY start, rank)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), found AS (
  {" UNION ALL ".join(found)}
), each AS (
  SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0
), placed AS (
  SELECT rid, doc_id, source, rank, secrets[i] AS secret, CAST({at} AS BIGINT) AS start, length(hits[i]) AS size
  FROM each WHERE length(secrets[i]) >= least
), owners AS (
  SELECT secret, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS repositories,
    owners > {MOST_OWNERS} OR repositories > {MOST_REPOSITORIES} AS example
  FROM placed GROUP BY secret
), spans AS (
  SELECT rid, rank, start, example, owners, repositories, {kinds}[rank + 1] || ':' || start || ':' || (start + size) AS span
  FROM placed JOIN owners USING (secret)
), by_doc AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    {written} FILTER (rank < {len(BASE)}) AS base, {written} FILTER (rank < {len(BASE)} OR NOT example) AS spans,
    count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example,
    max(owners) AS most_owners, max(repositories) AS most_repositories FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repositories, 0)::BIGINT AS most_repositories
FROM docs LEFT JOIN by_doc USING (rid)
"""


@common.query("op9_secrets", _sql())
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
