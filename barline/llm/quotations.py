"""Quotation linking, with DataFrame functions alone.

Every line's quote level is the number of ``>`` that lead it.  Neighbouring
lines of one level above 0 form a quoted passage; passages are normalised
(ASCII lower case, one blank between words) and hashed, whole and line by line.
Originals are hashed the same way from what each message says itself: the whole
message, its paragraphs and its lines.  A passage is joined to the first message
of the conversation that says it, if that is earlier.  A message replies to the
latest such message among its outermost passages that are found.  Replies are
followed to the message that began them, so that rows ordered by
``(conv_id, root_turn, turn)`` are conversations in reply order, and the texts
come without their quotes.

Conversations and passages that hold a third of all rows: originals are
minimums by (conversation, hash), summed inside the tasks; quotes meet them in
joins whose other side has one row for each key.  No window or list spans more
than the lines of one message, and roots are found by doubling steps.

Defined cases: null and empty texts quote nothing and stay as they are (null
stays null); lines of fewer than ``MIN_WORDS`` words are no evidence by
themselves, only as a whole passage; a message that quotes nothing found replies
to nothing (``parent_turn`` null) and begins a thread; rows of the same
conversation and turn share their links; messages without conv_id or turn link
to nothing.  Extra columns stay in ``linked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm import common

MIN_WORDS = 4
_BLANKS = " \t\n\x0b\x0c\r"
_LEAD = r"^[ \t>]*>[ \t]?"
# Fixed formats: the line that mail programs put before a quote.
_INTRODUCES = r"(?:[Oo]n .*wrote|[Ll]e .*a écrit|[Aa]m .*schrieb.*|[Ee]l .*escribió) ?:[ \t\r]*$"


def lead(line: Column) -> Column:
    return F.regexp_extract(line, _LEAD, 0)


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(lead(line), "[^>]", ""))


def normal(text: Column) -> Column:
    """ASCII lower case, blanks folded."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, r"[\x20\x09-\x0D]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def own_text(text: Column) -> Column:
    """What the message says itself: no quoted lines, no lines that introduce a quote."""
    lines = F.split(text, "\n", -1)
    quoted_next = lambda i: F.coalesce(F.get(lines, i + 1).rlike(_LEAD), F.lit(False))
    kept = F.filter(lines, lambda x, i: ~x.rlike(_LEAD) & ~(x.rlike(_INTRODUCES) & quoted_next(i)))
    return F.when(text.contains(">"), F.btrim(F.array_join(kept, "\n"), F.lit(_BLANKS))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, digest of every quoted passage and of its longer lines."""
    each = (
        messages.filter(F.col("text").contains(">") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", "text", F.xxhash64("text").alias("_text"))
        .distinct()
        .select("conv_id", "turn", "_text", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("level", level(F.col("line")))
    )
    message = Window.partitionBy("conv_id", "turn", "_text").orderBy("pos")
    starts = F.coalesce((F.col("level") != F.lag("level").over(message)).cast("int"), F.lit(1))
    body = F.expr(r"substring(line, length(regexp_extract(line, '^[ \t>]*>[ \t]?', 0)) + 1)")
    runs = (
        each.withColumn("_starts", starts)
        .withColumn("_run", F.sum("_starts").over(message))
        .filter("level > 0")
        .withColumn("body", body)
        .groupBy("conv_id", "turn", "_text", "_run", "level")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("lines"))
    )
    whole = F.array(F.array_join(F.col("lines.body"), " "))
    longer = F.filter("lines.body", lambda x: F.size(F.split(normal(x), " ")) >= MIN_WORDS)
    return (
        runs.select("conv_id", "turn", "level", F.explode(F.concat(whole, longer)).alias("body"))
        .filter(normal(F.col("body")) != "")
        .select("conv_id", "turn", "level", digest(F.col("body")).alias("digest"))
        .distinct()
    )


def originals(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """conv_id, digest, origin: the first turn that says a passage, in conversations that quote at all."""
    said = messages.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", own_text(F.col("text")).alias("text"))
    blocks = F.split("text", r"\n[ \t\r]*\n", -1)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.size(F.split(normal(x), " ")) >= MIN_WORDS)
    parts = F.array_distinct(F.concat(F.array("text"), blocks, lines))
    return (
        said.filter(F.col("text").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", F.explode(parts).alias("body"))
        .select("conv_id", "turn", digest(F.col("body")).alias("digest"))
        .groupBy("conv_id", "digest")
        .agg(F.min("turn").alias("origin"))
    )


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_passages, n_found for messages with quotes."""
    quoted = common.settle(passages(messages), "quoted")
    known = originals(messages, quoted.select("conv_id").distinct())
    met = quoted.join(known, ["conv_id", "digest"], "left").withColumn(
        "origin", F.when(F.col("origin") < F.col("turn"), F.col("origin"))
    )
    # outermost level that is found, then the latest turn: one maximum
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("outer"), "origin")))
    return met.groupBy("conv_id", "turn").agg(
        best["origin"].alias("parent_turn"),
        F.count("*").alias("n_passages"),
        F.count("origin").alias("n_found"),
    )


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of messages with a parent, by doubling: steps grow with the log of the depth."""
    state = links.filter("parent_turn is not null").select(
        "conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")
    )
    while True:
        state = common.settle(state, "roots")
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_next"), F.col("depth").alias("_more"))
        joined = state.join(up, ["conv_id", "root_turn"], "left")
        if joined.filter("_next is not null").isEmpty():
            return state
        state = joined.select(
            "conv_id",
            "turn",
            F.coalesce("_next", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
        )


def linked(messages: DataFrame) -> DataFrame:
    """All columns, the text without quotes, and parent_turn, root_turn, depth, n_passages, n_found."""
    links = common.settle(parents(messages), "links")
    threads = roots(links)
    added = links.join(threads, ["conv_id", "turn"], "left")
    names = ("parent_turn", "root_turn", "depth", "n_passages", "n_found")
    own = messages.drop(*names)
    zero = F.lit(0).cast("long")
    return (
        own.join(added, ["conv_id", "turn"], "left")
        .withColumn("text", own_text(F.col("text")))
        .withColumn("root_turn", F.coalesce("root_turn", "turn"))
        .withColumn("depth", F.coalesce(F.col("depth").cast("long"), zero))
        .withColumn("n_passages", F.coalesce("n_passages", zero))
        .withColumn("n_found", F.coalesce("n_found", zero))
        .select(*own.columns, *names)
    )


SQL = r"""
WITH RECURSIVE split_lines AS (
  SELECT *, string_split(text, chr(10)) AS lines FROM conversations
), said AS (
  SELECT conv_id, turn, role, text AS given, CASE WHEN contains(text, '>') THEN trim(array_to_string([
      lines[i] for i in range(1, len(lines) + 1) if NOT regexp_matches(lines[i], '^[ \t>]*>')
      AND NOT (regexp_matches(lines[i], '{introduces}') AND coalesce(regexp_matches(lines[i + 1], '^[ \t>]*>'), false))
    ], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END AS text
  FROM split_lines
), each AS (
  SELECT conv_id, turn, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT DISTINCT conv_id, turn, text, lines FROM split_lines
        WHERE contains(text, '>') AND conv_id IS NOT NULL AND turn IS NOT NULL)
), leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t>]*>[ \t]?'), '[^>]', '', 'g')) AS level,
    substring(line, length(regexp_extract(line, '^[ \t>]*>[ \t]?')) + 1) AS body FROM each
), flagged AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS f FROM leveled
  WINDOW w AS (PARTITION BY conv_id, turn, text ORDER BY pos)
), runs AS (
  SELECT *, sum(f) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) AS run FROM flagged
), bodies AS (
  SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY pos) AS body, true AS whole FROM runs WHERE level > 0
  GROUP BY conv_id, turn, text, run, level
  UNION ALL SELECT conv_id, turn, level, body, false FROM runs WHERE level > 0
), quoted AS (
  SELECT DISTINCT conv_id, turn, level, {normal_body} AS digest FROM bodies
  WHERE {normal_body} <> '' AND (whole OR len(string_split({normal_body}, ' ')) >= 4)
), parts AS (
  SELECT conv_id, turn, text AS body, true AS whole FROM said
  UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')), true FROM said
  UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))), false FROM said
), known AS (
  SELECT conv_id, {normal_body} AS digest, min(turn) AS origin FROM parts
  WHERE turn IS NOT NULL AND body IS NOT NULL AND (whole OR len(string_split({normal_body}, ' ')) >= 4) GROUP BY 1, 2
), met AS (
  SELECT q.conv_id, q.turn, q.level, CASE WHEN k.origin < q.turn THEN k.origin END AS origin
  FROM quoted q LEFT JOIN known k USING (conv_id, digest)
), outer_level AS (
  SELECT *, min(level) FILTER (WHERE origin IS NOT NULL) OVER (PARTITION BY conv_id, turn) AS best FROM met
), links AS (
  SELECT conv_id, turn, max(origin) FILTER (WHERE level = best) AS parent_turn, count(*) AS n_passages, count(origin) AS n_found
  FROM outer_level GROUP BY conv_id, turn
), up(conv_id, turn, root_turn, depth) AS (
  SELECT conv_id, turn, parent_turn, 1 FROM links WHERE parent_turn IS NOT NULL
  UNION ALL SELECT u.conv_id, u.turn, l.parent_turn, u.depth + 1 FROM up u
  JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.root_turn AND l.parent_turn IS NOT NULL
), roots AS (
  SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn
)
SELECT s.conv_id, s.turn, s.role, s.text, l.parent_turn, coalesce(r.root_turn, s.turn) AS root_turn,
  CAST(coalesce(r.depth, 0) AS BIGINT) AS depth, coalesce(l.n_passages, 0) AS n_passages, coalesce(l.n_found, 0) AS n_found
FROM said s LEFT JOIN links l ON s.conv_id = l.conv_id AND s.turn = l.turn
LEFT JOIN roots r ON s.conv_id = r.conv_id AND s.turn = r.turn
""".format(
    introduces=_INTRODUCES,
    normal_body=r"trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))",
)


@common.query("op7_quotations", SQL)
def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "conversations"))
