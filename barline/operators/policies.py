"""Rule evaluation over candidate tables, fingerprints and drift."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision classes, strongest first.
PRECEDENCE = {"block": 0, "rest": 1, "cap": 2, "size": 3}
SURFACES = ("backtest", "paper", "live")
FAIL_REASONS = ("malformed_policy", "missing_evidence", "limit_breach", "none")


@dataclass(frozen=True)
class PolicyRule:
    id: str
    path: str
    op: str
    decision: str
    value: object = None
    allowed_size: float | None = None


def condition(rule: PolicyRule, available: Sequence[str]) -> Column:
    """exists / eq / lte / gte on a column; an absent path never matches."""
    if rule.path not in available:
        return F.lit(False)
    seen = F.col(rule.path)
    test = {
        "exists": lambda: seen.isNotNull(),
        "eq": lambda: seen == F.lit(rule.value),
        "lte": lambda: seen <= F.lit(rule.value),
        "gte": lambda: seen >= F.lit(rule.value),
    }[rule.op]()
    return F.coalesce(test, F.lit(False))


def evaluate(candidates: DataFrame, rules: Sequence[PolicyRule], size: str) -> DataFrame:
    """Decision, binding rule, supporting rules and allowed size per candidate.

    All rules are tested on the row itself: no candidate x rule rows and no
    shuffle.  Nothing matched, or a bad size, blocks.
    """
    ordered = sorted(enumerate(rules), key=lambda r: (PRECEDENCE[r[1].decision], r[0]))
    hits = F.filter(
        F.array(
            *[
                F.when(
                    condition(r, candidates.columns),
                    F.struct(
                        F.lit(r.id).alias("id"),
                        F.lit(r.decision).alias("decision"),
                        F.lit(r.allowed_size).cast("double").alias("cap"),
                    ),
                )
                for _, r in ordered
            ]
        ),
        lambda h: h.isNotNull(),
    )
    out = candidates.withColumn("_hits", hits).withColumn("_win", F.get("_hits", F.lit(0)))
    valid = F.col(size).isNotNull() & (F.col(size) > 0)
    decision = F.when(~valid, "block").otherwise(F.coalesce("_win.decision", F.lit("block")))
    binding = F.when(~valid, "invalid.requested_size").otherwise(F.coalesce("_win.id", F.lit("malformed_policy.no_match")))
    allowed = (
        F.when(decision == "size", F.col(size))
        .when(decision == "cap", F.least(F.col(size), F.col("_win.cap")))
        .otherwise(0.0)
    )
    supporting = F.when(valid, F.array_join(F.transform("_hits", lambda h: h["id"]), ",")).otherwise("")
    return out.select(
        *candidates.columns,
        decision.alias("decision_class"),
        binding.alias("binding_rule"),
        supporting.alias("supporting_rules"),
        allowed.alias("allowed_size"),
    )


def contract_faults(rows: DataFrame, doc: str) -> DataFrame:
    """First broken rule of each JSON decision row, in a fixed order."""
    schema = "surface STRING, decision STRUCT<`class`: STRING, fail_close_reason: STRING>, trace STRUCT<`class`: STRING>"
    d = F.from_json(doc, schema)
    fault = (
        F.when(d.isNull() | d["decision"].isNull(), "required_fields:decision")
        .when(d["decision"]["class"].isNull(), "required_fields:decision.class")
        .when(d["trace"]["class"].isNull(), "required_fields:trace.class")
        .when(~F.coalesce(d["surface"].isin(*SURFACES), F.lit(False)), "surface_scope:surface")
        .when(~d["decision"]["class"].isin(*PRECEDENCE), "decision_enum:decision.class")
        .when(~F.coalesce(d["decision"]["fail_close_reason"].isin(*FAIL_REASONS), F.lit(False)), "reason_enum:decision.fail_close_reason")
        .when(d["decision"]["class"] != d["trace"]["class"], "class_mismatch:trace.class")
    )
    return rows.withColumn("fault", fault)


def group_drift(hashed: DataFrame, within: Sequence[str], digest: str, across: str) -> DataFrame:
    """Groups whose members do not all share one fingerprint."""
    agg = hashed.groupBy(*within).agg(
        F.countDistinct(digest).alias("variants"), F.array_join(F.array_sort(F.collect_set(across)), ",").alias("members")
    )
    return agg.filter("variants > 1")


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Full outer comparison on a key: match, mismatch, only_left, only_right."""
    a = left.select(*keys, F.col(digest).alias("_a"))
    b = right.select(*keys, F.col(digest).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "only_left")
        .when(F.col("_a").isNull(), "only_right")
        .when(F.col("_a") == F.col("_b"), "match")
        .otherwise("mismatch")
    )
    return a.join(b, list(keys), "full_outer").withColumn("status", status)
