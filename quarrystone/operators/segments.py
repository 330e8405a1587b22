"""Customer segments: rule trees compiled to one boolean column each, all evaluated in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_OPS = (">", ">=", "<", "<=", "=", "!=")
TEXT_OPS = ("=", "!=", "IN", "NOT IN")
NULL_OPS = ("IS NULL", "IS NOT NULL")
#: The fields that rules may name, their operators, and whether they can be null.
FIELDS: dict[str, tuple[tuple[str, ...], bool]] = {
    "total_spend": (NUMBER_OPS, True), "order_count": (NUMBER_OPS, False), "aov": (NUMBER_OPS, True), "days_since_last_order": (NUMBER_OPS, True),
    "days_since_first_seen": (NUMBER_OPS, True), "churn_risk_band": (TEXT_OPS, False), "engagement_score": (NUMBER_OPS, True),
    "cart_abandon_sessions_90d": (NUMBER_OPS, False), "country_code": (TEXT_OPS, True), "rfm_segment": (TEXT_OPS, True),
}


@dataclass(frozen=True)
class Segment:
    id: str
    name: str
    rule: dict[str, Any] = field(hash=False)
    thresholds: dict[str, Any] = field(default_factory=dict, hash=False)
    null_handling: str = "exclude"
    description: str = ""


def _leaf(op: str, name: str, value: Any = None) -> dict[str, Any]:
    return {"op": op, "field": name, "value": value}


#: The baseline segments.
BASELINE = [
    Segment("S-01", "High Value", _leaf(">=", "total_spend", {"param": "high_value_spend_threshold"}), {"high_value_spend_threshold": 100000}),
    Segment("S-02", "New Customer", {"op": "AND", "children": [_leaf("<=", "days_since_first_seen", {"param": "new_customer_days"}), _leaf("<=", "order_count", 1)]}, {"new_customer_days": 60}),
    Segment("S-03", "Active Customer", _leaf("<=", "days_since_last_order", {"param": "active_days"}), {"active_days": 90}),
    Segment("S-04", "At Risk", _leaf("=", "churn_risk_band", "at_risk")),
    Segment("S-05", "Churned", _leaf("=", "churn_risk_band", "churned")),
    Segment("S-06", "Cart Abandoner", {"op": "AND", "children": [_leaf(">=", "cart_abandon_sessions_90d", 1), _leaf(">", "days_since_last_order", {"param": "cart_abandon_lookback_days"})]}, {"cart_abandon_lookback_days": 14}, "include"),
    Segment("S-07", "Highly Engaged", _leaf(">=", "engagement_score", {"param": "high_engagement_score"}), {"high_engagement_score": 80}),
    Segment("S-08", "Repeat Buyer", _leaf(">=", "order_count", {"param": "repeat_buyer_min_orders"}), {"repeat_buyer_min_orders": 2}),
]


class RuleError(ValueError):
    """A rule names an unknown field, operator or parameter."""


def compile_rule(rule: dict[str, Any], thresholds: dict[str, Any], null_handling: str = "exclude") -> Column:
    """The rule as a column, in SQL's three-valued logic; with ``include``, comparisons of a null field hold."""
    op = str(rule.get("op", "")).upper()
    if op in ("AND", "OR"):
        parts = [compile_rule(r, thresholds, null_handling) for r in rule["children"]]
        if not parts:
            raise RuleError(f"{op} without children")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "AND" else out | p
        return out
    if op == "NOT":
        below = rule["child"] if "child" in rule else rule["children"][0]
        return ~compile_rule(below, thresholds, null_handling)
    name = rule.get("field")
    if name not in FIELDS:
        raise RuleError(f"unknown field {name}")
    allowed, nullable = FIELDS[name]
    c = F.col(name)
    if op in NULL_OPS:
        return c.isNull() if op == "IS NULL" else c.isNotNull()
    if op not in allowed:
        raise RuleError(f"{name} does not take {op}")

    def value(v: Any) -> Any:
        if isinstance(v, dict):
            if v.get("param") not in thresholds:
                raise RuleError(f"unknown parameter {v.get('param')}")
            return thresholds[v["param"]]
        return v

    v = rule.get("value")
    if op in ("IN", "NOT IN"):
        inside = c.isin([value(x) for x in value(v)])
        out = inside if op == "IN" else ~inside
    else:
        other = F.lit(value(v))
        out = {">": c > other, ">=": c >= other, "<": c < other, "<=": c <= other, "=": c == other, "!=": c != other}[op]
    return out | c.isNull() if null_handling == "include" and nullable else out


def members(base: DataFrame, segments: list[Segment], key: str = "canonical_customer_id") -> DataFrame:
    """``(segment_id, key)`` of every customer in every segment, from one scan of ``base``."""
    marks = [F.when(F.coalesce(compile_rule(s.rule, s.thresholds, s.null_handling), F.lit(False)), F.lit(s.id)) for s in segments]
    return base.select(key, F.explode(F.array_compact(F.array(*marks))).alias("segment_id")).select("segment_id", key)


def changes(before: DataFrame, now: DataFrame, key: str = "canonical_customer_id") -> DataFrame:
    """``(segment_id, key, event)``: entered or exited."""
    on = ["segment_id", key]
    entered = now.join(before, on, "left_anti").select(*on, F.lit("entered").alias("event"))
    return entered.unionByName(before.join(now, on, "left_anti").select(*on, F.lit("exited").alias("event")))


def run_stats(before: DataFrame, now: DataFrame, segments: list[Segment]) -> DataFrame:
    """A row a segment: members, entered, exited, definition version."""
    spark = now.sparkSession
    every = spark.createDataFrame([(s.id, s.name) for s in segments], "segment_id string, name string")
    counts = now.groupBy("segment_id").agg(F.count("*").alias("member_count"))
    delta = changes(before, now).groupBy("segment_id").agg(F.count_if(F.col("event") == "entered").alias("entered"), F.count_if(F.col("event") == "exited").alias("exited"))
    out = every.join(counts, "segment_id", "left").join(delta, "segment_id", "left")
    return out.select("segment_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("member_count", "entered", "exited")], F.lit(1).alias("definition_version"))
