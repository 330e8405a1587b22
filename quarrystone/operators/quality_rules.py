"""Data quality: rules compiled to boolean columns, classified rows, rule results and scores."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.screen import Screen, marked

#: Severities by rank, their weights, and the weights of dimensions.
SEVERITIES = ["info", "warn", "quarantine", "reject"]
SEVERITY_WEIGHT = {"info": 0.1, "warn": 0.4, "quarantine": 1.0, "reject": 1.0}
DIMENSION_WEIGHT = {"completeness": 0.25, "validity": 0.25, "uniqueness": 0.15, "consistency": 0.15, "integrity": 0.10, "timeliness": 0.10}
EMAIL = r"^[^@\s]+@[^@\s.]+\.[^@\s]{2,}$"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    dimension: str
    type: str
    severity: str = "warn"
    column: str | None = None
    columns: tuple[str, ...] = ()
    applies_when: str | None = None
    threshold: float | None = None
    args: dict[str, Any] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Context:
    """What rules may need besides the row: the moment that counts as now, and whether references are enforced."""

    as_of: str | None = None
    referential: bool = False

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp") if self.as_of else F.current_timestamp()


Builder = Callable[[DataFrame, Rule, Context], Column]
BUILDERS: dict[str, Builder] = {}


def rule_type(f: Builder) -> Builder:
    BUILDERS[f.__name__] = f
    return f


@rule_type
def not_null(df, r, ctx):
    return F.col(r.column).isNotNull()


@rule_type
def not_blank(df, r, ctx):
    return F.coalesce(F.trim(r.column) != "", F.lit(False))


@rule_type
def type_cast(df, r, ctx):
    typed = r.args.get("typed", f"{r.column}_typed")
    return F.col(r.column).isNull() | F.col(typed).isNotNull() if typed in df.columns else F.lit(True)


@rule_type
def regex(df, r, ctx):
    return F.col(r.column).rlike(r.args["pattern"])


@rule_type
def in_set(df, r, ctx):
    return F.col(r.column).isNull() | F.col(r.column).isin(list(r.args["values"]))


@rule_type
def numeric_range(df, r, ctx):
    c, low, high = F.col(r.column), r.args.get("min"), r.args.get("max")
    strict = r.args.get("exclusive", False)
    inside = F.lit(True)
    if low is not None:
        inside &= c > low if strict else c >= low
    if high is not None:
        inside &= c < high if strict else c <= high
    return c.isNull() | inside


@rule_type
def length_range(df, r, ctx):
    n = F.length(r.column)
    return n.isNull() | n.between(r.args.get("min", 0), r.args.get("max", 2**31 - 1))


def group_mark(r: Rule) -> str:
    return f"__group_{r.id}"


def group_screen(r: Rule) -> Screen | None:
    """What makes all rows of a key fail, for rules about keys: several rows, or several values of the second column."""
    if r.type in ("unique", "duplicate_composite"):
        return Screen(tuple(r.columns or (r.column,)), F.count("*") > 1)
    if r.type == "set_consistency":
        key, value = r.columns
        return Screen((key,), F.coalesce(F.min(value) != F.max(value), F.lit(False)))
    return None


def with_groups(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with a mark, for each rule about keys, of the rows whose key fails; rules whose columns are not there are left to fail open."""
    found = {group_mark(r): s for r in rules if (s := group_screen(r)) and set(r.columns or (r.column,)) <= set(df.columns)}
    return marked(df, found) if found else df


@rule_type
def unique(df, r, ctx):
    """No other row has the key; ``with_groups`` has marked the rows."""
    return ~F.col(group_mark(r))


@rule_type
def duplicate_composite(df, r, ctx):
    return ~F.col(group_mark(r))


@rule_type
def referential(df, r, ctx):
    """Passes unless references are enforced; then with_references() has marked the rows."""
    mark = reference_mark(r)
    return F.col(r.column).isNull() | F.col(mark) if ctx.referential and mark in df.columns else F.lit(True)


@rule_type
def timestamp_not_future(df, r, ctx):
    skew = F.make_dt_interval(secs=F.lit(r.args.get("skew", 300)))
    return F.col(r.column).isNull() | (F.col(r.column) <= ctx.now() + skew)


@rule_type
def timestamp_range(df, r, ctx):
    c = F.col(r.column)
    return c.isNull() | c.between(F.lit(r.args["min"]).cast("timestamp"), F.lit(r.args["max"]).cast("timestamp"))


@rule_type
def date_range(df, r, ctx):
    c = F.col(r.column).cast("date")
    top = F.lit(r.args["max"]).cast("date") if "max" in r.args else ctx.now().cast("date")
    inside = (c >= F.lit(r.args["min"]).cast("date")) & (c <= top)
    if years := r.args.get("max_age_years"):
        inside &= F.datediff(top, c) <= years * 366
    return c.isNull() | inside


@rule_type
def temporal_order(df, r, ctx):
    early, late = (F.col(c) for c in r.columns)
    return early.isNull() | late.isNull() | (late >= early if r.args.get("allow_equal", True) else late > early)


@rule_type
def email_syntax(df, r, ctx):
    return F.col(r.column).isNull() | F.col(r.column).rlike(EMAIL)


@rule_type
def phone_normalisable(df, r, ctx):
    norm = r.args.get("norm", f"{r.column}_norm")
    return F.col(r.column).isNull() | F.col(norm).isNotNull() if norm in df.columns else F.lit(True)


@rule_type
def cross_field_consistency(df, r, ctx):
    return F.expr(r.args["expression"])


@rule_type
def set_consistency(df, r, ctx):
    """At most one value of the second column for each value of the first; ``with_groups`` has marked the rows."""
    return ~F.col(group_mark(r))


def reference_mark(r: Rule) -> str:
    return f"__resolves_{r.id}"


def with_references(df: DataFrame, r: Rule, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with a mark, for the referential rule, of the rows whose value is among ``keys``: a join, never a list of literals."""
    known = keys.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    return df.join(known, df[r.column] == known["__key"], "left").withColumn(reference_mark(r), F.col("__key").isNotNull()).drop("__key")


def _columns(df: DataFrame, rules: list[Rule], ctx: Context) -> list[tuple[Rule, Column, Column]]:
    out = []
    for r in rules:
        if r.type not in BUILDERS:
            raise ValueError(f"unknown rule type {r.type}")
        applies = F.expr(r.applies_when) if r.applies_when else F.lit(True)
        try:
            passed = BUILDERS[r.type](df, r, ctx)
            df.select(passed)  # resolves the names, runs nothing
        except Exception:  # a rule that cannot be built lets all rows pass, as information
            r, passed = Rule(r.id, r.name, r.dimension, r.type, "info", r.column, r.columns, r.applies_when), F.lit(True)
        out.append((r, applies, passed))
    return out


def _failed(applies: Column, passed: Column) -> Column:
    return applies & ~passed


def classify(df: DataFrame, rules: list[Rule], ctx: Context = Context()) -> DataFrame:
    """Adds ``dq_failed_rules`` (array of structs) and ``dq_status`` by the worst severity. An unknown result is no failure."""
    df = with_groups(df, rules)
    built = _columns(df, rules, ctx)
    marks = [
        F.when(_failed(a, p), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity")))
        for r, a, p in built
    ]
    empty = F.expr("cast(array() as array<struct<rule_id:string,rule_name:string,dimension:string,severity:string>>)")
    out = df.withColumn("dq_failed_rules", F.array_compact(F.array(*marks)) if marks else empty)
    has = lambda s: F.exists("dq_failed_rules", lambda x: x["severity"] == s)
    status = F.when(F.size("dq_failed_rules") == 0, "accepted").when(has("reject"), "rejected").when(has("quarantine"), "quarantined").otherwise("accepted_with_warning")
    return out.withColumn("dq_status", status).drop(*map(group_mark, rules))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("dq_status").isin("accepted", "accepted_with_warning"))


def quarantined_payloads(classified: DataFrame, key: str) -> DataFrame:
    """Refused rows as JSON with a hash and what they failed."""
    refused = classified.where(F.col("dq_status").isin("quarantined", "rejected"))
    body = F.to_json(F.struct(*[c for c in classified.columns if not c.startswith("dq_")]))
    return refused.select(F.col(key).alias("record_key"), "dq_status", F.transform("dq_failed_rules", lambda x: x["rule_id"]).alias("failed_rules"), body.alias("payload"), F.sha2(body, 256).alias("payload_sha256"))


def rule_results(df: DataFrame, rules: list[Rule], ctx: Context = Context()) -> DataFrame:
    """One row a rule: applicable, failed and passed rows, failure rate and whether it breaks the rule's threshold.

    Rules about rows are counted in one pass; each rule about keys is a count of keys, and no row is marked for it.
    """
    about_keys = [r for r in rules if group_screen(r) and set(r.columns or (r.column,)) <= set(df.columns)]
    built = _columns(df, [r for r in rules if r not in about_keys], ctx)
    head = lambda r: [F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.lit(r.threshold).cast("double").alias("threshold")]
    parts = []
    if built:
        flags = df.select(*[F.struct(a.alias("a"), _failed(a, p).alias("f")).alias(f"r{i}") for i, (_, a, p) in enumerate(built)])
        sums = flags.agg(*[F.struct(F.count_if(f"r{i}.a").alias("applicable"), F.count_if(f"r{i}.f").alias("failed")).alias(f"r{i}") for i in range(len(built))])
        parts.append(sums.select(F.inline(F.array(*[F.struct(*head(r), F.col(f"r{i}.applicable").alias("applicable"), F.col(f"r{i}.failed").alias("failed")) for i, (r, _, _) in enumerate(built)]))))
    for r in about_keys:
        screen, applies = group_screen(r), F.expr(r.applies_when) if r.applies_when else F.lit(True)
        keys = df.groupBy(*screen.keys).agg(F.count_if(applies).alias("a"), screen.bad.alias("bad"))
        parts.append(keys.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("applicable"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("a"))), F.lit(0)).alias("failed")).select(*head(r), "applicable", "failed"))
    rate = F.round(F.coalesce(F.try_divide("failed", "applicable"), F.lit(0.0)), 5)
    return reduce(DataFrame.unionByName, parts).withColumns({"passed": F.col("applicable") - F.col("failed"), "failure_rate": rate}).withColumn(
        "threshold_breached", F.coalesce(F.col("failure_rate") > F.col("threshold"), F.lit(False))
    )


def dimension_scores(results: DataFrame) -> DataFrame:
    """``(dimension, score)`` from rule results; dimensions without applicable rows are left out."""
    w = F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY_WEIGHT.items() for x in pair)), F.col("severity"))
    sums = results.groupBy("dimension").agg(F.sum(F.col("failed") * w).alias("bad"), F.sum(F.col("applicable") * w).alias("all")).where(F.col("all") > 0)
    return sums.select("dimension", F.bround(100 * (1 - F.col("bad") / F.col("all")), 2).alias("score"))


def overall_score(scores: DataFrame) -> DataFrame:
    """One row: the mean of the dimensions that have a score, by their weights; 0 without any."""
    w = F.element_at(F.create_map(*(F.lit(x) for pair in DIMENSION_WEIGHT.items() for x in pair)), F.col("dimension"))
    return scores.agg(F.bround(F.coalesce(F.try_divide(F.sum(F.col("score") * w), F.sum(w)), F.lit(0.0)), 2).alias("score_overall"))


def status_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("dq_status").agg(F.count("*").alias("rows"))


def ruleset_hash(rules: list[Rule]) -> str:
    return hashlib.sha256(json.dumps([asdict(r) for r in rules], sort_keys=True, default=str).encode()).hexdigest()[:16]


def _r(id, name, dimension, type, severity, column=None, columns=(), when=None, threshold=None, **args):
    return Rule(id, name, dimension, type, severity, column, tuple(columns), when, threshold, args)


#: The catalogue of rules, by dataset.
CATALOGUE: dict[str, list[Rule]] = {
    "customers_crm": [
        _r("Q-01", "email_present", "completeness", "not_null", "warn", "email", threshold=0.15),
        _r("Q-02", "phone_present", "completeness", "not_null", "info", "phone"),
        _r("Q-03", "names_present", "completeness", "not_blank", "reject", "first_name"),
        _r("Q-04", "crm_id_unique", "uniqueness", "unique", "reject", columns=["crm_customer_id"]),
        _r("Q-10", "email_syntax_valid", "validity", "email_syntax", "quarantine", "email_norm", when="email_norm IS NOT NULL"),
        _r("Q-11", "phone_normalisable", "validity", "phone_normalisable", "warn", "phone", when="phone IS NOT NULL"),
        _r("Q-15", "dob_plausible", "validity", "date_range", "quarantine", "date_of_birth_typed", min="1900-01-01", max_age_years=120),
        _r("Q-16", "account_status_enum", "validity", "in_set", "warn", "account_status_norm", values=("active", "inactive", "churned")),
        _r("Q-17", "created_before_updated", "consistency", "temporal_order", "quarantine", columns=["created_at_typed", "updated_at_typed"]),
        _r("Q-TYPE-created_at", "created_at_typed", "timeliness", "type_cast", "quarantine", "created_at"),
    ],
    "loyalty_members": [
        _r("Q-20", "mobile_present", "completeness", "not_blank", "reject", "mobile"),
        _r("Q-21", "loyalty_id_unique", "uniqueness", "unique", "reject", columns=["loyalty_id"]),
        _r("Q-22", "points_balance_range", "validity", "numeric_range", "quarantine", "points_balance_typed", min=0, max=1000000),
        _r("Q-23", "tier_enum", "validity", "in_set", "warn", "tier", values=("bronze", "silver", "gold", "platinum")),
        _r("Q-24", "phone_normalisable_loyalty", "validity", "phone_normalisable", "warn", "mobile"),
    ],
    "app_users": [
        _r("Q-30", "email_present_app", "completeness", "not_blank", "reject", "email"),
        _r("Q-31", "email_syntax_valid_app", "validity", "email_syntax", "quarantine", "email_norm", when="email_norm IS NOT NULL"),
        _r("Q-32", "app_user_id_unique", "uniqueness", "unique", "reject", columns=["app_user_id"]),
        _r("Q-33", "signup_before_last_login", "consistency", "temporal_order", "warn", columns=["signup_ts_typed", "last_login_ts_typed"], when="last_login_ts_typed IS NOT NULL"),
        _r("Q-34", "signup_ts_not_future", "timeliness", "timestamp_not_future", "quarantine", "signup_ts_typed", skew=300),
        _r("Q-35", "last_login_not_future", "timeliness", "timestamp_not_future", "warn", "last_login_ts_typed", skew=300),
    ],
    "products": [
        _r("Q-40", "sku_unique", "uniqueness", "unique", "warn", columns=["sku"]),
        _r("Q-41", "unit_price_positive", "validity", "numeric_range", "quarantine", "unit_price_typed", min=0.01, max=10000000),
        _r("Q-42", "currency_known", "validity", "in_set", "quarantine", "currency", values=("INR", "USD")),
        _r("Q-43", "category_name_consistent", "consistency", "set_consistency", "warn", columns=["category_id", "category_name"]),
    ],
    "orders": [
        _r("Q-50", "order_id_unique", "uniqueness", "duplicate_composite", "warn", columns=["order_id"]),
        _r("Q-51", "order_type_enum", "validity", "in_set", "reject", "order_type", values=("sale", "refund")),
        _r("Q-52", "gross_amount_non_negative", "validity", "numeric_range", "quarantine", "gross_amount_typed", when="order_type = 'sale'", min=0, max=100000000),
        _r("Q-53", "order_ts_not_future", "timeliness", "timestamp_not_future", "quarantine", "order_ts_typed", skew=300),
        _r("Q-54", "order_ts_not_epoch", "timeliness", "timestamp_range", "quarantine", "order_ts_typed", min="2000-01-01T00:00:00Z", max="2100-01-01T00:00:00Z"),
        _r("Q-55", "currency_known_orders", "validity", "in_set", "quarantine", "currency", values=("INR", "USD")),
    ],
    "order_items": [
        _r("Q-60", "line_key_unique", "uniqueness", "unique", "warn", columns=["order_id", "line_number"]),
        _r("Q-61", "quantity_positive", "validity", "numeric_range", "quarantine", "quantity_typed", min=1, max=10000),
        _r("Q-62", "order_id_resolves", "integrity", "referential", "quarantine", "order_id"),
    ],
    "support_tickets": [
        _r("Q-70", "requester_email_valid", "validity", "email_syntax", "quarantine", "requester_email_norm", when="requester_email_norm IS NOT NULL"),
        _r("Q-71", "satisfaction_score_range", "validity", "numeric_range", "quarantine", "satisfaction_score_typed", when="satisfaction_score_typed IS NOT NULL", min=1, max=5),
        _r("Q-72", "first_response_after_created", "consistency", "temporal_order", "warn", columns=["created_at_typed", "first_response_at_typed"], when="first_response_at_typed IS NOT NULL"),
        _r("Q-73", "ticket_id_unique", "uniqueness", "unique", "reject", columns=["ticket_id"]),
    ],
}
