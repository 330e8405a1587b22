"""Views of quality results, segments, runs and the assistant's tools."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as dq
from .retrieval import TOOLS
from .segments import Segment
from .serving import KEY, has_at_least

DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "integrity", "timeliness")


# Quality


def quarantined_page(records: DataFrame, dataset: str | None = None, status: str | None = None, customer=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The latest refused rows by quarantine_id, of one dataset, status or customer if given."""
    for c, v in (("dataset", dataset), ("dq_status", status), (KEY, customer)):
        if v is not None:
            records = records.where(F.col(c) == v)
    return records.orderBy(F.desc("quarantine_id")).offset(offset).limit(limit)


def dataset_result(df: DataFrame, rules: list[dq.Rule], dataset: str, run_id: int, ctx: dq.Context = dq.Context()) -> DataFrame:
    """One row: rows by status, the score of each dimension (null without applicable rows), the overall score and the rules' hash."""
    classified = dq.classify(df, rules, ctx)
    counts = classified.agg(
        F.count("*").alias("records_ingested"), F.count_if(F.col("dq_status") == "accepted").alias("records_accepted"), F.count_if(F.col("dq_status") == "accepted_with_warning").alias("records_warned"),
        F.count_if(F.col("dq_status") == "quarantined").alias("records_quarantined"), F.count_if(F.col("dq_status") == "rejected").alias("records_rejected"),
    )
    scores = dq.dimension_scores(dq.rule_results(df, rules, ctx))
    wide = scores.agg(*[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(f"score_{d}") for d in DIMENSIONS])
    whole = counts.crossJoin(wide).crossJoin(dq.overall_score(scores))  # one row each
    return whole.select(F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), "*", F.lit(dq.ruleset_hash(rules)).alias("ruleset_hash"))


def quality_overview(results: DataFrame) -> DataFrame:
    """Of the last run's datasets: how many, the plain mean of their scores, and refused rows."""
    last = results.agg(F.max("run_id").alias("run_id"))
    return results.join(F.broadcast(last), "run_id", "left_semi").agg(
        F.count("*").alias("datasets"), F.avg("score_overall").alias("score_mean"), F.sum("records_quarantined").alias("quarantined"), F.sum("records_rejected").alias("rejected")
    )


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, rows)`` of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# Segments


def segment_list(segments: DataFrame, members: DataFrame, stats: DataFrame) -> DataFrame:
    """Segments with their number of members (0 for none) and when they were last computed."""
    n = members.groupBy("segment_id").agg(F.count("*").alias("member_count"))
    last = stats.groupBy("segment_id").agg(F.max("computed_at").alias("last_computed_at"))
    out = segments.join(n, "segment_id", "left").join(last, "segment_id", "left")
    return out.withColumn("member_count", F.coalesce("member_count", F.lit(0))).orderBy("segment_id")


def segment_history(stats: DataFrame, segment: str, limit: int = 20) -> DataFrame:
    return stats.where(F.col("segment_id") == segment).orderBy(F.desc("computed_at")).limit(limit)


def members_by_entry(members: DataFrame, customers: DataFrame, segment: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Members of a segment with their names, the latest to enter first (ties: smaller id)."""
    kept = members.where(F.col("segment_id") == segment).select(KEY, "entered_on")
    page = kept.join(customers, KEY).orderBy(F.desc_nulls_last("entered_on"), KEY)
    return page.offset(offset).limit(limit)


def largest_segments(listed: DataFrame, n: int = 6) -> DataFrame:
    """The n segments of most members, and their share of the largest one's."""
    most = listed.agg(F.max("member_count").alias("__most"))
    out = listed.orderBy(F.desc("member_count"), "segment_id").limit(n).crossJoin(F.broadcast(most))
    return out.withColumn("share_of_largest", F.coalesce(F.try_divide("member_count", "__most"), F.lit(0.0))).drop("__most")


def segment_base(customers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Customers with metrics, with the fields of both that rules may name."""
    return customers.join(metrics, KEY)


def evolved(before: DataFrame, now: DataFrame, run_day: Column) -> DataFrame:
    """Members of this run with ``entered_on``: kept from before, or this run's day."""
    old = before.select("segment_id", KEY, F.col("entered_on").alias("__since"))
    return now.join(old, ["segment_id", KEY], "left").select("segment_id", KEY, F.coalesce("__since", run_day).alias("entered_on"))


# Names and fills


def proper_names(df: DataFrame, *columns: str) -> DataFrame:
    """Names with each word's first letter large and the others small."""
    return df.withColumns({c: F.initcap(c) for c in columns})


#: What every customer row is filled with.
CUSTOMER_FILLS = {"country_code": "IN", "account_status": "active", "identity_confidence": 0.95, "needs_review": False}


def customer_rows(golden: DataFrame, run_id: int) -> DataFrame:
    """Rows of the customers table from golden records: display name, fixed fills and the run."""
    text = F.trim(F.concat_ws(" ", F.trim(F.coalesce("first_name", F.lit(""))), F.trim(F.coalesce("last_name", F.lit("")))))
    fills = {c: F.lit(v) for c, v in CUSTOMER_FILLS.items()}
    return golden.withColumns({"full_name_display": F.when(text != "", text), **fills, "last_activity_at": F.lit(None).cast("timestamp"), "last_updated_run_id": F.lit(run_id)})


# The assistant


@dataclass(frozen=True)
class ToolResult:
    tool: str
    allowed: bool
    rows: DataFrame | None
    error: str | None = None


class Tools:
    """The named tools over tables, each behind the least role that may call it. No other name can be called."""

    def __init__(self, role: str, tables: dict[str, Callable[..., DataFrame]]):
        self.role, self.tables = role, tables

    def call(self, tool: str, *args) -> ToolResult:
        if tool not in TOOLS:
            return ToolResult(tool, False, None, "unknown tool")
        if not has_at_least(self.role, TOOLS[tool]):
            return ToolResult(tool, False, None, f"requires {TOOLS[tool]} role or higher")
        return ToolResult(tool, True, self.tables[tool](*args))


def allowed_tools(tools: Column, role: Column) -> Column:
    """Of each row's tools those that its role may call."""
    may = {least: [r for r in ("viewer", "analyst", "data_engineer", "admin") if has_at_least(r, least)] for least in set(TOOLS.values())}
    named = {least: [t for t, x in TOOLS.items() if x == least] for least in may}
    kept = None
    for least in sorted(may):
        part = F.when(role.isin(may[least]), F.array(*map(F.lit, named[least]))).otherwise(F.expr("cast(array() as array<string>)"))
        kept = part if kept is None else F.concat(kept, part)
    return F.filter(tools, lambda t: F.array_contains(kept, t))


def audit_rows(calls: DataFrame, provider: str, model: str | None, configured: bool) -> DataFrame:
    """A row a question for the audit log, lists as JSON, from ``(actor_email, customer_id, question, tools_called, sources, request_id)``."""
    return calls.select(
        "actor_email", "customer_id", "question", F.to_json("tools_called").alias("tools_called"), F.to_json("sources").alias("sources"), F.lit(provider).alias("provider"),
        F.lit(model).cast("string").alias("model"), F.lit(configured).alias("configured"), "request_id",
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    """A line ``name: value`` for each value that is not null or blank."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in pairs])


def rules_table(spark: SparkSession, rules: dict[str, list[dq.Rule]]) -> DataFrame:
    """The rules of every dataset as rows."""
    rows = [(d, r.id, r.name, r.dimension, r.type, r.column, ", ".join(r.columns), r.applies_when, r.severity, r.threshold) for d, listed in rules.items() for r in listed]
    return spark.createDataFrame(rows, "dataset string, rule_id string, rule_name string, dimension string, type string, column string, columns string, applies_when string, severity string, threshold double")


def rule_chunks(rules: DataFrame, results: DataFrame, source: str) -> DataFrame:
    """``(source, section, content, kind, name)``: one chunk a quality rule of ``rules_table``, with the figures that its last run in ``results(rule_id, applicable, failed)`` has."""
    c = F.col
    # fixed values: the names and the order of the lines
    about = _lines(*[(n, c(n)) for n in ("dimension", "type", "column", "columns", "applies_when", "severity")], ("threshold_dataset_fail_rate", c("threshold")))
    run = F.concat(F.lit("\nLast run: "), c("failed").cast("string"), F.lit(" of "), c("applicable").cast("string"), F.lit(" rows failed"))
    head = F.concat(F.lit("Dataset: "), c("dataset"), F.lit("\nRule "), c("rule_id"), F.lit(": "), c("rule_name"), F.lit("\n"))
    section = F.concat(F.lit("DQ rule "), c("rule_id"), F.lit(" ("), c("dataset"), F.lit(")"))
    rows = rules.join(results.select("rule_id", "applicable", "failed"), "rule_id", "left")
    return rows.select(F.lit(source).alias("source"), section.alias("section"), F.concat(head, about, F.coalesce(run, F.lit(""))).alias("content"), F.lit("dq_rule").alias("kind"), c("rule_id").alias("name"))


def segment_chunks(segments: list[Segment], members: DataFrame, source: str) -> DataFrame:
    """``(source, section, content, kind, name)``: one chunk a segment, with the number of its ``members(segment_id)``."""
    rows = [(s.id, s.name, s.description, s.null_handling, json.dumps(s.rule), json.dumps(s.thresholds)) for s in segments]
    listed = members.sparkSession.createDataFrame(rows, "segment_id string, title string, description string, handling string, rule string, thresholds string")
    n = members.groupBy("segment_id").agg(F.count("*").alias("n"))
    c = F.col
    # fixed values: the names and the order of the lines
    content = F.concat(F.lit("Segment "), c("segment_id"), F.lit(": "), c("title"), F.lit("\n"), _lines(
        ("Description", c("description")), ("Null handling", c("handling")), ("Rule definition (JSON AST)", c("rule")), ("Thresholds", c("thresholds")), ("Members", F.coalesce("n", F.lit(0))),
    ))
    section = F.concat(F.lit("Segment "), c("segment_id"), F.lit(" ("), c("title"), F.lit(")"))
    return listed.join(n, "segment_id", "left").select(F.lit(source).alias("source"), section.alias("section"), content.alias("content"), F.lit("segment_definition").alias("kind"), c("segment_id").alias("name"))
