"""Queries of identity screens and guards, quality views, segments, runs and the assistant's tools, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import clean
from .operators import bitmaps, identity, metrics, retrieval, segments, serving, views
from .operators import quality_rules as dq
from .plans.durable import durable
from .queries import CUSTOMER_DQ, CUSTOMER_RULES, EDGES, EMBEDDED, EVENTS_AS_OF, MEMBERS, METRICS, RULE_SQL, _customers, _edges, _memberships, as_of, metric_table, order_facts, query
from .sources import contracts
from .sources.readers import table

KEY = metrics.CUSTOMER


# Identity


def _planted(spark, d):
    """Identifiers of customers, some of which name nobody."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    mail = F.when(k % 7 == 0, "test@test.com").when(k % 7 == 1, F.concat(F.lit("Sales@n"), F.col("c_nationkey"), F.lit(".com"))).otherwise(F.concat(F.lit("c"), k, F.lit("@example.com")))
    phone = F.when(k % 5 == 0, "+917777777777").when(k % 5 == 1, "9999999999").otherwise(F.concat(F.lit("+9170000"), F.lpad(k.cast("string"), 6, "0")))
    return identity.identifiers(c, "cust", "c_custkey", {"email": mail, "phone": phone})


PLANTED = """p as (
    select cast(c_custkey as varchar) r, 'email' ns, case when c_custkey % 7 = 0 then 'test@test.com' when c_custkey % 7 = 1 then concat('Sales@n', c_nationkey, '.com') else concat('c', c_custkey, '@example.com') end v from customer union all
    select cast(c_custkey as varchar), 'phone', case when c_custkey % 5 = 0 then '+917777777777' when c_custkey % 5 = 1 then '9999999999' else concat('+9170000', lpad(cast(c_custkey as varchar), 6, '0')) end from customer
), s as (
    select *, case when v in ('test@test.com', '9999999999') then 'S1_static_denylist' when v like 'Sales@%' then 'S2_generic_email'
        when regexp_matches(regexp_replace(v, '[^0-9]', '', 'g'), '^(0{7,}|1{7,}|2{7,}|3{7,}|4{7,}|5{7,}|6{7,}|7{7,}|8{7,}|9{7,})$') then 'S5_implausible_value' end reason from p
)"""


@query(f"with {PLANTED} select r as source_record_id, ns as identity_namespace, v as identity_value_norm, reason as screen_reason from s where reason is not null")
def static_screens(spark, d):
    return identity.screen(_planted(spark, d)).where("is_screened").select("source_record_id", "identity_namespace", "identity_value_norm", "screen_reason")


@query(f"with {PLANTED} select ns as identity_namespace, reason as screen_reason, count(*) as records, count(distinct v) as \"values\" from s where reason is not null group by 1, 2")
def screened_log(spark, d):
    log = identity.screened_log(identity.screen(_planted(spark, d)))
    return log.groupBy("identity_namespace", "screen_reason").agg(F.sum("records").alias("records"), F.count("*").alias("values"))


@query("""with m as (select c_custkey k, concat('C', lpad(cast(c_custkey // 3 as varchar), 6, '0')) v from customer)
    select concat('cust:', a.k) as record_a, concat('cust:', b.k) as record_b, 'R-01' as rule_id, 1.0 as confidence from m a join m b on a.v = b.v and concat('cust:', a.k) < concat('cust:', b.k)""")
def authoritative_edges(spark, d):
    own = F.concat(F.lit("c"), F.lpad(F.floor(F.col("c_custkey") / 3).cast("string"), 6, "0"))
    ids = identity.identifiers(table(spark, d, "customer"), "cust", "c_custkey", {"crm_id": clean.authoritative_id(own)})
    return identity.match(identity.screen(ids)).select("record_a", "record_b", "rule_id", "confidence")


@query("select concat('cust:', c_custkey) as source_record_key, concat('cust:', min(cast(c_custkey as varchar)) over (partition by c_nationkey)) as cluster_key from customer")
def frequent_value_clusters(spark, d):
    """Values of many records of one source: joined by stars, not by all pairs."""
    ids = identity.identifiers(table(spark, d, "customer"), "cust", "c_custkey", {"email": F.concat(F.lit("n"), F.col("c_nationkey"), F.lit("@example.com"))})
    return identity.clusters(identity.record_keys(ids), identity.match(identity.screen(ids), most=2))


SURE = f"""{EDGES},
walk as (select rec as a, rec as b from scr union select walk.a, case when e.record_a = walk.b then e.record_b else e.record_a end from walk join (select * from edge where confidence >= 0.9) e on e.record_a = walk.b or e.record_b = walk.b),
final as (select a as source_record_key, min(b) as cluster_key from walk group by a)"""


@query(f"with recursive {SURE} select * from final")
def low_confidence_clusters(spark, d):
    """Clusters without the edges below a merge confidence of 0.9."""
    ids, edges = _edges(spark, d)
    edges = durable(edges)
    found = durable(identity.clusters(identity.record_keys(ids), edges))
    return identity.guard(found, edges, identity.Settings(merge_confidence=0.9, max_cluster_size=10**9))[0]


@query("""select c_custkey as customer, case c_custkey % 4 when 0 then concat('P', c_custkey) when 1 then concat('N', c_custkey) end as resolved_id,
    case c_custkey % 4 when 0 then 'found' when 1 then 'merged' when 2 then 'split' else 'unknown' end as outcome from customer""")
def crosswalk_lookup(spark, d):
    k = F.col("c_custkey")
    old = F.concat(F.lit("P"), k)
    c = table(spark, d, "customer")
    walk = c.where("c_custkey % 4 < 3").select(
        old.alias("prior_canonical_customer_id"), F.when(k % 4 == 0, old).otherwise(F.concat(F.lit("N"), k)).alias("canonical_customer_id"),
        F.when(k % 4 == 0, "current").when(k % 4 == 1, "merged").otherwise("split").alias("status"),
    )
    return identity.resolve(c.select(k.alias("customer"), old.alias("customer_id")), walk).select("customer", "resolved_id", "outcome")


@query("select l_orderkey as order_id, cast(max(l_shipdate) as varchar) as updated_at from lineitem group by 1")
def latest_orders(spark, d):
    versions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("updated_at_typed"), "l_linenumber")
    at = F.date_format("updated_at_typed", "yyyy-MM-dd HH:mm:ss") if versions.schema["updated_at_typed"].dataType.typeName() == "timestamp" else F.col("updated_at_typed").cast("string")
    return identity.latest_orders(versions).select("order_id", at.alias("updated_at"))


# Typing


@query("""select c_custkey as customer, case c_custkey % 4 when 0 then null when 1 then date '2024-01-02' when 2 then date '2024-02-01' end as day,
    case c_custkey % 3 when 0 then true when 1 then false end as flag, case when c_custkey % 5 > 0 then c_acctbal end as amount, lower(trim(concat(' Req', c_custkey, '@X.com'))) as requester, concat('rcp', c_custkey, '@x.com.') as recipient from customer""")
def typed_values(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        k.alias("customer"), F.when(k % 4 == 0, "N/A").when(k % 4 == 1, " 2024-01-02").when(k % 4 == 2, "01/02/2024").otherwise("soon").alias("day"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0").otherwise("?").alias("flag"), F.when(k % 5 > 0, F.concat(F.lit("₹ "), F.col("c_acctbal"))).otherwise("null").alias("amount"),
        F.concat(F.lit(" Req"), k, F.lit("@X.com. ")).alias("requester"), F.concat(F.lit(" Rcp"), k, F.lit("@x.com.")).alias("recipient"),
    )
    kinds = {"day": "date", "flag": "boolean", "amount": "decimal"}
    fields = {n: contracts.Field(n, kind, true_words=("yes", "1"), false_words=("no", "0")) for n, kind in kinds.items()}
    made = {n: contracts.typed_column(f, F.col(n)) for n, f in fields.items()}
    return raw.withColumns(made).withColumns({"amount": F.col("amount").cast("double"), "requester": clean.requester_email(F.col("requester")), "recipient": clean.recipient_email(F.col("recipient"))})


@query("select c_custkey as customer, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as first_name, split_part(lower(c_name), '#', 2) as last_token from customer")
def proper_names(spark, d):
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.lower("c_mktsegment").alias("first_name"), clean.last_token(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("last_token"))
    return views.proper_names(named, "first_name")


@query("select c_custkey as customer, trim(concat_ws(' ', trim(c_mktsegment), trim(c_name))) as full_name_display, 'IN' as country_code, 'active' as account_status, 0.95 as identity_confidence, false as needs_review, 4 as last_updated_run_id from customer")
def customer_rows(spark, d):
    golden = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"))
    return views.customer_rows(golden, 4).drop("first_name", "last_name", "last_activity_at")


# Quality


@query(f"with {CUSTOMER_DQ} select c_custkey as quarantine_id, concat_ws(',', case when b1 then 'C-1' end, case when b2 then 'C-2' end, case when b3 then 'C-3' end, case when b4 then 'C-4' end, case when b5 then 'C-5' end) as failed_rules from f where (b2 and not (b1 or b4)) order by c_custkey desc limit 50 offset 10")
def quarantined_page(spark, d):
    refused = dq.quarantined_payloads(dq.classify(table(spark, d, "customer"), CUSTOMER_RULES), "c_custkey").withColumnRenamed("record_key", "quarantine_id").withColumn("dataset", F.lit("customer"))
    return views.quarantined_page(refused, "customer", "quarantined", limit=50, offset=10).select("quarantine_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@query(f"""with {CUSTOMER_DQ} select 3 as run_id, 'customer' as dataset, count(*) as records_ingested, count(*) filter (not (b1 or b2 or b3 or b4 or b5)) as records_accepted, count(*) filter ((b3 or b5) and not (b1 or b2 or b4)) as records_warned,
    count(*) filter (b2 and not (b1 or b4)) as records_quarantined, count(*) filter (b1 or b4) as records_rejected from f""")
def dq_dataset_result(spark, d):
    out = views.dataset_result(table(spark, d, "customer"), CUSTOMER_RULES, "customer", 3)
    return out.select("run_id", "dataset", *[f"records_{c}" for c in ("ingested", "accepted", "warned", "quarantined", "rejected")])


SCORES_SQL = """scores as (select cast(year(o_orderdate) as int) run_id, o_orderpriority dataset, avg(o_totalprice) / 5000 score_overall, count(*) filter (o_orderstatus = 'P') records_quarantined, count(*) filter (o_orderstatus = 'F') records_rejected from orders group by 1, 2)"""


def _scores(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("run_id"), F.col("o_orderpriority").alias("dataset")).agg(
        (F.avg("o_totalprice") / 5000).alias("score_overall"), F.count_if(F.col("o_orderstatus") == "P").alias("records_quarantined"), F.count_if(F.col("o_orderstatus") == "F").alias("records_rejected")
    )


@query(f"with {SCORES_SQL} select count(*) as datasets, round(avg(score_overall), 4) as score_mean, sum(records_quarantined)::bigint as quarantined, sum(records_rejected)::bigint as rejected from scores where run_id = (select max(run_id) from scores)")
def dq_overview(spark, d):
    return views.quality_overview(_scores(spark, d)).withColumn("score_mean", F.round("score_mean", 4))


@query(f"with {SCORES_SQL} select run_id, round(score_overall, 4) as score_overall from scores where dataset = '1-URGENT' order by run_id desc limit 20")
def score_trend(spark, d):
    return serving.score_trend(_scores(spark, d), "1-URGENT").withColumn("score_overall", F.round("score_overall", 4))


@query(f"with {SCORES_SQL} select dataset, round(score_overall, 4) as score_overall from scores where run_id = (select max(run_id) from scores)")
def latest_dataset_scores(spark, d):
    return serving.dataset_scores(_scores(spark, d)).select("dataset", F.round("score_overall", 4).alias("score_overall"))


@query(f"with {METRICS}, {SCORES_SQL}, l as (select run_id, avg(score_overall) s from scores group by 1 order by 1 desc limit 1) select round(l.s, 4) as dq_score, l.run_id as last_run_id, (select count(*) from metrics where band = 'active') as active_customers from l")
def summary_with_quality(spark, d):
    out = serving.summary(_customers(spark, d), metric_table(spark, d), order_facts(spark, d), _scores(spark, d))
    return out.select(F.round("dq_score", 4).alias("dq_score"), "last_run_id", "active_customers")


@query("select 'customers' as name, count(*) as rows from customer union all select 'orders', count(*) from orders")
def health(spark, d):
    return views.health({"customers": table(spark, d, "customer"), "orders": table(spark, d, "orders")})


# Runs


RUNS_SQL = """runs as (select cast(year(o_orderdate) * 100 + month(o_orderdate) as int) run_id, case when count(*) % 2 = 0 then 'succeeded' else 'failed' end status, count(*) as n from orders group by 1)"""


def _runs(spark, d):
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("run_id")
    return table(spark, d, "orders").groupBy(month).agg(F.when(F.count("*") % 2 == 0, "succeeded").otherwise("failed").alias("status"), F.count("*").alias("n"))


@query(f"with {RUNS_SQL} select run_id, status from runs order by run_id desc limit 20 offset 3")
def runs_page(spark, d):
    return serving.runs(_runs(spark, d), 20, 3).select("run_id", "status")


@query(f"with {RUNS_SQL} select run_id, n from runs where status = 'succeeded' order by run_id desc limit 1")
def latest_run(spark, d):
    return serving.latest_run(_runs(spark, d)).select("run_id", "n")


@query("select cast(l_linenumber as int) as stage_order, count(*) as rows from lineitem join orders on o_orderkey = l_orderkey where cast(year(o_orderdate) as int) = 1997 group by 1")
def stages_of_run(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stages = lines.groupBy(F.year("o_orderdate").alias("run_id"), F.col("l_linenumber").cast("int").alias("stage_order")).agg(F.count("*").alias("rows"))
    return serving.run_stages(stages, 1997).select("stage_order", "rows")


# Segments


HELD = """held as (select o_orderpriority segment_id, o_custkey cid, min(cast(o_orderdate as date)) entered_on from orders group by 1, 2)"""


def _held(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("segment_id"), F.col("o_custkey").alias(KEY)).agg(F.min(F.to_date("o_orderdate")).alias("entered_on"))


def _stats(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("segment_id"), F.date_trunc("month", "o_orderdate").cast("date").alias("computed_at")).agg(F.count_distinct("o_custkey").alias("member_count"))


@query(f"with {HELD} select strftime(entered_on, '%Y-%m-%d') as entered_on, cid as customer, trim(c_name) as full_name_display from held join customer on c_custkey = cid where segment_id = '2-HIGH' order by held.entered_on desc, cid limit 50 offset 5")
def segment_member_page(spark, d):
    out = views.members_by_entry(_held(spark, d), _customers(spark, d), "2-HIGH", 50, 5)
    return out.select(F.col("entered_on").cast("string").alias("entered_on"), F.col(KEY).alias("customer"), "full_name_display")


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as computed_at, count(distinct o_custkey) as member_count from orders where o_orderpriority = '1-URGENT' group by 1 order by 1 desc limit 20")
def segment_history(spark, d):
    return views.segment_history(_stats(spark, d), "1-URGENT").select(F.col("computed_at").cast("string").alias("computed_at"), "member_count")


LISTED = f"""with {HELD}, seg(segment_id) as (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE'), ('7-NONE')),
    listed as (select segment_id, (select count(*) from held h where h.segment_id = seg.segment_id) member_count, (select strftime(max(date_trunc('month', o_orderdate)), '%Y-%m-%d') from orders where o_orderpriority = segment_id) last_computed_at from seg)"""


def _listed(spark, d):
    every = spark.createDataFrame([(s,) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE", "7-NONE")], "segment_id string")
    return views.segment_list(every, _held(spark, d), _stats(spark, d)).withColumn("last_computed_at", F.col("last_computed_at").cast("string"))


@query(f"{LISTED} select * from listed")
def segment_list(spark, d):
    return _listed(spark, d)


@query(f"{LISTED} select segment_id, member_count, round(member_count / (select max(member_count) from listed), 6) as share_of_largest from listed order by member_count desc, segment_id limit 6")
def largest_segments(spark, d):
    return views.largest_segments(_listed(spark, d)).select("segment_id", "member_count", F.round("share_of_largest", 6).alias("share_of_largest"))


@query(f"with {HELD} select h.segment_id, h.cid as customer, case when h.entered_on < date '1997-01-01' then strftime(h.entered_on, '%Y-%m-%d') else '2001-08-02' end as entered_on from held h")
def segment_entries(spark, d):
    now = _held(spark, d)
    out = views.evolved(now.where("entered_on < date'1997-01-01'"), now.select("segment_id", KEY), as_of())
    return out.select("segment_id", F.col(KEY).alias("customer"), F.col("entered_on").cast("string").alias("entered_on"))


@query(f"""with {METRICS}, b as (select m.*, case when c_nationkey = 1 then 'IN' when c_nationkey > 3 then concat('N', c_nationkey) end country from metrics m join customer on c_custkey = cid)
    select 'X-1' as segment_id, cid as customer from b where country in ('IN', 'N7') or order_count > 12 union all
    select 'X-2', cid from b where not (country = 'N4') union all select 'X-3', cid from b where country is null and days_last > 100 union all
    select 'X-4', cid from b where country <> 'N5' or country is null union all select 'X-5', cid from b where country not in ('IN', 'N4', 'N5')""")
def country_segments(spark, d):
    """Rules with OR, NOT, IN, NOT IN, IS NULL and included nulls over customers and their metrics."""
    nation = F.col("c_nationkey")
    who = table(spark, d, "customer").select(F.col("c_custkey").alias(KEY), F.when(nation == 1, "IN").when(nation > 3, F.concat(F.lit("N"), nation)).alias("country_code"))
    leaf = lambda op, name, value=None: {"op": op, "field": name, "value": value}
    made = [
        segments.Segment("X-1", "", {"op": "OR", "children": [leaf("IN", "country_code", ["IN", "N7"]), leaf(">", "order_count", 12)]}),
        segments.Segment("X-2", "", {"op": "NOT", "child": leaf("=", "country_code", "N4")}),
        segments.Segment("X-3", "", {"op": "AND", "children": [leaf("IS NULL", "country_code"), leaf(">", "days_since_last_order", 100)]}),
        segments.Segment("X-4", "", leaf("!=", "country_code", "N5"), {}, "include"),
        segments.Segment("X-5", "", leaf("NOT IN", "country_code", {"param": "out"}), {"out": ["IN", "N4", "N5"]}),
    ]
    return segments.members(views.segment_base(who, metric_table(spark, d)), made).select("segment_id", F.col(KEY).alias("customer"))


# The assistant


ROLE = "case turn % 3 when 0 then 'viewer' when 1 then 'analyst' else 'guest' end"
CALLED = f"""t as (select conv_id, turn, lower(text) q, {ROLE} as role from conversations), c as (select *, case when role = 'guest' then '' else 'get_customer_profile' end as tools from t)"""


def _called(spark, d):
    turns = table(spark, d, "conversations").withColumn("role", F.expr(ROLE))
    sure = F.array(F.lit("get_customer_profile"), F.lit("get_customer_identities"), F.lit("drop_tables"))
    return turns.withColumn("tools_called", views.allowed_tools(sure, F.col("role")))


@query(f"with {CALLED} select conv_id, turn, case role when 'viewer' then 'get_customer_profile' when 'analyst' then 'get_customer_profile,get_customer_identities' else '' end as tools from c")
def allowed_tools(spark, d):
    """Two known tools and an unknown one asked for in every turn: what each turn's role may call."""
    return _called(spark, d).select("conv_id", "turn", F.array_join("tools_called", ",").alias("tools"))


@query(f"""with {CALLED} select concat(conv_id, ':', turn) as request_id, case role when 'viewer' then '["get_customer_profile"]' when 'analyst' then '["get_customer_profile","get_customer_identities"]' else '[]' end as tools_called,
    concat('[{{"source":"docs","section":"', role, '"}}]') as sources, 'local' as provider, false as configured from c""")
def assistant_audit(spark, d):
    named = _called(spark, d).withColumns({
        "actor_email": F.lit("a@example.com"), "customer_id": F.lit(None).cast("string"), "question": F.col("text"), "request_id": F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        "sources": F.array(F.struct(F.lit("docs").alias("source"), F.col("role").alias("section"))),
    })
    return views.audit_rows(named, "local", None, False).select("request_id", "tools_called", "sources", "provider", "configured")


@query(f"""with {MEMBERS}, titles as (select * from (values ('S-01', 'High Value'), ('S-02', 'New Customer'), ('S-03', 'Active Customer'), ('S-04', 'At Risk'), ('S-05', 'Churned'), ('S-06', 'Cart Abandoner'), ('S-07', 'Highly Engaged'), ('S-08', 'Repeat Buyer')) v(id, title))
    select concat('Segment ', id, ' (', title, ')') as section, id as name, concat('Members: ', (select count(*) from seg where segment_id = id)) as last_line from titles""")
def segment_chunks(spark, d):
    found = views.segment_chunks(segments.BASELINE, _memberships(spark, d), "segments")
    return found.select("section", "name", F.substring_index("content", "\n", -1).alias("last_line"))


@query(f"""with {CUSTOMER_DQ}, {RULE_SQL}, said as (select * from (values
        ('C-1', 'name_present', 'type: not_blank' || chr(10) || 'column: c_name'), ('C-2', 'balance_not_negative', 'type: numeric_range' || chr(10) || 'column: c_acctbal'),
        ('C-3', 'segment_known', 'type: in_set' || chr(10) || 'column: c_mktsegment'), ('C-4', 'key_unique', 'type: unique' || chr(10) || 'columns: c_custkey'),
        ('C-5', 'nation_has_one_segment', 'type: set_consistency' || chr(10) || 'columns: c_acctbal, c_mktsegment' || chr(10) || 'applies_when: c_nationkey < 5')) v(id, title, about))
    select concat('DQ rule ', id, ' (customer)') as section,
        concat('Dataset: customer', chr(10), 'Rule ', id, ': ', title, chr(10), 'dimension: ', dimension, chr(10), about, chr(10), 'severity: ', severity, chr(10), 'Last run: ', failed, ' of ', applicable, ' rows failed') as content
    from said join rules on id = rule_id""")
def rule_chunks(spark, d):
    """The rules over customers, each with what its run over the table found."""
    results = dq.rule_results(table(spark, d, "customer"), CUSTOMER_RULES)
    return views.rule_chunks(views.rules_table(spark, {"customer": CUSTOMER_RULES}), results, "rules").select("section", "content")


@query("""select event_id, case event_id % 7 when 0 then 'get_customer_profile,get_customer_segments' when 1 then 'get_customer_profile,get_customer_identities' when 2 then 'get_customer_profile,get_customer_quality'
    when 3 then 'get_customer_profile,get_customer_timeline' when 4 then 'get_customer_profile,get_customer_metrics' when 5 then 'get_customer_profile' else '' end as tools from events""")
def routed_questions(spark, d):
    """A question about each event; each seventh is about something else, and has no customer."""
    asked = F.array(*map(F.lit, ["Which SEGMENT is", "Is it the same customer, with", "Any data issue with", "What changed for", "How much churn has", "Who is", "Is it a segment:"]))
    kind = (F.col("event_id") % 7).cast("int")
    question = F.concat_ws(" ", F.get(asked, kind), F.col("event_type"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.array_join(retrieval.routed(question, kind < 6), ",").alias("tools"))


# Memberships and figures by day


@query("""with m as (select distinct event_type, cast(ts as date) as day, user_id from events where user_id is not null), d as (select event_type, day from m union select event_type, day + 1 from m)
    select d.event_type, cast(d.day as date) as day, (select count(*) from m where m.event_type = d.event_type and m.day = d.day) as members,
        (select count(*) from m where m.event_type = d.event_type and m.day = d.day and user_id not in (select user_id from m x where x.event_type = d.event_type and x.day = d.day - 1)) as entered,
        (select count(*) from m where m.event_type = d.event_type and m.day = d.day - 1 and user_id not in (select user_id from m x where x.event_type = d.event_type and x.day = d.day)) as exited
    from d""")
def daily_memberships(spark, d):
    """Who has each kind of event on each day, who is new to it since the day before and who is gone."""
    events = table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    rows = events.join(bitmaps.numbered(events, "user_id"), "user_id")
    return bitmaps.daily_changes(bitmaps.membership(rows, ["event_type", "day"]), ["event_type"])


@query(f"""select event_type, days, count(*) as events from (select event_type, date_diff('day', cast(ts as date), date '{EVENTS_AS_OF}') g from events), (values (7), (14), (30)) w(days) where g >= 0 and g < days group by 1, 2""")
def merged_event_windows(spark, d):
    """Events of several windows from the partials of days, which also estimate visitors and medians."""
    partials = bitmaps.daily_partials(table(spark, d, "events"), ["event_type"], "ts", "user_id", "value")
    return bitmaps.windows(durable(partials), ["event_type"], as_of(EVENTS_AS_OF), (7, 14, 30)).select("event_type", "days", "events")


@query(f"with {EMBEDDED}, n as (select item_id, idx, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) as value from e where v <> 0) select item_id, count(*) as dimensions, round(sum(value * (idx + 1)), 3) as weighted from n group by 1")
def dense_embedding(spark, d):
    """The dense form: numbers other than 0, and their sum weighted by place."""
    dense = retrieval.embed(table(spark, d, "benchmark"), "item_id", "text")
    placed = dense.select("item_id", F.posexplode("embedding").alias("i", "x")).where("x <> 0")
    return placed.groupBy("item_id").agg(F.count("*").alias("dimensions"), F.round(F.sum(F.round("x", 6) * (F.col("i") + 1)), 3).alias("weighted"))
