"""Queries that read source files: the test tables are written as the sources' CSV and JSON, read back by their contracts, typed, cleaned and conformed, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import identity
from .operators import quality_rules as dq
from .plans.durable import shared_folder
from .queries import query
from .sources import config, contracts
from .sources.readers import read_raw, table


def _read_back(spark: SparkSession, rows: DataFrame, contract: contracts.Contract) -> DataFrame:
    """``rows`` written in the contract's layout with its options, and read by it."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if contract.layout == "csv":
        rows.write.options(header=True, **contract.options).csv(path)
    elif contract.layout == "dated_json":
        rows.write.partitionBy("dt").json(path, compression="gzip")
    else:
        rows.write.json(path)
    return contracts.cleaned(contracts.typed(read_raw(spark, path, contract, run_id=3), contract))


def _as(contract: contracts.Contract, df: DataFrame, **columns: Column) -> DataFrame:
    """The contract's columns in its order, null where not given."""
    return df.select(*[columns.get(f.name, F.lit(None).cast("string")).cast("string").alias(f.name) for f in contract.fields])


def _crm(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    odd = F.col("c_custkey") % 10 == 0
    return _read_back(spark, _as(
        contracts.CRM, c, crm_customer_id=F.concat(F.lit(" c"), "c_custkey"), first_name=F.concat(F.lit(" "), "c_mktsegment"), last_name=F.lower("c_name"),
        email=F.when(odd, "N/A").otherwise(F.concat(F.upper("c_name"), F.lit("@Shop.IN "))), phone=F.format_string("0%010d", F.col("c_custkey") + 9000000000),
        country=F.when(odd, "india").otherwise("USA"), account_status=F.lit("Active"), created_at=F.lit("2024-02-03T04:05:06Z"),
    ), contracts.CRM)


def _loyalty(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return _read_back(spark, _as(
        contracts.LOYALTY_MEMBERS, s, loyalty_id=F.concat(F.lit("l"), "s_suppkey"), member_name=F.concat(F.lit("Ann; B "), "s_name"), mobile=F.format_string("91 %010d", F.col("s_suppkey") + 9000000000),
        points_balance=F.when(F.col("s_suppkey") % 7 == 0, "many").otherwise(F.col("s_suppkey").cast("string")), country_code=F.lit("IN"), last_updated=F.lit("05/06/2024 07:08"),
    ), contracts.LOYALTY_MEMBERS)


def _app(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").where("c_nationkey < 8")
    return _read_back(spark, _as(
        contracts.APP_USERS, rows, app_user_id=F.concat(F.lit("u"), "c_custkey"), email=F.concat("c_name", F.lit("@shop.in")), display_name=F.col("c_name"),
        phone_verified=F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("n"), marketing_opt_in=F.lit("yes"),
    ).drop("device_cookies"), contracts.APP_USERS)


@query("""select upper(concat('c', c_custkey)) as id, lower(c_mktsegment) as first_name, lower(c_name) as last_name, case when c_custkey % 10 <> 0 then lower(c_name) || '@shop.in' else 'n/a' end as email,
    concat('+91', cast(c_custkey + 9000000000 as varchar)) as phone, case when c_custkey % 10 = 0 then 'IN' else 'US' end as country, 'active' as status, timestamp '2024-02-03 04:05:06' as created_at, 3 as run_id from customer""")
def crm_from_csv(spark, d):
    """Customers as a CSV source, read, typed and cleaned."""
    out = _crm(spark, d).where("_source_row_num > 0 and _source_file is not null and _ingested_at is not null")
    return out.select(
        F.upper(F.trim("crm_customer_id")).alias("id"), F.col("first_name_norm").alias("first_name"), F.col("last_name_norm").alias("last_name"), F.col("email_norm").alias("email"),
        F.col("phone_norm").alias("phone"), F.col("country_norm").alias("country"), F.col("account_status_norm").alias("status"), F.col("created_at_typed").cast("timestamp_ntz").alias("created_at"), F.col("_run_id").alias("run_id"),
    )


@query("""select s_suppkey as id, 'ann;' as first_name, lower(s_name) as last_name, concat('+91', cast(s_suppkey + 9000000000 as varchar)) as phone,
    case when s_suppkey % 7 <> 0 then cast(s_suppkey as int) end as points, timestamp '2024-06-05 07:08:00' as last_updated from supplier""")
def loyalty_from_csv(spark, d):
    """Suppliers as a CSV source with semicolons between its columns and in its values."""
    return _loyalty(spark, d).select(
        F.substring("loyalty_id", 2, 20).cast("long").alias("id"), F.col("first_name_norm").alias("first_name"), F.col("last_name_norm").alias("last_name"), F.col("phone_norm").alias("phone"),
        F.col("points_balance_typed").alias("points"), F.col("last_updated_typed").cast("timestamp_ntz").alias("last_updated"),
    )


@query("""select cast(event_id as varchar) as event_id, event_type, cast(ts as date) as dt, date_trunc('second', ts) as event_ts, case when value is not null then cast(round(cast(value as decimal(18, 6)), 2) as double) end as cart_value from events""")
def events_from_dated_json(spark, d):
    """Events as gzipped JSON in folders of days; the day is a column again."""
    e = table(spark, d, "events")
    rows = _as(
        contracts.WEB_EVENTS, e, event_id=F.col("event_id"), event_type=F.col("event_type"), event_ts=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        cart_value=F.round(F.col("value").cast("decimal(18,6)"), 2).cast("string"), device_cookie=F.col("user_id"),
    ).withColumn("dt", F.left("event_ts", F.lit(10)))
    out = _read_back(spark, rows, contracts.WEB_EVENTS)
    return out.select("event_id", "event_type", "dt", F.col("event_ts_typed").cast("timestamp_ntz").alias("event_ts"), F.col("cart_value_typed").cast("double").alias("cart_value"))


@query("""with p as (
    select 'crm' s, upper(concat('c', c_custkey)) r, 'crm_id' ns, upper(concat('c', c_custkey)) v from customer union all
    select 'crm', upper(concat('c', c_custkey)), 'email', case when c_custkey % 10 <> 0 then lower(c_name) || '@shop.in' else 'n/a' end from customer union all
    select 'crm', upper(concat('c', c_custkey)), 'phone', concat('+91', cast(c_custkey + 9000000000 as varchar)) from customer union all
    select 'loyalty', concat('l', s_suppkey), 'loyalty_id', concat('L', s_suppkey) from supplier union all
    select 'loyalty', concat('l', s_suppkey), 'phone', concat('+91', cast(s_suppkey + 9000000000 as varchar)) from supplier union all
    select 'app', concat('u', c_custkey), 'app_user_id', concat('U', c_custkey) from customer where c_nationkey < 8 union all
    select 'app', concat('u', c_custkey), 'email', lower(c_name) || '@shop.in' from customer where c_nationkey < 8
) select s as source_system, r as source_record_id, ns as identity_namespace, v as identity_value_norm from p""")
def person_identifier_rows(spark, d):
    """Ids, e-mails and phones of the three person sources, from their files."""
    crm = _crm(spark, d).withColumn("crm_customer_id", F.upper(F.trim("crm_customer_id")))
    app = _app(spark, d).withColumn("phone_norm", F.lit(None).cast("string"))
    return identity.person_identifiers(crm, _loyalty(spark, d).withColumn("email_norm", F.lit(None).cast("string")), app)


RULES_TEXT = """{"datasets": {"customers_crm": {"rules": [
    {"id": "T-1", "name": "email_known", "dimension": "completeness", "type": "not_null", "severity": "warn", "column": "email_typed"},
    {"id": "T-2", "name": "country_known", "dimension": "validity", "type": "in_set", "severity": "quarantine", "column": "country_norm", "values": ["US"]},
    {"id": "T-3", "name": "one_name_each", "dimension": "uniqueness", "type": "unique", "severity": "reject", "columns": ["first_name_norm", "country_norm"], "applies_when": "account_status_norm = 'active'"}
]}}}"""


@query("""with f as (select c_custkey % 10 = 0 b, count(*) over (partition by c_mktsegment, c_custkey % 10 = 0) > 1 u from customer)
    select 'T-1' as rule_id, count(*) as applicable, count(*) filter (b) as failed from f union all select 'T-2', count(*), count(*) filter (b) from f union all select 'T-3', count(*), count(*) filter (u) from f""")
def rules_from_text(spark, d):
    """Rules read from configuration text, over a source file."""
    rules = config.rules(RULES_TEXT)["customers_crm"]
    return dq.rule_results(_crm(spark, d), rules).select("rule_id", "applicable", "failed")
