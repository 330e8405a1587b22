"""Declared schemas of the nine source datasets, and the typed projection that follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean

ISO, MIXED, LOYALTY = tuple(clean.ISO), tuple(clean.MIXED), ("dd/MM/yyyy HH:mm",)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    patterns: tuple[str, ...] = ()
    true_words: tuple[str, ...] = ("true", "1", "yes", "y")
    false_words: tuple[str, ...] = ("false", "0", "no", "n")


@dataclass(frozen=True)
class Contract:
    name: str
    source: str
    key: tuple[str, ...]
    layout: str
    fields: tuple[Field, ...]
    options: dict[str, str] = field(default_factory=dict)

    def raw_schema(self) -> T.StructType:
        """All strings, arrays aside."""
        return T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.kind == "array" else T.StringType()) for f in self.fields])


#: The columns of the source files, their types, and how their timestamps and booleans are written.
# fmt: off
CRM = Contract("customers_crm", "crm", ("crm_customer_id",), "csv", (
    Field("crm_customer_id", "string", required=True),
    Field("first_name", "string", required=True),
    Field("last_name", "string", required=True),
    Field("email", "string"),
    Field("phone", "string"),
    Field("date_of_birth", "date"),
    Field("gender", "string"),
    Field("city", "string"),
    Field("state", "string"),
    Field("country", "string"),
    Field("postal_code", "string"),
    Field("account_status", "string", required=True),
    Field("signup_channel", "string"),
    Field("created_at", "timestamp", required=True, patterns=ISO),
    Field("updated_at", "timestamp", required=True, patterns=ISO),
))
LOYALTY_MEMBERS = Contract("loyalty_members", "loyalty", ("loyalty_id",), "csv", (
    Field("loyalty_id", "string", required=True),
    Field("member_name", "string", required=True),
    Field("mobile", "string", required=True),
    Field("email_address", "string"),
    Field("tier", "string", required=True),
    Field("points_balance", "integer", required=True),
    Field("enrolled_on", "date", required=True),
    Field("home_store", "string"),
    Field("city", "string"),
    Field("country_code", "string"),
    Field("last_updated", "timestamp", required=True, patterns=LOYALTY),
), {"sep": ";"})
APP_USERS = Contract("app_users", "app", ("app_user_id",), "json", (
    Field("app_user_id", "string", required=True),
    Field("email", "string", required=True),
    Field("display_name", "string"),
    Field("phone_verified", "boolean", true_words=("y", "yes", "1", "true"), false_words=("n", "no", "0", "false")),
    Field("phone", "string"),
    Field("locale", "string"),
    Field("signup_ts", "timestamp", required=True, patterns=ISO),
    Field("marketing_opt_in", "boolean", true_words=("true", "1"), false_words=("false", "0")),
    Field("last_login_ts", "timestamp", patterns=ISO),
    Field("device_cookies", "array"),
))
PRODUCTS = Contract("products", "catalogue", ("product_id",), "csv", (
    Field("product_id", "string", required=True),
    Field("sku", "string", required=True),
    Field("product_name", "string", required=True),
    Field("category_id", "string", required=True),
    Field("category_name", "string", required=True),
    Field("brand", "string"),
    Field("unit_price", "decimal", required=True),
    Field("currency", "string", required=True),
    Field("is_active", "boolean", required=True),
    Field("stock_qty", "integer"),
    Field("launched_on", "date"),
))
ORDERS = Contract("orders", "orders", ("order_id",), "json", (
    Field("order_id", "string", required=True),
    Field("customer_ref", "string"),
    Field("customer_ref_type", "string"),
    Field("order_ts", "timestamp", required=True, patterns=MIXED),
    Field("order_status", "string", required=True),
    Field("order_type", "string", required=True),
    Field("currency", "string", required=True),
    Field("gross_amount", "decimal", required=True),
    Field("discount_amount", "decimal"),
    Field("shipping_amount", "decimal"),
    Field("tax_amount", "decimal"),
    Field("payment_method", "string"),
    Field("channel", "string"),
    Field("ship_country", "string"),
    Field("updated_at", "timestamp", required=True, patterns=ISO),
))
ORDER_ITEMS = Contract("order_items", "orders", ("order_id", "line_number",), "csv", (
    Field("order_id", "string", required=True),
    Field("line_number", "integer", required=True),
    Field("product_id", "string", required=True),
    Field("quantity", "integer", required=True),
    Field("unit_price", "decimal", required=True),
    Field("line_discount", "decimal"),
))
WEB_EVENTS = Contract("web_events", "clickstream", ("event_id",), "dated_json", (
    Field("event_id", "string"),
    Field("event_type", "string", required=True),
    Field("event_ts", "timestamp", required=True, patterns=ISO),
    Field("app_user_id", "string"),
    Field("device_cookie", "string", required=True),
    Field("session_hint", "string"),
    Field("page_url", "string"),
    Field("referrer", "string"),
    Field("product_id", "string"),
    Field("search_term", "string"),
    Field("cart_value", "decimal"),
    Field("utm_source", "string"),
    Field("utm_medium", "string"),
    Field("utm_campaign", "string"),
    Field("device_type", "string"),
    Field("country", "string"),
    Field("user_agent", "string"),
))
SUPPORT_TICKETS = Contract("support_tickets", "support", ("ticket_id",), "csv", (
    Field("ticket_id", "string", required=True),
    Field("requester_email", "string", required=True),
    Field("subject", "string", required=True),
    Field("category", "string", required=True),
    Field("priority", "string", required=True),
    Field("status", "string", required=True),
    Field("created_at", "timestamp", required=True, patterns=ISO),
    Field("first_response_at", "timestamp", patterns=ISO),
    Field("resolved_at", "timestamp", patterns=ISO),
    Field("satisfaction_score", "integer"),
    Field("order_id", "string"),
))
MARKETING_EVENTS = Contract("marketing_events", "marketing", ("campaign_id", "recipient_email", "event_type", "event_ts",), "json", (
    Field("campaign_id", "string", required=True),
    Field("campaign_name", "string", required=True),
    Field("channel", "string", required=True),
    Field("recipient_email", "string", required=True),
    Field("event_type", "string", required=True),
    Field("event_ts", "timestamp", required=True, patterns=ISO),
    Field("link_url", "string"),
    Field("product_id", "string"),
))
# fmt: on
CONTRACTS = {c.name: c for c in (CRM, LOYALTY_MEMBERS, APP_USERS, PRODUCTS, ORDERS, ORDER_ITEMS, WEB_EVENTS, SUPPORT_TICKETS, MARKETING_EVENTS)}


def typed_column(f: Field, c: Column) -> Column:
    """Null for what does not fit the type, never an error."""
    if f.kind == "array":
        return c
    text = clean.without_sentinel(c)
    if f.kind == "decimal":
        return clean.number_text(text).try_cast("decimal(14,2)")
    if f.kind == "integer":
        return text.try_cast("int")
    if f.kind == "boolean":
        word = F.lower(text)
        return F.when(word.isin(list(f.true_words)), True).when(word.isin(list(f.false_words)), False)
    if f.kind == "timestamp":
        return clean.first_timestamp(text, list(f.patterns))
    if f.kind == "date":
        return clean.first_date(text)
    return text


def typed(df: DataFrame, contract: Contract) -> DataFrame:
    """All columns and, for each of the contract, ``<name>_typed``; missing ones are added as null. Extra columns stay."""
    have = set(df.columns)
    missing = {f.name: F.lit(None).cast("array<string>" if f.kind == "array" else "string") for f in contract.fields if f.name not in have}
    df = df.withColumns(missing) if missing else df
    return df.select("*", *(typed_column(f, F.col(f.name)).alias(f"{f.name}_typed") for f in contract.fields))


#: Normalised columns: name, source column, expression. Later ones of a name win.
NORMALISED = [
    ("email_norm", "email", clean.email), ("email_norm", "email_address", clean.email), ("requester_email_norm", "requester_email", clean.requester_email),
    ("email_norm", "recipient_email", clean.recipient_email), ("phone_norm", "mobile", clean.phone), ("phone_norm", "phone", clean.phone),
    ("country_norm", "country", clean.country), ("country_norm", "ship_country", clean.country), ("country_norm", "country_code", clean.country),
    ("account_status_norm", "account_status", clean.status), ("first_name_norm", "first_name", clean.name), ("last_name_norm", "last_name", clean.name),
    ("first_name_norm", "member_name", clean.first_token), ("last_name_norm", "member_name", clean.last_token),
]


def cleaned(df: DataFrame) -> DataFrame:
    """Adds the normalised columns that the frame has sources for, in one projection."""
    return df.withColumns({name: make(F.col(c)) for name, c, make in NORMALISED if c in df.columns})
