"""The serving queries: analytics summaries, customer search, profile, timeline, quality and run views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean

KEY = "canonical_customer_id"
#: Roles from least to most, and those that see masked contact data.
ROLES = ["viewer", "analyst", "data_engineer", "admin"]
MASKED_ROLES = {"analyst", "viewer"}


def has_at_least(role: str, least: str) -> bool:
    return role in ROLES and ROLES.index(role) >= ROLES.index(least)


def masked_profile(df: DataFrame, role: str, masked: set[str] | None = None, email: str = "primary_email", phone: str = "primary_phone") -> DataFrame:
    """Contact fields masked for the roles that must not see them."""
    if role not in (MASKED_ROLES if masked is None else masked):
        return df
    return df.withColumns({c: f(F.col(c)) for c, f in ((email, clean.masked_email), (phone, clean.masked_phone)) if c in df.columns})


def summary(customers: DataFrame, metrics: DataFrame, orders: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row of figures; each table is read once. dq_score is the mean over the datasets of the last run in ``scores(run_id, score_overall)``."""
    one = customers.agg(F.count("*").alias("total_customers")).crossJoin(
        metrics.agg(
            F.count_if(F.col("churn_risk_band") == "active").alias("active_customers"), F.count_if(F.col("churn_risk_band") == "at_risk").alias("at_risk_customers"),
            F.avg("aov").alias("avg_aov"),
        )
    ).crossJoin(orders.agg(F.sum("revenue_amount").alias("total_revenue"), F.count_if(F.col("order_type") == "sale").alias("total_orders")))
    if scores is None:
        return one.withColumns({"dq_score": F.lit(None).cast("double"), "last_run_id": F.lit(None).cast("int")})
    last = scores.groupBy("run_id").agg(F.avg("score_overall").alias("s")).agg(F.max_by("s", "run_id").alias("dq_score"), F.max("run_id").alias("last_run_id"))
    return one.crossJoin(last)


def revenue_by_month(orders: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """(period, revenue, orders) of the trailing months; refunds count as orders with revenue 0."""
    kept = orders.where(F.col("order_ts") >= F.add_months(as_of, -months))
    return kept.groupBy(F.date_trunc("month", "order_ts").cast("date").alias("period")).agg(F.sum("revenue_amount").alias("revenue"), F.count("*").alias("orders")).orderBy("period")


def top_customers(customers: DataFrame, metrics: DataFrame, limit: int = 10) -> DataFrame:
    best = metrics.select(KEY, "total_spend", "order_count").orderBy(F.desc_nulls_last("total_spend"), KEY).limit(limit)
    return best.join(customers.select(KEY, "full_name_display"), KEY).orderBy(F.desc_nulls_last("total_spend"), KEY)


def churn_distribution(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("churn_risk_band").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "churn_risk_band")


def rfm_distribution(metrics: DataFrame) -> DataFrame:
    return metrics.where("rfm_segment is not null").groupBy("rfm_segment").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "rfm_segment")


def repeat_rate(metrics: DataFrame) -> DataFrame:
    buyers, again = F.count_if(F.col("order_count") >= 1), F.count_if(F.col("order_count") >= 2)
    return metrics.agg(F.try_divide(again, buyers).alias("repeat_rate"), buyers.alias("purchasers"))


def search(customers: DataFrame, metrics: DataFrame, q: str | None = None, band: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Customers whose name, e-mail or phone contains q (any case), or whose id is q; the biggest spenders first."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    out = customers.join(metrics.select(KEY, "total_spend", "order_count", "churn_risk_band", "rfm_segment"), KEY, "left")
    if q:
        like = lambda c: F.contains(F.lower(c), F.lit(q.lower()))
        hit = F.col(KEY).cast("string") == q
        for c in ("full_name_display", "primary_email", "primary_phone"):
            if c in customers.columns:
                hit = hit | F.coalesce(like(F.col(c)), F.lit(False))
        out = out.where(hit)
    if band:
        out = out.where(F.col("churn_risk_band") == band)
    return out.orderBy(F.desc_nulls_last("total_spend"), KEY).offset(offset).limit(limit)


def customer_orders(orders: DataFrame, customer, limit: int = 50) -> DataFrame:
    return orders.where(F.col(KEY) == customer).orderBy(F.desc_nulls_last("order_ts"), "order_id").limit(limit)


def timeline(parts: list[DataFrame], customer, limit: int = 50) -> DataFrame:
    """The newest of the union of ``(canonical_customer_id, event_ts, event_kind, summary)`` frames; each branch filters first."""
    branches = [p.where(F.col(KEY) == customer).select("event_ts", "event_kind", "summary") for p in parts]
    out = branches[0]
    for p in branches[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc_nulls_last("event_ts"), "event_kind", "summary").limit(limit)


def profiles(customers: DataFrame, metrics: DataFrame, identities: DataFrame, members: DataFrame, orders: DataFrame, recent: int = 5) -> DataFrame:
    """One row a customer with its metrics, identities, segments and latest orders as nested columns."""
    by = lambda df, name, *cols: df.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    ids = by(identities, "identities", "source_system", "source_record_id")
    segs = by(members, "segments", "segment_id")
    from pyspark.sql import Window

    latest = orders.withColumn("__n", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc_nulls_last("order_ts"), "order_id"))).where(F.col("__n") <= recent)
    last = by(latest, "recent_orders", "__n", "order_id", "order_ts", "revenue_amount")
    out = customers
    for part in (metrics, ids, segs, last):
        out = out.join(part, KEY, "left")
    return out


def dataset_scores(scores: DataFrame, run_id: int | None = None) -> DataFrame:
    """The scores of a run, or of the last."""
    if run_id is None:
        last = scores.agg(F.max("run_id").alias("run_id"))
        return scores.join(F.broadcast(last), "run_id", "left_semi").orderBy("dataset")
    return scores.where(F.col("run_id") == run_id).orderBy("dataset")


def score_trend(scores: DataFrame, dataset: str, limit: int = 20) -> DataFrame:
    return scores.where(F.col("dataset") == dataset).orderBy(F.desc("run_id")).limit(limit).select("run_id", "score_overall")


def runs(log: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return log.orderBy(F.desc("run_id")).offset(offset).limit(limit)


def latest_run(log: DataFrame) -> DataFrame:
    return log.where("status = 'succeeded'").orderBy(F.desc("run_id")).limit(1)


def run_stages(stages: DataFrame, run_id: int) -> DataFrame:
    return stages.where(F.col("run_id") == run_id).orderBy("stage_order")


# Declared by the data model, computed here


def revenue_daily(orders: DataFrame) -> DataFrame:
    """Revenue by day, and how much of it came from first orders."""
    day = F.to_date("order_ts").alias("day")
    new = F.when(F.col("is_first_order"), F.col("revenue_amount")).otherwise(F.lit(0).cast("decimal(14,2)"))
    return orders.groupBy(day).agg(F.sum("revenue_amount").alias("revenue"), F.sum(new).alias("new_revenue"), F.count("*").alias("orders"))


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Customers of each month of first purchase who bought n months later."""
    month = F.date_trunc("month", "order_ts").cast("date")
    bought = orders.where("order_type = 'sale'").select(KEY, month.alias("m")).distinct()
    first = bought.groupBy(KEY).agg(F.min("m").alias("cohort"))
    both = bought.join(first, KEY)
    later = ((F.year("m") - F.year("cohort")) * 12 + F.month("m") - F.month("cohort")).alias("month_number")
    return both.groupBy("cohort", later).agg(F.count("*").alias("customers"))


def product_performance(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Units, revenue and orders of each product; lines are summed before the join."""
    sums = lines.groupBy("product_id").agg(F.sum("quantity").alias("units"), F.sum("net_amount").alias("revenue"), F.count_distinct("order_id").alias("orders"))
    return sums.join(products, "product_id")


def category_performance(lines: DataFrame, products: DataFrame) -> DataFrame:
    return product_performance(lines, products).groupBy("category").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.count("*").alias("products"))


def category_affinity(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Each customer's share of spending by category."""
    from pyspark.sql import Window

    sums = lines.join(products.select("product_id", "category"), "product_id").groupBy(KEY, "category").agg(F.sum("net_amount").alias("spend"))
    total = F.sum("spend").over(Window.partitionBy(KEY))
    return sums.select(KEY, "category", "spend", F.try_divide(F.col("spend").cast("double"), total.cast("double")).alias("share"))


def basket_pairs(basket: DataFrame, tile: int = 500) -> DataFrame:
    """``(product_a, product_b)``, a < b, once for each order of ``basket(order_id, product_id)``, distinct, that has both.

    An order of more than ``tile`` products is cut into tiles by a hash; each pair of tiles is a key of its own, to which the products of both are sent, so no task
    pairs all of a large order.
    """
    sizes = basket.groupBy("order_id").agg(F.ceil(F.count("*") / tile).cast("int").alias("k"))
    rows = basket.join(sizes, "order_id").withColumn("own", F.pmod(F.xxhash64("product_id"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("order_id", "product_id", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("order_id", "low", "high")]
    both = (F.least("a.own", "b.own") == F.col("a.low")) & (F.greatest("a.own", "b.own") == F.col("a.high"))
    pairs = a.join(b, on[0] & on[1] & on[2] & both & (F.col("a.product_id") < F.col("b.product_id")))
    return pairs.select(F.col("a.product_id").alias("product_a"), F.col("b.product_id").alias("product_b"))


def co_purchase(lines: DataFrame, least: int = 2, tile: int = 500) -> DataFrame:
    """Pairs of products in at least ``least`` common orders, with lift. Products in fewer orders than that are in no such pair and are not paired."""
    basket = lines.select("order_id", "product_id").distinct()
    n = basket.select("order_id").distinct().agg(F.count("*").alias("n"))
    single = basket.groupBy("product_id").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    frequent = basket.join(single, "product_id", "left_semi").select("order_id", "product_id")
    pairs = basket_pairs(frequent, tile).groupBy("product_a", "product_b").agg(F.count("*").alias("orders_together")).where(F.col("orders_together") >= least)
    out = pairs.join(single.select(F.col("product_id").alias("product_a"), F.col("c").alias("ca")), "product_a").join(single.select(F.col("product_id").alias("product_b"), F.col("c").alias("cb")), "product_b")
    return out.crossJoin(F.broadcast(n)).select("product_a", "product_b", "orders_together", (F.col("orders_together") * F.col("n") / (F.col("ca") * F.col("cb"))).alias("lift"))


def event_windows(events: DataFrame, as_of: Column, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """Each customer's events in the last 30, 90 and 365 days, in one pass."""
    age = F.datediff(as_of, "event_ts")
    return events.groupBy(KEY).agg(*[F.count_if((age >= 0) & (age < d)).alias(f"events_{d}d") for d in days])


def order_status_cube(orders: DataFrame, by: tuple[str, str]) -> DataFrame:
    """Order counts and revenue for every combination of two attributes and their totals."""
    return orders.cube(*by).agg(F.count("*").alias("orders"), F.sum("revenue_amount").alias("revenue"))


# Checks that the data model declares

CHECKS = {
    "order_count_not_negative": "order_count >= 0", "aov_not_negative": "aov is null or aov >= 0",
    "churn_band_known": "churn_risk_band in ('no_purchase_history', 'active', 'at_risk', 'churned')",
}


def check_violations(metrics: DataFrame) -> DataFrame:
    """A row a check with the number of rows that break it."""
    sums = metrics.agg(*[F.count_if(~F.expr(e)).alias(n) for n, e in CHECKS.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in CHECKS])))
