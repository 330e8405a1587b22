"""Memberships by day as bitmaps of dense numbers, and counts over days as partials that merge.

A bitmap has one bit for each of 32,768 numbers; a group has one for each stretch of numbers in which it has members, so a day of a segment of a billion
customers is at most 125 MB in 30,518 rows, and days are compared stretch by stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import ranks


def numbered(keys: DataFrame, key: str) -> DataFrame:
    """``(key, number)``: the distinct keys, numbered from 0 in their order without a gap."""
    every = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return ranks(every, [F.col(key)], "number", "__total").select(key, (F.col("number") - 1).alias("number"))


def membership(rows: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """``(*by, stretch, bits)``: who is in each group. Rows that repeat a member set its bit once; the aggregate is combined before the shuffle."""
    return rows.groupBy(*by, F.bitmap_bucket_number(F.col(number) + 1).alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number) + 1)).alias("bits"))


def sizes(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("members"))


def daily_changes(bitmaps: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """``(*by, day, members, entered, exited)`` for each day that has members or follows one that has.

    A day's bitmaps meet those of the day before, stretch by stretch; who is in either is their union, so entered are the union less yesterday's and exited the union less
    today's. No member is listed.
    """
    n = F.bitmap_count("bits")
    now = bitmaps.select(*by, day, "stretch", "bits", n.alias("now"), F.lit(0).cast("long").alias("was"))
    was = bitmaps.select(*by, F.date_add(day, 1).alias(day), "stretch", "bits", F.lit(0).cast("long").alias("now"), n.alias("was"))
    each = now.unionAll(was).groupBy(*by, day, "stretch").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"), F.sum("now").alias("now"), F.sum("was").alias("was"))
    return each.groupBy(*by, day).agg(F.sum("now").alias("members"), (F.sum("either") - F.sum("was")).alias("entered"), (F.sum("either") - F.sum("now")).alias("exited"))


def daily_partials(events: DataFrame, by: list[str], at: str, visitor: str, value: str, register_bits: int = 14) -> DataFrame:
    """``(*by, day, events, visitors, amounts)``: counts, and sketches of the distinct visitors and of the values' quantiles, of each day; what windows are merged from."""
    return events.groupBy(*by, F.to_date(at).alias("day")).agg(
        F.count("*").alias("events"), F.hll_sketch_agg(F.col(visitor), register_bits).alias("visitors"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("amounts"),
    )


def windows(partials: DataFrame, by: list[str], as_of: Column, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """``(*by, days, events, visitors, median)`` of the last so many days, from the partials alone: each day goes to the windows that it lies in. Counts are exact, visitors and median are estimates."""
    age = F.datediff(as_of, "day")
    within = F.filter(F.array(*map(F.lit, days)), lambda d: (age >= 0) & (age < d))
    each = partials.withColumn("days", F.explode(within))
    return each.groupBy(*by, "days").agg(
        F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors"),
        F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("amounts"), F.lit(0.5)).alias("median"),
    )
