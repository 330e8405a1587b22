"""Rows whose key has some property over the whole table, without a window over whole rows.

Keys are aggregated by themselves first. Those that have the property set bits of a filter of fixed size, which goes to all tasks; rows
that it lets pass are not moved at all, and only the others are joined with the keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Bits of the filter (1 MB), hashes a key, and how many keys may count as heavy and be sent to all tasks.
BITS, HASHES, HEAVY = 2**23, 3, 10_000


@dataclass(frozen=True)
class Screen:
    """Rows are marked whose ``keys``, null or not, have a group with ``bad``, an aggregate."""

    keys: tuple[str, ...]
    bad: Column


def _bits(keys: list[str] | tuple[str, ...]) -> list[Column]:
    nulls = F.concat(*[F.col(k).isNull().cast("string") for k in keys])  # a hash passes nulls over
    return [F.pmod(F.xxhash64(F.lit(i), nulls, *[F.col(k) for k in keys]), F.lit(BITS)) for i in range(HASHES)]


def filter_of(found: DataFrame, keys: tuple[str, ...]) -> Column:
    """The filter of the keys in ``found`` as an array of longs, 0 where no bit of one is set; at most BITS / 64 of them."""
    bits = found.select(F.explode(F.array(*_bits(keys))).alias("bit"))
    words = bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
    every = found.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("word"))
    whole = every.join(words, "word", "left").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set")))).alias("all"))
    return durable(whole.select(F.col("all.set").alias("all"))).scalar()


def may_have(words: Column, keys: tuple[str, ...]) -> Column:
    """Whether a row's key may be in the filter; one that is in it always may."""
    return reduce(Column.__and__, [F.getbit(F.get(words, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1 for b in _bits(keys)])


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[f"__of_{k}"]) for k in keys])


def marked(df: DataFrame, screens: dict[str, Screen]) -> DataFrame:
    """``df`` with a boolean column for each of ``screens``; null keys make one group, and an empty table stays empty.

    Of the keys found, the heavy ones, of which there are at most HEAVY (each has at least so great a part of the rows of keys found), are sent
    to all tasks; the others have few rows each and are joined by a shuffle. So neither nulls nor any other frequent key come into one task. A filter
    with more keys than bits only lets more rows into the join.
    """
    found = {}
    for name, s in screens.items():
        bad = df.groupBy(*s.keys).agg(F.count("*").alias("__n"), s.bad.alias("__bad")).where("__bad").select(*s.keys, "__n")
        bad = durable(bad)
        total = bad.agg(F.sum("__n")).first()[0]
        if total is not None:
            found[name] = (s.keys, bad, total)
    rest = {name: F.lit(False) for name in screens if name not in found}
    if not found:
        return df.withColumns(rest)
    told = df.withColumns({f"__h_{name}": may_have(filter_of(bad, keys), keys) for name, (keys, bad, _) in found.items()})
    some = reduce(Column.__or__, [F.col(f"__h_{name}") for name in found])
    hit = told.where(some)
    for name, (keys, bad, total) in found.items():
        of = bad.withColumnsRenamed({k: f"__of_{k}" for k in keys})
        ours = [f"__of_{k}" for k in keys]
        heavy = of.where(F.col("__n") * HEAVY >= total).select(*ours, F.lit(True).alias("__heavy"))
        hit = hit.join(F.broadcast(heavy), _same(hit, heavy, keys), "left").drop(*ours)
        light = of.where(F.col("__n") * HEAVY < total)
        light = light.select(*ours, F.xxhash64(*ours).alias("__hash"), F.lit(True).alias("__light"))
        asked = F.col(f"__h_{name}") & F.col("__heavy").isNull()
        # rows that ask for nothing are dealt at random, not all by one value
        hit = hit.withColumns({"__asked": asked, "__key": F.when(asked, F.xxhash64(*keys)).otherwise(F.xxhash64(F.monotonically_increasing_id()))})
        on = F.col("__asked") & (hit["__key"] == light["__hash"]) & _same(hit, light, keys)
        hit = hit.join(light, on, "left").drop(*ours, "__hash")
        hit = hit.withColumn(name, F.coalesce("__heavy", "__light", F.lit(False))).drop("__heavy", "__light", "__asked", "__key")
    out = hit.unionByName(told.where(~some).withColumns({name: F.lit(False) for name in found}))
    return out.drop(*[f"__h_{name}" for name in found]).withColumns(rest)
