"""Scans in the order of time inside keys, of which one may have most rows.

A key with many rows is cut into slices of time, which are scanned apart; what a slice needs to know of those before it is
carried over from one row a slice.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Rows of a key that are scanned in one piece, and the most pieces that a key is cut into.
PIECE, PIECES = 1_000_000, 4_000
SLICE = "__slice"


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[f"__of_{k}"]) for k in keys])


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``other``, whose keys are unique; null keys meet. Which side is sent out is left to its measured size."""
    other = other.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return df.join(other, same(df, other, keys), "left").drop(*[f"__of_{k}" for k in keys])


def sliced(df: DataFrame, keys: list[str], at: str, piece: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with the number of a slice, ascending with the timestamp ``at`` inside each key, and whether any key has several.

    Keys are counted by a sum that is combined before the shuffle; only those with more than ``piece`` rows are cut, at quantiles
    of their times. Rows without a time are in the first slice; rows of one key and one time stay together.
    """
    piece = piece or PIECE
    hot = durable(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > piece))
    most = hot.agg(F.max("__n")).first()[0]
    if most is None:
        return df.withColumn(SLICE, F.lit(0)), False
    n = min(PIECES, math.ceil(most / piece) + 1)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    of_hot = _beside(df, hot, keys).where("__n is not null")
    cuts = durable(of_hot.groupBy(*keys).agg(F.percentile_approx(micros, [i / n for i in range(1, n)], 100 * n).alias("__cuts")))
    told = _beside(df, cuts, keys)
    found = F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < micros))
    return told.withColumn(SLICE, F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(found)).drop("__cuts"), True


def carried(df: DataFrame, keys: list[str], ends: dict[str, Column], *told: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of the last of ``told``, made of what the slices before a row's have at their ``ends``.

    ``ends`` are aggregates of a slice; each of ``told`` is expressions over the columns so far, in windows over the slices of a key
    (``before(keys)``). There is one row a slice, and none for a key that is in one piece.
    """
    each = df.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in ends.items()])
    each = each.withColumn("__of", F.count("*").over(Window.partitionBy(*keys))).where("__of > 1")
    for more in told:
        each = each.withColumns(more)
    return _beside(df, durable(each.select(*keys, SLICE, *told[-1])), [*keys, SLICE])


def before(keys: list[str]) -> Window:
    """The slices of a key in the order of time."""
    return Window.partitionBy(*keys).orderBy(SLICE)
