"""Ranks and tiles over a whole table without putting it into one partition.

Ranks: rows are dealt out by ranges of the order; each range numbers its own rows and is moved up by the
counts of those before it, which are one number a partition. Tiles: only their borders are looked for, by counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from .durable import durable


def ntile_of(rank: Column, total: Column, n: int) -> Column:
    """The tile of a rank when ``total`` rows are cut into n tiles, the first ones larger by one."""
    small, extra = F.floor(total / n), total % n
    wide = extra * (small + 1)
    low = F.ceil(rank / (small + 1))
    high = extra + F.ceil((rank - wide) / F.greatest(small, F.lit(1)))
    return F.when(rank <= wide, low).otherwise(high).cast("int")


_ORDERS = ("asc_nulls_first", "asc_nulls_last", "desc_nulls_first", "desc_nulls_last")


class Order:
    """A column and its direction."""

    def __init__(self, name: str, how: str = "asc_nulls_last"):
        if how not in _ORDERS:
            raise ValueError(how)
        self.name, self.how = name, how


def ranks(df: DataFrame, order: list[Column], name: str, total: str) -> DataFrame:
    """``df`` with the rank of each row in ``order``, from 1, and the number of rows."""
    dealt = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    running = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias(total))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


#: Rows that an interval between two cuts is to hold, and the greatest number of cuts. Cuts are drawn from the rows by a hash.
INTERVAL, MOST = 50_000, 65_536


def _place(df: DataFrame, order: list[Order], key: str) -> Column:
    """One value that ascends as the order does, and then by the key."""
    parts = []
    for o in order:
        c, kind = F.col(o.name), df.schema[o.name].dataType
        parts.append(c.isNull() if o.how.endswith("last") else c.isNotNull())
        if o.how.startswith("desc"):
            if not isinstance(kind, NumericType):
                raise ValueError(f"descending orders are of numbers, {o.name} is {kind.simpleString()}")
            if isinstance(kind, (FloatType, DoubleType)):
                parts.append(~F.isnan(F.coalesce(c, F.lit(0.0))))
            c = -c
        parts.append(c)
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate([*parts, F.col(key)])])


def _below(cuts: Column, steps: Column, width: int, x: Column) -> Column:
    """How many of the ascending ``cuts`` are less than x; ``steps`` has every width-th of them."""
    far = F.size(F.filter(steps, lambda c: c < x))
    near = F.size(F.filter(F.slice(cuts, (far - 1) * width + 1, F.lit(width)), lambda c: c < x))
    return F.when(far == 0, F.lit(0)).otherwise((far - 1) * width + near)


def _cuts(rows: DataFrame, place: dict[str, Column], key: str, share: float, width: int) -> Column:
    """Of each order the ascending places of a draw of the rows, and every width-th of them: a constant, so that no row carries it.

    A value that JSON rounds makes another cut, and no other result.
    """
    drawn = rows.where(F.pmod(F.xxhash64(key), F.lit(2**20)) < math.ceil(2**20 * share))
    lists = drawn.agg(*[F.sort_array(F.collect_list(x)).alias(name) for name, x in place.items()])
    every = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / width).cast("int")), lambda i: F.get(c, i * width))
    steps = [F.when(F.size(name) > 0, every(name)).otherwise(F.col(name)).alias(f"{name} steps") for name in place]
    cuts = lists.select(F.struct(*place, *steps).alias("cuts"))
    return F.from_json(F.lit(cuts.select(F.to_json("cuts")).first()[0]), cuts.schema["cuts"].dataType)


def ntiles(df: DataFrame, key: str, orders: dict[str, tuple[list[Order], int]]) -> DataFrame:
    """``df`` with one tile column for each of ``orders``: name -> (order, number of tiles); ``key`` is unique and ends each order.

    No row is sorted or shuffled but those next to a tile's border. All orders are counted in one pass, by intervals between cuts that are a bounded
    draw of the rows; running sums of the counts name the interval in which each border lies, only its rows are ranked, by value and key, and a row's tile is
    the number of borders before it. The draw decides how long intervals are, never what comes out, so a value that a third of all rows have is
    no heavier than others. The driver gets one number an interval.
    """
    rows = durable(df)
    n = rows.count()
    if not n:
        return rows.withColumns({name: F.lit(None).cast("int") for name in orders})
    size = min(MOST, n // INTERVAL)
    width = math.isqrt(size) + 1
    place = {name: _place(rows, order, key) for name, (order, _) in orders.items()}
    cuts = _cuts(rows, place, key, size / n, width) if size else None
    spot = lambda name: _below(cuts[name], cuts[f"{name} steps"], width, place[name]) if size else F.lit(0)
    one = lambda name: F.struct(F.lit(name).alias("name"), spot(name).alias("i"), *[(x if other == name else F.lit(None)).alias(other) for other, x in place.items()])
    spots = rows.select(F.inline(F.array(*map(one, orders))))
    counts = {(r["name"], r["i"]): r["n"] for r in spots.groupBy("name", "i").agg(F.count("*").alias("n")).collect()} if size else {(name, 0): n for name in orders}
    asked: dict[tuple[str, int], list[int]] = {}
    for name, (_, tiles) in orders.items():
        small, more = divmod(n, tiles)
        ends, done = {t * small + min(t, more) for t in range(1, tiles)}, 0
        for i in sorted(i for x, i in counts if x == name):
            if at := [e - done for e in ends if done < e <= done + counts[name, i]]:
                asked[name, i] = at
            done += counts[name, i]
    if not asked:  # one tile each
        return rows.withColumns({name: F.lit(1) for name in orders})
    here = lambda name, i: (F.col("name") == name) & (F.col("i") == i)
    near = spots.where(reduce(Column.__or__, [here(*x) for x in asked]))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("name", "i").orderBy(*orders)))
    each = near.where(reduce(Column.__or__, [here(*x) & F.col("k").isin(at) for x, at in asked.items()]))
    borders = durable(each.agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in orders]))
    told = rows.withColumn("__borders", borders.select(F.struct(*orders)).scalar())
    before = lambda name: F.size(F.filter(F.col("__borders")[name], lambda c: c < place[name]))
    return told.withColumns({name: (before(name) + 1).cast("int") for name in orders}).drop("__borders")
