"""Spanning forests of the best edges, and the step at which a growing graph first has too large a part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .durable import durable
from .ranking import ranks

#: Steps of a graph that are tried side by side in a round.
WAYS = 16


def best_forest(edges: DataFrame, a: str, b: str, order: list[Column], kept: list[str] | None = None) -> DataFrame:
    """The edges of a spanning forest in which every two vertices are joined by edges as early in ``order`` as any path has; columns a, b and ``kept``.

    Borůvka rounds: each part picks its earliest edge to another part, by a minimum that is combined before the shuffle, and the parts that the
    picked edges join become one. At least half of the parts go in each round. Ties are broken by the edge's ends; null ends, loops
    and repeats of an edge are ignored, and an empty table gives an empty forest.
    """
    kept = kept or []
    edge = F.struct(F.struct(*order).alias("order"), F.col(a).alias("a"), F.col(b).alias("b"), *[F.col(c).alias(c) for c in kept])
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(edge.alias("e"), F.col(a).alias("pa"), F.col(b).alias("pb"))
    now, picked = durable(now), []
    while True:
        ends = now.select(F.explode(F.array("pa", "pb")).alias("part"), F.struct("e", "pa", "pb").alias("x"))
        picks = durable(ends.groupBy("part").agg(F.min("x").alias("x")).select("x.*").distinct())
        picked.append(picks.select("e.*"))
        if picks.isEmpty():
            break
        part = connected_components(picks, "pa", "pb")
        for p in ("pa", "pb"):
            new = part.select(F.col("vertex").alias(p), F.col("component").alias("__new"))
            now = now.join(new.hint("merge"), p).withColumn(p, F.col("__new")).drop("__new")
        now = durable(now.where("pa <> pb"))
    every = reduce(DataFrame.unionAll, picked)
    return durable(every.select(F.col("a").alias(a), F.col("b").alias(b), *kept).distinct())


def last_step_that_fits(forest: DataFrame, group: str, a: str, b: str, step: list[str], limit: int, ways: int = WAYS) -> DataFrame:
    """``(group, *step)``: of each group the last of its steps, ascending, up to which the forest's edges make no part of more than ``limit`` vertices.

    Groups without such a step are absent. All edges of a step come at once. In a round several steps of every group are tried side by side, as
    components of one graph, and the span between the last that fits and the first that does not shrinks ``ways``-fold, so groups
    of a million steps take five rounds.
    """
    steps = durable(ranks(forest.select(group, *step).distinct(), [F.col(group), *map(F.col, step)], "at", "__all").drop("__all"))
    edges = durable(forest.join(steps, [group, *step]).select(group, "at", a, b))
    spans = durable(steps.groupBy(group).agg((F.min("at") - 1).alias("fits"), (F.max("at") + 1).alias("over")))
    owner = durable(edges.select(group, F.explode(F.array(a, b)).alias("u")).distinct())
    while not (wide := spans.where("over - fits > 1")).isEmpty():
        tried = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ways - 1)), lambda i: F.col("fits") + F.greatest(F.floor(i * (F.col("over") - F.col("fits")) / ways), F.lit(1))))
        rows = edges.join(wide.select(group, F.explode(tried).alias("to")), group).where(F.col("at") <= F.col("to"))
        parts = connected_components(rows.select(F.struct("to", F.col(a).alias("u")).alias("a"), F.struct("to", F.col(b).alias("u")).alias("b")))
        large = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("component.to", "component.u")
        first = large.join(owner, "u").groupBy(group).agg(F.min("to").alias("__over"))
        judged = wide.withColumn("tried", tried).join(first, group, "left")
        fits = F.array_max(F.filter("tried", lambda t: F.col("__over").isNull() | (t < F.col("__over"))))
        judged = judged.select(group, F.coalesce(fits, "fits").alias("fits"), F.coalesce("__over", "over").alias("over"))
        spans = durable(spans.where("over - fits <= 1").unionByName(judged))
    return steps.join(spans.select(group, F.col("fits").alias("at")), [group, "at"]).select(group, *step)
