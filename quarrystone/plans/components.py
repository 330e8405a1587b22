"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a vertex on the least vertex around it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a vertex, and itself, on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Vertices with several parents, or with a parent and children; where there are none, each component hangs on its least vertex."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` of every vertex that has an edge; the component is its least vertex.

    Large-star and small-star rounds alternate until every component is a star. A hot vertex
    costs no list: each round is a map-side combined minimum and a join, and skewed joins are
    split by adaptive execution. Null ends, loops and repeated edges are ignored; an empty table
    gives an empty result. Each round is written to the shared folder.
    """
    now = durable(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        now = durable(_small_star(_large_star(now)))
        if _unsettled(now).isEmpty():
            roots = now.select(F.col("v").alias("vertex")).distinct()
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(
                roots.select("vertex", F.col("vertex").alias("component"))
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labels_of(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (u, v) between what their ends are labelled with; an unknown end is its own label."""
    for end in ("u", "v"):
        known = labels.select(F.col("vertex").alias(end), F.col("component").alias("__l"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce("__l", end)).drop("__l")
    return edges.where("u <> v")


def changed_components(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, component)`` of the vertices whose component is another after a change of edges than in ``labels(vertex, component)``, or that are new.

    ``edges`` are all edges after the change. Added edges are contracted to edges between the labels of their ends, so components that
    they join are one vertex each, whatever their size. A component that loses an edge falls apart into its vertices, and its own
    edges that are left count as added. Components that no change touches are neither joined anew nor rewritten. A vertex that has lost
    all its edges is its own component.
    """
    ends = lambda df: df.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    broken = durable(ends(removed).join(labels, F.col("u") == F.col("vertex")).select("component").distinct())
    apart = durable(labels.join(broken, "component", "left_semi").select("vertex", F.col("vertex").alias("component"), F.col("component").alias("was")))
    kept = labels.join(broken, "component", "left_anti").select("vertex", "component")
    own = ends(edges).join(apart.select(F.col("vertex").alias("u")), "u", "left_semi").select("u", "v")
    delta = ends(added).unionAll(own).distinct()
    now = kept.unionAll(apart.select("vertex", "component"))
    moved = connected_components(_labels_of(delta, now), "u", "v").withColumnsRenamed({"vertex": "__from", "component": "__to"})
    new = delta.select(F.explode(F.array("u", "v")).alias("vertex")).distinct().join(labels, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"), F.lit(None).cast(labels.schema["component"].dataType).alias("was"))
    touched = kept.join(moved, kept["component"] == moved["__from"], "left_semi").select("vertex", "component", F.col("component").alias("was"))
    out = touched.unionAll(apart).unionAll(new)
    out = out.join(moved, out["component"] == moved["__from"], "left").select("vertex", F.coalesce("__to", "component").alias("component"), "was")
    return durable(out.where(~F.col("component").eqNullSafe(F.col("was"))).select("vertex", "component"))


def updated_components(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All labels after the change: those of ``labels`` with what ``changed_components`` gives in their place."""
    changed = changed_components(labels, edges, added, removed, a, b)
    return labels.join(changed, "vertex", "left_anti").select("vertex", "component").unionAll(changed)
