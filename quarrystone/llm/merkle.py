"""A Merkle manifest of a dataset: leaves in blocks of fixed size, collapsed inside Spark's own array functions.

Each language is a tree of arity 8. Its ordered leaves are dealt into blocks of 512, which are arrays; three levels of a block
collapse by sequence, transform and slice, and the block roots are the leaves of the next round, until one is left. The
subroots of the languages make the last tree. No Python and no RDD code runs on this path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable

ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def counted(c: str | Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    return digest(*[counted(c) for c in ("doc_id", "source", "lang", "n_chars")], counted(text))


def tampered_text() -> Column:
    """The text with A-Z lowered where 3 divides the crc32 of the decimal doc_id; null for the other rows, which nobody tampers with."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER))


def numbered(df: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its tree, from 0, and ``total``, the rows of its tree.

    Rows are dealt by ranges of the order; each range numbers its own and is moved up by the counts of those before it, one number a range and tree.
    """
    dealt = durable(df.repartitionByRange(F.col(tree).asc_nulls_first(), *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part", F.col(tree).alias("__tree")).agg(F.count("*").alias("__n"))
    inside = Window.partitionBy("__tree")
    before = F.coalesce(F.sum("__n").over(inside.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select("__part", "__tree", before.alias("__before"), F.sum("__n").over(inside).alias("total")).withColumnRenamed("__part", "__p")
    own = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__part", tree).orderBy(*order)) - 1)
    both = own.join(moved, (F.col("__part") == F.col("__p")) & F.col(tree).eqNullSafe(F.col("__tree")))
    return both.withColumn("pos", F.col("__k") + F.col("__before")).drop("__part", "__p", "__tree", "__k", "__before")


def _level(nodes: str, alone: Column) -> Column:
    """Every eight consecutive nodes as their digest; the one node that is left of a tree stays."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    made = F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")))
    return F.when(alone & (F.size(nodes) == 1), F.col(nodes)).otherwise(made)


def blocks(nodes: DataFrame, tree: str) -> DataFrame:
    """``(tree, block, total, items, l0, l1, l2, root)`` of ``nodes(tree, pos, total, node, item)``: ordered arrays, their levels and roots."""
    rows = nodes.groupBy(tree, F.floor(F.col("pos") / BLOCK).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "item"))).alias("rows"))
    out = rows.select(tree, "block", "total", F.col("rows.item").alias("items"), F.col("rows.node").alias("l0"))
    alone = F.col("total") <= BLOCK
    for i in range(LEVELS):
        out = out.withColumn(f"l{i + 1}", _level(f"l{i}", alone))
    return durable(out.withColumn("root", F.col(f"l{LEVELS}")[0]).drop(f"l{LEVELS}"))


def path_in(i: Column) -> Column:
    """From row i of a block up to its root: on each level the joined digests left and right of it in its run."""
    steps = []
    for j in range(LEVELS):
        own = F.floor(i / ARITY**j).cast("int")
        start = F.floor(i / ARITY ** (j + 1)).cast("int") * ARITY
        part = lambda a, n, j=j: F.array_join(F.slice(f"l{j}", a + 1, n), "")
        step = F.struct(part(start, own - start).alias("left"), part(own + 1, start + ARITY - 1 - own).alias("right"))
        steps.append(F.when((F.size(f"l{j}") > 1) | (F.col("total") > BLOCK), step))
    return F.array_compact(F.array(*steps))


def climbed(nodes: DataFrame, tree: str) -> list[DataFrame]:
    """Blocks of the leaves, blocks of their roots, and so on until every tree is one block.

    Each round has one node for 512 of the round before, so three rounds take up 134 million leaves a tree.
    """
    rounds = [blocks(nodes, tree)]
    while not rounds[-1].where(F.col("total") > BLOCK).isEmpty():
        size = F.ceil(F.col("total") / BLOCK).cast("long")
        rounds.append(blocks(rounds[-1].select(tree, F.col("block").alias("pos"), size.alias("total"), F.col("root").alias("node"), F.col("block").alias("item")), tree))
    return rounds


def descended(rounds: list[DataFrame], tree: str, above: DataFrame) -> DataFrame:
    """The blocks of the leaves with ``path``, from their roots up to the end of the path that ``above(tree, path, ...)`` has for each tree.

    The paths are joined to the top round, which has one block a tree, so no join on a tree meets all blocks of a large one.
    """
    kept = [c for c in above.columns if c not in (tree, "path")]
    over = above.withColumnRenamed(tree, "__tree")
    done = rounds[-1].join(over, rounds[-1][tree].eqNullSafe(over["__tree"])).drop("__tree")
    for below in rounds[-2::-1]:
        step = F.transform(every(), lambda i: F.struct(F.col("items")[i].alias("__block"), F.concat(path_in(i), F.col("path")).alias("path")))
        paths = done.select(F.col(tree).alias("__tree"), *kept, F.inline(step))
        done = below.join(paths, below[tree].eqNullSafe(paths["__tree"]) & (below["block"] == paths["__block"])).drop("__tree", "__block")
    return done


def every() -> Column:
    """The indices of a block's rows."""
    return F.sequence(F.lit(0), F.size("l0") - 1)


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of each row of ``docs(doc_id, source, lang, n_chars, text)``, and the root that a tampered copy folds to.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. ``changed`` is the text of the copy that is checked, or null
    where that is the row's own; by default ``tampered_text()``. Leaves of a language ascend by doc_id, rows without one first, and by their
    digests where rows repeat an id, so that wholly repeated rows give the same root in any order. A null language is a tree of its own, the
    first. Any null column counts as ``-``. A single leaf is its subroot and a single subroot the root; its proof is the digest of
    nothing. Other columns are ignored, whatever their names; an empty table gives no rows. A block is 512 digests, whatever the size
    of a tree, and nothing is collected to the driver.
    """
    copy = tampered_text() if changed is None else changed
    rows = docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(copy.isNotNull(), leaf(copy)).alias("copy"))
    rows = numbered(rows, "lang", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    low = climbed(rows.select("lang", "pos", "total", F.col("leaf").alias("node"), F.struct("doc_id", "copy").alias("item")), "lang")
    tops = low[-1].select("lang", F.col("root").alias("subroot"), F.lit(0).alias("all"))
    forest = numbered(tops, "all", [F.col("lang").asc_nulls_first()])
    high = climbed(forest.select("all", "pos", "total", F.col("subroot").alias("node"), F.struct("lang").alias("item")), "all")

    start = high[-1].select("all", F.col("root").alias("top"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    step = F.transform(every(), lambda i: F.struct(F.col("items")[i]["lang"].alias("lang"), F.col("l0")[i].alias("subroot"), F.concat(path_in(i), F.col("path")).alias("path")))
    above = descended(high, "all", start).select("top", F.inline(step))

    def proved(i: Column) -> Column:
        item, own, path = F.col("items")[i], F.col("l0")[i], F.concat(path_in(i), F.col("path"))
        proof = F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)
        fold = F.aggregate(path, F.coalesce(item["copy"], own), lambda acc, p: digest(p["left"], acc, p["right"]))
        return F.struct(item["doc_id"].alias("doc_id"), own.alias("leaf"), proof.alias("proof_sha256"), fold.alias("folded_root"))

    out = descended(low, "lang", durable(above)).select("subroot", F.col("top").alias("root"), F.inline(F.transform(every(), proved)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
