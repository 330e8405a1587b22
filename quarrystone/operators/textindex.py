"""Substring search by an index of trigrams with their positions.

A value has a gram at each position: the three characters from there on, or what is left of them with an end mark. So a pattern of three or more
characters is at a position exactly if its grams are at the right distances, and a shorter one is the beginning of a gram. The index is Parquet in
ranges of grams, so a search reads the row groups of its grams alone, and a frequent gram lies in many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks behind the end of a value, and before a whole key.
END, WHOLE = "\x00", "\x01"


def postings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(gram, key, field, pos)`` of the lower-cased ``fields`` of ``df``, and of each key as a whole. Null values have no grams, and an empty one has a mark alone.

    Keys are compared as strings; rows that repeat one are found as one.
    """
    text = lambda c: F.concat(F.lower(F.col(c).cast("string")), F.lit(END * 3))
    named = F.array(*[F.struct(F.lit(i).alias("field"), text(c).alias("text")) for i, c in enumerate(fields)])
    rows = df.select(F.col(key).cast("string").alias("key"), F.inline(named)).where("text is not null")
    grams = F.transform(F.sequence(F.lit(0), F.length("text") - 3), lambda i: F.struct(F.substring(F.col("text"), i + 1, F.lit(3)).alias("gram"), i.alias("pos")))
    parts = rows.select("key", "field", F.inline(grams)).select("gram", "key", "field", "pos")
    whole = df.where(F.col(key).isNotNull()).select(F.concat(F.lit(WHOLE), F.col(key).cast("string")).alias("gram"), F.col(key).cast("string").alias("key"), F.lit(-1).alias("field"), F.lit(0).alias("pos"))
    return parts.unionAll(whole)


def write(df: DataFrame, path: str) -> DataFrame:
    """The postings as Parquet in ranges of gram and key, and the table read back."""
    df.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cover(q: str) -> list[int]:
    """Positions whose grams make up a pattern of three characters or more."""
    return [*range(0, len(q) - 3, 3), len(q) - 3]


def find(index: DataFrame, q: str) -> DataFrame:
    """``(key)`` of the rows one of whose fields contains ``q`` in any case, or whose key is ``q``; every key once.

    The gram of the pattern that is least frequent gives the candidates, and each other gram keeps those that it stands beside. Nothing is read
    but the postings of these grams. An empty pattern is in every row that has a field.
    """
    low = q.lower()
    exact = index.where(F.col("gram") == WHOLE + q).select("key")
    if len(low) < 3:
        return index.where(F.col("gram").startswith(low) & (F.col("field") >= 0)).select("key").unionAll(exact).distinct()
    at = {i: low[i : i + 3] for i in cover(low)}
    counted = index.where(F.col("gram").isin(sorted(set(at.values())))).groupBy("gram").agg(F.count("*").alias("n"))
    sizes = {r["gram"]: r["n"] for r in counted.collect()}  # one row a gram of the pattern
    if len(sizes) < len(set(at.values())):
        return exact.distinct()
    starts = lambda i: index.where(F.col("gram") == at[i]).select("key", "field", (F.col("pos") - i).alias("start"))
    first, *others = sorted(at, key=lambda i: (sizes[at[i]], i))
    hits = starts(first)
    for i in others:
        hits = starts(i).join(hits, ["key", "field", "start"], "left_semi")
    return hits.select("key").unionAll(exact).distinct()


def search(index: DataFrame, customers: DataFrame, key: str, q: str) -> DataFrame:
    """The rows of ``customers`` that ``find`` gives; the join is on keys, so what is known of their layout (buckets, statistics) is used."""
    found = find(index, q).withColumnRenamed("key", "__found")
    return customers.join(found, customers[key].cast("string") == found["__found"], "left_semi")
