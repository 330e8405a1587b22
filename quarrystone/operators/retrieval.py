"""The retrieval assistant's data operators: hashed embeddings, exact cosine search, chunking and routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 256
#: The least score of a relevant chunk, the longest chunk, and the most tools of a question.
FLOOR, CHUNK_CHARS, MOST_TOOLS = 0.25, 900, 6
#: The most vectors that a task compares with, and pairs that it compares at a time.
SLAB, BLOCK = 32_768, 2**21
BLANK = " \t\n\r"
#: Words of a question and the tool that they call, in order.
ROUTES = [
    (["segment", "high value", "high-value", "high value segment"], "get_customer_segments"),
    (["identit", "same customer", "merge", "linked"], "get_customer_identities"),
    (["quality", "data issue", "dq ", "data-quality"], "get_customer_quality"),
    (["timeline", "recent", "activity", "history", "changed", "event"], "get_customer_timeline"),
    (["rfm", "metric", "value", "spend", "clv", "churn", "engagement"], "get_customer_metrics"),
]
#: The tools and the least role that may call each.
TOOLS = {
    "get_customer_profile": "viewer", "get_customer_metrics": "viewer", "get_customer_segments": "viewer", "get_customer_timeline": "viewer",
    "get_customer_identities": "analyst", "get_customer_quality": "analyst", "get_segment_definition": "viewer", "get_data_quality_summary": "viewer",
}


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def embedding_entries(df: DataFrame, key: str, text: str, dim: int = DIMENSIONS) -> DataFrame:
    """The non-zero entries ``(key, idx, value)`` of each text's hashed, normalised embedding.

    A token adds 1 or -1, by the parity of its hash's fifth byte, at the first four bytes modulo ``dim``. Texts without tokens, or whose entries cancel, have none.
    """
    each = df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    digest = F.sha2("token", 256)
    idx = (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = each.groupBy(key, idx.alias("idx")).agg(F.sum(F.col("n") * sign).alias("v")).where("v <> 0")
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return sums.join(norm, key).select(key, "idx", (F.col("v") / F.col("norm")).alias("value"))


def embed(df: DataFrame, key: str, text: str, dim: int = DIMENSIONS) -> DataFrame:
    """``(key, embedding)`` as an array of ``dim`` numbers, zeros for texts without tokens."""
    entries = embedding_entries(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    at = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))
    return df.select(key).join(entries, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(k, v)``: rows with a key and a vector without nulls."""
    picked = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    return picked.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where(~F.exists("v", F.isnull))


def slab_rows(n: int) -> int:
    """Vectors of a slab, about: as many as a task holds, or fewer to keep 24 tasks busy."""
    return max(256, min(SLAB, n // 24))


def _best(q: np.ndarray, qi: np.ndarray, v: np.ndarray, vi: np.ndarray, vn: np.ndarray, unit: np.ndarray, taken: np.ndarray | None, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of ``v`` for each row of ``q``: a matrix product rules out what is surely not among them, the others are scored by sums in order of dimensions.

    ``taken`` says for each query which units must be compared; where that is much of all, all are.
    """
    qn = np.sqrt(np.cumsum(q * q, axis=1)[:, -1])
    long = qn > 0
    q, qi, qn = q[long], qi[long], qn[long]
    one = q / qn[:, None]
    if taken is None or taken[long].mean() > 0.25:
        near = one @ (v / vn[:, None]).T
    else:
        taken, near = taken[long], np.full((len(q), len(v)), -3.0)
        ends = np.searchsorted(unit, np.arange(taken.shape[1] + 1))
        for u in np.nonzero(taken.any(axis=0) & (ends[1:] > ends[:-1]))[0]:
            at, rows = slice(ends[u], ends[u + 1]), taken[:, u]
            near[rows, at] = one[rows] @ (v[at] / vn[at, None]).T
    least = np.maximum(np.partition(near, -k, axis=1)[:, -k] - 1e-9, -2.0) if len(v) > k else np.full(len(q), -2.0)
    a, b = np.nonzero(near >= (least if floor is None else np.maximum(least, floor - 1e-9))[:, None])
    score = np.zeros(len(a))
    for j in range(q.shape[1]):
        score += q[a, j] * v[b, j]
    score /= qn[a] * vn[b]
    if floor is not None:
        a, b, score = (x[score >= floor] for x in (a, b, score))
    order = np.lexsort((vi[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    best = np.arange(len(a)) - np.searchsorted(a, a) < k
    return qi[a[best]], vi[b[best]], score[best]


def best_of_slabs(vectors: DataFrame, asked: DataFrame, slabs: int, k: int, key: str, floor: float | None = None, units: list[int] | None = None) -> DataFrame:
    """``(query_id, key, score)``: each query's k best of the slabs that it is sent to, ties by key.

    ``vectors(slab, unit, k, v)`` and ``asked(slab, k, v, taken)`` meet in one shuffle of single rows: a task holds the vectors of a slab, whose number has a bound,
    and the slab's queries stream past them. ``taken`` has a bit for each of the slab's ``units``, or is null for all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slab, held, ready = None, [], {}
        for f in frames:
            for s, same in f.groupby("slab"):
                if s != slab:
                    slab, held, ready = s, [], {}
                if len(new := same[same["side"] == 0]):
                    held.append(new)
                queries = same[same["side"] == 1]
                if not len(queries) or not held and not ready:
                    continue
                if held:
                    every = pd.concat(held).sort_values("unit", kind="stable")
                    held = []
                    for dim, g in every.groupby(every["v"].map(len)):
                        v = np.stack(g["v"].to_numpy()).astype(np.float64)
                        vn = np.sqrt(np.cumsum(v * v, axis=1)[:, -1])
                        if (vn > 0).any():
                            ready[dim] = v[vn > 0], g["k"].to_numpy(np.int64)[vn > 0], vn[vn > 0], g["unit"].to_numpy()[vn > 0]
                for dim, g in queries.groupby(queries["v"].map(len)):
                    if dim not in ready:
                        continue
                    v, vi, vn, unit = ready[dim]
                    rows = max(16, BLOCK // len(v))
                    for at in range(0, len(g), rows):
                        part = g.iloc[at : at + rows]
                        taken = None
                        if units is not None:
                            bits = np.stack([np.frombuffer(t, np.uint8) for t in part["taken"]])
                            taken = np.unpackbits(bits, axis=1, count=units[s]).astype(bool)
                        ids, near, score = _best(np.stack(part["v"].to_numpy()).astype(np.float64), part["k"].to_numpy(np.int64), v, vi, vn, unit, taken, k, floor)
                        yield pd.DataFrame({"query_id": ids, key: near, "score": score})

    sides = vectors.select("slab", F.lit(0).alias("side"), "unit", "k", "v", F.lit(None).cast("binary").alias("taken")).unionByName(
        asked.select("slab", F.lit(1).alias("side"), F.lit(0).alias("unit"), "k", "v", "taken")
    )
    met = sides.repartitionById(slabs, F.col("slab")).sortWithinPartitions("slab", "side")
    found = met.mapInPandas(run, f"query_id long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """``(query_id, key, score)``: for every row of ``queries`` the k rows of highest cosine similarity, exactly; ties by key.

    Vectors are dealt into slabs of a bounded size, each query is sent to each slab, and the slabs' best are merged by query. Rows without a vector, or whose length
    is 0, have none.
    """
    every, asked = usable(vectors, key, vector), usable(queries, key, vector)
    n = every.count()
    slabs = n // slab_rows(n) + 1
    dealt = every.select(F.pmod(F.xxhash64("k", "v"), F.lit(slabs)).cast("int").alias("slab"), F.lit(0).alias("unit"), "k", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), "k", "v", F.lit(None).cast("binary").alias("taken"))
    return best_of_slabs(dealt, sent, slabs, k, key, floor)


def _parts(body: Column, longest: int) -> Column:
    """A section's text as it is if it is short, else its paragraphs, as many in a part as fit; a longer paragraph is a part of its own."""
    paragraphs = F.filter(F.split(body, "\n\n"), lambda p: F.btrim(p, F.lit(BLANK)) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(held: Column, p: Column) -> Column:
        joined = F.concat(held["open"], F.lit("\n\n"), p)
        full = F.struct(F.array_append(held["done"], held["open"]).alias("done"), p.alias("open"))
        return F.when(held["open"] == "", F.struct(held["done"].alias("done"), p.alias("open"))).when(F.length(joined) <= longest, F.struct(held["done"].alias("done"), joined.alias("open"))).otherwise(full)

    packed = F.aggregate(paragraphs, start, add, lambda held: F.array_append(held["done"], held["open"]))
    short = F.filter(F.array(body), lambda b: b != "")
    return F.when(F.length(body) <= longest, short).otherwise(F.transform(packed, lambda p: F.btrim(p, F.lit(BLANK))))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = CHUNK_CHARS) -> DataFrame:
    """``(key, chunk_no, section, content)`` of Markdown texts: by second and third level headings, long sections by paragraphs.

    What stands before the first heading is the section "Introduction"; parts of a long section are numbered in its name.
    Lines end with a line feed, a carriage return or both. Null and blank texts have no chunks; rows that repeat a key are cut each.
    """
    whole = F.concat(F.lit("## Introduction\n"), F.regexp_replace(text, "\r\n?", "\n"))
    cut = F.transform(F.split(whole, "(?<=\n)(?=##{1,2} )"), lambda s: F.struct(
        F.btrim(F.regexp_replace(F.substring_index(s, "\n", 1), "^#+", ""), F.lit(BLANK)).alias("heading"),
        F.btrim(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s)), F.lit(BLANK)).alias("body"),
    ))
    parted = F.transform(cut, lambda s: F.struct(s["heading"].alias("heading"), _parts(s["body"], longest).alias("parts")))
    number = lambda i: F.concat(F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))
    name = lambda s, i: F.concat(s["heading"], F.when(F.size(s["parts"]) > 1, number(i)).otherwise(""))
    every = F.flatten(F.transform(parted, lambda s: F.transform(s["parts"], lambda p, i: F.struct(name(s, i).alias("section"), p.alias("content")))))
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(every).alias("chunk_no", "c")).select(key, "chunk_no", "c.section", "c.content")


def routed(question: Column, has_customer: Column, most: int = MOST_TOOLS) -> Column:
    """The tools that a question calls, in order: none without a customer."""
    q = F.lower(question)
    named = []
    for words, tool in ROUTES:
        hit = F.contains(q, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(q, F.lit(w))
        named.append(F.when(hit, F.lit(tool)))
    every = F.slice(F.array_compact(F.array(F.lit("get_customer_profile"), *named)), 1, most)
    return F.when(has_customer, every).otherwise(F.expr("cast(array() as array<string>)"))
