"""Best-fit packing of documents into sequences of a fixed number of words.

Bins lie in order of their free space. A bin carries a bitmap of the sources and one of the
duplicate clusters it holds; two pieces conflict if they share a source or a cluster. The search starts at
the tightest bin that has room and goes on to its successors until one has no conflict.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .arrays import chunks, words_of

CAPACITY = 1024
GROUP = 20_000


class Bins:
    """Open bins by free space; bins of equal space and sources lie together, so a conflict of sources skips them at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free = 0  # bit r: some bin has r words free
        self.at: dict[int, dict[int, dict[int, int]]] = defaultdict(dict)  # free space -> sources -> bin -> clusters
        self.n = 0

    def find(self, need: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        rest = self.free >> need
        r = need
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for sources, bins in self.at[r].items():
                if not sources & source:
                    for b, clusters in bins.items():
                        if not clusters & cluster:
                            return r, sources, b
            rest >>= step + 1
            r += 1
        return None

    def put(self, need: int, source: int, cluster: int) -> int:
        found = self.find(need, source, cluster)
        if found:
            r, sources, b = found
            clusters = self.at[r][sources].pop(b)
            if not self.at[r][sources]:
                del self.at[r][sources]
            if not self.at[r]:
                self.free &= ~(1 << r)
        else:
            r, sources, clusters, b = self.capacity, 0, 0, self.n
            self.n += 1
        left = r - need
        if left:
            self.at[left].setdefault(sources | source, {})[b] = clusters | cluster
            self.free |= 1 << left
        return b


def pack_group(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Bins of the pieces of one group, longest pieces first. Expects doc_id, source, cluster, piece, n_words."""
    rows = rows.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
    bit = {s: 1 << i for i, s in enumerate(sorted(rows["source"].unique()))}
    seen = rows["cluster"].value_counts()
    shared = {c: 1 << i for i, c in enumerate(sorted(seen[seen > 1].index))}  # a cluster of one cannot conflict
    bins = Bins(capacity)
    rows["bin"] = [
        bins.put(max(n, 0), bit[s], shared.get(c, 0)) for n, s, c in zip(rows["n_words"].tolist(), rows["source"], rows["cluster"].tolist(), strict=True)
    ]
    return rows


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w = words_of(batch.column("text"), lower=True)
        n, first = w.counts(), w.first()
        cluster = [xxhash.xxh3_64_intdigest(w.h[a:b].tobytes()) - 2**63 for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("__run"), batch.column("__place"), batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array(n.astype(np.int64)), pa.array(cluster, pa.int64())],
            ["__run", "__place", "doc_id", "source", "n_words", "cluster"],
        )


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, order: list[Column] | None = None) -> DataFrame:
    """``(bin, doc_id, source, piece, first_word, n_words, cluster)``: every word of every row in one bin.

    A text longer than ``capacity`` is cut into whole sequences, each a bin of its own, and a rest;
    these pieces share the document's source and cluster. No bin holds more than ``capacity``
    words, two pieces of one source, or two of one duplicate cluster (equal words, letter case
    aside, unless ``docs`` brings a column ``cluster`` of longs). Pieces are dealt by hash and position into
    groups of about ``group``, packed apart; so hot sources, clusters and repeated rows spread over all. With ``order``, a
    number of a run of rows and a place in it, both from ``docs``, a group is ``group`` rows that follow each other in that order,
    and bins are named by it. Bins are named ``group:number``.

    Null and empty texts have one piece of 0 words, in a bin like others. Null sources are one
    source, named ''. Repeated rows are packed each. An empty table gives no rows. Other columns are ignored.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    own = "cluster" in docs.columns
    run, place = order or (F.lit(0), F.lit(0))
    docs = docs.withColumns({"__run": run.cast("long"), "__place": place.cast("long")})
    picked = docs.select("__run", "__place", F.col("doc_id").cast("long").alias("doc_id"), source, "text", *([F.col("cluster").cast("long").alias("__own")] if own else []))
    if own:
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        measured = picked.select("__run", "__place", "doc_id", "source", words.cast("long").alias("n_words"), F.coalesce("__own", F.xxhash64("text")).alias("cluster"))
    else:
        measured = picked.mapInArrow(_measure, "__run long, __place long, doc_id long, source string, n_words long, cluster long")
    measured = durable(measured).withColumn("__row", F.monotonically_increasing_id())  # of a written table: the same whenever it is read
    whole = F.expr(f"sequence(0, greatest(cast(ceil(n_words / {capacity}) as int) - 1, 0))")
    pieces = measured.select("__row", "__run", "__place", "doc_id", "source", "cluster", F.explode(whole).alias("piece"), F.col("n_words").alias("__n")).select(
        "__row", "__run", "__place", "doc_id", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"),
        F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("piece") * capacity).alias("n_words"),
    )
    full, rest = pieces.where(F.col("n_words") == capacity), pieces.where(F.col("n_words") < capacity)
    if order:
        rest = rest.withColumn("group", F.format_string("%08d-%08d", "__run", F.floor(F.col("__place") / group)))
    else:
        groups = max(1, -(-measured.count() // group))
        rest = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "__row"), F.lit(groups)).cast("string"))
    rest = rest.drop("__row", "__run", "__place")
    schema = "doc_id long, source string, cluster long, piece int, first_word long, n_words long, group string, bin long"
    packed = rest.groupBy("group").applyInPandas(lambda rows: pack_group(rows, capacity), schema)
    name = F.concat_ws(":", "group", F.col("bin").cast("string"))
    alone = F.concat_ws(":", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"), F.col("__row").cast("string"))
    columns = ["doc_id", "source", "piece", "first_word", "n_words", "cluster"]
    return full.select(alone.alias("bin"), *columns).unionAll(packed.select(name.alias("bin"), *columns))
