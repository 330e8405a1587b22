"""Near-duplicate documents by probability MinHash, banding and exact verification.

A text's elements are its distinct runs of five words, and an element weighs as much as it has repeats in the
text. Each element is a Poisson process whose rate is its weight and whose randomness is its hash; every arrival
falls in one of the signature's registers, a register keeps the earliest, and an element stops as soon as its next
arrival is later than every register of its text (ProbMinHash). Two signatures then agree in a register with the
probability Jaccard similarity of the weighted runs. That is what bands and estimates are laid out for, and what is
verified exactly: the sum over the shared runs d of 1 / sum over all runs z of max(x[z] / x[d], y[z] / y[d]), for
weights x and y. For texts that repeat no run it is the Jaccard similarity of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.durable import durable
from .arrays import U, chunks, mix, words_of

SHINGLE = 5
BANDS, ROWS = 40, 6
#: The first 240 registers make the bands; of all, so many random bits are kept to estimate similarities, each bit in so many longs.
REGISTERS, BITS, LONGS = 480, 4, 8
#: Registers that differ at similarity 0.8: 48 are expected by their first bits, 90 by all, and either limit is exceeded once in 300,000 pairs.
MOST_BY_FIRST, MOST = 80, 130
#: Texts a side of a tile of a bucket.
TILE = 2048
SIG_SCHEMA = "doc_id long, tag long, th binary, v long, bands array<long>, bits array<long>"


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct elements of each text and their counts, in order of text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures, one row a text; rows of texts without elements are zero."""
    first = np.full(n_docs * registers, np.inf)
    sig = np.zeros(n_docs * registers, U)
    t, r = np.zeros(len(h)), 0
    while len(h):
        x = mix(h + U(0x632BE59BD9B4E019 * (r + 1) % 2**64))
        t = t - np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        key = doc * registers + (((mix(x) >> U(32)) * U(registers)) >> U(32)).astype(np.int64)
        np.minimum.at(first, key, t)
        won = t == first[key]
        sig[key[won]] = h[won]
        r += 1
        if r < 8 or r % 16 == 0:
            on = np.unique(doc)
            last = np.full(n_docs, -1.0)
            last[on] = first.reshape(n_docs, registers)[on].max(axis=1)
            alive = t < last[doc]
            doc, h, weight, t = doc[alive], h[alive], weight[alive], t[alive]
    return sig.reshape(n_docs, registers)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = pc.fill_null(batch.column("text"), "")
        w = words_of(texts)
        doc, h, count = weighted(*w.shingles(SHINGLE))
        sig = prob_minhash(doc, h, count.astype(np.float64), w.n_docs)
        has = np.bincount(doc, minlength=w.n_docs) > 0
        band = np.arange(BANDS, dtype=U)[None, :] * U(0xA0761D6478BD642F)
        parts = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        for i in range(ROWS):
            band = mix(band + parts[:, :, i])
        bits = np.zeros((w.n_docs, BITS, 8 * LONGS), np.uint8)
        mixed = mix(sig + np.arange(1, REGISTERS + 1, dtype=U) * U(0xD6E8FEB86659FD93))
        for i in range(BITS):
            bits[:, i, : REGISTERS // 8] = np.packbits((mixed >> U(i) & U(1)).astype(bool), axis=1)
        bits = bits.reshape(w.n_docs, -1).view(np.int64)
        th = [xxhash.xxh3_128_digest(x.as_buffer()) if x.is_valid else b"" for x in texts.cast(pa.binary())]
        offsets = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("tag"),
                pa.array(th, pa.binary()),
                pa.array([int.from_bytes(x[:8], "little", signed=True) for x in th], pa.int64()),
                pa.ListArray.from_arrays(offsets, band[has].view(np.int64).ravel()),
                pa.ListArray.from_arrays(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32), bits.ravel()),
            ],
            ["doc_id", "tag", "th", "v", "bands", "bits"],
        )


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact probability Jaccard similarity of the five-word runs of a[i] and b[i], weighed by their counts; 0 if neither has any.

    With the runs of a pair in order of y[z] / x[z], the larger of x[z] / x[d] and y[z] / y[d] is the first for runs z up to
    d and the second for those after it, so two running sums give every term.
    """
    (da, ha, ca), (db, hb, cb) = (weighted(*words_of(t).shingles(SHINGLE)) for t in (a, b))
    doc, h = np.concatenate((da, db)), np.concatenate((ha, hb))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    run = np.cumsum(new) - 1
    doc = doc[order][new]
    x, y = np.zeros(len(doc)), np.zeros(len(doc))
    first = order < len(da)
    x[run[first]], y[run[~first]] = ca[order[first]], cb[order[~first] - len(da)]
    order = np.lexsort((np.arctan2(y, x), doc))
    doc, x, y = doc[order], x[order], y[order]
    size = np.bincount(doc, minlength=len(a))
    upto, after = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    start, end = (np.cumsum(size) - size)[doc], np.cumsum(size)[doc]
    at = np.flatnonzero((x > 0) & (y > 0))
    below, above = upto[at + 1] - upto[start[at]], after[end[at]] - after[at + 1]
    return np.bincount(doc[at], 1 / (below / x[at] + above / y[at]), len(a)).round(12)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_b", 1 << 20):
            keep = pa.array(similarities(batch.column("text_a"), batch.column("text_b")) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _linked(pairs: DataFrame, docs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (va, vb) whose whole texts are as similar as ``least``, as (a, b) text hashes."""
    need = pairs.select(F.col("va").alias("v")).unionAll(pairs.select(F.col("vb").alias("v"))).distinct()
    first = texts.select("th", "v", "tag", F.col("doc_id").alias("__id")).join(need.hint("merge"), "v")
    same = docs["doc_id"].eqNullSafe(first["__id"]) & (F.xxhash64(docs["text"]) == first["tag"])
    whole = durable(docs.join(first.hint("merge"), same).select("th", "v", "text").dropDuplicates(["th"]))
    one = pairs.join(whole.select(F.col("v").alias("vb"), F.col("th").alias("b"), F.col("text").alias("text_b")).hint("merge"), "vb")
    two = one.join(whole.select(F.col("v").alias("va"), F.col("th").alias("a"), F.col("text").alias("text_a")).hint("merge"), "va")
    return durable(two.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), "a binary, b binary"))


def _close(x: str, y: str) -> Column:
    """Whether two signatures are as close as similar texts' are: by the first bits, which rule out most pairs in compiled code, then by all."""
    first = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(LONGS)), F.lit(0))
    step = lambda n, i: n + F.bit_count(reduce(Column.bitwiseOR, [F.get(x, i + k).bitwiseXOR(F.get(y, i + k)) for k in range(0, BITS * LONGS, LONGS)]))
    every = F.aggregate(F.array(*map(F.lit, range(LONGS))), F.lit(0), step)
    return (first <= MOST_BY_FIRST) & (every <= MOST)


def _buckets(texts: DataFrame) -> DataFrame:
    """``(bucket, v, size, centre)`` of buckets with several texts; the centre is the text that meets most others over all its buckets."""
    every = texts.select("v", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = durable(every.join(shared.hint("merge"), "bucket"))
    met = held.groupBy("v").agg(F.sum("size").alias("met"))
    centres = held.join(met.hint("merge"), "v").groupBy("bucket").agg(F.max_by("v", "met").alias("centre"))
    return durable(held.join(centres.hint("merge"), "bucket"))


def _between(wide: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a bucket, of different classes, whose signatures do not rule out that they are linked.

    Texts outside the class of a bucket's centre are held against all others of the bucket, so a bucket that is one
    class but for a few texts costs a few rows for each of its texts. A bucket of many classes is compared in tiles of at
    most about ``TILE`` texts by as many, so it is spread over tasks. A pair comes from the least bucket that it shares, and not if that
    bucket's centre is one of the two: those are judged already.
    """
    known = texts.select("th", "v").join(classes.withColumnRenamed("vertex", "th"), "th", "left")
    label = known.select("v", F.xxhash64(F.coalesce("component", "th")).alias("label"))
    rows = durable(wide.join(label.hint("merge"), "v"))
    several = rows.groupBy("bucket").agg(
        F.min("label").alias("a"), F.max("label").alias("z"), F.max_by("label", F.col("v") == F.col("centre")).alias("main"),
        F.ceil(F.count("*") / TILE).cast("int").alias("tiles"),
    )
    rows = rows.join(several.where("a <> z").drop("a", "z").hint("merge"), "bucket").where("v <> centre")
    rows = rows.withColumn("tile", F.pmod("v", "tiles").cast("int"))
    rows = durable(rows.join(texts.select("v", "bands", "bits").hint("merge"), "v"))
    other = lambda side: F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(side)
    x = rows.where("label <> main").select("*", F.col("tile").alias("left"), other("right")).alias("x")
    y = rows.select("*", other("left"), F.col("tile").alias("right")).alias("y")
    pairs = x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.left") == F.col("y.left")) & (F.col("x.right") == F.col("y.right"))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main")) | (F.col("x.v") < F.col("y.v")))
        & _close("x.bits", "y.bits")
        & (F.col("x.bucket") == F.array_min(F.array_intersect("x.bands", "y.bands"))),
    )
    return pairs.select(F.col("x.v").alias("va"), F.col("y.v").alias("vb"))


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``(doc_id, class_id, class_key, text_key)``, one row for each row of ``docs(doc_id, text)``.

    Documents whose texts are equal, or are linked by a chain of pairs with a probability Jaccard
    similarity of at least ``least`` (0.8 or more) between their five-word runs, weighed by counts, share a class; ``class_id`` is its
    smallest doc_id. Exact copies are folded first, so they cost one signature entry. Within a
    bucket every text is compared with the bucket's centre, the text that shares most buckets with others. Where a bucket then still holds several
    classes, pairs between those classes follow whose signatures do not rule out a link. So no group is expanded into all pairs,
    and a link between different texts is found whatever the size of its bucket. At similarity 0.8 a pair shares none of the 40
    bands, or is ruled out, once in 100,000.

    Null texts count as empty; empty texts are copies of each other; a text of one to four words is
    one run. Rows that repeat a doc_id with another text are judged by their own text. Rows with a
    null doc_id get the class of their text. Other columns are ignored; an empty table gives none.
    """
    if least < 0.8:
        raise ValueError("bands and estimates are laid out for similarities of 0.8 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sig = durable(docs.withColumn("tag", F.xxhash64("text")).mapInArrow(_signatures, SIG_SCHEMA))
    texts = durable(sig.dropDuplicates(["th"]))
    held = _buckets(texts)
    links = _linked(durable(held.where("v <> centre").select(F.col("centre").alias("va"), F.col("v").alias("vb")).distinct()), docs, texts, least)
    classes = connected_components(links)

    wide = held.where("size > 2").select("bucket", "v", "centre")
    pairs = durable(_between(wide, texts, classes))
    if not pairs.isEmpty():
        more = _linked(pairs, docs, texts, least)
        if not more.isEmpty():
            classes = connected_components(links.unionAll(more))

    rows = sig.select("doc_id", "tag", "th").join(classes.withColumnRenamed("vertex", "th"), "th", "left")
    rows = rows.select("doc_id", "tag", F.coalesce("component", "th").alias("root"))
    least_id = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least_id, "root").select("doc_id", "class_id", F.hex("root").alias("class_key"), F.col("tag").alias("text_key"))


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest doc_id.

    Columns stay as they are. Repeats of a kept row go too; a row without a doc_id stays only where
    its class has no document with one. Null texts count as empty ones.
    """
    found = near_duplicates(docs, least).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = found.groupBy("class_key").agg(F.min("class_id").alias("__id"), F.min("text_key").alias("__key")).drop("class_key")
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["__key"])
    return docs.join(kept.hint("merge"), same).drop("__id", "__key").dropDuplicates(["doc_id", "text"])
