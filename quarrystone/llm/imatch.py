"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms (words, A-Z lowered) whose document frequency lies in a band, so their
inverse document frequency does. A fingerprint has one 32-bit hash for the whole lexicon and for each of 31 random
subsets, which keep an eighth to a 1024th of it: the sorted distinct terms of a text that a subset keeps
are hashed together. The likeness of two fingerprints is the share of subsets, of those that keep a
term of either text, whose hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import BASES, U, chunks, mix, mix_one, spans, words_of
from .neardup import weighted

SUBSETS = 32
#: The band, as shares of all documents. A term in at least LOW of N documents uses up LOW * N of their
#: distinct terms, so with 400 of those a document, the lexicon has at most 400 / LOW entries, however large N is.
LOW, HIGH = 0.0005, 0.1
SALTS = [mix_one(1_000_003 * (k + 1)) for k in range(SUBSETS)]
LIMITS = [2**64 - 1, *(2 ** (61 - k // 4) for k in range(SUBSETS - 1))]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        terms, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x[1] for x in held]), len(terms)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

    for batch in chunks(batches):
        w = words_of(batch.column("text"), lower=True)
        _, h, _ = weighted(w.doc, w.h)
        held.append(np.unique(h, return_counts=True))
        size += len(held[-1][0])
        if size > 2_000_000:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Hashes of the terms in the band, ascending, from the frequencies over all documents; terms of one document are never in it."""
    n = docs.count()
    terms = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = terms.where((F.col("n") >= max(2, low * n)) & (F.col("n") <= high * n)).select("term").toArrow()
    return np.sort(found.column("term").to_numpy().view(U))


def fingerprints(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of kept terms: a row a text, a column a subset.

    A text none of whose terms is in the lexicon is fingerprinted by all its terms; one without words has zeros.
    """
    w = words_of(texts, lower=True)
    doc, h, _ = weighted(w.doc, w.h)
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    inside = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    some = np.bincount(doc[inside], minlength=w.n_docs) > 0
    use = inside | ~some[doc]
    doc, h = doc[use], h[use]
    out, n = np.zeros((w.n_docs, SUBSETS), np.uint32), np.zeros((w.n_docs, SUBSETS), np.int64)
    for k in range(SUBSETS):
        kept = mix(h ^ U(SALTS[k])) <= U(LIMITS[k])
        first = np.searchsorted(doc[kept], np.arange(w.n_docs + 1))
        n[:, k] = np.diff(first)
        whole = mix(spans(h[kept], BASES[0], first[:-1], first[1:]) + n[:, k].astype(U))
        out[:, k] = np.where(n[:, k] > 0, whole >> U(32), 0)
    return out, n


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each pair of rows the share of agreeing subsets; 1 where all are empty, or the hashes are the same."""
    used = (a[1] > 0) | (b[1] > 0)
    same = (a[0] == b[0]) & used
    return np.where((a[0] == b[0]).all(axis=1), 1.0, same.sum(axis=1) / np.maximum(used.sum(axis=1), 1))


def _hex(a: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in a.astype(">u4")]


def fingerprint(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """All columns of ``docs`` with ``fingerprint`` (256 hex digits), in one pass. Null texts count as empty."""
    source = docs.drop("fingerprint")
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found, _ = fingerprints(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"fingerprint": pa.array(_hex(found))})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{names}, fingerprint string")


def with_successors(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt out by ranges of doc_id, sorted, each range followed by a copy of the row that comes after it.

    Columns: doc_id, text, bucket, ghost. The first row of all follows the last. One shuffle of the texts; the
    boundary rows, one for each range, are found by their ids.
    """
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).where("x is not null")
    cuts = sorted(set(ids.approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    keyed = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep").transform(docs.withColumn("x", F.col("doc_id").cast("double")))
    late = len(splits) - 1 + F.floor((F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(2**63))), 32)) * parts / 2**32)  # rows without an id, by ranges of the hash
    keyed = keyed.select("doc_id", "text", F.when(F.col("doc_id").isNull(), late).otherwise(F.col("b")).cast("int").alias("bucket"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    found = {r["bucket"]: r["id"] for r in keyed.groupBy("bucket").agg(F.min("doc_id").alias("id")).collect()}
    first = sorted(found.items(), key=lambda x: x[0])
    before = [(first[i - 1][0], b) for i, (b, _) in enumerate(first)]
    spots = spark.createDataFrame([(b, to, i) for (b, i), (to, _) in zip(first, before, strict=True)], "bucket int, target int, id long")
    heads = keyed.join(F.broadcast(spots), "bucket").where(F.col("doc_id").eqNullSafe(F.col("id")))
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("text")))).where("n = 1")
    ghosts = heads.select("doc_id", "text", F.col("target").alias("bucket"), F.lit(1).alias("ghost"))
    both = keyed.withColumn("ghost", F.lit(0)).unionAll(ghosts)
    return both.repartitionById(len(splits) - 1 + parts, F.col("bucket")).sortWithinPartitions("bucket", "ghost", *order)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count
    as empty; rows with a null doc_id come last, rows that repeat one follow each other by a hash of their text; a
    single document is its own successor. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in chunks(batches, limit=2 << 20):
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([last, rows]) if last is not None else rows).combine_chunks()
            last = rows.slice(rows.num_rows - 1)
            n = rows.num_rows - 1
            if not n:
                continue
            texts = rows.column("text").to_pylist()
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts[:-1], texts[1:], strict=True)]
            hashes, counts = fingerprints(rows.column("text").combine_chunks(), shared.value)
            other = fingerprints(pa.array(edited, pa.large_string()), shared.value)
            out = pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id").slice(0, n).combine_chunks(),
                "n_chars": pa.array([len(a) for a in texts[:-1]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(a.encode()).hexdigest() for a in edited], pa.string()),
                "fingerprint": pa.array(_hex(hashes[:-1]), pa.string()),
                "edited_fingerprint": pa.array(_hex(other[0]), pa.string()),
                "near_edited": pa.array(likeness((hashes[:-1], counts[:-1]), other)),
                "near_next": pa.array(likeness((hashes[:-1], counts[:-1]), (hashes[1:], counts[1:]))),
            })
            yield out.filter(pc.equal(rows.column("ghost").slice(0, n).combine_chunks(), 0))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).mapInArrow(run, schema)
