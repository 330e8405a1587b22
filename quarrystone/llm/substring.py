"""Removal of passages of 50 or more words that stand in an earlier document.

A window is 50 consecutive words. Each window has an anchor, the least hash of its 26 runs of 25 words,
so equal windows have equal anchors, and about one run in thirteen is an anchor. Every partition
counts, in a count-min sketch, the documents of each anchor; the merged sketch never counts too few, so a window
whose anchor it counts once is no repeat. A second pass takes the other windows and groups them exactly:
first whole stretches of windows with one anchor, then, where an anchor has several different stretches, window by
window.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .arrays import BASES, U, Words, chunks, mix, mix_one, runs, words_of
from .neardup import weighted

WINDOW, GRAM = 50, 25
#: Cells of a sketch row, as a power of two. The merged sketch is one bit a cell (counted twice or more): 16 MB a row, whatever the input.
CELL_BITS, SKETCH_ROWS, BLOCK_BITS = 27, 2, 18
STRETCH = 26
SALTS = [mix_one(77 + r) for r in range(SKETCH_ROWS)]


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start (as indexes of words), and their anchors."""
    n = len(w.doc)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    least = runs(w.h, GRAM)
    covered, width = 1, WINDOW - GRAM + 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    at = np.flatnonzero(w.doc[: n - WINDOW + 1] == w.doc[WINDOW - 1 :])
    return at, least[at]


def cells(anchor: np.ndarray, row: int) -> np.ndarray:
    return (mix(anchor ^ U(SALTS[row])) >> U(64 - CELL_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def blocks() -> Iterator[pa.RecordBatch]:
        seen = np.concatenate(held)
        rows = []
        for r in range(SKETCH_ROWS):
            cell, n = np.unique(cells(seen, r), return_counts=True)
            block, first = np.unique(cell >> BLOCK_BITS, return_index=True)
            for b, x, y in zip(block.tolist(), first, [*first[1:], len(cell)], strict=True):
                gaps = np.diff(cell[x:y] & ((1 << BLOCK_BITS) - 1), prepend=0).astype(np.uint32)
                rows.append((r, b, zlib.compress(gaps.tobytes(), 1), zlib.compress(np.minimum(n[x:y], 2).astype(np.uint8).tobytes(), 1)))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["row", "block", "gaps", "n"])

    for batch in chunks(batches):
        w = words_of(batch.column("text"))
        at, a = anchors(w)
        doc = w.doc[at]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
        held.append(weighted(doc[new], a[new])[1])  # each document counts once
        if sum(map(len, held)) > 4_000_000:
            yield from blocks()
            held = []
    if sum(map(len, held)):
        yield from blocks()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, counts = None, np.zeros(1 << BLOCK_BITS, np.uint8)

    def done() -> Iterator[pa.RecordBatch]:
        bits = np.packbits(counts >= 2)
        if at is not None and bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["row", "block", "bits"])

    for batch in batches:
        for r, b, gaps, n in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "gaps", "n")), strict=True):
            if (r, b) != at:
                yield from done()
                at = (r, b)
                counts[:] = 0
            cell = np.cumsum(np.frombuffer(zlib.decompress(gaps), np.uint32).astype(np.int64))
            counts[cell] = np.minimum(counts[cell] + np.frombuffer(zlib.decompress(n), np.uint8), 2)
    yield from done()


def sketch(docs: DataFrame) -> list[np.ndarray]:
    """Of each row of the merged sketch the bits of the cells that count two documents or more: 2**CELL_BITS bits a row."""
    parts = docs.select("text").mapInArrow(_sketch, "row int, block int, gaps binary, n binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merge, "row int, block int, bits binary")
    out = [np.zeros(1 << (CELL_BITS - 3), np.uint8) for _ in range(SKETCH_ROWS)]
    size = 1 << (BLOCK_BITS - 3)
    for r, b, bits in merged.toLocalIterator():
        out[r][b * size : (b + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out


def _repeated(bits: list[np.ndarray], anchor: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for r in range(SKETCH_ROWS):
        c = cells(anchor, r)
        out &= (bits[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return out


def stretches(w: Words, keep: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive kept windows of one anchor, at most 26: (first word, anchor, hash, offsets into windows, window hashes)."""
    at, anchor = at[keep], anchor[keep]
    window = runs(w.h, WINDOW)[at] if len(at) else np.zeros(0, U)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - first[run]) % STRETCH == 0 if len(at) else new
    first = np.append(np.flatnonzero(new), len(at))
    size = np.diff(first)
    step = np.arange(len(at)) - np.repeat(first[:-1], size)
    whole = mix(np.add.reduceat(mix(window + step.astype(U) * U(BASES[1])), first[:-1]) + size.astype(U)) if len(at) else np.zeros(0, U)
    return at[first[:-1]], anchor[first[:-1]], whole, first, window


def _candidates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = words_of(batch.column("text"))
            at, a = anchors(w)
            start, anchor, whole, first, window = stretches(w, _repeated(shared.value, a), at, a)
            doc = w.doc[start]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("doc_id").take(pa.array(doc)), batch.column("tag").take(pa.array(doc)),
                    pa.array((start - w.first()[doc]).astype(np.int32)), pa.array(np.diff(first).astype(np.int32)),
                    pa.ListArray.from_arrays(first.astype(np.int32), window.view(np.int64)),
                ],
                ["anchor", "stretch", "doc_id", "tag", "pos", "n", "windows"],
            )

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, at)``: of each text the (pos, windows) of its repeated windows, as bits from pos on."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(sketch(keyed))
    schema = "anchor long, stretch long, doc_id long, tag long, pos int, n int, windows array<long>"
    found = durable(keyed.mapInArrow(_candidates(shared), schema))
    kinds = durable(found.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    firsts = kinds.join(several, "anchor", "left_semi").select("anchor", "stretch", "low")
    one = found.join(firsts.hint("merge"), ["anchor", "stretch"]).where("doc_id = low").select("anchor", "stretch", "low", "windows").dropDuplicates(["anchor", "stretch"])
    single = durable(one.select("anchor", "stretch", "low", F.posexplode("windows").alias("k", "window")))
    lowest = single.groupBy("anchor", "window").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    early = single.join(lowest, ["anchor", "window"]).where("least < low")
    masks = early.groupBy("anchor", "stretch").agg(F.expr("bit_or(shiftleft(1L, k))").alias("mask"))
    rules = kinds.join(masks, ["anchor", "stretch"], "left").where("low < high or mask is not null")
    hits = found.select("anchor", "stretch", "doc_id", "tag", "pos", "n").join(rules.hint("merge"), ["anchor", "stretch"]).select(
        "doc_id", "tag", "pos", F.when(F.col("doc_id") > F.col("low"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("mask")).alias("windows")
    )
    return hits.where("windows is not null").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "windows")).alias("at"))


def covered(n_words: int, at: list[dict]) -> np.ndarray:
    """Which of a text's words repeated windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    if at:
        pos = np.array([x["pos"] for x in at])
        bits = np.array([x["windows"] for x in at])
        for k in range(STRETCH):
            start = pos[(bits >> k) & 1 == 1] + k
            np.add.at(change, start, 1)
            np.add.at(change, start + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_words`` and ``n_removed``.

    Every word goes that is covered by a window of 50 words whose sequence also starts in a document with a smaller
    doc_id; windows are judged on the input. Kept words are joined by one space. Null texts count as empty; texts under 50
    words lose nothing; rows without a doc_id lose nothing and are no source. Rows that repeat a doc_id are no
    earlier documents of each other and are told apart by their text. Columns of these names are replaced. Frequent
    windows are pre-aggregated to their smallest doc_id, so no group is gathered. The sketch only sieves: beyond some
    ten million anchors for each of its 2**27 cells' share it lets more windows through, never fewer.
    """
    source = docs.drop("kept_text", "n_words", "n_removed")
    clean = source.withColumn("text", F.coalesce("text", F.lit("")))
    found = repeats(clean.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("at").alias("__at"))
    joined = clean.join(found.hint("merge"), (clean["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(clean["text"]) == F.col("__tag")), "left").drop("__id", "__tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, words, gone = [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("__at").to_pylist(), strict=True):
                parts = text.encode().split()
                mask = covered(len(parts), at) if at else None
                texts.append(b" ".join(compress(parts, ~mask) if at else parts).decode())
                words.append(len(parts))
                gone.append(int(mask.sum()) if at else 0)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "__at"}
            yield pa.RecordBatch.from_pydict(columns | {"kept_text": pa.array(texts, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64())})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return joined.mapInArrow(run, f"{names}, kept_text string, n_words long, n_removed long")
