"""Near-duplicate documents by SimHash fingerprints, pigeonhole blocks and exact Hamming distances.

The 64 bits of a fingerprint are cut into blocks. Two that differ in few bits leave all but so many blocks untouched, so they
share the key made of the untouched ones; keys of all choices of blocks are joined, and each pair that shares a key is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.durable import durable
from .arrays import U

SHINGLE, SEED, MOST = 4, 42, 4
#: Bytes of a text that are cut into words at once, and hashes whose bits are summed at once.
PIECE, SLICE = 1 << 20, 1 << 16
#: Fingerprints of a key that are compared in one tile; a key with more is cut into tiles, and each pair of tiles is compared apart.
TILE = 4096
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lists of words; each starts with the last words of the one before, so that every shingle lies in one."""
    at, held = 0, []
    while at < len(data):
        cut = SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = held + data[at:end].split()
        yield words
        held, at = words[1 - SHINGLE :], end


def _sums(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the shingles of ``words``, and how many hashes there are."""
    n = len(words) - SHINGLE + 1
    text = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    spots = zip((end - size)[:n].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spots), ">u8", n)
    sums = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        sums += np.unpackbits(h[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return sums, n


def simhash(text: str | None) -> int:
    """The fingerprint of a whole text, unsigned; zero for a text without words."""
    sums, n, words = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode().lower()):
        if len(words) >= SHINGLE:
            more, m = _sums(words)
            sums, n = sums + more, n + m
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((simhash(t.as_py()) for t in batch.column("text")), U, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def blocks_for(n: int, most: int = MOST) -> int:
    """Into how many blocks fingerprints are cut so that keys and comparisons of n random ones cost least; every number finds the same links."""
    cost = lambda b: comb(b, most) * n * (1 + n / 2 ** (64 * (b - most) / b) / 64)
    return min(range(most + 1, most + 5), key=cost)


def masks(blocks: int, most: int = MOST) -> list[int]:
    """The bits of each choice of all but ``most`` blocks, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [(m + 2**63) % 2**64 - 2**63 for m in (sum(c) for c in combinations(parts, blocks - most))]


class _Forest:
    """Roots of rows, joined pair by pair, many at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (self.up[r] != r).any():
            r = self.up[self.up[r]]
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def linked(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal keys (``key`` ascends) that differ in at most ``most`` bits: enough of them to connect all that are."""
    n = len(key)
    first = np.searchsorted(key, key)
    forest, found = _Forest(n), []
    at, d = np.arange(n), 1
    while len(at):
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= most]
        near = near[forest.find(near) != forest.find(near + d)]
        if len(near):
            found.append((near, near + d))
            forest.join(near, near + d)
        if d & (d - 1) == 0 and len(at):  # keys whose rows are all connected are done
            rows = np.flatnonzero(np.isin(first, first[at]))
            apart = first[rows[forest.find(rows) != forest.find(first[rows])]]
            at = at[np.isin(first[at], apart)]
        d += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = linked(key, fp.view(U), most)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, batch.column("key").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy()))
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield out(key[:end], fp[:end])
            key, fp = key[end:], fp[end:]
        yield out(key, fp)

    return run


def links(prints: DataFrame, most: int = MOST, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """``(a, b)``: pairs of ``prints(fp)``, distinct, that connect all that are linked by chains of at most ``most`` differing bits.

    A key that more than ``tile`` fingerprints share is cut into tiles by a hash, and each pair of tiles is a key of its own.
    """
    choices = masks(blocks or blocks_for(prints.count(), most), most)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(choices)])
    keyed = prints.select("fp", F.explode(keys).alias("key"))
    large = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile))
    rows = keyed
    if not large.isEmpty():
        cut = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
        rows = keyed.join(large.hint("merge"), "key", "left").select("fp", "key", cut.alias("k"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda i: (F.col("k") == 1) | (i != F.col("own")))
        rows = rows.select("fp", "key", "k", "own", F.explode(others).alias("other"))
        pair = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        rows = rows.select("fp", pair.alias("key"))
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(most), "a long, b long")
    return durable(found.distinct())


def components(docs: DataFrame, most: int = MOST, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs(doc_id, text)``.

    Fingerprints of A-Z lowered words ``[^\\x20\\x09-\\x0D]+`` in shingles of four, repeats included; a bit is set if it is in over
    half of the XXH64 hashes (seed 42). Documents are linked if their fingerprints differ in at most ``most`` bits, and
    ``component_id`` is the smallest doc_id that a chain of links reaches. Equal fingerprints are folded before they are compared.

    Null and empty texts have fingerprint zero, which is linked like any other; a text of one to three words is one shingle. Rows
    that repeat a doc_id are judged each by its own text. A null doc_id is never the smallest unless a component has no other; then
    component_id is null. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    prints = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long"))
    folded = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(folded.select("fp"), most, tile, blocks))
    rooted = folded.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
