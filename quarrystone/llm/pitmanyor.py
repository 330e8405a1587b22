"""Language model scoring by a hierarchical Pitman-Yor process over three levels.

The restaurant of a token is that of the two tokens before it. Restaurants of pairs with the same last token share that
token's restaurant as their parent, and those of single tokens share one root, whose base is uniform over the
training tokens and one more. Customers of a parent are its children's tables. Contexts are exact: words are
told apart by 63-bit hashes, the most frequent ones by codes. Tables are drawn from their full conditionals
(``seating``), dish by dish, and predictive probabilities of several sweeps are averaged. Strengths are 1;
discounts are estimated once, from how many cells hold one and two customers.

One shuffle deals the n-grams of chunks of texts to blocks by the token before, so a block holds whole restaurants of
the two lower levels; a token before that makes up half a block or more is dealt by both tokens before. A block is a row of
a bucketed table and is never shuffled again. Only the cells of the root, and those of the restaurants of such
frequent tokens, are shared: between sweeps blocks send their tables to tasks by word, which draw the shared
cells' own tables and send counts back. Other blocks' tables are as before the sweep meanwhile.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import durable, shared_folder
from .arrays import U, chunks, distinct, mix, words_of
from .packed import RARE, bundle, pack, pack_keys, parts_of, unpack, unpack_keys
from .seating import Parent, draw, turns

STRENGTH = 1.0
#: Exchanges of shared cells after the first one, sweeps of a block before each, and sweeps at the end, whose predictions are averaged.
ROUNDS, SWEEPS, SAMPLES = 2, 2, 3
#: Bytes of text whose n-grams make up a block, and of a chunk that is dealt at once.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 4 << 20
#: Buckets of the table of blocks, and parts of the shared cells: one a block up to this number (Spark allows 100,000 buckets); above it, blocks share them.
BUCKETS = 50_000
#: Words with a code: a bound on what is broadcast (12 bytes each). Codes only shorten; words without one keep their hash.
CODES = 1 << 20
START, END, FIRST_CODE = U(1), U(2), 3
FIXED = float(1 << 30)  # partial sums of logarithms are shipped as whole numbers of this fraction
NO_ID = -(2**63)


@dataclass
class Book:
    """Hashes of frequent words, ascending, with their codes, and the frequent tokens before."""

    words: np.ndarray
    codes: np.ndarray
    hot: np.ndarray  # keys, ascending
    blocks: int

    def keys(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        return np.where(known, self.codes[at].astype(U) if len(self.words) else U(0), h | RARE)

    def hot_at(self, keys: np.ndarray) -> np.ndarray:
        """Place among the frequent tokens, or -1."""
        at = np.minimum(np.searchsorted(self.hot, keys), max(len(self.hot) - 1, 0))
        return np.where(self.hot[at] == keys, at, -1) if len(self.hot) else np.full(len(keys), -1)


@dataclass
class Shared:
    """Sums over all restaurants, the same in every task; entry 0 is the root, then come the frequent tokens."""

    n: int  # training tokens
    v: int  # distinct ones
    discounts: tuple[float, float, float]  # of the root, of single tokens, of pairs
    customers: np.ndarray
    tables: np.ndarray


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _changes(*arrays: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    new = np.zeros(len(arrays[0]), bool)
    new[:1] = True
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of whole numbers from each start to the next."""
    running = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=running[1:])
    return np.diff(running[np.append(starts, len(x))])


# Frequent words


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that a task meets twice or more, and its tokens and texts under word 0."""
    word, n, total, docs, held = np.zeros(0, U), np.zeros(0, np.int64), 0, 0, []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, counts = (np.concatenate(x) for x in zip((word, n), *held, strict=True))
        held.clear()
        found, at = np.unique(words, return_inverse=True)
        return found, np.bincount(at, counts, len(found)).astype(np.int64)

    def kept(least: int) -> pa.RecordBatch:
        some = n >= max(least, n.sum() / (2 * CODES))
        return pa.RecordBatch.from_arrays([pa.array(np.append(word[some], U(0)).view(np.int64)), pa.array(np.append(n[some], total)), pa.array(np.append(0 * n[some], docs))], ["word", "n", "docs"])

    for batch in chunks(batches, limit=CHUNK_BYTES, rows=1 << 16):
        h = words_of(batch.column("text"), lower=True).h
        total, docs = total + len(h) + batch.num_rows, docs + batch.num_rows
        held.append(np.unique(h, return_counts=True))
        if len(word) + sum(len(x) for x, _ in held) > 4 * CODES:
            word, n = merged()
        if len(word) > 4 * CODES:
            yield kept(2)
            word, n, total, docs = np.zeros(0, U), np.zeros(0, np.int64), 0, 0
    word, n = merged()
    yield kept(2)


def code_book(rows: DataFrame, blocks: int) -> Book:
    """At most ``CODES`` codes, by frequency, and the tokens that stand before half a block's share of all tokens or more."""
    found = durable(rows.select("text").mapInArrow(_frequent, "word long, n long, docs long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = found.where("word = 0").first()
    if not total:
        return Book(np.zeros(0, U), np.zeros(0, np.uint32), np.zeros(0, U), blocks)
    sizes = found.where("word <> 0").groupBy(F.floor(F.log2("n") * 4).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()
    least, held = 0, 0
    for r in sizes:
        held += r["count"]
        if held > CODES:
            break
        least = r["k"]
    table = found.where((F.col("word") != 0) & (F.floor(F.log2("n") * 4) >= least)).select("word", "n").toArrow()
    word, n = table.column("word").to_numpy().view(U), table.column("n").to_numpy()
    order = np.lexsort((word, -n))
    codes = np.empty(len(word), np.uint32)
    codes[order] = np.arange(len(word), dtype=np.uint32) + np.uint32(FIRST_CODE)
    often = total["n"] / (2 * blocks)
    hot = codes[n >= often].astype(U)
    if total["docs"] >= often:
        hot = np.append(hot, START)
    order = np.argsort(word)
    return Book(word[order], codes[order], np.sort(hot), blocks)


# Dealing n-grams to blocks

DEALT = "block long, chunk long, grams binary, entries binary, docs binary"


def tokens(texts: pa.Array, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in ascending order, and of each token (a text's words with A-Z lowered, then one end) its text and its place among them."""
    w = words_of(texts, lower=True)
    word, place = distinct(w.h)
    keys = np.concatenate(([START, END], book.keys(word)))
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    n = len(w.doc) + w.n_docs
    doc, t = np.empty(n, np.int64), np.empty(n, np.int64)
    at = np.arange(len(w.doc)) + w.doc
    doc[at], t[at] = w.doc, rank[place + 2]
    ends = w.first()[1:] + np.arange(w.n_docs)
    doc[ends], t[ends] = np.arange(w.n_docs), rank[1]
    return keys[order], doc, t


def before(doc: np.ndarray, t: np.ndarray, steps: int) -> np.ndarray:
    """The token so many steps before each, or the start."""
    out = np.zeros(len(t), np.int64)  # the start has the smallest key
    out[steps:] = np.where(doc[steps:] == doc[:-steps], t[:-steps], 0)
    return out


def _deal(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, number = shared.value, 0
        for batch in chunks(batches, limit=CHUNK_BYTES, rows=1 << 16):
            chunk = (TaskContext.get().partitionId() << 32) + number
            number += 1
            keys, doc, t = tokens(batch.column("text"), book)
            one, two, n = before(doc, t, 1), before(doc, t, 2), len(t)
            (one, t, two, doc), entry = _sorted((one, t, two, doc), (len(keys), len(keys), len(keys), batch.num_rows))
            train = batch.column("train").to_numpy(zero_copy_only=False)
            times = _lengths(entry, n)
            cell = _changes(one, t, two)
            one, t, two = one[cell], t[cell], two[cell]
            learnt = np.add.reduceat(times * train[doc], cell)
            hot = book.hot_at(keys)[one] >= 0
            to = (mix(keys[one] + np.where(hot, mix(keys[two]), U(0))) % U(book.blocks)).astype(np.int64)
            per_cell = _lengths(cell, len(entry))
            by_block = np.argsort(to.astype(np.uint16) if book.blocks <= 1 << 16 else to, kind="stable")
            to, one, t, two, learnt, per_cell = (x[by_block] for x in (to, one, t, two, learnt, per_cell))
            first_entry = np.concatenate(([0], np.cumsum(per_cell)))
            moved = np.repeat(cell[by_block] - first_entry[:-1], per_cell) + np.arange(len(entry))
            doc, times = doc[moved], times[moved]
            ids = batch.column("doc_id")
            about = bundle(ids.fill_null(NO_ID).to_numpy().astype(np.int64).tobytes(), pack(batch.column("held").to_numpy(zero_copy_only=False)))
            cuts = np.append(_changes(to), len(to))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                c, e = slice(x, y), slice(first_entry[x], first_entry[y])
                entries = bundle(pack(per_cell[c]), pack(doc[e]), pack(times[e]))
                yield _batch([(int(to[x]), chunk, said_of(keys[one[c]], keys[t[c]], keys[two[c]], learnt[c]), entries, about)], DEALT)
                about = None

    return run


def _sorted(columns: tuple[np.ndarray, ...], sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers below ``sizes``, in ascending order, and where each starts among all sorted rows."""
    if math.prod(sizes) < 1 << 63:
        key = columns[0]
        for x, n in zip(columns[1:], sizes[1:], strict=True):
            key = key * n + x
        key = np.sort(key)  # values are sorted faster than their places, and hold the row
        start = _changes(key)
        key, out = key[start], []
        for n in sizes[:0:-1]:
            above = key // n
            out.append(key - above * n)
            key = above
        return [key, *out[::-1]], start
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    start = _changes(*columns)
    return [x[start] for x in columns], start


def _nested(one: np.ndarray, word: np.ndarray, two: np.ndarray, count: np.ndarray, packed: Callable[[np.ndarray], bytes]) -> tuple[bytes, ...]:
    """Sorted cells: tokens before, each with its words, each with its tokens two before and their training counts."""
    pair, first = _changes(one, word), _changes(one)
    return pack_keys(one[first]), pack(np.diff(np.append(np.searchsorted(pair, first), len(pair)))), packed(word[pair]), pack(_lengths(pair, len(one))), packed(two), pack(count)


def said_of(one: np.ndarray, word: np.ndarray, two: np.ndarray, count: np.ndarray) -> bytes:
    """Cells of one chunk."""
    return bundle(*_nested(one, word, two, count, pack_keys))


def grams_of(one: np.ndarray, word: np.ndarray, two: np.ndarray, count: np.ndarray) -> bytes:
    """Cells of a block: its distinct words and tokens two before are written once, cells name them by their places."""
    (words, word), (twos, two) = distinct(word), distinct(two)
    return _block_of(one, words, word, twos, two, count)


def _block_of(one: np.ndarray, words: np.ndarray, word: np.ndarray, twos: np.ndarray, two: np.ndarray, count: np.ndarray) -> bytes:
    return bundle(*_nested(one, word, two, count, pack), pack_keys(words), pack_keys(twos))


@dataclass
class Grams:
    one: np.ndarray
    pairs: np.ndarray  # of each token before
    word: np.ndarray  # of each pair
    cells: np.ndarray  # of each pair
    two: np.ndarray  # of each cell
    count: np.ndarray
    words: np.ndarray | None = None  # of a block, whose pairs and cells hold places in them
    twos: np.ndarray | None = None

    @classmethod
    def read(cls, data: bytes) -> Grams:
        one, pairs, word, cells, two, count, *names = parts_of(data)
        keys = unpack if names else unpack_keys
        return cls(unpack_keys(one), unpack(pairs), keys(word), unpack(cells), keys(two), unpack(count), *map(unpack_keys, names))


# Blocks

BLOCK = "block long, part long, chunk long, grams binary, entries binary, docs binary, cells_once long, cells_twice long, pairs_once long, pairs_twice long"


def _merged(block: int, messages: list[dict], book: Book) -> Iterator[pa.RecordBatch]:
    """One row of the block's cells, with numbers of those that hold one and two customers, then one of each message's entries, which name cells by their place."""
    said = [Grams.read(m["grams"]) for m in messages]
    sizes = [len(g.two) for g in said]
    pairs, cells, count = (np.concatenate([getattr(g, c) for g in said]) for c in ("pairs", "cells", "count"))
    (ones, one), (words, word), (twos, two) = (distinct(np.concatenate([getattr(g, c) for g in said])) for c in ("one", "word", "two"))
    one, word = np.repeat(np.repeat(one, pairs), cells), np.repeat(word, cells)
    if len(ones) * len(words) * len(twos) < 1 << 63:
        order = np.argsort((one * len(words) + word) * len(twos) + two)
    else:
        order = np.lexsort((two, word, one))
    one, word, two = one[order], word[order], two[order]
    new = _changes(one, word, two)
    place = np.zeros(len(order), np.int64)
    place[new] = 1
    place[order] = np.cumsum(place) - 1
    one, word, two, count = ones[one[new]], word[new], two[new], np.add.reduceat(count[order], new)
    own = np.add.reduceat(count > 0, _changes(one, word), dtype=np.int64)[book.hot_at(one[_changes(one, word)]) < 0]
    few = [int((x == k).sum()) for x in (count, own) for k in (1, 2)]
    yield _batch([(block, 0, -1, _block_of(one, words, word, twos, two, count), None, None, *few)], BLOCK)
    for i, (m, at) in enumerate(zip(messages, np.split(place, np.cumsum(sizes)[:-1]), strict=True)):
        yield _batch([(block, i + 1, m["chunk"], None, bundle(pack(np.diff(at, prepend=0)), m["entries"]), m["docs"], 0, 0, 0, 0)], BLOCK)


def _gather(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for row in _rows(batches):
            if row["block"] != at:
                if held:
                    yield from _merged(at, held, shared.value)
                at, held = row["block"], []
            held.append(row)
        if held:
            yield from _merged(at, held, shared.value)

    return run


class Block:
    """A block's restaurants: cells are dishes of pairs of tokens, pairs are dishes of single tokens."""

    def __init__(self, row: dict, book: Book):
        g = Grams.read(row["grams"])
        self.number, self.count, self.keys = row["block"], g.count, g.one
        self.pair = np.repeat(np.arange(len(g.word)), g.cells)
        self.one = np.repeat(np.arange(len(g.one)), g.pairs)
        self.first_cell, self.first_pair = np.cumsum(g.cells) - g.cells, np.cumsum(g.pairs) - g.pairs
        self.pair_count = _sums(g.count, self.first_cell)
        self.place = book.hot_at(g.one)  # of tokens before among the frequent ones
        self.hot = self.place[self.one] >= 0  # pairs whose restaurant is shared
        self.two, self.n_two = g.two, len(g.twos)
        self.words, self.root = g.words, g.word  # the root's cells
        self.tables = (g.count > 0).astype(np.int64)
        self.customers = _sums(self.tables, self.first_cell)
        self.pair_tables = ((self.customers > 0) & ~self.hot).astype(np.int64)
        self.private, self.seen, self.root_tables = np.zeros(len(self.words), bool), np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        self.active = np.flatnonzero(g.count > 1)
        self.active_pairs = np.flatnonzero((self.pair_count > 1) & ~self.hot)

    @cached_property
    def room(self) -> np.ndarray:
        """Restaurants of cells: one for each pair of tokens."""
        one, n = self.one[self.pair], len(self.two)
        key = one * self.n_two + self.two
        if len(self.keys) * self.n_two * n >= 1 << 63:
            return distinct(key)[1]
        key = np.sort(key * n + np.arange(n))
        above = key // n
        new = np.zeros(n, np.int64)
        new[_changes(above)] = 1
        out = np.empty(n, np.int64)
        out[key - above * n] = np.cumsum(new) - 1
        return out

    @cached_property
    def in_room(self) -> np.ndarray:
        """Tables of each restaurant of cells, kept up by sweeps."""
        return np.bincount(self.room, self.tables)

    @cached_property
    def room_customers(self) -> np.ndarray:
        return np.bincount(self.room, self.count)

    # What is shared: the root's cells of words that other blocks have too, then the pairs of frequent tokens

    def sums(self) -> np.ndarray:
        return np.bincount(self.root, self.pair_tables, len(self.words)).astype(np.int64)

    def shared_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Restaurant (0, or 1 and the place) and word of each shared cell."""
        pairs, words = np.flatnonzero(self.hot), self.words[~self.private]
        return np.concatenate((np.zeros(len(words), np.int64), 1 + self.place[self.one[pairs]])), np.concatenate((words, self.words[self.root[pairs]]))

    def order(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Shared cells by the part that their word belongs to, and where each part starts."""
        room, word = self.shared_keys()
        part = (mix(word ^ U(0x5851F42D4C957F2D)) % U(parts)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # by restaurant and word they are sorted
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def messages(self, parts: int, first: bool) -> Iterator[tuple[int, bytes]]:
        """To each part: its cells' restaurants, words and customers here, tables that they have, and at first the training counts of the words."""
        room, word = self.shared_keys()
        shown = ~self.private
        sums = np.concatenate((self.sums()[shown], self.customers[self.hot]))
        old = np.minimum(sums, 1) if first else np.concatenate((self.root_tables[shown], self.hot_tables[self.hot]))
        seen = np.bincount(self.root, self.pair_count, len(self.words)).astype(np.int64)
        order, cuts = self.order(parts)
        for p in range(parts):
            at = order[cuts[p] : cuts[p + 1]]
            if len(at):
                yield p, bundle(pack(room[at]), pack_keys(word[at]), pack(sums[at]), pack(old[at]), pack(seen[at[at < len(seen)]]) if first else b"")

    def receive(self, parts: int, answers: list[dict] | None, shared: Shared) -> None:
        """Take the shared cells' customers and tables; at first also the words' counts, and which words no other block has."""
        n = int((~self.private).sum())
        room, _ = self.shared_keys()
        customers, tables = np.zeros(len(room), np.int64), np.zeros(len(room), np.int64)
        order, cuts = self.order(parts)
        private = np.zeros(len(self.words), bool)
        for a in answers or ():
            if a["part"] < 0:
                continue
            at = order[cuts[a["part"]] : cuts[a["part"] + 1]]
            c, t, seen, alone = parts_of(a["data"])
            customers[at], tables[at] = unpack(c), unpack(t)
            if seen:
                self.seen[at[at < n]], private[at[at < n]] = unpack(seen), unpack(alone)
        self.shared = shared
        self.root_customers = self.sums()
        self.root_customers[~self.private], self.root_tables[~self.private] = customers[:n], tables[:n]
        self.hot_customers, self.hot_tables = np.zeros(len(self.hot), np.int64), np.zeros(len(self.hot), np.int64)
        self.hot_customers[self.hot], self.hot_tables[self.hot] = customers[n:], tables[n:]
        self.private |= private

    def settle(self, rng: np.random.Generator) -> tuple[int, int]:
        """Draw the root's tables of the words that only this block has; their customers and tables."""
        s, x = self.shared, np.flatnonzero(self.private)
        customers = self.sums()[x]
        self.root_tables[x] = draw(customers, np.maximum(s.tables[0] - self.root_tables[x], 0), s.discounts[0], STRENGTH, 1 / (s.v + 1), rng)
        return int(customers.sum()), int(self.root_tables[x].sum())

    # Sweeps

    def base(self) -> np.ndarray:
        """The root's probability of each word."""
        s, d = self.shared, self.shared.discounts[0]
        return (np.maximum(self.root_customers - d * self.root_tables, 0) + (STRENGTH + d * s.tables[0]) / (s.v + 1)) / (STRENGTH + s.customers[0])

    def of_ones(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each single token's restaurant."""
        customers, tables = (_sums(x, self.first_pair).astype(np.float64) for x in (self.customers, self.pair_tables))
        far = self.place >= 0
        customers[far], tables[far] = self.shared.customers[1 + self.place[far]], self.shared.tables[1 + self.place[far]]
        return customers, tables

    def plan(self, rng: np.random.Generator) -> None:
        """Turns, with what stays the same from sweep to sweep: of cells their restaurants, pairs, tokens before and words; of pairs their tokens before and words."""
        x = [self.active[turn] for turn in turns(self.room[self.active], self.pair[self.active], rng)]
        self.cell_turns = [(x, self.room[x], p, self.one[p], self.root[p]) for x in x for p in [self.pair[x]]]
        x = [self.active_pairs[turn] for turn in turns(self.one[self.active_pairs], self.root[self.active_pairs], rng)]
        self.pair_turns = [(x, self.one[x], self.root[x]) for x in x]

    def sweep(self, rng: np.random.Generator) -> None:
        """Draw the tables of every cell, then those of every pair, in turns."""
        s = self.shared
        d_root, d_one, d_pair = s.discounts
        base = self.base()
        customers, tables = self.of_ones()
        in_room = self.in_room
        held = np.where(self.hot, self.hot_customers, self.customers)
        above = np.where(self.hot, self.hot_tables, self.pair_tables)
        fresh_one = STRENGTH + d_one * tables
        for x, room, pair, one, root in self.cell_turns:
            own = self.tables[x]
            fresh = fresh_one[one] * base[root]
            up = Parent(held[pair] - own, above[pair], d_one, fresh, STRENGTH + customers[one] - own)
            new = draw(self.count[x], in_room[room] - own, d_pair, STRENGTH, up, rng)
            self.tables[x] = new
            other = np.flatnonzero(new != own)
            more, room, pair, one = (new - own)[other], room[other], pair[other], one[other]
            for to, at in ((in_room, room), (held, pair), (self.customers, pair), (customers, one)):
                np.add.at(to, at, more.astype(to.dtype))
        total = s.customers[0]
        for x, one, root in self.pair_turns:
            own = self.pair_tables[x]
            fresh = np.full(len(x), (STRENGTH + d_root * s.tables[0]) / (s.v + 1))
            up = Parent(self.root_customers[root] - own, self.root_tables[root], d_root, fresh, np.full(len(x), STRENGTH + total) - own)
            new = draw(self.customers[x], tables[one] - own, d_one, STRENGTH, up, rng)
            self.pair_tables[x] = new
            other = np.flatnonzero(new != own)
            more = (new - own)[other]
            for to, at in ((tables, one[other]), (self.root_customers, root[other])):
                np.add.at(to, at, more.astype(to.dtype))
            total += int(more.sum())
        self.hot_customers = np.where(self.hot, held, 0)

    def predict(self) -> np.ndarray:
        """The probability of each cell's token after its two tokens."""
        _, d_one, d_pair = self.shared.discounts
        customers, tables = self.of_ones()
        held, above = np.where(self.hot, self.hot_customers, self.customers), np.where(self.hot, self.hot_tables, self.pair_tables)
        p = (np.maximum(held - d_one * above, 0) + (STRENGTH + d_one * tables[self.one]) * self.base()[self.root]) / (STRENGTH + customers[self.one])
        n, t = self.room_customers, self.in_room
        share, scale = (STRENGTH + d_pair * t) / (STRENGTH + n), 1 / (STRENGTH + n)
        return np.maximum(self.count - d_pair * self.tables, 0) * scale[self.room] + share[self.room] * p[self.pair]

    # What is kept between passes

    def state(self) -> bytes:
        return bundle(*map(pack, (self.tables[self.active], self.pair_tables[self.active_pairs], self.seen, self.private, self.root_tables[self.private])))

    def resume(self, answers: list[dict] | None) -> None:
        data = next((a["data"] for a in answers or () if a["part"] == STATE), None)
        if data is None:
            return
        cells, pairs, self.seen, private, tables = map(unpack, parts_of(data))
        self.tables[self.active] = cells
        self.customers = _sums(self.tables, self.first_cell)
        self.pair_tables[self.active_pairs] = pairs
        self.private = private > 0
        self.root_tables[self.private] = tables


# Shared cells

SAID = "block long, part long, data binary"
OWN, STATE = -1, -2  # instead of a part: sums over what only this block has, and what it keeps
ANSWER = "block long, part long, data binary, room long, customers double, tables double, n double, v double, once double, twice double"


def _first_words(shared, parts: int):
    """Before the first sweep: every cell with customers has one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, shared.value)
            yield _batch([(b.number, p, data) for p, data in b.messages(parts, True)], SAID)

    return run


def _answer(parts_said: list[dict], shared: Shared | None, seed: tuple) -> list[tuple]:
    """Merge what blocks say of one part's cells, draw the tables of the cells of frequent tokens, then those of the root."""
    said = [parts_of(m["data"]) for m in parts_said]
    rooms = [unpack(x[0]) for x in said]
    sizes, room = [len(x) for x in rooms], np.concatenate(rooms)
    word = np.concatenate([unpack_keys(x[1]) for x in said])
    sums, old = (np.concatenate([unpack(x[i]) for x in said]) for i in (2, 3))
    counts = any(x[4] for x in said)
    order = np.lexsort((word, room))
    new = _changes(room[order], word[order])
    cell = np.empty(len(order), np.int64)
    step = np.zeros(len(order), np.int64)
    step[new] = 1
    cell[order] = np.cumsum(step) - 1
    r, w = room[order][new], word[order][new]
    customers = np.bincount(cell, sums, len(r)).astype(np.int64)
    own = np.zeros(len(r), np.int64)
    own[cell] = old
    n_root = int(np.searchsorted(r, 1))
    up = np.searchsorted(w[:n_root], w[n_root:])  # every word has a cell in the root
    tables = np.minimum(customers, 1)
    if shared is not None:
        rng = np.random.default_rng(seed)
        d_root, d_one, _ = shared.discounts
        base = 1 / (shared.v + 1)
        fresh = np.full(len(up), (STRENGTH + d_root * shared.tables[0]) * base)
        mine = own[n_root:]
        above = customers[:n_root] + np.bincount(up, mine, n_root).astype(np.int64)
        parent = Parent(np.maximum(above[up] - mine, 0), own[:n_root][up], d_root, fresh, np.full(len(up), STRENGTH + shared.customers[0]) - mine)
        tables[n_root:] = draw(customers[n_root:], np.maximum(shared.tables[r[n_root:]] - mine, 0), d_one, STRENGTH, parent, rng)
    customers[:n_root] += np.bincount(up, tables[n_root:], n_root).astype(np.int64)
    tables[:n_root] = np.minimum(customers[:n_root], 1)
    if shared is not None:
        tables[:n_root] = draw(customers[:n_root], np.maximum(shared.tables[0] - own[:n_root], 0), d_root, STRENGTH, base, rng)
    seen = np.zeros(n_root, np.int64)
    mine = np.split(cell, np.cumsum(sizes)[:-1])
    speakers = np.zeros(n_root, np.int64)
    for some, x in zip(mine, said, strict=True) if counts else ():
        np.add.at(seen, some[some < n_root], unpack(x[4]))
        speakers[some[some < n_root]] += 1
    alone = (speakers == 1) & (np.bincount(up, minlength=n_root) == 0)
    out = []
    for m, some in zip(parts_said, mine, strict=True):
        words = some[some < n_root]
        more = (pack(seen[words]), pack(alone[words])) if counts else (b"", b"")
        out.append((m["block"], m["part"], bundle(pack(customers[some]), pack(tables[some]), *more), -1, *[0.0] * 6))
    rooms, first = np.unique(r, return_index=True)
    c, t = (np.add.reduceat(v, first) for v in (customers, tables))
    root = customers[:n_root]
    for i, k in enumerate(rooms.tolist()):
        more = (float(seen.sum()), float((seen > 0).sum()), float((root == 1).sum()), float((root == 2).sum())) if k == 0 else (0.0,) * 4
        out.append((-1, -1, None, k, float(c[i]), float(t[i]), *more))
    return out


def _shared_cells(shared: Shared | None, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for row in _rows(batches):
            if row["part"] != at:
                if held:
                    yield _batch(_answer(held, shared, (seed, at)), ANSWER)
                at, held = row["part"], []
            held.append(row)
        if held:
            yield _batch(_answer(held, shared, (seed, at)), ANSWER)

    return run


def exchange(said: DataFrame, parts: int, last: Shared | None, book: Book, seed: int) -> tuple[DataFrame, Shared]:
    """Answers to the blocks, and the sums over all restaurants: one row for the root and each frequent token reaches the driver."""
    dealt = said.where("part >= 0").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "block")
    rows = durable(dealt.mapInArrow(_shared_cells(last, seed), ANSWER))
    sums = rows.where("block < 0").groupBy("room").agg(*[F.sum(c).alias(c) for c in ("customers", "tables", "n", "v", "once", "twice")]).collect()
    customers, tables = np.zeros(1 + len(book.hot)), np.zeros(1 + len(book.hot))
    for r in sums:
        customers[r["room"]], tables[r["room"]] = r["customers"], r["tables"]
    answers = rows.where("block >= 0").select("block", "part", "data")
    if last is not None:
        return answers, Shared(last.n, last.v, last.discounts, customers, tables)
    root = next((r for r in sums if r["room"] == 0), None)
    few = (root["once"], root["twice"]) if root else (0, 0)
    return answers, Shared(int(root["n"]) if root else 0, int(root["v"]) if root else 0, (_discount(*few), 0.5, 0.5), customers, tables)


def _discount(once: float, twice: float) -> float:
    return float(min(0.95, max(0.05, once / max(once + 2 * twice, 1))))


def _next_words(shared, parts: int, now: Shared, sweeps: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, shared.value)
            b.resume(row["answers"])
            b.receive(parts, row["answers"], now)
            rng = np.random.default_rng((seed, b.number))
            b.plan(rng)
            for _ in range(sweeps):
                b.sweep(rng)
            own = np.array(b.settle(rng), np.int64).tobytes()
            yield _batch([*((b.number, p, data) for p, data in b.messages(parts, False)), (b.number, OWN, own), (b.number, STATE, b.state())], SAID)

    return run


# Scores

PARTIAL = "chunk long, docs binary, data binary"


def _partial(shared, parts: int, now: Shared, sweeps: int, seed: int):
    """A block's predictions, then of each message the sums of each of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = known = base = None
        for row in _rows(batches):
            if row["part"] == 0:
                b = Block(row, shared.value)
                b.resume(row["answers"])
                b.receive(parts, row["answers"], now)
                rng = np.random.default_rng((seed, b.number))
                b.plan(rng)
                p = np.zeros(len(b.count))
                for _ in range(sweeps):
                    b.sweep(rng)
                    p += b.predict()
                p, seen = -np.log10(p / sweeps), b.seen[b.root[b.pair]]
                known, base = seen > 0, np.log10(2 * seen + 1)
                continue
            at, entries = parts_of(row["entries"])
            per_cell, doc, times = map(unpack, parts_of(entries))
            cell = np.repeat(np.cumsum(unpack(at)), per_cell)
            some = np.flatnonzero(np.bincount(doc))
            add = lambda x: np.bincount(doc, x)[some]  # noqa: B023, E731
            found = [add(times), add(known[cell] * times), np.round(add(base[cell] * times) * FIXED), np.round(add(p[cell] * times) * FIXED)]
            yield _batch([(row["chunk"], row["docs"], bundle(pack(np.diff(some, prepend=0)), *(pack(x.astype(np.int64)) for x in found)))], PARTIAL)

    return run


SCORED = "doc_id long, held int, n_tokens long, n_known long, base double, score double"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one chunk's texts after another."""
    at, about, held = None, None, []

    def done() -> pa.RecordBatch:
        ids, out = np.frombuffer(about[0], np.int64), np.zeros((4, len(about[0]) // 8), np.int64)
        for x in held:
            out[:, np.cumsum(unpack(x[0]))] += np.stack([unpack(v) for v in x[1:]])
        columns = [pa.array(ids, mask=ids == NO_ID), pa.array(unpack(about[1]).astype(np.int32)), pa.array(out[0]), pa.array(out[1]), pa.array(out[2] / FIXED), pa.array(-out[3] / FIXED)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    for row in _rows(batches):
        if row["chunk"] != at:
            if held:
                yield done()
            at, about, held = row["chunk"], None, []
        about = parts_of(row["docs"]) if row["docs"] is not None else about
        held.append(parts_of(row["data"]))
    if held:
        yield done()


def _with_answers(table: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Rows of blocks with what was sent to them, at their first part. The bucketed side stays where it is."""
    sent = answers.repartition(buckets, "block").groupBy(F.col("block").alias("__block")).agg(F.collect_list(F.struct("part", "data")).alias("answers"))
    return table.join(sent, (table["block"] == sent["__block"]) & (table["part"] == 0), "left").drop("__block")


def _bucketed(spark: SparkSession, blocks: DataFrame, n: int) -> DataFrame:
    """Blocks written to the shared folder in buckets by their number, so that later joins by it move the other side only."""
    name = f"quarrystone_{uuid.uuid4().hex}"
    blocks.write.bucketBy(n, "block").sortBy("block", "part").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, held_out: F.Column, rounds: int = ROUNDS, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """Log10 probabilities of all texts under a model of those for which ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, one row a row of ``docs``.
    base_score is that of single tokens with half a count added to each. Null texts count as empty and have one
    token, the end. Rows for which ``held_out`` is null, as with a null doc_id, are held out. Repeated rows are scored each, and learnt from
    each. With nothing to learn from, all tokens are equally likely. An empty table gives no rows. ``docs`` must give the same rows
    in the same order whenever it is read, as files and written tables do. Other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(True))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.cast("long").alias("held"), (~held).cast("long").alias("train"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(4, -(-size // BLOCK_BYTES))
    buckets = min(blocks, BUCKETS)
    book = code_book(rows, blocks)
    shared = spark.sparkContext.broadcast(book)
    dealt = rows.mapInArrow(_deal(shared), DEALT).repartitionById(buckets, (F.col("block") % buckets).cast("int")).sortWithinPartitions("block", "chunk")
    table = _bucketed(spark, dealt.mapInArrow(_gather(shared), BLOCK), buckets)
    grams = table.where("part = 0").select("block", "part", "grams")

    few = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs_once", "pairs_twice", "cells_once", "cells_twice")]).first()
    answers, now = exchange(grams.mapInArrow(_first_words(shared, buckets), SAID), buckets, None, book, 0)
    now.discounts = (now.discounts[0], _discount(few[0], few[1]), _discount(few[2], few[3]))
    for k in range(rounds):
        said = durable(_with_answers(grams, answers, buckets).mapInArrow(_next_words(shared, buckets, now, sweeps, 1 + k), SAID))
        answers, now = exchange(said, buckets, now, book, 1001 + k)
        answers = answers.unionAll(said.where(F.col("part") == STATE))
        own = [np.frombuffer(r["data"], np.int64) for r in said.where(F.col("part") == OWN).select("data").toLocalIterator()]  # two numbers a block
        now.customers[0] += sum(int(x[0]) for x in own)
        now.tables[0] += sum(int(x[1]) for x in own)
    whole = _with_answers(table, answers, buckets).sortWithinPartitions("block", "part")
    parts = whole.mapInArrow(_partial(shared, buckets, now, samples, 2001), PARTIAL)
    out = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_whole, SCORED)
    missing = float(np.log10(now.n + 0.5 * (now.v + 1)) + np.log10(2))
    return out.select(
        "doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(now.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * missing).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
