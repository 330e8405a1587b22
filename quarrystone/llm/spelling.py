"""Spelling variants of the words of a corpus, by deletion keys of rolling hashes.

Two words are near if one code point is inserted, deleted or replaced: they are then equal after one deletion, or one is the other after
it. A word's polynomial without its i-th code point is its prefix's plus its suffix's moved down by one, so the keys of all deletions of
many words come from two running sums in NumPy. Keys are dealt by their hash, sorted, and compared with their neighbours; what they find
is verified on the strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .arrays import BASES, FIELDS, U, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DELETE_EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Distinct words that a task counts before it gives them out, and code points whose keys are made at once.
HELD, POINTS = 500_000, 1 << 18
WHOLE = -1


def occurrences(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of a text that are long enough, after the code points that their hash names are deleted, with their numbers; a null id is written as nothing."""
    head = f"{'' if doc_id is None else doc_id}:".encode()
    start = zlib.crc32(head)
    runs = RUN.findall((text or "").encode().lower().decode())  # bytes are lowered from A to Z only
    for word, n in Counter(runs).items():
        if len(word) >= LEAST_LENGTH:
            h = zlib.crc32(word.encode(), start)
            if h % DELETE_EVERY == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
                if len(word) < LEAST_LENGTH:
                    continue
            yield word, n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            for word, n in occurrences(doc_id.as_py(), text.as_py()):
                held[word] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that occur at least ``least`` times in all of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _up(p: int, base: int, n: int) -> np.ndarray:
    """base**i modulo p for i below n."""
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate((out, out * U(pow(base, len(out), p)) % U(p)))
    return out[:n]


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, first, key) of every word whole, at position -1, and without each of its code points.

    ``first`` is false where the code point before is the same, so that its deletion gives the same string.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U) + U(1)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(point)) - start[row]
    whole, cut = np.zeros(len(words), U), np.zeros(len(point), U)
    for i, (p, base) in enumerate(FIELDS):
        up = _up(p, base, int(size.max(initial=1)))
        total = np.zeros(len(point) + 1, U)
        np.cumsum(point * up[at] % U(p), out=total[1:])
        prefix = (total[:-1] - total[start[row]]) % U(p)
        suffix = (total[(start + size)[row]] - total[1:]) % U(p)
        moved = suffix * U(pow(base, -1, p)) % U(p)
        cut |= (prefix + moved) % U(p) << U(31 * i)
        whole |= (total[start + size] - total[start]) % U(p) << U(31 * i)
    salt = lambda n: n.astype(U) * U(BASES[0])
    first = np.ones(len(point), bool)
    first[1:] = (point[1:] != point[:-1]) | (row[1:] != row[:-1])
    rows = np.concatenate((np.arange(len(words)), row))
    keys = np.concatenate((mix(whole + salt(size)), mix(cut + salt(size[row] - 1))))
    return rows, np.concatenate((np.full(len(words), WHOLE), at)), np.concatenate((np.ones(len(words), bool), first)), keys


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        a = 0
        while a < len(words):
            b, points = a + 1, len(words[a])
            while b < len(words) and points + len(words[b]) <= POINTS:
                points += len(words[b])
                b += 1
            row, pos, first, key = deletion_keys(words[a:b])
            for i in range(0, len(row), POINTS):
                part = slice(i, i + POINTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part].view(np.int64)), pa.array(ids[a:b][row[part]]), pa.array(pos[part].astype(np.int32)), pa.array(first[part])], ["key", "id", "pos", "first"]
                )
            a = b


def met(key: np.ndarray, pos: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, ascending by (key, pos), with equal keys: deletions at one position, and whole words with first deletions."""
    n, found = len(key), []
    at, d = np.arange(n), 1
    while len(at):
        at = at[at + d < n]
        at = at[(key[at] == key[at + d]) & (pos[at] == pos[at + d])]
        found.append((at, at + d))
        d += 1
    found = [(a[pos[a] != WHOLE], b[pos[a] != WHOLE]) for a, b in found]
    whole, cut = np.flatnonzero(pos == WHOLE), np.flatnonzero((pos != WHOLE) & first)
    low, high = np.searchsorted(key[whole], key[cut]), np.searchsorted(key[whole], key[cut], side="right")
    while len(cut):  # a key has one whole word, or several that collide
        on = low < high
        cut, low, high = cut[on], low[on], high[on]
        found.append((whole[low], cut))
        low = low + 1
    return np.concatenate([a for a, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([b for _, b in found] or [np.zeros(0, np.int64)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, pos, first, ids = (rows.column(c).to_numpy() for c in ("key", "pos", "first", "id"))
        a, b = met(key, pos, first)
        for i in range(0, len(a), POINTS):
            x, y = a[i : i + POINTS], b[i : i + POINTS]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(pos[x]), pa.array(pos[y])], ["a", "b", "pos_a", "pos_b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if end or (held and held[-1].column("key")[-1].as_py() != key[-1]):
            yield from out(pa.Table.from_batches([*held, batch.slice(0, end)]))
            held = []
        held.append(batch.slice(end))
    if held:
        yield from out(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``, both ways round, of ``words(id, word, n)``: each two that differ by one code point, once.

    A key has at most one row for each code point that its position can have, and for each position, so it is no hot key.
    A pair comes from one position alone, where its strings are compared.
    """
    keys = words.select("id", "word").mapInArrow(_keys, "key long, id long, pos int, first boolean")
    pairs = keys.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_pairs, "a long, b long, pos_a int, pos_b int")
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    cut = lambda x: F.when(F.col(f"pos_{x}") == WHOLE, F.col(f"word_{x}")).otherwise(F.expr(f"concat(left(word_{x}, pos_{x}), substring(word_{x}, pos_{x} + 2))"))
    true = durable(both.where((cut("a") == cut("b")) & (F.col("word_a") != F.col("word_b"))).select("word_a", "n_a", "word_b", "n_b"))
    return true.select(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("other"), F.col("n_b").alias("other_n")).unionAll(
        true.select("word_b", "n_b", "word_a", "n_a")
    )


def rooted(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the end of the forms that follow each other. Each round doubles the steps; forms grow fivefold, so there are few."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        moved = durable(moved)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of ``docs(doc_id, text)``.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, one code point deleted where 199 divides the crc32 of
    ``<doc_id>:<run>``, that have at least six code points and occur at least ``least`` times. A word's form is the most frequent
    word near it (the first in code-point order of several) if that occurs ``ratio`` times as often, and its root is where its forms end.

    Null and empty texts have no words; a null doc_id is written as nothing. Repeated rows count each. Words may be as long as a text. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    words = durable(word_counts(docs, least).withColumn("id", F.monotonically_increasing_id()))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = durable(near.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")))
    roots = rooted(found.where("form is not null"))
    out = words.select("word", "n").join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
