"""Token counts that follow edits.

Leaf sums can be kept as a column and given back, so that a later edit does not encode the text again.

A text's pre-tokens lie in blocks, and a segment tree over the blocks keeps sums of characters and
of tokens. An edit touches the blocks around it: the pre-tokens from the block with the last
unchanged character but one (the pattern looks that far ahead) are cut anew until a cut falls on an old block's start behind the edit. From there on nothing
can differ, since the pattern looks ahead only; the touched leaves and the paths above them are updated.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks

#: Ranks of a byte-level BPE in tiktoken's format; every executor must find the file there.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 64
CACHE = 300_000

TREE_TYPE = "array<struct<chars: int, tokens: int>>"
EDIT_TYPE = "array<struct<start: int, end: int, text: string>>"


class Counter:
    """Numbers of tokens of pre-tokens, remembered."""

    def __init__(self, path: str = TOKENIZER, pattern: str = PATTERN):
        with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def __getitem__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class TokenTree:
    """One text: its string and the sums over blocks of its pre-tokens."""

    def __init__(self, text: str, counter: Counter, leaves: list[tuple[int, int]] | None = None):
        """With ``leaves``, (characters, tokens) of blocks as kept before; leaves of another text are cut anew."""
        self.counter, self.encoded, self.text = counter, 0, text
        if not leaves or sum(c for c, _ in leaves) != len(text):
            leaves = self.cut(counter.split(text))
            self.encoded = len(text)
        self.plant(leaves)

    def cut(self, pieces: list[str]) -> list[tuple[int, int]]:
        counter = self.counter
        blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        return [(sum(map(len, b)), sum(counter[p] for p in b)) for b in blocks]

    def plant(self, leaves: list[tuple[int, int]]) -> None:
        """The tree over these leaves."""
        self.size = 1 << (len(leaves) - 1).bit_length()
        rest = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [c for c, _ in leaves] + rest
        self.tokens = [0] * self.size + [t for _, t in leaves] + rest
        for i in range(self.size - 1, 0, -1):
            self.add_up(i)

    def leaves(self) -> list[tuple[int, int]]:
        return [x for x in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if x[0]]

    def leaf(self, i: int, pieces: list[str]) -> None:
        counter = self.counter
        self.chars[self.size + i] = sum(map(len, pieces))
        self.tokens[self.size + i] = sum(counter[p] for p in pieces)

    def add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def block_at(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one with text for the end), and where it starts."""
        i, start = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters start to end, both cut to the text, by ``text``."""
        old = len(self.text)
        start = min(max(start, 0), old)
        end = min(max(end, start), old)
        first, left = self.block_at(max(start - 2, 0))
        last, right = self.block_at(end)
        right += self.chars[self.size + last]
        self.text = self.text[:start] + text + self.text[end:]
        shift = len(text) - (end - start)
        pieces, done = [], left
        for m in self.counter.pattern.finditer(self.text, left):
            pieces.append(m[0])
            done = m.end()
            while right + shift < done and last + 1 < self.size:
                last += 1
                right += self.chars[self.size + last]
            if done == right + shift and right >= end and right < old:
                break
        else:
            last = self.size - 1
        self.encoded += done - left
        room = last - first + 1
        each = -(-len(pieces) // room) if pieces else 0
        if each > 4 * BLOCK:  # more text than these leaves should hold: others are put between
            old = list(zip(self.chars[self.size :], self.tokens[self.size :], strict=True))
            self.plant([x for x in old[:first] + self.cut(pieces) + old[last + 1 :] if x[0]] or [(0, 0)])
            return
        for k in range(room):
            self.leaf(first + k, pieces[k * each : (k + 1) * each])
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self.add_up(i)
            low, high = low // 2, high // 2


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, keep_tree: bool = False) -> DataFrame:
    """All columns of ``docs`` with counts before and after the row's ``edits``.

    ``edits`` is an array of (start, end, text), in characters, each applied to what the one before left; ends are
    cut to the text, null texts and null arrays count as empty, null entries are skipped. Added: n_chars, n_tokens,
    edited_chars, edited_tokens and reencoded_chars, the characters that were cut anew after the first count. Columns of these
    names are replaced; repeated rows are counted each. With ``keep_tree``, ``edited_text`` and ``tree``, its leaf sums, are
    added. A row whose ``tree`` comes along (as kept, of the row's text) is not encoded but where its edits touch it;
    ``keep_tree`` has to be set for that. ``tokenizer`` is a path on every executor, or the name of a file sent with ``SparkContext.addFile``.
    """
    added = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"]
    source = docs.drop(*added, *(["edited_text"] if keep_tree else []))
    if keep_tree and "tree" not in source.columns:
        source = source.withColumn("tree", F.lit(None).cast(TREE_TYPE))
    if "edits" not in source.columns:
        source = source.withColumn("edits", F.lit(None).cast(EDIT_TYPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, pattern)
        for batch in chunks(batches):
            rows = np.zeros((batch.num_rows, len(added)), np.int64)
            kept, texts = [], []
            trees = batch.column("tree").to_pylist() if keep_tree else [None] * batch.num_rows
            for i, (text, edits, leaves) in enumerate(zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), trees, strict=True)):
                tree = TokenTree(text or "", counter, leaves and [(x["chars"], x["tokens"]) for x in leaves])
                n = (len(tree.text), tree.total)
                tree.encoded = 0
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows[i] = (*n, len(tree.text), tree.total, tree.encoded)
                if keep_tree:
                    kept.append([{"chars": c, "tokens": t} for c, t in tree.leaves()])
                    texts.append(tree.text)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("edits", *(["tree"] if keep_tree else []))}
            if keep_tree:
                columns |= {"edited_text": pa.array(texts, pa.string()), "tree": pa.array(kept, pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])))}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(rows[:, i]) for i, c in enumerate(added)})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name not in ("edits", *(["tree"] if keep_tree else [])))
    names += f", edited_text string, tree {TREE_TYPE}" if keep_tree else ""
    return source.mapInArrow(run, names + "".join(f", {c} long" for c in added))
