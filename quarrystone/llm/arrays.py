"""Words of a batch of texts as numpy arrays.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. The separators are ASCII, so UTF-8 texts are
cut on their bytes. A word's hash is made of two polynomials of its bytes modulo primes of 31 bits, taken from running sums
over many words at once, and then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4096

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of sums and of the mixer.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Primes and bases of the words' polynomials, and how many bytes are summed up at once.
FIELDS = ((2**31 - 1, 1_640_531_527), (2**31 - 19, 1_540_483_477))
SLICE = 1 << 16
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x % 2**64], U))[0])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order and each value's place among them; only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[coded.indices.to_numpy()]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(p: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo p for i up to SLICE."""
    if p not in _powers:
        both = []
        for b in (base, pow(base, -1, p)):
            out = np.ones(1, U)
            while len(out) <= SLICE:
                out = np.concatenate((out, out * U(pow(b, len(out), p)) % U(p)))
            both.append(out)
        _powers[p] = (both[0], both[1])
    return _powers[p]


def _polynomials(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each span of bytes, ascending and apart, its two polynomials side by side."""
    out, a, n = np.zeros(len(start), U), 0, len(start)
    while a < n:
        b = max(a + 1, int(np.searchsorted(end, start[a] + SLICE, side="right")))
        from_, to = int(start[a]), int(end[b - 1])
        values = data[from_:to].astype(U) + U(1) if to - from_ <= SLICE else None
        s, e = start[a:b] - from_, end[a:b] - from_
        for i, (p, base) in enumerate(FIELDS):
            up, down = _prime_powers(p, base)
            if values is None:  # one word
                v = 0
                for x in range(from_, to, SLICE):
                    part = data[x : min(x + SLICE, to)].astype(U) + U(1)
                    v = (v + int((part * up[: len(part)]).sum()) * pow(base, x - from_, p)) % p
                found = np.array([v], U)
            else:
                total = np.zeros(to - from_ + 1, U)
                np.cumsum(values * up[: to - from_], out=total[1:])
                found = (total[e] - total[s]) % U(p) * down[s] % U(p)
            out[a:b] |= found << U(31 * i)
        a = b
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            out = np.full(size, b, U)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of values[start:end] for each span, by running sums."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # of each text in data
    doc: np.ndarray  # of each word, ascending
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """Of each text the index of its first word; one more at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The text and the hash of each run of k words; a shorter text that has words is one run."""
        n, out = len(self.doc), []
        if n >= k:
            g = self.h[: n - k + 1].copy()
            for j in range(1, k):
                g = mix(g * U(BASES[0]) + self.h[j : n - k + 1 + j])
            inside = self.doc[: n - k + 1] == self.doc[k - 1 :]
            out.append((self.doc[: n - k + 1][inside], g[inside]))
        counts, first = self.counts(), self.first()
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            whole = spans(self.h, BASES[1], first[short], first[short + 1])
            out.append((short, mix(whole + U(7) * counts[short].astype(U))))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, U)
        doc, h = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(doc, kind="stable")
        return doc[order], h[order]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of an Arrow array of texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~SEPARATOR[data]
    left, right = np.ones(n, bool), np.ones(n, bool)
    left[1:], right[:-1] = ~inside[:-1], ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    left[edge] = True
    right[(offsets[1:] - 1)[offsets[:-1] < offsets[1:]]] = True
    start, end = np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1
    doc = np.searchsorted(offsets[1:], start, side="right")
    h = mix(_polynomials(data, start, end) + (end - start).astype(U) * U(BASES[0]))
    return Words(data, offsets, doc, start, end, h)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values, put together from runs whose lengths are powers of two."""
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                n = len(h) - done - size + 1
                out = mix(out[: max(n, 0)] * U(BASES[0]) + part[done : done + max(n, 0)])
            done += size
        if done == k:
            return out
        n = max(len(part) - size, 0)
        part, size = mix(part[:n] * U(BASES[1]) + part[size : size + n] + U(size)), 2 * size


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``rows`` rows and ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), 1))
        at, done = 0, 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(sizes, done + limit, side="right"))))
            yield batch.slice(at, to - at)
            at, done = to, int(sizes[to - 1])
