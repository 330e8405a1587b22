"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a shallow tree of that feature alone to
its lookup table over bins; then pairs of features get small tables in the same way. A score is the
sum of one table entry for each feature and pair, so scoring is bin search and addition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, words_of
from .neardup import weighted

#: The most labelled rows, about, that a model is fitted on; a larger number is thinned by a hash of doc_id.
MAX_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, ROUNDS, PAIRS, RATE = 32, 8, 120, 6, 0.1

FEATURES = (
    "words", "bytes_per_word", "sd_bytes_per_word", "upper", "digits", "exclamation", "bars", "symbols", "stops", "non_ascii",
    "other_marks", "distinct_words", "top_word", "distinct_runs", "short_words", "long_words", "lines_per_word", "repeated_lines", "line_sd", "marked_words",
)


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, chars in (("exclamation", "!"), ("bars", "|"), ("symbols", "#$%&*@^~=<>{}[]\\_+"), ("stops", ".,;:?"), ("other_marks", "\"'()/-`"), ("digits", "0123456789"), ("newline", "\n")):
        out[name] = np.zeros(256, bool)
        out[name][list(chars.encode())] = True
    out["upper"], out["non_ascii"] = np.zeros(256, bool), np.zeros(256, bool)
    out["upper"][65:91], out["non_ascii"][128:] = True, True
    return out


CLASSES = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers a text, in the order of FEATURES. Texts without words have zeros."""
    w = words_of(texts)
    n, size = w.counts(), np.maximum(np.diff(w.offsets), 1)
    per = np.maximum(n, 1)
    length = (w.end - w.start).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[w.offsets[1:]] - total[w.offsets[:-1]]

    out = {name: share(table[w.data]) / size for name, table in CLASSES.items()}
    add = lambda x: np.bincount(w.doc, weights=x, minlength=w.n_docs)
    mean = add(length) / per
    out["words"], out["bytes_per_word"] = np.log1p(n), mean
    out["sd_bytes_per_word"] = np.sqrt(np.maximum(add(length**2) / per - mean**2, 0))
    out["short_words"], out["long_words"] = add(length <= 3) / per, add(length > 12) / per
    last = w.data[w.end - 1] if len(w.end) else w.data[:0]
    out["marked_words"] = add((CLASSES["exclamation"] | CLASSES["symbols"])[last]) / per
    doc, _, count = weighted(w.doc, w.h)
    out["distinct_words"] = np.bincount(doc, minlength=w.n_docs) / per
    top = np.zeros(w.n_docs)
    np.maximum.at(top, doc, count)
    out["top_word"] = top / per
    at, h = w.shingles(5)
    doc, _, _ = weighted(at, h)
    out["distinct_runs"] = np.bincount(doc, minlength=w.n_docs) / np.maximum(np.bincount(at, minlength=w.n_docs), 1)
    # a line is named by its first word and its length, which is enough for a share of repeats
    starts = np.ones(len(w.doc), bool)
    lines = np.concatenate(([0], np.cumsum(w.data == 10)))
    line = lines[w.start]
    starts[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(starts)
    words = np.diff(np.append(first, len(w.doc))).astype(np.float64)
    doc, total = w.doc[first], np.maximum(np.bincount(w.doc[first], minlength=w.n_docs), 1)
    distinct, _, _ = weighted(doc, w.h[first] + words.astype(np.uint64))
    out["repeated_lines"] = 1 - np.bincount(distinct, minlength=w.n_docs) / total
    out["lines_per_word"] = total / per
    mean = np.bincount(doc, weights=words, minlength=w.n_docs) / total
    out["line_sd"] = np.sqrt(np.maximum(np.bincount(doc, weights=words**2, minlength=w.n_docs) / total - mean**2, 0))
    table = np.column_stack([out[f] for f in FEATURES])
    table[n == 0] = 0
    return table


@dataclass
class Model:
    """Bins and lookup tables: at most len(FEATURES) * BINS + PAIRS * PAIR_BINS**2 numbers."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """The gain and the place of the best cut of consecutive bins; place 0 for none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """The leaf value of each bin in a tree of depth two."""
    _, root = _cut(g, h, penalty)
    places = [0, len(g)] if not root else [0, _cut(g[:root], h[:root], penalty)[1], root, root + _cut(g[root:], h[root:], penalty)[1], len(g)]
    out = np.zeros(len(g))
    for a, b in zip(places[:-1], places[1:], strict=True):
        if b > a:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Of a two-way table the best tree that cuts both features once: its gain and leaf values."""
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            sums = [(g[p].sum(), h[p].sum()) for p in parts]
            gain = sum(a * a / (b + penalty) for a, b in sums)
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for p, (a, b) in zip(parts, sums, strict=True):
                    out[p] = a / (b + penalty)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 5.0) -> Model:
    """A model of y (0 or 1). Without rows it scores 0.5; with one class, near that class."""
    if not len(y):
        return Model()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    m = Model(intercept=float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return m
    quantiles = lambda n, k: np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1]))
    m.edges = [quantiles(BINS, k) for k in range(x.shape[1])]
    m.coarse = [quantiles(PAIR_BINS, k) for k in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.edges)]
    wide = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.coarse)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, b in enumerate(fine):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(m.tables[k])), np.bincount(b, h, len(m.tables[k])), penalty)
            m.tables[k] += step
            z += step[b]

    def crossed(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = len(m.coarse[a]) + 1, len(m.coarse[b]) + 1
        cell = wide[a] * shape[1] + wide[b]
        return *_quadrants(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), penalty), cell

    ranked = sorted(((crossed(a, b)[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    m.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    m.pair_tables = [np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)) for a, b in m.pairs]
    for _ in range(ROUNDS // 4):
        for i, (a, b) in enumerate(m.pairs):
            _, step, cell = crossed(a, b)
            m.pair_tables[i] += RATE * step
            z += RATE * step.ravel()[cell]
    return m


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        x = features(batch.column("text"))
        rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.float64()), rows], ["quality", "x"])


def held_out() -> F.Column:
    """Rows that are never learnt from; false for a null doc_id, which has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows whose crc32 of doc_id, modulo 4, is not 2.

    Rows without a label or a doc_id are left out, and a doc_id with both labels counts as 1. Of more than ``max_rows`` labels
    those with the smallest hashes are taken, so the driver gets a bounded table of numbers.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out())
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "quality")
    found = rows.mapInArrow(_measured, "quality double, x array<double>").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = found.column("quality").to_numpy()
    order = np.lexsort((*x.T, y))  # the order of rows does not matter to sums
    return fit(x[order], (y[order] > 0).astype(np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= threshold).

    Every whole text is scored; null texts as empty ones. Repeated rows get equal scores. Columns of these names are replaced.
    """
    source = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = model.score(features(batch.column("text")))
            columns = {n: batch.column(n) for n in batch.schema.names} | {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(columns)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{names}, score double, predicted int")
