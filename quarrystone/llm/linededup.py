"""Removal of passages of three or more lines that stood before.

Windows are three consecutive lines, blank ones skipped, compared without spaces, tabs and carriage
returns at their ends. All windows are hashed to 128 bits and counted over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable

WINDOW = 3
ENDS = " \t\r"


def uncovered(text: str, starts: list[int]) -> tuple[str, int]:
    """The text without the lines that windows at ``starts`` cover, and their number."""
    covered, end = set(), 0
    for s in sorted(starts):
        covered.update(range(max(s, end), s + WINDOW))
        end = s + WINDOW
    kept, k = [], -1
    lines = text.split("\n")
    for line in lines:
        blank = not line.strip(ENDS)
        k += not blank
        if blank or k not in covered:
            kept.append(line)
    return "\n".join(kept), len(lines) - len(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [
            (text, 0) if not starts or text is None else uncovered(text, starts)
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("__starts").to_pylist(), strict=True)
        ]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "__starts"}
        columns["text"] = pa.array([x[0] for x in done], batch.schema.field("text").type)
        columns["n_removed"] = pa.array([x[1] for x in done], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, starts)``: where windows begin in a row that also stood earlier, by (doc_id, text, position)."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("tag"),
        F.expr(r"filter(transform(split(text, '\n'), l -> trim(BOTH ' \t\r' FROM l)), l -> l <> '')").alias("l"),
    ).where(F.size("l") >= WINDOW)
    windows = lines.select(
        "doc_id", "tag",
        F.posexplode(F.expr("transform(sequence(0, size(l) - 3), i -> struct(xxhash64(l[i], l[i + 1], l[i + 2]) as a, xxhash64(1, l[i], l[i + 1], l[i + 2]) as b))")).alias("pos", "w"),
    ).select("doc_id", "tag", "pos", "w.a", "w.b")
    first = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "pos")).alias("first")).where("n > 1")
    later = windows.join(first.hint("merge"), ["a", "b"]).where(F.struct("doc_id", "tag", "pos") > F.col("first"))
    return later.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("starts"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines gone that a later occurrence of a three-line window covers, and ``n_removed``.

    Occurrences are ordered by doc_id and position; the first stays whole. Overlapping windows
    merge, so longer passages go as one. Windows are judged on the input. Blank lines are never
    part of a window and stay. Null texts stay null; texts under three lines stay as they are.
    Rows that repeat a doc_id are told apart by their text; wholly repeated rows are one
    document and get the same result. Columns of ``docs`` keep their names and order; one named
    n_removed is replaced. Hot windows are pre-aggregated, and the join back is on a unique key.
    """
    source = docs.drop("n_removed")
    found = repeated_windows(source).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("starts").alias("__starts"))
    joined = source.join(
        durable(found).hint("merge"), source["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(source["text"]) == F.col("__tag")), "left"
    ).drop("__id", "__tag")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return joined.mapInArrow(_cut, f"{names}, n_removed long")
