"""Interleaving sources by Pfair schedules.

Block i (from 0) of a source of weight w, a share of all, is released at slot floor(i / w) and due by slot
ceil((i + 1) / w); each slot goes to the released block with the earliest deadline. Weights are whole numbers over their
sum, without rounding. Slots are cut into windows, and up to each cut a source has had its target rounded down or up. Which are rounded
up is decided at the cut alone, such that the slots before it can hold all that are, and those after it all others, each block between its
release and its deadline. A window is long enough for one block of every source, so counts never fall, and
every window is scheduled in a task, without the others.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable

PERIOD = 1024
BLOCK = 16
#: Rows of a source are ranked in hashed buckets: at least so many, and one for so many rows of all.
BUCKETS, BUCKET_ROWS = 256, 50_000
SLOTS = "__source string, mix_block long, mix_slot long, mix_release long, mix_deadline long"


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source: largest remainders, and one at least; ``period`` grows to the number of sources."""
    names = sorted(weights)
    period, total = max(period, len(names)), sum(weights.values())
    exact = {s: weights[s] / total * (period - len(names)) for s in names}
    q = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(q.values())]:
        q[s] += 1
    return q


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    most = math.gcd(*out.values())
    return {s: w // most for s, w in out.items()}


def cut(w: dict[str, int], slots: int) -> dict[str, int]:
    """Blocks of each source up to a cut: its target rounded down or up, together as many as there are slots.

    A source whose target is not whole has one block that is released before the cut and due after it, on either side. Those put before it must
    be so many that the slots from any x to the cut are not too few for what is released from x on: of those released before x, at most as many as
    all targets at x, rounded up, exceed x may be left. Where one more must be chosen it is the one due first, and no more are than must be
    until all that are released are known; so as few as can be are due late, and what is left after the cut can keep its deadlines.
    """
    total = sum(w.values())
    out = {s: slots * x // total for s, x in w.items()}
    spare = slots - sum(out.values())
    if not spare:
        return out
    open_ = [(out[s] * total // w[s], -(-(out[s] + 1) * total // w[s]), s) for s in sorted(w) if slots * w[s] % total]
    at = min(open_)[0] + 1
    released = Counter(i * total // v for v in w.values() for i in range(-(-at * v // total), -(-slots * v // total)))
    left = sum(-(-at * v // total) for v in w.values()) - at  # at slot ``at``: blocks that are open less slots that are filled
    by_slot: dict[int, list[tuple[int, str]]] = {}
    for release, due, s in open_:
        by_slot.setdefault(release + 1, []).append((due, s))
    ready: list[tuple[int, str]] = []
    chosen: list[str] = []
    for x in range(at, slots):
        for one in by_slot.get(x, ()):
            heapq.heappush(ready, one)
        while len(ready) > left:
            chosen.append(heapq.heappop(ready)[1])
        left += released[x] - 1
    ready += by_slot.get(slots, ())
    heapq.heapify(ready)
    chosen += [heapq.heappop(ready)[1] for _ in range(spare - len(chosen))]
    for s in chosen:
        out[s] += 1
    return out


def window(w: dict[str, int], start: int, end: int, last: dict[str, int] | None = None) -> list[tuple[str, int, int, int, int]]:
    """``(source, block, slot, release, deadline)`` of the slots from start to end, earliest deadline first; blocks from ``last`` on do not exist."""
    total, out, ready = sum(w.values()), [], []
    first, to = cut(w, start), cut(w, end)
    blocks = sorted(
        (max(i * total // w[s], start), min(-(-(i + 1) * total // w[s]), end), s, i)
        for s in w for i in range(first[s], to[s] if last is None else min(to[s], last[s]))
    )
    at, slot = 0, start
    while at < len(blocks) or ready:
        slot = slot if ready else max(slot, blocks[at][0])
        while at < len(blocks) and blocks[at][0] <= slot:
            heapq.heappush(ready, blocks[at][1:])
            at += 1
        _, s, i = heapq.heappop(ready)
        out.append((s, i, slot, i * total // w[s], -(-(i + 1) * total // w[s])))
        slot += 1
    return out


def schedule(q: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The slots of one period."""
    return window(q, 0, sum(q.values()))


def _slots(spark, weights: dict[str, float], last: dict[str, int], base: int) -> tuple[DataFrame, int]:
    """``(__source, mix_block, mix_slot, mix_release, mix_deadline)`` of every block, from slot ``base`` on, and the slot after them."""
    w = whole(weights)
    total = sum(w.values())
    length = max(PERIOD, -(-total // min(w.values())))
    end = max(-(-last[s] * total // w[s]) for s in w)
    windows = -(-end // length)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["id"].tolist():
                found = pd.DataFrame(window(w, k * length, (k + 1) * length, last), columns=["__source", "mix_block", "mix_slot", "mix_release", "mix_deadline"])
                found[["mix_slot", "mix_release", "mix_deadline"]] += base
                yield found

    return spark.range(0, windows, 1, min(windows, BUCKETS)).mapInPandas(plan, SLOTS), base + end


def _rows(docs: DataFrame) -> dict[str, int]:
    rows = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).count().collect()
    return {r["s"]: r["count"] for r in rows}


def target_weights(docs: DataFrame, power: float = 0.5) -> dict[str, float]:
    """Default targets: the sources' numbers of rows to a power; 0 makes them equal, 1 leaves them as they are.

    There is one entry a source (null counts as the source ``''``): sources are few, not documents.
    """
    return {s: float(n) ** power for s, n in _rows(docs).items()}


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``mix_block`` (its source's block), ``mix_slot``, ``mix_release``, ``mix_deadline``, ``mix_seq``.

    Read in order of (mix_slot, mix_seq), every prefix holds less than one block more or less of a
    source than its target, as long as all sources last; a source that has run out leaves its
    slots empty and the others keep their proportions. No row is dropped or repeated. Blocks are
    ``block`` rows, in order of hashed buckets and doc_id; the ranks come from counts of
    (source, bucket), so a source with a third of all rows is spread over its buckets.

    Sources missing from ``weights`` (or with a weight of 0) follow after all others, in equal shares; a null source is one of its own,
    named ``''``. Repeated rows are separate rows. An empty table stays empty. Columns of that
    name in ``docs`` are replaced.
    """
    added = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_seq"]
    docs = docs.drop(*added)
    rows = _rows(docs)
    found = {s: float(n) ** 0.5 if weights is None else max(weights.get(s, 0.0), 0.0) for s, n in rows.items()}
    last = {s: -(-n // block) for s, n in rows.items()}
    spark = docs.sparkSession
    slots, base = spark.createDataFrame([], SLOTS), 0
    for part in ({s: x for s, x in found.items() if x > 0}, {s: 1.0 for s, x in found.items() if x <= 0}):
        if part:
            more, base = _slots(spark, part, {s: last[s] for s in part}, base)
            slots = slots.unionAll(more)

    keyed = docs.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "__bucket": F.pmod(F.xxhash64("doc_id"), F.lit(max(BUCKETS, -(-sum(rows.values()) // BUCKET_ROWS)))),
    })
    counts = keyed.groupBy("__source", "__bucket").count()
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select("__source", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")))
    inside = Window.partitionBy("__source", "__bucket").orderBy("doc_id", *([F.xxhash64("text")] if "text" in docs.columns else []))
    ranked = keyed.withColumn("__rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, ["__source", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__rank") / block).cast("long")).withColumn("mix_seq", (F.col("__rank") % block).cast("int"))
    placed = ranked.join(slots, ["__source", "mix_block"])
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def in_order(mixed: DataFrame) -> DataFrame:
    """Mixed rows written out in their order: ranges of slots, sorted inside."""
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_seq")
