"""Exact nearest vectors by an index of cells and shells.

Cells are fitted on a bounded draw of the vectors and hold every vector. On the unit sphere a vector of a cell is as far from a query as their distances to the
cell's centre differ, at least (the triangle inequality). So a unit, one shell of one cell, whose distances from the centre lie too far from the query's own
is passed over, and nothing that belongs to the result is lost. Units lie side by side in slabs, which a task compares at a time; a unit larger than a slab is dealt over several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .retrieval import best_of_slabs, nearest_each, slab_rows, usable

#: Vectors that cells are fitted on (about), the most cells, shells of a cell, queries of a block.
DRAWN, CELLS, SHELLS, ASKED = 20_000, 512, 16, 512
#: Distances are taken as known up to this.
SLACK = 1e-6


@dataclass
class VectorIndex:
    rows: DataFrame  # (slab, unit, k, v), of durable rows; the unit's number in its slab
    centres: np.ndarray
    units: pd.DataFrame  # cell, shell, near, far, n, slab, parts, unit: one row for each shell of a cell
    slabs: int
    dim: int
    vectors: DataFrame
    key: str
    vector: str


def _unit_vectors(v: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, and each of length 1."""
    x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, dim))
    norm = np.sqrt((x * x).sum(axis=1))
    return x, x / np.where(norm > 0, norm, 1.0)[:, None]


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ centres.T), 0))


def _usable(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    return usable(rows.where(F.size(vector) == dim), key, vector).where(F.exists("v", lambda x: x != 0))


def _slabs(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For units of ``n`` rows in order, their first slab, the slabs that they are dealt over, and their number in them."""
    first, parts, place = (np.zeros(len(n), np.int32) for _ in range(3))
    slab, held, units = 0, 0, 0
    for i, rows in enumerate(n):
        if units and held + rows > most:
            slab, held, units = slab + 1, 0, 0
        first[i], parts[i], place[i] = slab, max(1, -(-rows // most)), units
        held, units = held + rows, units + 1
        if parts[i] > 1:
            slab, held, units = slab + parts[i], 0, 0
    return first, parts, place


def _centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Directions of ``cells`` groups of unit vectors, by a few rounds of means."""
    found = x[np.random.default_rng(7).choice(len(x), cells, replace=False)]
    for _ in range(8):
        own = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        found = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1)[:, None], found)
    return found


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex | None:
    """An index of all vectors of the most frequent length; null if there are none. Those of other lengths are compared without it."""
    lengths = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return None
    dim, n = lengths["dim"], lengths["count"]
    rows = _usable(vectors, key, vector, dim)
    _, drawn = _unit_vectors(rows.where(F.pmod(F.xxhash64("k"), F.lit(2**20)) < 2**20 * DRAWN // n + 1).select("v").toPandas()["v"], dim)
    if not len(drawn):
        _, drawn = _unit_vectors(rows.limit(1000).select("v").toPandas()["v"], dim)
        if not len(drawn):
            return None
    centres = _centres(drawn, min(cells or max(1, min(CELLS, int(len(drawn) ** 0.5))), len(drawn)))
    apart = _apart(drawn, centres)
    own, r = apart.argmin(axis=1), apart.min(axis=1)
    edges = [np.unique(np.quantile(r[own == c], np.arange(1, SHELLS) / SHELLS)) if (own == c).any() else np.zeros(0) for c in range(len(centres))]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            _, x = _unit_vectors(f["v"], dim)
            apart = _apart(x, centres)
            cell, r = apart.argmin(axis=1), apart.min(axis=1)
            shell = np.array([np.searchsorted(edges[c], d) for c, d in zip(cell, r, strict=True)], np.int32)
            yield f.assign(cell=cell.astype(np.int32), shell=shell, r=r)

    placed = durable(rows.mapInPandas(place, "k long, v array<double>, cell int, shell int, r double"))
    units = placed.groupBy("cell", "shell").agg(F.min("r").alias("near"), F.max("r").alias("far"), F.count("*").alias("n")).orderBy("cell", "shell").toPandas()
    units["slab"], units["parts"], units["unit"] = _slabs(units["n"].to_numpy(), slab_rows(int(units["n"].sum())))
    where = vectors.sparkSession.createDataFrame([tuple(map(int, u)) for u in units[["cell", "shell", "slab", "parts", "unit"]].to_numpy()], "cell int, shell int, slab int, parts int, unit int")
    dealt = placed.join(F.broadcast(where), ["cell", "shell"]).select((F.col("slab") + F.pmod(F.xxhash64("k", "v"), F.col("parts"))).cast("int").alias("slab"), "unit", "k", "v")
    return VectorIndex(dealt, centres, units, int((units["slab"] + units["parts"]).max()), dim, vectors, key, vector)


def probes(index: VectorIndex, asked: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """``(slab, k, v, taken, n)``: the slabs that each row of ``asked(k, v, least)`` is sent to, the units there that it must be compared with, and their rows.

    Without ``least`` (null) these are the nearest units that have k rows in all. With it, the score of the k-th of those, they are
    all that can hold a score as high.
    """
    dim = index.dim
    shared = asked.sparkSession.sparkContext.broadcast((index.centres, *(index.units[c].to_numpy() for c in ("cell", "near", "far", "n", "slab", "parts"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, cell, near, far, n, slab, parts = shared.value
        starts = np.unique(slab, return_index=True)[1]
        ends = [*starts[1:], len(slab)]
        for f in frames:
            for at in range(0, len(f), ASKED):
                g = f.iloc[at : at + ASKED].reset_index(drop=True)
                _, q = _unit_vectors(g["v"], dim)
                apart = _apart(q, centres)[:, cell]
                low = np.maximum(np.maximum(apart - far, near - apart), 0)
                least = g["least"].to_numpy(np.float64)
                bound = np.sqrt(np.maximum(2 - 2 * np.where(np.isnan(least), -1.0, least), 0)) + SLACK
                take = low <= bound[:, None]
                if (open_ := np.isnan(least)).any():
                    order = np.lexsort((apart[open_], low[open_]))
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(order.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    take[open_] = first
                if floor is not None:
                    take &= low <= np.sqrt(max(2 - 2 * floor, 0)) + SLACK
                for a, b in zip(starts, ends, strict=True):
                    mine = take[:, a:b]
                    if not len(i := np.nonzero(mine.any(axis=1))[0]):
                        continue
                    bits, rows = [x.tobytes() for x in np.packbits(mine[i], axis=1)], mine[i] @ n[a:b]
                    for part in range(parts[b - 1]):  # a unit dealt over several slabs is the last of its first
                        only = bits if not part else [np.packbits(np.arange(b - a) == b - a - 1).tobytes()] * len(i)
                        to = np.ones(len(i), bool) if not part else mine[i, -1]
                        yield pd.DataFrame({
                            "slab": slab[a] + part, "k": g["k"].to_numpy()[i][to], "v": g["v"].to_numpy()[i][to], "taken": np.array(only, object)[to], "n": rows[to] if not part else 0,
                        })

    return asked.mapInPandas(run, "slab int, k long, v array<double>, taken binary, n long")


def _compared(index: VectorIndex, sent: DataFrame, k: int, floor: float | None) -> DataFrame:
    """The best k of each query in what it is compared with."""
    of = index.units.groupby("slab")["unit"].max().to_dict()
    last = index.units.groupby("slab")["parts"].last().to_dict()
    units = [0] * index.slabs
    for slab, most in of.items():
        units[slab : slab + last[slab]] = [int(most) + 1] * int(last[slab])
    return durable(best_of_slabs(index.rows, sent, index.slabs, k, index.key, floor, units))


def nearest_indexed(index: VectorIndex, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """What ``nearest_each`` gives for ``queries``, exactly: ``(query_id, key, score)``, the k rows of highest cosine similarity, ties by key.

    First each query is compared with the units nearest to it; the k-th score that it has found bounds the distance of all that can be better,
    and units farther away are passed over.
    """
    asked = durable(_usable(queries, index.key, index.vector, index.dim))
    first = _compared(index, probes(index, asked.withColumn("least", F.lit(None).cast("double")), k, floor), k, floor)
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = asked.join(least, asked["k"] == least["query_id"], "left").select("k", "v", F.coalesce("least", F.lit(-1.0)).alias("least"))
    out = _compared(index, probes(index, bounded, k, floor), k, floor)
    other = F.size(index.vector) != index.dim
    if (rest := queries.where(other)).isEmpty():
        return out
    return out.unionByName(nearest_each(rest, index.vectors.where(other), k, index.key, index.vector, floor))
