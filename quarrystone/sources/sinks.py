"""Keyed merges, partition overwrites and run logs as Parquet tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import durable


def upserted(old: DataFrame, new: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """``old`` with the rows of ``new``: those of a known key replace it, or are ignored if ``update`` is false.

    Null keys match null keys. Of rows of ``new`` with one key any one is taken; columns are matched by name.
    """
    new = new.dropDuplicates(key)
    gone, kept = (old, new) if update else (new, old)
    other = kept.select(*[F.col(k).alias(f"__{k}") for k in key])
    match = F.lit(True)
    for k in key:
        match &= gone[k].eqNullSafe(other[f"__{k}"])
    return gone.join(other, match, "left_anti").unionByName(kept).select(*old.columns)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


BUCKET = "__bucket"


def bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """``df`` with the folder of a keyed table that each row belongs to; null keys have one too."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def write_keyed(df: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """A keyed table in folders by the hash of its key, of which ``merge_keyed`` rewrites those that it must."""
    rows = bucketed(df, key, buckets)
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def merge_keyed(spark: SparkSession, path: str, new: DataFrame, key: list[str], update: bool = True, buckets: int = 64) -> int:
    """``upserted`` into a table of ``write_keyed``, and the number of folders that were rewritten: those that a key of ``new`` belongs to.

    The others are neither read nor written. The merged rows are written aside before they replace the old ones. ``buckets`` is the table's own.
    """
    new = durable(bucketed(new, key, buckets))
    touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if touched:
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        merged = durable(upserted(old.select(*new.columns), new, key, update))
        overwrite_partitions(merged.repartition(BUCKET), path, [BUCKET])
    return len(touched)


class Stage:
    """``with Stage(spark, folder, run_id, name) as s: s.rows = n`` appends one row to the stage log, also if it fails."""

    def __init__(self, spark: SparkSession, folder: str, run_id: int, name: str, order: int = 0):
        self.spark, self.folder, self.run_id, self.name, self.order, self.rows = spark, folder, run_id, name, order, None

    def __enter__(self) -> Stage:
        self.began = dt.datetime.now(dt.UTC)
        return self

    def __exit__(self, kind, error, trace) -> None:
        row = (self.run_id, self.order, self.name, "failed" if error else "succeeded", self.began, dt.datetime.now(dt.UTC), self.rows, str(error)[:500] if error else None)
        schema = "run_id int, stage_order int, stage string, status string, started_at timestamp, ended_at timestamp, rows long, error string"
        self.spark.createDataFrame([row], schema).write.mode("append").parquet(f"{self.folder}/stage_runs")
