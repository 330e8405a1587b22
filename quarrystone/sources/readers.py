"""Scans of the source files as strings, with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import durable
from .contracts import Contract

CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, contract: Contract, run_id: int = 0) -> DataFrame:
    """The contract's columns as strings; a broken JSON line is a row of nulls with its text in ``_corrupt_record``.

    ``path`` is a file or folder; of dated JSON the folder above ``dt=...``, which becomes a column. Added:
    _source_file, _ingested_at, _run_id, and _source_row_num, which counts from 1 in each file. The files are read once, into a
    table in the shared folder, and numbered there.
    """
    schema = contract.raw_schema()
    reader = spark.read.option("mode", "PERMISSIVE").options(**contract.options)
    if contract.layout == "csv":
        df = reader.option("header", True).schema(schema).csv(path)
    else:
        reader = reader.option("primitivesAsString", True).option("columnNameOfCorruptRecord", CORRUPT)
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        if contract.layout == "dated_json":
            reader = reader.option("basePath", path).option("recursiveFileLookup", False)
            schema = T.StructType([*schema.fields, T.StructField("dt", T.DateType())])
        df = reader.schema(schema).json(path)
    block = ["_source_file", "__block"]
    file, start = F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("__block")
    rows = durable(df.select("*", file, F.current_timestamp().alias("_ingested_at"), F.lit(run_id).alias("_run_id"), start, F.monotonically_increasing_id().alias("__at")))
    earlier = Window.partitionBy("_source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # one row a block of a file
    blocks = blocks.select(*block, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return rows.join(blocks, block).withColumn("_source_row_num", (F.col("__at") + F.col("__shift")).cast("int")).select(*df.columns, "_source_file", "_ingested_at", "_run_id", "_source_row_num")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are taken as the session's, which should be UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})
