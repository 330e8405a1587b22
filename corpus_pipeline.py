"""Documents to packed training sequences: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import linededup, mixing, neardup, packing, quality
from quarrystone.plans.durable import shared_folder
from quarrystone.plans.ship import shipped


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that no operator reads renamed, so that none is replaced, and the columns that give them back."""
    names = {c: c if c in ("doc_id", "text", "source") else f"__own_{c}" for c in docs.columns}
    return docs.withColumnsRenamed({c: x for c, x in names.items() if c != x}), [F.col(f"`{x}`").alias(c) for c, x in names.items()]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the folder's labels, accepts."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = aside(docs)
    return quality.score(own, model).where("predicted = 1").select(*back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated passages; n_chars follows the text."""
    own, back = aside(docs)
    out = linededup.drop_repeated_lines(own).select(*back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    own, back = aside(docs)
    return neardup.one_of_each(own).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: file after file, row after row."""
    own, back = aside(docs)
    return mixing.in_order(mixing.mix_sources(own)).select(*back)


def fill(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and the bins that they lie in; a bin holds pieces of documents that the mixture puts close to each other.

    The order is that of the files that the stage before has written; documents that come from no files are in their own order.
    """
    try:
        order = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.col("_metadata.row_index")]
        docs = docs.select("doc_id", "text", "source", *(c.alias(n) for c, n in zip(order, ("__file", "__at"), strict=True)))
    except AnalysisException:
        row = F.monotonically_increasing_id()
        docs = docs.select("doc_id", "text", "source", F.shiftright(row, 33).alias("__file"), row.bitwiseAND(F.lit(2**33 - 1)).alias("__at"))
    return packing.pack(docs, order=[F.col("__file"), F.col("__at")])


STAGES = [
    ("quality classifier", shipped(keep_good)),
    ("line dedup", shipped(drop_lines)),
    ("minhash near-dedup", shipped(drop_copies)),
    ("source mixing", shipped(mix)),
    ("best-fit packing", shipped(fill)),
]

#: Fitting a model and linking near-duplicates are no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
