"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of fewer rows than Spark's default of 10,000.

    Batches lie in memory on both sides, several to a task; whole texts can be long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: computed once, lineage cut.

    Compressed Parquet instead of ``checkpoint()``, whose files are not compressed.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key():
    """Hash of a row's ``text``; with ``doc_id`` it names a document also when ids repeat."""
    return F.xxhash64(F.col("text"))
