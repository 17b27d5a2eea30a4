"""Rule scores on streams: the batch functions are stateless and run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ringwatch.operators import rules


def read_files(spark: SparkSession, folder: str, schema, name_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files in a folder, on request only those whose name fits."""
    reader = spark.readStream.schema(schema)
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(points: DataFrame) -> DataFrame:
    """Scored long form of a point stream."""
    return rules.assess_points(points)


def write_scores(scored: DataFrame, out: str, state: str) -> StreamingQuery:
    """Append scores as parquet until the available files are processed."""
    return (
        scored.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
