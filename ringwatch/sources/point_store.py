"""Point and history tables laid out for the requests that read them.

Points are partitioned by shield and span of ring numbers and clustered by ring and time, so a
request for a ring or a range of rings opens the folders of its spans and, within them, only row
groups whose ring statistics match. History is partitioned by day and clustered by time. Rows are
dealt by ranges that end with time and id: a ring with a third of all points fills several files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS_PER_SPAN = 256


def write_points(points: DataFrame, path: str, span: int = RINGS_PER_SPAN, mode: str = "overwrite") -> None:
    """Write points (``shield_id, ring, time, point_id`` and readings). Points without a ring share one folder per shield.

    ``span`` is stored with the rows, so that readers need not know it.
    """
    placed = points.withColumn("ring_span", F.floor(F.col("ring") / F.lit(span)).cast("bigint"))
    order = ["shield_id", "ring_span", "ring", "time", "point_id"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode(mode).partitionBy("shield_id", "ring_span").parquet(f"{path}/points")
    points.sparkSession.createDataFrame([(span,)], "span bigint").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def read_points(spark: SparkSession, path: str, shield: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Stored points of a shield with ``start <= ring < end``; either bound and the shield may be left out.

    The shield and the spans choose folders, the range itself reaches the scan.
    """
    span = spark.read.schema("span bigint").json(f"{path}/layout").first()["span"]
    # folder names are read by these types: a shield "01" is no number
    folders = {"shield_id": T.StringType(), "ring_span": T.LongType()}
    schema = spark.read.parquet(f"{path}/points").schema
    rows = spark.read.schema(T.StructType([T.StructField(f.name, folders.get(f.name, f.dataType)) for f in schema])).parquet(f"{path}/points")
    if shield is not None:
        rows = rows.filter(F.col("shield_id") == shield)
    if start is not None:
        rows = rows.filter((F.col("ring_span") >= start // span) & (F.col("ring") >= start))
    if end is not None:
        rows = rows.filter((F.col("ring_span") <= (end - 1) // span) & (F.col("ring") < end))
    return rows.drop("ring_span")


def write_history(history: DataFrame, path: str, time_col: str = "time", mode: str = "overwrite") -> None:
    """Write a history table by the UTC day of its times; rows without a time share one folder."""
    placed = history.withColumn("day", F.col(time_col).cast("date"))
    order = ["day", time_col]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A stored history with its ``day``, for :func:`ringwatch.sources.tables.history_scan`."""
    stored = spark.read.parquet(path)
    return stored.withColumn("day", F.col("day").cast("date"))
