"""Readers and scans."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwatch import catalog
from ringwatch.functions import text
from ringwatch.operators.cleaning import dedupe_by_time
from ringwatch.operators.ordered import first_per_key
from ringwatch.scratch import materialize

# Header names that mark a geology file, and reader options.
GEO_MARKERS = {"Ring_Index", "Cluster_Label"}
TEXT_SUFFIX = ".csv"
BOM = "﻿"
SUMMARY_TABLES = ["sum", "sum_old"]


def headers_of(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """``path, file_name, header`` of delimited files; the header is one line, without byte-order mark.

    Line numbers come from the file's own partitions: the first row of the block at position 0.
    """
    lines = spark.read.option("header", False).option("encoding", encoding).option("sep", "\0").schema("value string").csv(path)
    first = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value",
    ).filter("start = 0")
    heads = first.groupBy("path", "file_name").agg(F.min_by("value", "row").alias("header"))
    return heads.withColumn("header", F.regexp_replace("header", f"^{BOM}", ""))


def read_delimited(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, encoding: str = "UTF-8", heads: DataFrame | None = None) -> DataFrame:
    """Delimited text with a header from a path, a glob or a list of paths; every column is read as text.

    Each file is read by its own header: files are grouped by header line, each group is read with
    that header as its schema, and the groups are united by name, absent columns NULL. ``columns``
    picks and orders the columns of the result. The byte-order mark is stripped from the first header name. ``folder``
    and ``file_name`` come from the file path, ``file_order`` follows the rows of each file.
    ``heads`` are ``path, header`` of the files where they are known, which saves reading the files for them.
    """
    heads = headers_of(spark, path, encoding) if heads is None else heads
    groups = heads.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    out = None
    for group in groups:
        names = next(csv.reader([group["header"]])) if group["header"] else []
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        raw = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", True).schema(schema)
        df = raw.csv([unquote(p) for p in group["paths"]])
        df = df.select(
            *[F.col(f"`{c}`") for c in names],
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"),
            F.col("_metadata.file_name").alias("file_name"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("file_order"),
        )
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is not None and columns is not None:
        have = set(out.columns)
        picked = [F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns]
        out = out.select(*picked, "folder", "file_name", "file_order")
    if out is None:
        raise FileNotFoundError(f"no file with a header under {path}")
    return out


def split_by_kind(spark: SparkSession, folder_glob: str) -> tuple[DataFrame, DataFrame]:
    """File names of excavation and geology files, told apart by their header line only.

    Returns two frames ``(folder, file_name, path, header)``; temporary files and other
    suffixes are ignored.
    """
    heads = headers_of(spark, folder_glob)
    kept = heads.filter(F.lower("file_name").endswith(TEXT_SUFFIX) & ~F.col("file_name").startswith("~$"))
    names = F.split("header", ",")
    marked = F.arrays_overlap(names, F.array(*[F.lit(m) for m in sorted(GEO_MARKERS)]))
    # one row per file; the files are read for it once
    listed = materialize(kept.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"), "file_name", "path", names.alias("header"), marked.alias("is_geo")
    ))
    return listed.filter("NOT is_geo").drop("is_geo"), listed.filter("is_geo").drop("is_geo")


def ring_points(points: DataFrame, fields: list[str], limit: int | None = None, shield: str | None = None, ring: int | None = None) -> DataFrame:
    """Points of each ring in time order, at most ``limit`` per ring, then deduplicated.

    With ``shield`` and ``ring`` set this is the single-ring request; both filters reach
    the scan.
    """
    rows = points
    if shield is not None:
        rows = rows.filter(F.col("shield_id") == shield)
    if ring is not None:
        rows = rows.filter((F.col("ring_no") >= ring) & (F.col("ring_no") < ring + 1))
    rows = rows.select("shield_id", "ring", "point_id", "time", *fields)
    if limit is not None and limit > 0:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("shield_id", "ring").orderBy("time", "point_id"))
        rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    return dedupe_by_time(rows)


def ring_range_points(points: DataFrame, start: int, end: int, fields: list[str]) -> DataFrame:
    """Points with ``start <= ring < end``, deduplicated; the range reaches the scan."""
    rows = points.filter((F.col("ring") >= start) & (F.col("ring") < end))
    return dedupe_by_time(rows.select("shield_id", "ring", "point_id", "time", *fields))


def wrap_values(points: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """Fields under their labels, each value paired with its unit."""
    labels = F.array(*[F.lit(catalog.FIELD_LABELS[f]) for f in fields])
    cells = F.array(
        *[F.struct(F.col(f).cast("double").alias("value"), F.lit(catalog.field_unit(f)).alias("unit")) for f in fields]
    )
    return points.select(*keep, F.map_from_arrays(labels, cells).alias("values"))


def geo_by_ring(geo: DataFrame, order_col: str) -> DataFrame:
    """Geology keyed by (source, ring): label and features present, last row of the file wins."""
    ring = next((c for c in ("Ring.No", "Ring_Index", "ring") if c in geo.columns), None)
    if ring is None or "source_file" not in geo.columns:
        raise ValueError("geology needs a ring and a source_file column")
    features = [c for c in ["cluster_label", *catalog.GEO_FEATURES] if c in geo.columns]
    rows = geo.select(
        F.trim("source_file").alias("source_file"), text.to_ring(F.col(f"`{ring}`")).alias("ring"), order_col, *features
    ).filter("ring IS NOT NULL AND source_file <> ''")
    return first_per_key(rows, ["source_file", "ring"], [F.col(order_col).desc()]).drop(order_col)


def point_tables(dictionary: DataFrame) -> DataFrame:
    """Shields that have a dictionary, without the summary entries, in name order."""
    return dictionary.select("shield_id").distinct().filter(~F.col("shield_id").isin(SUMMARY_TABLES)).orderBy("shield_id")


def resolve_point_table(dictionary: DataFrame, shield: str) -> DataFrame:
    """Dictionary rows of one shield; an unknown shield is an error."""
    rows = dictionary.filter(F.col("shield_id") == shield)
    if rows.isEmpty():
        raise ValueError(f"no point dictionary for shield {shield}")
    return rows


def history_scan(history: DataFrame, start: str, end: str, time_col: str = "time", day_col: str | None = "day") -> DataFrame:
    """Rows from local midnight of ``start`` to local midnight after ``end``, both dates included.

    Stored times are UTC, local time is 8 hours ahead. The day filter spans one day more on
    either side and prunes partitions of a table partitioned by ``day_col``.
    """
    low = F.to_timestamp_ntz(F.lit(f"{start} 00:00:00")) - F.expr(f"INTERVAL '{text.LOCAL_OFFSET_HOURS}' HOUR")
    high = F.to_timestamp_ntz(F.lit(f"{end} 00:00:00")) + F.expr(f"INTERVAL '{24 - text.LOCAL_OFFSET_HOURS}' HOUR")
    rows = history
    if day_col is not None and day_col in history.columns:
        day = F.col(day_col).cast("date")
        rows = rows.filter((day >= F.date_sub(F.lit(start).cast("date"), 1)) & (day <= F.date_add(F.lit(end).cast("date"), 1)))
    return rows.filter((F.col(time_col) >= low) & (F.col(time_col) < high))
