"""Running positions over ordered groups of any size.

A plain ``row_number() OVER (PARTITION BY key)`` puts a whole key into one task. Here an
ordered group is cut into slices (a span of time, a span of ring numbers): rows are numbered
inside each slice in parallel and the slice offsets, one row per slice, are added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, TimestampNTZType

SLICE_SECONDS = 6 * 3600
RING_SPAN = 4096
TIE_SPAN = 4096
UNTIMED = 2**60


def time_slice(df: DataFrame, time_col: str = "time", seconds: int = SLICE_SECONDS, tie: str = "point_id", span: int = TIE_SPAN) -> Column:
    """Number of the fixed-width time span a row falls into; rises with time, unknown times last.

    Rows without a time are ordered by ``tie`` alone; they fall into spans of its values (null first),
    so that a group of them is cut as well. A tie that is absent or no whole number leaves one slice.
    """
    c = F.col(time_col)
    if isinstance(df.schema[time_col].dataType, TimestampNTZType):
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        in_day = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        epoch = days * 86400 + in_day
    else:
        epoch = F.unix_seconds(c)
    untimed = F.lit(UNTIMED)
    if tie in df.columns and isinstance(df.schema[tie].dataType, IntegralType):
        untimed = untimed + F.coalesce(F.floor(F.col(tie) / F.lit(span)).cast("bigint"), F.lit(-(2**55)))
    return F.coalesce(F.floor(epoch / F.lit(seconds)).cast("bigint"), untimed)


def ring_slice(ring: Column, span: int = RING_SPAN) -> Column:
    return F.floor(ring / F.lit(span)).cast("bigint")


def add_index(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list,
    index: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within ``keys`` and, on request, the group size."""
    part = [*keys, slice_col]
    local = df.withColumn(index, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint") - 1)
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    cols = [*part, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")]
    if total:
        cols.append(F.sum("_size").over(Window.partitionBy(*keys)).alias(total))
    joined = local.join(counts.select(*cols), part)
    return joined.withColumn(index, F.col(index) + F.col("_before")).drop("_before")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key. The rank filter is applied before the shuffle as well, so a key
    with very many copies sends at most one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
