"""Queries over stored risk records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.functions import text

# Columns read for the latest record of a risk, as far as the table has them.
LATEST_COLUMNS = [
    "ring",
    "project_code",
    "key_parameters",
    "safety_level",
    "risk_level",
    "risk_score",
    "potential_risk",
    "fault_reason_analysis",
    "fault_cause",
    "fault_measures",
    "measures",
    "impact_parameters",
]
DEFAULT_LIMIT = 1000
PARTS = 64


def risk_records(records: DataFrame, risk_type: str | None = None, project: str | None = None) -> DataFrame:
    """Record scan reduced to the report columns that exist; blank project means all."""
    out = records
    if risk_type is not None:
        out = out.filter(F.col("risk_type") == risk_type)
    if project and project.strip() and "project_code" in records.columns:
        out = out.filter(F.col("project_code") == project.strip())
    keys = [c for c in ("id", "risk_type") if c in records.columns]
    return out.select(*keys, *[c for c in LATEST_COLUMNS if c in records.columns])


def latest_record(records: DataFrame, keys: list[str]) -> DataFrame:
    """Newest record per key: greatest id, or greatest ring when there is no id."""
    order = "id" if "id" in records.columns else "ring"
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*")


def latest_summary(records: DataFrame) -> DataFrame:
    """Latest level and ring per risk type; a blank level shows as '-'."""
    level = F.when(F.trim("risk_level") == "", "-").otherwise(F.coalesce("risk_level", F.lit("-")))
    ring = F.coalesce(text.to_ring(F.col("ring")).cast("string"), F.col("ring").cast("string"), F.lit("-"))
    return latest_record(records, ["risk_type"]).select("risk_type", level.alias("risk_level"), ring.alias("ring"))


def newest(records: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Newest ``limit`` rows per key. Rows are ranked within hashed parts of a key first, so
    the final rank of a hot key sees at most ``PARTS * limit`` rows."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a whole number from 1")
    newest_first = F.col("id").desc()
    by_part = Window.partitionBy(*keys, "_part").orderBy(newest_first)
    by_key = Window.partitionBy(*keys).orderBy(newest_first)
    return (
        records.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
        .withColumn("_rank", F.row_number().over(by_part))
        .filter(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(by_key))
        .filter(F.col("_rank") <= limit)
        .drop("_rank", "_part")
    )


def risk_history(records: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Warnings among the newest rows of each (risk, project), with level counts.

    The limit comes before the level filter, so the counts cover the newest rows only.
    """
    keys = ["risk_type", "project_code"]
    warned = (
        newest(records, keys, limit)
        .withColumn("priority", text.level_priority(F.coalesce("risk_level", F.lit(""))))
        .filter("priority >= 2")
    )
    w = Window.partitionBy(*keys)
    counted = warned.withColumns(
        {
            "high_risk_count": F.count_if(F.col("priority") == 4).over(w),
            "mid_risk_count": F.count_if(F.col("priority") == 3).over(w),
            "low_risk_count": F.count_if(F.col("priority") == 2).over(w),
        }
    )
    ring_order = F.coalesce(text.to_ring(F.col("ring")), F.lit(-1))
    place = F.row_number().over(w.orderBy(ring_order.desc(), F.col("id").desc()))
    return counted.withColumn("position", place).drop("priority")
