"""Correlated-parameter lookups and machine state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default system name and machine state remarks.
UNKNOWN_SYSTEM = "未知系统"
STATE_REMARKS = {0: "停机", 1: "掘进", 2: "拼环"}


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends. ``edges``: edge_id, start_node, end_node, correlation, ..."""
    whole = edges.filter("start_node <> '' AND end_node <> '' AND correlation IS NOT NULL")
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("start_node").alias("parameter"), F.col("end_node").alias("name")),
        F.struct(F.lit(1).alias("side"), F.col("end_node").alias("parameter"), F.col("start_node").alias("name")),
    )
    rest = [c for c in edges.columns if c not in ("start_node", "end_node")]
    return whole.select(*rest, F.explode(ends).alias("_e")).select("_e.*", *rest)


def top_neighbours(adjacent: DataFrame, systems: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest neighbours of each parameter with the system they belong to."""
    strength = [F.abs("correlation").desc(), F.col("edge_id"), F.col("side")]
    rank = F.row_number().over(Window.partitionBy("parameter").orderBy(*strength))
    top = adjacent.withColumn("place", rank).filter(F.col("place") <= k)
    named = systems.select(F.col("parameter").alias("name"), "system")
    return top.join(named, "name", "left").withColumn("system", F.coalesce("system", F.lit(UNKNOWN_SYSTEM)))


def system_parameters(nodes: DataFrame) -> DataFrame:
    """Parameters of each system from ``(system, parameters array)``."""
    pairs = nodes.select("system", F.explode("parameters").alias("parameter"))
    return pairs.filter(F.coalesce("parameter", F.lit("")) != "").distinct()


def latest_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """Newest state per machine with its remark."""
    best = states.groupBy(*keys).agg(F.max("time").alias("time"), F.max_by("state", "time").alias("state"))
    remark = F.lit("-")
    for code, label in STATE_REMARKS.items():
        remark = F.when(F.col("state") == code, label).otherwise(remark)
    return best.withColumn("remark", remark)
