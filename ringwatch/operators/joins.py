"""Joins between points, geology, texts and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.operators.ordered import add_index, ring_slice

GEO_COLUMNS = ["cluster_label", *catalog.GEO_FEATURES]
SALTS = 16


def join_rings(points: DataFrame, rings: DataFrame, keys: list[str], how: str = "inner", tie: str = "point_id", salts: int = SALTS) -> DataFrame:
    """Points with the row of their ring; ``rings`` has one row per ring.

    Each ring stands once per salt and its points are dealt over the salts by ``tie``, so a ring
    with very many points is spread over that many tasks. Adaptive execution broadcasts the rings
    instead where their measured size allows it.
    """
    deal_by = [tie] if tie in points.columns else points.columns
    dealt = points.withColumn("_salt", F.pmod(F.xxhash64(*deal_by), F.lit(salts)))
    copies = rings.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def fuse(tbm: DataFrame, geo: DataFrame) -> DataFrame:
    """Every excavation file with every geology file of its folder, matched on ring.

    ``tbm`` has folder, tbm_file, ring and readings; ``geo`` has folder, geo_file, ring
    (one row per ring). Pairs without a common ring yield nothing.
    """
    joined = tbm.join(geo, ["folder", "ring"])
    source = F.concat(F.col("folder"), F.lit(":"), F.col("tbm_file"), F.lit("+"), F.col("geo_file"))
    return joined.withColumn("data_source", source)


def common_rings(tbm: DataFrame, geo: DataFrame, keys=("ring",)) -> DataFrame:
    return tbm.select(*keys).intersect(geo.select(*keys))


def geo_for_rings(rings: DataFrame, candidates: DataFrame, geo: DataFrame) -> DataFrame:
    """Geology of each (shield, ring): the best-ranked source that knows the ring.

    A hit without a label, or no hit at all, gives label 0 and zero features; otherwise
    only features the source holds are set. ``candidates`` is (shield_id, source_file, rank).
    """
    hits = rings.join(candidates, "shield_id").join(geo, ["source_file", "ring"])
    best = hits.groupBy("shield_id", "ring").agg(F.min_by(F.struct(*GEO_COLUMNS), F.col("rank")).alias("g"))
    found = F.col("g.cluster_label").isNotNull()
    out = rings.join(best, ["shield_id", "ring"], "left")
    return out.select(
        "shield_id",
        "ring",
        F.when(found, F.col("g.cluster_label").cast("double")).otherwise(F.lit(0.0)).alias("cluster_label"),
        *[F.when(found, F.col(f"g.{f}")).otherwise(F.lit(0.0)).alias(f) for f in catalog.GEO_FEATURES],
    )


def enrich_geo(points: DataFrame, candidates: DataFrame, geo: DataFrame) -> DataFrame:
    """Points with the geology of their ring. The lookup runs once per ring, not per point."""
    rings = points.select("shield_id", "ring").distinct()
    return join_rings(points, geo_for_rings(rings, candidates, geo), ["shield_id", "ring"], "left")


def attach_texts(results: DataFrame) -> DataFrame:
    """Measures, reasons and causes by (risk, level); the catalogues hold 16 and 4 rows."""
    spark = results.sparkSession
    texts = F.broadcast(catalog.level_texts(spark))
    causes = F.broadcast(catalog.risk_catalog(spark).select("risk_type", "fault_cause"))
    out = results.join(texts, ["risk_type", "safety_level"], "left").join(causes, "risk_type", "left")
    return out.withColumns(
        {
            "fault_measures": F.coalesce("fault_measures", F.lit("-")),
            "fault_reason": F.coalesce("fault_reason", F.lit("")),
            "fault_reason_analysis": F.coalesce("fault_reason_analysis", F.lit(catalog.UNKNOWN_LEVEL_ANALYSIS)),
        }
    )


def history_mapping(requested: DataFrame, dictionary: DataFrame, order_col: str = "row_id", keys=("point_cn_name",)) -> DataFrame:
    """Code and unit of each requested name; a later dictionary row replaces an earlier one."""
    known = dictionary.join(requested.select(*keys).distinct(), list(keys), "left_semi")
    last = known.groupBy(*keys).agg(F.max_by(F.struct("point_code", "point_unit"), F.col(order_col)).alias("m"))
    return last.select(
        *keys, F.trim("m.point_code").alias("code"), F.coalesce("m.point_unit", F.lit("")).alias("unit")
    )


def rings_with_index(points: DataFrame) -> DataFrame:
    """Distinct rings of each shield with their 0-based rank."""
    rings = points.filter("ring >= 0").select("shield_id", "ring").distinct()
    sliced = rings.withColumn("_s", ring_slice(F.col("ring")))
    return add_index(sliced, ["shield_id"], "_s", ["ring"], "ring_idx").drop("_s")


def last_k_rings(rings: DataFrame, k: int = 6) -> DataFrame:
    """For every center ring, its k latest rings with data (the center included).

    Each ring serves the k centers that follow it in rank, so this is an equi-join on
    rank with a fan-out of k instead of a range join.
    """
    serves = rings.select(
        "shield_id", "ring", F.explode(F.sequence(F.col("ring_idx"), F.col("ring_idx") + (k - 1))).alias("center_idx")
    )
    centers = rings.select("shield_id", F.col("ring").alias("center_ring"), F.col("ring_idx").alias("center_idx"))
    return centers.join(serves, ["shield_id", "center_idx"]).select("shield_id", "center_ring", "ring")


def last_k_rings_of(points: DataFrame, center: int, k: int = 6) -> DataFrame:
    """Points of the k greatest rings at or below one center, per shield."""
    near = points.filter((F.col("ring") <= center) & (F.col("ring") >= 0))
    rings = near.select("shield_id", "ring").distinct()
    rank = F.row_number().over(Window.partitionBy("shield_id").orderBy(F.col("ring").desc()))
    wanted = rings.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
    return join_rings(near, wanted, ["shield_id", "ring"], "left_semi")
