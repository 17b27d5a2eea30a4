"""Data profiles: coverage, ring summaries, feature profiles, score statistics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.operators.quantiles import exact_percentiles
from ringwatch.scratch import broadcast_if_small


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value")


def feature_coverage(df: DataFrame, keys: list[str], features=None) -> DataFrame:
    """Non-null count and ratio per feature; one wide aggregate, then a small unpivot."""
    names = features or catalog.FEATURES
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in names])
    ratio = F.col("valid_count") / F.greatest(F.col("_n"), F.lit(1))
    return (
        wide.unpivot([*keys, "_n"], names, "feature", "valid_count").withColumn("valid_ratio", ratio).drop("_n")
    )


def ring_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("points"))


def stratum_summary(fused: DataFrame, keys: list[str] = ("stratum",), config: ModelConfig = ModelConfig()) -> DataFrame:
    """Rows, rings and points-per-ring figures. Ring sizes are small whole numbers, so the
    built-in percentile keeps few distinct values."""
    sizes = ring_sizes(fused, list(keys))
    return sizes.groupBy(*keys).agg(
        F.sum("points").alias("rows"),
        F.count(F.lit(1)).alias("rings"),
        F.min("ring").alias("ring_min"),
        F.max("ring").alias("ring_max"),
        F.min("points").alias("points_per_ring_min"),
        F.percentile("points", 0.5).alias("points_per_ring_median"),
        F.max("points").alias("points_per_ring_max"),
        F.lit(len(catalog.FEATURES)).alias("features"),
        F.lit(len(catalog.FEATURES) * config.window_points).alias("feature_dim"),
    )


def estimated_windows(points: Column, config: ModelConfig = ModelConfig()) -> Column:
    size, stride = config.window_points, config.window_stride
    return F.when(points >= size, F.floor((points - size) / stride).cast("bigint") + 1).otherwise(0)


def alignment_summary(tbm: DataFrame, geo: DataFrame, key: str = "folder", config: ModelConfig = ModelConfig()) -> DataFrame:
    """Rings before and after matching both sides of a folder, with window estimates."""
    tbm_sizes = ring_sizes(tbm, [key])
    geo_rings = geo.select(key, "ring").distinct()
    sides = (
        tbm_sizes.groupBy(key)
        .agg(F.count(F.lit(1)).alias("tbm_rings_before"))
        .join(geo_rings.groupBy(key).agg(F.count(F.lit(1)).alias("geo_rings_before")), key)
    )
    common = tbm_sizes.join(geo_rings, [key, "ring"], "left_semi")
    figures = common.groupBy(key).agg(
        F.count(F.lit(1)).alias("common_rings"),
        F.min("ring").alias("common_ring_min"),
        F.max("ring").alias("common_ring_max"),
        F.sum("points").alias("aligned_tbm_rows"),
        F.min("points").alias("points_per_ring_min"),
        F.percentile("points", 0.5).alias("points_per_ring_median"),
        F.max("points").alias("points_per_ring_max"),
        F.count_if(F.col("points") >= config.window_points).alias("rings_with_ge48_points"),
        F.sum(estimated_windows(F.col("points"), config)).alias("estimated_windows"),
    )
    return sides.join(figures, key)


def tbm_profile(fused: DataFrame, keys: list[str] = ("stratum",), features=None) -> DataFrame:
    """Moments and exact median of each machine feature."""
    long = unpivot(fused, list(keys), features or catalog.TBM_FEATURES)
    groups = [*keys, "feature"]
    moments = long.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("non_null"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    medians = exact_percentiles(long, groups, "value", {"median": 0.5}).drop("n")
    missing = 1 - F.col("non_null") / F.col("rows")
    return moments.join(medians, groups, "left").withColumn("missing_rate", missing)


def geo_profile(geo: DataFrame, keys: list[str] = ("stratum",), features=None) -> DataFrame:
    """Distinct values and mean of each geology feature over rings; equal values are counted first."""
    groups = [*keys, "feature"]
    counts = unpivot(geo, list(keys), features or catalog.GEO_FEATURES).groupBy(*groups, "value").agg(
        F.count(F.lit(1)).alias("_c")
    )
    known = F.when(F.col("value").isNotNull(), F.col("_c"))
    out = counts.groupBy(*groups).agg(
        F.sum("_c").alias("rings"),
        F.coalesce(F.sum(known), F.lit(0)).alias("non_null"),
        F.count("value").alias("unique_non_null"),
        (F.sum(F.col("value") * F.col("_c")) / F.sum(known)).alias("mean"),
    )
    return out.withColumn("missing_rate", 1 - F.col("non_null") / F.col("rings"))


def level_name(score: Column, low: Column, medium: Column, high: Column) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("no_risk")


def risk_level_counts(scored: DataFrame, keys: list[str], score: str = "risk_score") -> DataFrame:
    """Counts and rates of the four levels; needs threshold columns low, medium and high."""
    s = F.col(score)
    counts = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s < F.col("low")).alias("no_risk"),
        F.count_if((s >= F.col("low")) & (s < F.col("medium"))).alias("low_risk"),
        F.count_if((s >= F.col("medium")) & (s < F.col("high"))).alias("medium_risk"),
        F.count_if(s >= F.col("high")).alias("high_risk"),
    )
    total = F.greatest(F.col("total"), F.lit(1))
    return counts.withColumns(
        {
            "no_risk_rate": F.col("no_risk") / total,
            "low_rate": F.col("low_risk") / total,
            "medium_rate": F.col("medium_risk") / total,
            "high_rate": F.col("high_risk") / total,
            "medium_high_rate": (F.col("medium_risk") + F.col("high_risk")) / total,
        }
    )


def score_statistics(scored: DataFrame, keys: list[str], score: str = "risk_score") -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count(score).alias("scores"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
    )


def risk_histogram(scored: DataFrame, keys: list[str], bins: int = 60, score: str = "risk_score") -> DataFrame:
    """Equal-width density histogram between each group's extremes; the top edge is inclusive.

    A group with one single value gets a unit-wide range around it.
    """
    known = scored.filter(F.col(score).isNotNull())
    edges = known.groupBy(*keys).agg(F.min(score).alias("_a"), F.max(score).alias("_b"), F.count(F.lit(1)).alias("_n"))
    flat = F.col("_a") == F.col("_b")
    edges = edges.select(
        *keys,
        "_n",
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    )
    width = F.col("_hi") - F.col("_lo")
    at = F.floor((F.col(score) - F.col("_lo")) / width * bins)
    edges = broadcast_if_small(edges)  # a row per group of a report
    binned = known.join(edges, keys).withColumn("bin", F.least(at, F.lit(bins - 1)).cast("bigint"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(edges, keys).select(
        *keys,
        "bin",
        "count",
        (F.col("_lo") + F.col("bin") * width / bins).alias("left_edge"),
        (F.col("count") / F.col("_n") / (width / bins)).alias("density"),
    )


def score_density(scored: DataFrame, keys: list[str], x: str = "ae_error", y: str = "if_anomaly", bins: int = 60) -> DataFrame:
    """Scatter of two scores as counts on a grid between each group's extremes: ``x_bin, y_bin, count, x_left, y_left``.

    At most ``bins * bins`` cells a group whatever its rows. The top edges are inclusive; an axis with one
    single value gets a unit-wide range around it. Rows without a finite pair are left out.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (x, y)]
    known = scored.filter(finite[0] & finite[1])
    edges = known.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for f, n in ((F.min, "a"), (F.max, "b"))])
    spans = []
    for c, n in ((x, "x"), (y, "y")):
        a, b = F.col(f"_a{c}"), F.col(f"_b{c}")
        spans += [F.when(a == b, a - 0.5).otherwise(a).alias(f"_{n}_lo"), F.when(a == b, b + 0.5).otherwise(b).alias(f"_{n}_hi")]
    edges = broadcast_if_small(edges.select(*keys, *spans))
    width = {n: F.col(f"_{n}_hi") - F.col(f"_{n}_lo") for n in "xy"}
    cell = {n: F.least(F.floor((F.col(c) - F.col(f"_{n}_lo")) / width[n] * bins), F.lit(bins - 1)).cast("bigint") for c, n in ((x, "x"), (y, "y"))}
    placed = known.join(edges, keys).select(*keys, cell["x"].alias("x_bin"), cell["y"].alias("y_bin"))
    counts = placed.groupBy(*keys, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))
    left = {n: F.col(f"_{n}_lo") + F.col(f"{n}_bin") * width[n] / bins for n in "xy"}
    return counts.join(edges, keys).select(*keys, "x_bin", "y_bin", "count", left["x"].alias("x_left"), left["y"].alias("y_left"))


def window_score_aggregates(scores: DataFrame, keys: list[str], score: str = "risk_score", config: ModelConfig = ModelConfig()) -> DataFrame:
    """All aggregation modes of a ring's window scores: max, mean, median, quantile, top-k mean.

    A ring with a score that is NULL, NaN or infinite keeps its row, with NULL in every mode.
    """
    from pyspark.sql import Window

    bad = scores.filter(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
    finite = scores.join(bad.select(*keys).distinct(), keys, "left_anti")
    plain = finite.groupBy(*keys).agg(F.max(score).alias("max"), F.avg(score).alias("mean"))
    ordered = exact_percentiles(finite, keys, score, {"median": 0.5, "pquantile": config.quantile_p})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc()))
    top = finite.withColumn("_r", rank).filter(F.col("_r") <= config.topk_k).groupBy(*keys).agg(F.avg(score).alias("topk_mean"))
    whole = plain.join(ordered, keys).join(top, keys)
    return whole.unionByName(bad.select(*keys).distinct(), allowMissingColumns=True)
