"""Writers of score frames and model documents."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig


def write_score_frame(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Score frame (split, ae_error, if_anomaly, risk_score), one folder per stratum."""
    columns = [c for c in ("stratum", "split", "ae_error", "if_anomaly", "risk_score") if c in scores.columns]
    writer = scores.select(*columns).write.mode("overwrite").partitionBy("stratum")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON document per stratum."""
    metrics.write.mode("overwrite").partitionBy("stratum").json(path)


def model_info(thresholds: DataFrame, bounds: DataFrame, coverage: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """One struct row per stratum: settings, features, weights, coverage, bounds and thresholds."""
    covered = coverage.groupBy("stratum").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("feature", F.struct("valid_count", "valid_ratio"))))  # 16 features
        ).alias("feature_coverage")
    )
    return (
        thresholds.join(bounds, "stratum", "left")
        .join(covered, "stratum", "left")
        .select(
            "stratum",
            F.lit("unsupervised_normal_only").alias("learning_type"),
            F.lit("stratum_specific").alias("training_mode"),
            F.lit(json.dumps(asdict(config))).alias("config"),
            F.array(*[F.lit(f) for f in catalog.FEATURES]).alias("features"),
            F.lit(len(catalog.FEATURES) * config.window_points).alias("feature_dim"),
            F.struct("low", "medium", "high", "bandwidth", "status").alias("thresholds"),
            F.struct("ae_low", "ae_high", "if_low", "if_high").alias("bounds"),
            "feature_coverage",
        )
    )


def write_documents(rows: DataFrame, path: str) -> None:
    """Struct rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def manifest(metrics: DataFrame, root: str) -> DataFrame:
    """One row over all strata: which exist, and their figures. A manifest row has six entries at most."""
    entry = F.struct(
        "stratum",
        F.concat(F.lit(root + "/stratum="), "stratum").alias("model_dir"),
        "data_size",
        (F.col("train_sequences") + F.col("val_sequences") + F.col("test_sequences")).alias("sequence_count"),
        "status",
    )
    known = metrics.filter(F.col("stratum").isin(catalog.EXPECTED_STRATA))
    return known.agg(F.sort_array(F.collect_list(entry)).alias("strata")).select(
        F.lit("stratum_specific").alias("training_mode"),
        F.lit("cluster_label").alias("selector_feature"),
        F.array(*[F.lit(s) for s in catalog.EXPECTED_STRATA]).alias("expected_strata"),
        "strata",
    )
