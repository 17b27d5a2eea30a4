"""Trained models as versioned folders of tables and documents.

A version holds the models of all strata, the scores they were calibrated on, and a document per stratum
with what an audit needs: thresholds, bounds, offset, count and digest of the scores, sizes of the
splits, features. Its marker is written last; versions without one are not seen.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.operators import calibration
from ringwatch.plans import training
from ringwatch.sources import sinks

TABLES = ["scalers", "reconstruction", "forest", "offsets", "bounds", "thresholds", "scores", "sequences", "rings"]
_DOCUMENT = (
    "stratum string, n bigint, bandwidth double, low double, medium double, high double, status string, score_count bigint, score_digest bigint, "
    "train_sequences bigint, val_sequences bigint, test_sequences bigint, rings bigint, points bigint, ae_low double, ae_high double, "
    "if_low double, if_high double, if_offset double, features array<string>, config string"
)
_MARKER = "config string, strata array<string>, tables array<string>"


def documents(models: training.TrainedModels) -> DataFrame:
    """One row per stratum with a threshold status: what the audit and a reader need."""
    digest = calibration.score_digest(models.scores, ["stratum"], training.SEQ_KEYS)
    splits = models.scores.groupBy("stratum").agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_sequences") for s in ("train", "val", "test")])
    sizes = models.rings.groupBy("stratum").agg(F.count(F.lit(1)).alias("rings"), F.sum("ring_points").alias("points"))
    return (
        models.thresholds.join(digest, "stratum", "left")
        .join(splits, "stratum", "left").join(sizes, "stratum", "left").join(models.bounds, "stratum", "left").join(models.offsets, "stratum", "left")
        .withColumns({"features": F.array(*[F.lit(f) for f in catalog.FEATURES]), "config": F.lit(json.dumps(asdict(models.config)))})
    )


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Newest complete version below ``root``; None if there is none."""
    try:
        found = spark.read.option("basePath", root).schema(f"{_MARKER}, version int").json(f"{root}/version=*/complete")
        return found.agg(F.max("version")).first()[0]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_models(models: training.TrainedModels, root: str) -> int:
    """Write a new version and return its number."""
    spark = models.scores.sparkSession
    version = (latest_version(spark, root) or 0) + 1
    folder = f"{root}/version={version}"
    for name in TABLES:
        getattr(models, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    sinks.write_documents(documents(models), f"{folder}/documents")
    strata = [r["stratum"] for r in models.thresholds.select("stratum").orderBy("stratum").collect()]  # a checked few
    marker = spark.createDataFrame([(json.dumps(asdict(models.config)), strata, TABLES)], _MARKER)
    marker.coalesce(1).write.mode("overwrite").json(f"{folder}/complete")
    return version


def load_models(spark: SparkSession, root: str, version: int | None = None) -> training.TrainedModels:
    """The models of a complete version, the newest unless one is named."""
    version = latest_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no complete models below {root}")
    folder = f"{root}/version={version}"
    marker = spark.read.schema(_MARKER).json(f"{folder}/complete").first()
    known = {f.name for f in fields(ModelConfig)}
    config = ModelConfig(**{k: v for k, v in json.loads(marker["config"]).items() if k in known})
    return training.TrainedModels(config=config, **{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})


def stored_documents(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = latest_version(spark, root) if version is None else version
    return spark.read.schema(_DOCUMENT).json(f"{root}/version={version}/documents")


def audit_models(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Counts, digests and thresholds of a version's documents against its stored scores."""
    models = load_models(spark, root, version)
    told = stored_documents(spark, root, version).filter("status = 'ok'").select(
        "stratum", "low", "medium", "high", "score_count", "score_digest")
    return calibration.audit_calibration(models.scores, told, ["stratum"], training.SEQ_KEYS, models.config)
