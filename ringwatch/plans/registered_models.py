"""Registered queries of the model jobs. Models are trained and stored once per session and data folder, and read from the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwatch.catalog import ModelConfig
from ringwatch.operators import calibration, profiles
from ringwatch.plans import reports, store, training
from ringwatch.plans.registered_joins import STRATUM_SUMMARY, source_candidates
from ringwatch.scratch import new_folder
from ringwatch.sources import tables
from ringwatch.sources.adapters import oracle_ctes, view

QUERIES: dict = {}
ORACLES: dict = {}
_STORES: dict[tuple, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def store_of(spark, sf_dir) -> str:
    """Folder of the models trained from the files made of ``sf_dir``; trained and stored at first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        files = training_folders(spark, sf_dir, one_file=True)
        models = training.train_models(training.training_input(spark, f"{files}/*/*/*.csv"), ModelConfig())
        root = new_folder(spark, "models")
        store.save_models(models, root)
        _STORES[key] = root
    return _STORES[key]


def trained(spark, sf_dir) -> training.TrainedModels:
    return store.load_models(spark, store_of(spark, sf_dir))


def _geo(spark, sf_dir):
    return tables.geo_by_ring(view(spark, sf_dir, "fx_geo").withColumn("file_order", F.col("ring")), "file_order")


def _shield_scores(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points")
    return training.score_shields(pts, source_candidates(pts), _geo(spark, sf_dir), trained(spark, sf_dir))


@register("m1_isolation_forest_fit")
def m1_isolation_forest_fit(spark, sf_dir):
    trees = trained(spark, sf_dir).forest
    leaves = F.size(F.filter("feature", lambda f: f < 0))
    return trees.select("stratum", "tree", "sample_size", F.size("feature").alias("nodes"), leaves.alias("leaves"))


@register("m2_isolation_forest_score")
def m2_isolation_forest_score(spark, sf_dir):
    return trained(spark, sf_dir).scores.select(*training.SEQ_KEYS, "if_anomaly")


@register("m3_reconstruction_fit")
def m3_reconstruction_fit(spark, sf_dir):
    model = trained(spark, sf_dir).reconstruction
    return model.select("stratum", "rows", F.size("mean").alias("dim"), (F.size("components") / F.size("mean")).alias("components"))


@register("m4_reconstruction_error")
def m4_reconstruction_error(spark, sf_dir):
    return trained(spark, sf_dir).scores.select(*training.SEQ_KEYS, "ae_error")


@register("m5_masked_loss")
def m5_masked_loss(spark, sf_dir):
    return trained(spark, sf_dir).scores.groupBy("stratum", "split").agg(F.avg("masked_loss").alias("loss"))


@register("m6_score_sequences")
def m6_score_sequences(spark, sf_dir):
    return training.score_frame(trained(spark, sf_dir))


@register("m7_calibrate")
def m7_calibrate(spark, sf_dir):
    models = trained(spark, sf_dir)
    stats = profiles.score_statistics(models.scores, ["stratum"])
    return models.thresholds.join(models.bounds, "stratum", "left").join(stats, "stratum", "left")


@register("m8_score_by_stratum")
def m8_score_by_stratum(spark, sf_dir):
    return _shield_scores(spark, sf_dir)


@register("m9_train_strata")
def m9_train_strata(spark, sf_dir):
    root = store_of(spark, sf_dir)
    return training.training_metrics(store.load_models(spark, root)).join(store.audit_models(spark, root), "stratum", "left")


@register("m10_training_report")
def m10_training_report(spark, sf_dir):
    return profiles.risk_histogram(trained(spark, sf_dir).scores, ["stratum", "split"], 60)


@register("m10_report_parts")
def m10_report_parts(spark, sf_dir):
    return training.training_report(trained(spark, sf_dir), new_folder(spark, "training-report"))


@register("q1_ring_risk_report")
def q1_ring_risk_report(spark, sf_dir):
    raw = view(spark, sf_dir, "fx_points_raw")
    pts = view(spark, sf_dir, "fx_points")
    shields = pts.select("shield_id").distinct().withColumn("project_code", F.concat(F.lit("P_"), "shield_id"))
    return reports.ring_risk_report(raw, source_candidates(pts), _geo(spark, sf_dir), trained(spark, sf_dir), shields)


@register("q7_train_strata")
def q7_train_strata(spark, sf_dir):
    return training.training_metrics(trained(spark, sf_dir))


def training_folders(spark, sf_dir, one_file: bool = False):
    """Training folders as text files, written from the given tables: one per stratum.

    With ``one_file`` a folder has one machine and one geology file, as pairs of files are data sources.
    """
    root = new_folder(spark, "aligned")
    pts, geo = view(spark, sf_dir, "fx_points"), view(spark, sf_dir, "fx_geo").filter("cluster_label IS NOT NULL")
    areas = F.concat(F.lit("cluster_"), "cluster_label")
    labelled = geo.select("ring", areas.alias("area"))
    tbm = pts.join(labelled, "ring").select("area", "ring_no", "time", "point_id", *training.TBM)
    tbm = tbm.withColumnRenamed("ring_no", "RING")
    if one_file:
        tbm = tbm.repartition("area")
    # one area's files have their columns in another order
    turned = F.col("area") == "cluster_1"
    tbm.filter(~turned).write.partitionBy("area").option("header", True).csv(f"{root}/machine")
    tbm.filter(turned).select(*reversed(tbm.columns)).write.mode("append").partitionBy("area").option("header", True).csv(f"{root}/machine")
    renamed = geo.withColumnsRenamed({"ring": "Ring_Index", "cluster_label": "Cluster_Label"}).withColumn("area", F.concat(F.lit("cluster_"), "Cluster_Label"))
    if one_file:
        renamed = renamed.repartition("area")
    renamed.write.partitionBy("area").option("header", True).csv(f"{root}/geology")
    return root


_LABELLED = (
    oracle_ctes("fx_points", "fx_geo")
    + """, labelled AS (
  SELECT 'area=cluster_' || CAST(g.cluster_label AS VARCHAR) AS folder, p.*
  FROM fx_points p JOIN fx_geo g ON p.ring = g.ring WHERE g.cluster_label IS NOT NULL)
"""
)


@register(
    "s1_read_table",
    _LABELLED + "SELECT folder, point_id, CAST(ring_no AS DOUBLE) AS ring, thrust_spd, ch_torque FROM labelled",
)
def s1_read_table(spark, sf_dir):
    root = training_folders(spark, sf_dir)
    rows = tables.read_delimited(spark, f"{root}/machine/*/*.csv")
    numbers = [F.col(c).try_cast("double").alias(a) for c, a in (("RING", "ring"), ("thrust_spd", "thrust_spd"), ("ch_torque", "ch_torque"))]
    return rows.select("folder", F.col("point_id").cast("bigint").alias("point_id"), *numbers)


@register(
    "s3_split_by_kind",
    _LABELLED + """, kinds AS (
  SELECT DISTINCT 'machine' AS kind, folder FROM labelled
  UNION ALL SELECT DISTINCT 'geology', 'area=cluster_' || CAST(cluster_label AS VARCHAR) FROM fx_geo WHERE cluster_label IS NOT NULL)
SELECT kind, folder, true AS found FROM kinds""",
)
def s3_split_by_kind(spark, sf_dir):
    root = training_folders(spark, sf_dir)
    tbm, geo = tables.split_by_kind(spark, f"{root}/*/*/*.csv")
    both = tbm.withColumn("kind", F.lit("machine")).unionByName(geo.withColumn("kind", F.lit("geology")))
    return both.groupBy("kind", "folder").agg((F.count(F.lit(1)) > 0).alias("found"))


@register("s12_score_frame_sink")
def s12_score_frame_sink(spark, sf_dir):
    from ringwatch.sources import sinks

    path = new_folder(spark, "score-frame")
    sinks.write_score_frame(training.score_frame(trained(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("rows"), F.max("risk_score").alias("top"))


@register("s13_document_sinks")
def s13_document_sinks(spark, sf_dir):
    from ringwatch.sources import sinks

    models = trained(spark, sf_dir)
    path = new_folder(spark, "documents")
    coverage = profiles.feature_coverage(view(spark, sf_dir, "fx_fused"), ["stratum"])
    metrics = training.training_metrics(models)
    sinks.write_metrics(metrics, f"{path}/metrics")
    sinks.write_documents(sinks.model_info(models.thresholds, models.bounds, coverage, models.config), f"{path}/model_info")
    sinks.write_documents(sinks.manifest(metrics, path), f"{path}/manifest")
    strata = spark.read.json(f"{path}/manifest").select(F.explode("strata").alias("s")).select("s.*")
    return strata.select("stratum", "data_size", "sequence_count", "status")


@register("q8_training_data_summary", oracle_ctes("fx_fused") + STRATUM_SUMMARY)
def q8_training_data_summary(spark, sf_dir):
    files = training_folders(spark, sf_dir, one_file=True)
    return reports.training_data_summary(spark, f"{files}/*/*/*.csv")
