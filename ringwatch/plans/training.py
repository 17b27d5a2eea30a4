"""Model input and training jobs, all strata in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.functions import scoring, text
from ringwatch.functions.rounding import with_rounded
from ringwatch.operators import calibration, cleaning, forest, joins, profiles, reconstruction, rules, sequences, windows
from ringwatch.scratch import broadcast_if_small, materialize, stored
from ringwatch.sources import sinks, tables

SOURCE_KEYS = ["stratum", "data_source"]
RING_KEYS = [*SOURCE_KEYS, "ring"]
TBM = catalog.TBM_FEATURES


def training_input(spark: SparkSession, files: str, expected=None) -> DataFrame:
    """Fused points of training folders: every machine file with every geology file of its folder.

    ``files`` is a glob over delimited files. Files are told apart by their header, cleaned, matched on ring
    and checked: every expected stratum must be there, rows of others are left out. The fused rows are
    written once; whatever follows reads that table instead of the text files.
    """
    machine, geology = tables.split_by_kind(spark, files)
    paths = [[unquote(r["path"]) for r in kind.select("path").orderBy("path").collect()] for kind in (machine, geology)]
    if not all(paths):
        raise FileNotFoundError(f"machine and geology files are needed under {files}")
    heads = [kind.select("path", F.array_join("header", ",").alias("header")) for kind in (machine, geology)]
    tbm = cleaning.normalize_tbm(tables.read_delimited(spark, paths[0], heads=heads[0])).withColumnRenamed("file_name", "tbm_file")
    tbm = tbm.withColumns({"time": F.col("time").try_cast("timestamp_ntz"), "point_id": F.col("point_id").try_cast("bigint")})
    geo = tables.read_delimited(spark, paths[1], heads=heads[1]).withColumnRenamed("Cluster_Label", "cluster_label")
    geo = cleaning.normalize_geo(geo, "file_order", ("folder", "file_name")).withColumnRenamed("file_name", "geo_file")
    fused = joins.fuse(tbm.select("folder", "tbm_file", "ring", "time", "point_id", *TBM), geo)
    labelled = fused.withColumn("stratum", text.stratum_key(F.col("cluster_label"))).filter("stratum IS NOT NULL")
    rows = cleaning.drop_all_null_features(labelled.select(*RING_KEYS, "time", "point_id", *TBM, *catalog.GEO_FEATURES))
    return cleaning.check_strata(stored(rows, "training-input"), expected)


def ring_list(fused: DataFrame) -> DataFrame:
    """Rings of each source with their number of points."""
    return fused.groupBy(*RING_KEYS).agg(F.count(F.lit(1)).alias("ring_points"))


def ring_table(fused: DataFrame) -> DataFrame:
    """:func:`ring_list` with the geology of each ring; one row per ring, from one reading of the points."""
    return fused.groupBy(*RING_KEYS).agg(F.count(F.lit(1)).alias("ring_points"), *[F.first(f).alias(f) for f in catalog.GEO_FEATURES])


def point_blocks(fused: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Smoothed points of all rings in blocks, written once; scalers and windows both read them."""
    return stored(windows.point_blocks(fused, RING_KEYS, TBM, config), "point-blocks")


def windows_of(
    fused: DataFrame, config: ModelConfig = ModelConfig(), wanted: DataFrame | None = None, blocks: DataFrame | None = None, rings: DataFrame | None = None
) -> DataFrame:
    """Windows of all rings with the ring's geology carried along; of ``wanted`` ones only, if given."""
    return windows.sliding_windows(fused, RING_KEYS, TBM, config, carry=catalog.GEO_FEATURES, wanted=wanted, blocks=blocks, rings=rings)


def scalers(fused: DataFrame, config: ModelConfig = ModelConfig(), blocks: DataFrame | None = None, rings: DataFrame | None = None) -> DataFrame:
    """Robust scalers from full windows of the training rings; from their ``blocks`` and ``rings`` (:func:`ring_table`) where at hand."""
    rings = materialize(ring_table(fused)) if rings is None else rings
    split = sequences.split_rings(rings.select(*RING_KEYS, "ring_points"), SOURCE_KEYS)
    train = materialize(split.filter("split = 'train'").select(*RING_KEYS, "ring_points"))
    of_train = lambda rows, tie: joins.join_rings(rows, train.select(*RING_KEYS), RING_KEYS, "left_semi", tie)
    if blocks is None:
        rows = of_train(fused.select(*RING_KEYS, "time", "point_id", *TBM), "point_id")
        smoothed = windows.smoothed_points(rows, RING_KEYS, TBM, config.smoothing_window)
    else:
        smoothed = windows.block_points(of_train(blocks, "block"), RING_KEYS, TBM)
    geo = rings.drop("ring_points").join(train, RING_KEYS)
    return calibration.robust_scalers(smoothed, geo, config)


def scaler_vectors(scaler_rows: DataFrame) -> DataFrame:
    """One row per stratum: machine scaler arrays (feature-major) and geology scaler arrays."""
    order = F.array_position(F.array(*[F.lit(f) for f in catalog.FEATURES]), F.col("feature"))
    item = F.struct(order.alias("o"), "pos", "median", "mad")
    machine = F.col("feature").isin(TBM)
    geology = ~machine & (F.col("pos") == 0)
    # 768 rows per stratum at most
    packed = scaler_rows.groupBy("stratum").agg(
        F.sort_array(F.collect_list(F.when(machine, item))).alias("m"),
        F.sort_array(F.collect_list(F.when(geology, item))).alias("g"),
    )
    pick = lambda c, name: F.transform(c, lambda x: x[name])
    return packed.select(
        "stratum",
        pick("m", "median").alias("m_mid"),
        pick("m", "mad").alias("m_dev"),
        pick("g", "median").alias("g_mid"),
        pick("g", "mad").alias("g_dev"),
    )


def normalized_windows(wins: DataFrame, scaler_rows: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Add ``z`` (machine cells) and ``gz`` (one value per geology feature)."""
    joined = wins.join(F.broadcast(scaler_vectors(scaler_rows)), "stratum")  # one row per stratum
    geo = F.array(*[F.col(f) for f in catalog.GEO_FEATURES])
    always = F.array(*[F.lit(True)] * len(catalog.GEO_FEATURES))
    return joined.withColumns(
        {
            "z": windows.normalize_masked(F.col("vals"), F.col("mask"), F.col("m_mid"), F.col("m_dev"), config.clip_zscore),
            "gz": windows.normalize_masked(geo, always, F.col("g_mid"), F.col("g_dev"), config.clip_zscore),
        }
    ).drop("m_mid", "m_dev", "g_mid", "g_dev", *catalog.GEO_FEATURES)


def eligibility(points: DataFrame, candidates: DataFrame, geo: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Whether each ring can be scored by the model, and by which stratum's.

    Needs six rings with data, a full window of points in the ring itself and every
    machine feature measured at least once in it. Geology is constant within a ring, so
    the ring's label is the first label in time.
    """
    current = points.groupBy("shield_id", "ring").agg(
        F.count(F.lit(1)).alias("points"), *[F.count(f).alias(f"{f}_n") for f in TBM]
    )
    indexed = joins.rings_with_index(points)
    rings = F.least(F.col("ring_idx") + 1, F.lit(config.rings_per_sequence)).alias("rings")
    labels = joins.geo_for_rings(indexed.select("shield_id", "ring"), candidates, geo)
    measured = F.lit(True)
    for f in TBM:
        measured = measured & (F.col(f"{f}_n") > 0)
    ok = (F.col("rings") >= config.rings_per_sequence) & (F.col("points") >= config.window_points) & measured
    return (
        indexed.select("shield_id", "ring", rings)
        .join(current, ["shield_id", "ring"])
        .join(labels.select("shield_id", "ring", "cluster_label"), ["shield_id", "ring"])
        .select("shield_id", "ring", "rings", "points", ok.alias("eligible"), text.stratum_key(F.col("cluster_label")).alias("stratum"))
    )


SEQ_KEYS = [*SOURCE_KEYS, "split", "group_idx", "window_idx"]


@dataclass
class TrainedModels:
    """Bounded models of all strata and the scored calibration sequences."""

    config: ModelConfig
    scalers: DataFrame
    reconstruction: DataFrame
    forest: DataFrame
    offsets: DataFrame
    bounds: DataFrame
    thresholds: DataFrame
    scores: DataFrame
    sequences: DataFrame
    rings: DataFrame


def window_inputs(normal: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Model columns of normalised windows: cells and padding."""
    pad = F.greatest(F.lit(config.window_points) - F.col("ring_points"), F.lit(0)).cast("int")
    return normal.withColumn("pad", pad).drop("vals", "ring_points")


def all_sequences(rings: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """All sequences of every stratum with their split."""
    return materialize(sequences.split_sequences(rings, SOURCE_KEYS, config))


def sequence_inputs(steps: DataFrame, window_rows: DataFrame, join_keys: list[str], seq_keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Per sequence: trend vector, reconstruction error and masked loss, from its six windows."""
    cells = config.rings_per_sequence * len(catalog.FEATURES) * config.window_points
    joined = steps.withColumnRenamed("window_idx", "seq_window").withColumnRenamed("step_window_idx", "window_idx")
    seq_keys_ = ["seq_window" if k == "window_idx" else k for k in seq_keys]
    rows = joined.join(window_rows, join_keys)
    grouped = rows.groupBy(*seq_keys_).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", "trend"))), lambda s: s["trend"])).alias("vec"),
        (F.sum("weighted_error") / cells).alias("ae_error"),
        (F.sum("plain_error") / F.greatest(F.sum("measured"), F.lit(1.0))).alias("masked_loss"),
        F.max(F.when(F.col("step") == config.rings_per_sequence - 1, F.col("end_time"))).alias("end_time"),
        F.count(F.lit(1)).alias("_steps"),
    )
    return grouped.filter(F.col("_steps") == config.rings_per_sequence).drop("_steps").withColumnRenamed("seq_window", "window_idx")


def fit_rows(scored: DataFrame) -> DataFrame:
    """Training sequences; each tree of the forest draws its own bounded sample from all of them."""
    return scored.filter("split = 'train'")


def train_models(fused: DataFrame, config: ModelConfig = ModelConfig()) -> TrainedModels:
    """All strata at once: split, scale, window, reconstruct, isolate, calibrate."""
    table = materialize(ring_table(fused))
    rings = table.select(*RING_KEYS, "ring_points")
    seqs = all_sequences(rings, config)
    steps = materialize(
        sequences.sequence_steps(seqs, [*SOURCE_KEYS, "split"]).select(*SEQ_KEYS, "step", "ring", "step_window_idx")
    )
    blocks = point_blocks(fused, config)
    scaler_rows = materialize(scalers(fused, config, blocks, table))
    # only windows that some sequence uses
    wanted = steps.groupBy(*RING_KEYS, F.col("step_window_idx").alias("window_idx")).agg(
        F.count_if(F.col("split") == "train").cast("double").alias("weight")
    )
    normal = normalized_windows(windows_of(fused, config, wanted, blocks, table), scaler_rows, config)
    inputs = materialize(window_inputs(normal, config))
    model = materialize(reconstruction.fit_reconstruction(inputs.filter("weight > 0"), config))
    keys = [*RING_KEYS, "window_idx"]
    rows = materialize(reconstruction.window_errors(inputs, reconstruction.pack_reconstruction(model, config), [*keys, "end_time"], config))
    seq_rows = materialize(sequence_inputs(steps, rows, keys, SEQ_KEYS, config))
    trees = materialize(forest.fit_forest(fit_rows(seq_rows), SEQ_KEYS, config))
    raw = materialize(forest.score_forest(seq_rows, forest.pack_forest(trees, config)))
    offsets = materialize(forest.anomaly_offset(fit_rows(raw), config))
    anomalies = raw.join(F.broadcast(offsets), "stratum").withColumn("if_anomaly", F.col("if_raw") - F.col("if_offset"))
    bounds = materialize(calibration.score_bounds(anomalies, ["stratum"], config))
    scores = materialize(calibration.combined_scores(anomalies.drop("if_raw", "if_offset"), bounds, ["stratum"], config))
    thresholds = calibration.kde_thresholds(scores, ["stratum"], config)
    return TrainedModels(config, scaler_rows, model, trees, offsets, bounds, thresholds, scores, seqs, rings)


def score_frame(models: TrainedModels) -> DataFrame:
    return models.scores.select(*SEQ_KEYS, "ae_error", "if_anomaly", "risk_score")


def training_metrics(models: TrainedModels) -> DataFrame:
    """One metrics row per stratum: sequence counts, test level rates, thresholds."""
    limits = models.thresholds.select("stratum", "low", "medium", "high", "bandwidth", "status")
    test = models.scores.filter("split = 'test'").join(F.broadcast(limits), "stratum").filter("status = 'ok'")
    rates = profiles.risk_level_counts(test, ["stratum"]).select(
        "stratum", *[F.col(c).alias(f"test_{c}") for c in ("no_risk_rate", "low_rate", "medium_rate", "high_rate", "medium_high_rate")]
    )
    counts = models.scores.groupBy("stratum").agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_sequences") for s in ("train", "val", "test")],
        F.avg(F.when(F.col("split") == "train", F.col("masked_loss"))).alias("train_loss"),
        F.avg(F.when(F.col("split") == "val", F.col("masked_loss"))).alias("val_loss"),
    )
    sizes = models.rings.groupBy("stratum").agg(F.sum("ring_points").alias("data_size"), F.count(F.lit(1)).alias("rings"))
    dim = len(catalog.FEATURES) * models.config.window_points
    return (
        counts.join(sizes, "stratum")
        .join(limits, "stratum", "left")
        .join(rates, "stratum", "left")
        .withColumns({"feature_count": F.lit(len(catalog.FEATURES)), "feature_dim": F.lit(dim)})
    )


def training_report(models: TrainedModels, root: str, bins: int = 60) -> DataFrame:
    """Write the report of a training in four parts and return a row per part and stratum.

    ``scores`` holds the score frame, ``metrics`` a document per stratum with the settings, sizes,
    rates and thresholds, ``histogram`` the risk scores per split beside the thresholds, ``density``
    the two scores that make up the risk on a grid. All but the scores are bounded by the strata.
    """
    config = models.config
    limits = broadcast_if_small(scoring.checked_thresholds(models.thresholds.filter("status = 'ok'").select("stratum", "low", "medium", "high")))
    settings = {
        "window_points": config.window_points, "window_stride": config.window_stride, "rings_per_sequence": config.rings_per_sequence,
        "feature_names": ",".join(catalog.FEATURES)}
    parts = {
        "scores": score_frame(models),
        "metrics": training_metrics(models).withColumns({k: F.lit(v) for k, v in settings.items()}),
        "histogram": profiles.risk_histogram(models.scores, ["stratum", "split"], bins).join(limits, "stratum", "left"),
        "density": profiles.score_density(models.scores, ["stratum", "split"], bins=bins),
    }
    spark = models.scores.sparkSession
    sinks.write_score_frame(parts["scores"], f"{root}/scores")
    sinks.write_metrics(parts["metrics"], f"{root}/metrics")
    told = None
    for name, frame in parts.items():
        if name in ("histogram", "density"):
            frame.write.mode("overwrite").partitionBy("stratum").parquet(f"{root}/{name}")
        saved = spark.read.json(f"{root}/{name}") if name == "metrics" else spark.read.parquet(f"{root}/{name}")
        rows = saved.groupBy(F.col("stratum").cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
        rows = rows.select(F.lit(name).alias("part"), "stratum", "rows")
        told = rows if told is None else told.unionByName(rows)
    return told


def score_shields(points: DataFrame, candidates: DataFrame, geo: DataFrame, models: TrainedModels) -> DataFrame:
    """Window scores of every eligible ring by the model of its stratum.

    One row per (shield, ring, window); a ring whose stratum has no usable model gets one
    row with ``status`` 'no model' and no score.
    """
    config = models.config
    keys = ["shield_id", "ring"]
    ready = materialize(eligibility(points, candidates, geo, config).filter("eligible").select(*keys, "stratum"))
    usable = models.thresholds.filter("status = 'ok'").select("stratum")
    no_model = ready.join(F.broadcast(usable), "stratum", "left_anti")
    centers = ready.join(F.broadcast(usable), "stratum", "left_semi")
    sizes = materialize(profiles.ring_sizes(points, ["shield_id"]))
    near = joins.last_k_rings(joins.rings_with_index(points), config.rings_per_sequence)
    # the six rings of a center always form one group whose latest ring is the center
    n = F.col("points")
    group_rings = centers.withColumnRenamed("ring", "center_ring").join(near, ["shield_id", "center_ring"]).join(sizes, keys)
    has = F.when(n >= config.window_points, profiles.estimated_windows(n, config)).otherwise(F.lit(1))
    groups = (
        group_rings.withColumn("windows", has)
        .groupBy("shield_id", "center_ring", "stratum")
        .agg(
            F.sort_array(F.collect_list(F.struct("ring", "windows"))).alias("members"),
            F.max(F.when(F.col("ring") == F.col("center_ring"), F.col("windows"))).alias("sequences"),
        )
        .select(
            "shield_id",
            "center_ring",
            "stratum",
            "sequences",
            F.col("center_ring").alias("end_ring"),
            F.lit(0).cast("bigint").alias("group_idx"),
            F.transform("members", lambda m, i: F.struct(i.alias("step"), m["ring"].alias("ring"), m["windows"].alias("windows"))).alias("rings"),
        )
    )
    center_keys = ["shield_id", "center_ring", "stratum"]
    steps = materialize(
        sequences.sequence_steps(sequences.sequences(groups, center_keys), center_keys).drop("group_idx", "end_ring")
    )
    wanted = steps.select("shield_id", "ring", F.col("step_window_idx").alias("window_idx"), "stratum").distinct()
    used = joins.join_rings(points, steps.select(*keys).distinct(), keys, "left_semi")
    labelled = joins.geo_for_rings(steps.select(*keys).distinct(), candidates, geo)
    # the geology comes with the wanted windows, so that finished windows need not move again
    model_wins = windows.sliding_windows(used, keys, TBM, config, wanted=wanted.join(labelled.drop("cluster_label"), keys))
    inputs = materialize(window_inputs(normalized_windows(model_wins, models.scalers, config), config))
    row_keys = [*keys, "window_idx", "stratum"]
    rows = reconstruction.window_errors(inputs, reconstruction.pack_reconstruction(models.reconstruction, config), [*row_keys, "end_time"], config)
    seq_rows = sequence_inputs(steps, rows, row_keys, [*center_keys, "window_idx"], config)
    raw = materialize(forest.score_forest(seq_rows, forest.pack_forest(models.forest, config)))
    anomalies = raw.join(F.broadcast(models.offsets), "stratum").withColumn("if_anomaly", F.col("if_raw") - F.col("if_offset"))
    scored = calibration.combined_scores(anomalies, F.broadcast(models.bounds), ["stratum"], config)
    found = scored.select(
        "shield_id", F.col("center_ring").alias("ring"), "stratum", "window_idx", "end_time", "ae_error", "if_anomaly", "risk_score"
    ).withColumn("status", F.lit("scored"))
    return found.unionByName(no_model.withColumn("status", F.lit("no model")), allowMissingColumns=True)


def mud_cake_results(points: DataFrame, window_scores: DataFrame, models: TrainedModels) -> DataFrame:
    """Final mud cake result of each scored ring in report form."""
    usable = models.thresholds.filter("status = 'ok'").select("stratum", "low", "medium", "high")
    limits = broadcast_if_small(scoring.checked_thresholds(usable))
    scored = window_scores.filter("status = 'scored'")
    final = calibration.ring_result(scored, ["shield_id", "ring"], limits, config=models.config)
    out = final.select(
        "shield_id",
        "ring",
        F.lit("mud_cake").alias("risk_type"),
        "stratum",
        F.col("final_risk").alias("probability"),
        text.level_priority(text.level_from_model_text(F.col("model_level"))).alias("priority"),
        "earliest_time",
    )
    out = rules.with_score(with_rounded(out, {"probability": 2}), list(catalog.RISKS))
    first = points.groupBy("shield_id", "ring").agg(F.min("time").alias("first_time"))
    warned = F.when(F.col("earliest_time").isNull(), F.col("first_time")).when(F.col("priority") >= 2, F.col("earliest_time"))
    return out.join(first, ["shield_id", "ring"]).withColumn("warning_time", warned).drop("first_time", "earliest_time")
