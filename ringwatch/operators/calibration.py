"""Scalers, score bounds and density-based thresholds of the mud cake model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.functions import scoring
from ringwatch.operators import profiles
from ringwatch.operators.binned import KEYS, MOST_STRATA, cell_medians
from ringwatch.operators.kernel import KernelTable, kernel_tables
from ringwatch.operators.quantiles import exact_percentiles
from ringwatch.scratch import materialize, stored

MIN_SCORES = 20
MAD_SCALE = 1.4826
NEWTON_STEPS = 60
TOLERANCE = 1e-13
#: Keys (soil strata) whose iteration the driver holds.
MOST_KEYS = 1000


def _median_and_deviation(cells: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    # equal values are counted once; both passes then read this reduced table
    counted = materialize(cells.groupBy(*keys, "value").agg(F.sum(weight).alias("many")))
    medians = materialize(exact_percentiles(counted, keys, "value", {"median": 0.5}, "many").drop("n"))
    off = counted.join(medians, keys).withColumn("off", F.abs(F.col("value") - F.col("median")))
    spread = exact_percentiles(off, keys, "off", {"raw": 0.5}, "many").drop("n")
    mad = F.when(F.col("raw") > 0, F.col("raw") * MAD_SCALE).otherwise(1.0)
    return medians.join(spread, keys).select(*keys, "median", mad.alias("mad"))


def robust_scalers(points: DataFrame, geo_rings: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Median and scaled deviation per (stratum, feature, position) over training windows.

    ``points`` are smoothed points of training rings, ``geo_rings`` one row per training
    ring with ``ring_points`` and the geology features. Geology repeats over a ring's
    windows, so each ring counts with its number of windows and all positions agree.
    """
    spark = points.sparkSession
    cells = stored(points.select("stratum", "idx", "n", *[f"{f}{end}" for f in catalog.TBM_FEATURES for end in ("_s", "_ok")]), "scaler-points")
    medians, spread = cell_medians(cells, catalog.TBM_FEATURES, config)
    weights = geo_rings.withColumn("_w", profiles.estimated_windows(F.col("ring_points"), config)).filter("_w > 0")
    long = weights.unpivot(["stratum", "_w"], catalog.GEO_FEATURES, "feature", "value")
    geology = _median_and_deviation(long, ["stratum", "feature"], F.col("_w"))
    # 768 rows per stratum at most, of a checked number of strata
    raw = {tuple(r[k] for k in KEYS): r["median"] for r in spread.collect()}
    found = {}
    for r in medians.collect():
        key = tuple(r[k] for k in KEYS)
        found[key] = (r["median"], raw[key] * MAD_SCALE if raw[key] > 0 else 1.0)
    for r in geology.limit(MOST_STRATA * len(catalog.GEO_FEATURES)).collect():
        found |= {(r["stratum"], r["feature"], pos): (r["median"], r["mad"]) for pos in range(config.window_points)}
    rows = [
        (stratum, feature, pos, *found.get((stratum, feature, pos), (0.0, 1.0)))
        for stratum in sorted({k[0] for k in found if k[0] is not None}) for feature in catalog.FEATURES for pos in range(config.window_points)
    ]
    return spark.createDataFrame(rows, "stratum string, feature string, pos int, median double, mad double")


def score_bounds(scores: DataFrame, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Lower and upper quantile of both raw scores."""
    both = F.array(
        F.struct(F.lit("ae").alias("kind"), F.col("ae_error").alias("value")),
        F.struct(F.lit("if").alias("kind"), F.col("if_anomaly").alias("value")),
    )
    long = scores.select(*keys, F.explode(both).alias("s")).select(*keys, "s.*")
    found = exact_percentiles(
        long, [*keys, "kind"], "value", {"low": config.scale_low_quantile, "high": config.scale_high_quantile}
    )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("ae", "if") for c in ("low", "high")]
    )


def combined_scores(scores: DataFrame, bounds: DataFrame, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Weighted mean of both scores after scaling to their bounds."""
    ae = scoring.scale_by_bounds(F.col("ae_error"), F.col("ae_low"), F.col("ae_high"))
    iso = scoring.scale_by_bounds(F.col("if_anomaly"), F.col("if_low"), F.col("if_high"))
    risk = scoring.combined_risk(ae, iso, config.reconstruction_weight, config.isolation_weight)
    return scores.join(bounds, keys).withColumn("risk_score", risk).drop("ae_low", "ae_high", "if_low", "if_high")


def silverman_bandwidth(
    scores: DataFrame, keys: list[str], score: str = "risk_score", extra: dict[str, float] | None = None
) -> DataFrame:
    """Rule-of-thumb kernel width; NULL without spread or with fewer than two scores.

    ``extra`` asks for further quantiles from the same pass.
    """
    finite = scores.filter(_finite(score))
    moments = finite.groupBy(*keys).agg(F.stddev_samp(score).alias("std"))
    quantiles = exact_percentiles(finite, keys, score, {"q25": 0.25, "q75": 0.75, **(extra or {})})
    joined = moments.join(quantiles, keys).withColumn("iqr", F.col("q75") - F.col("q25"))
    sigma = F.when(F.col("iqr") > 0, F.least(F.col("std"), F.col("iqr") / 1.349)).otherwise(F.col("std"))
    width = F.lit(0.9) * sigma * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    usable = (F.col("n") >= 2) & (sigma > 1e-12)
    return joined.select(*keys, "n", "std", "iqr", F.when(usable, width).alias("bandwidth"), *(extra or {}))


def _finite(score: str) -> Column:
    c = F.col(score)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _levels(config: ModelConfig) -> dict[str, float]:
    levels = {"low": config.cdf_low, "medium": config.cdf_medium, "high": config.cdf_high}
    if not 0.0 < levels["low"] < levels["medium"] < levels["high"] < 1.0:
        raise ValueError("levels must rise within (0, 1)")
    return levels


def _newton(s: dict, table: KernelTable, targets: list[float]) -> None:
    """Advance the thresholds of one key by bracketed Newton steps until they settle or leave the table."""
    for i, target in enumerate(targets):
        while not s["done"][i] and s["steps"][i] < NEWTON_STEPS:
            x = s["x"][i]
            got = table.at(x)
            if got is None:
                break
            s["steps"][i] += 1
            gap = (got[0] - s["base"]) / s["mass"] - target
            slope = got[1] / s["mass"]
            if gap > 0:
                s["hi"][i] = x
            else:
                s["lo"][i] = x
            step = x - gap / slope if slope > 0 else float("nan")
            inside = s["lo"][i] < step < s["hi"][i]
            new = step if inside else (s["lo"][i] + s["hi"][i]) / 2
            # fine against narrow kernels as well, but no finer than doubles are
            fine = max(min(TOLERANCE, 1e-10 * s["h"]), 2.3e-16 * abs(x))
            s["done"][i] = abs(new - x) <= fine or gap == 0.0
            s["x"][i] = x if gap == 0.0 else new


def kde_thresholds(scores: DataFrame, keys: list[str], config: ModelConfig = ModelConfig(), score: str = "risk_score") -> DataFrame:
    """Scores at which the kernel-density distribution on [0, 1] reaches each level.

    One pass makes a bounded table of kernel bins per key around 0, 1 and the empirical quantiles,
    which lie close to the thresholds; a bracketed Newton iteration then asks only the tables. A
    further pass follows if a candidate leaves its table. ``status`` is 'ok', or why a key has no
    thresholds. Tables of at most ``MOST_KEYS`` keys are held at a time.
    """
    levels = _levels(config)
    targets = list(levels.values())
    spark = scores.sparkSession
    finite = scores.filter(_finite(score)).select(*keys, F.col(score).cast("double").alias("_s"))
    finite = materialize(finite)
    widths = silverman_bandwidth(finite, keys, "_s", {f"start_{k}": p for k, p in levels.items()})
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.select(*keys).schema)

    state, rows = {}, []
    found = widths.limit(MOST_KEYS + 1).collect()
    if len(found) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys to find thresholds for")
    for r in found:
        key = tuple(r[k] for k in keys)
        if r["n"] < MIN_SCORES:
            rows.append((*key, None, None, None, None, None, "too few scores"))
        elif r["bandwidth"] is None:
            rows.append((*key, None, None, None, None, None, "no dispersion"))
        else:
            start = [min(max(r[f"start_{k}"], 0.0), 1.0) for k in levels]
            state[key] = {"h": r["bandwidth"], "n": r["n"], "x": start, "lo": [0.0] * 3, "hi": [1.0] * 3,
                          "done": [False] * 3, "steps": [0] * 3, "base": None}
    open_keys = dict(state)
    for _ in range(NEWTON_STEPS):
        if not open_keys:
            break
        asked = {k: (s["h"], [*s["x"], *([0.0, 1.0] if s["base"] is None else [])]) for k, s in open_keys.items()}
        for key, table in kernel_tables(finite, keys, "_s", asked).items():
            s = state[key]
            if s["base"] is None:
                s["base"] = table.at(0.0)[0]
                s["mass"] = table.at(1.0)[0] - s["base"]
                if not s["mass"] > 1e-12:
                    rows.append((*key, None, None, None, None, None, "no mass in [0, 1]"))
                    del state[key]
                    continue
            _newton(s, table, targets)
        open_keys = {k: s for k, s in state.items() if any(not d and n < NEWTON_STEPS for d, n in zip(s["done"], s["steps"]))}
    for key, s in state.items():
        low, medium, high = s["x"]
        if not all(s["done"]):
            rows.append((*key, s["n"], s["h"], None, None, None, "not converged"))
            continue
        status = "ok" if low < medium < high else "not strictly ordered"
        rows.append((*key, s["n"], s["h"], low, medium, high, status))
    return spark.createDataFrame(
        rows, f"{key_ddl}, n bigint, bandwidth double, low double, medium double, high double, status string"
    )


def threshold_levels(scores: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "risk_score") -> DataFrame:
    """Distribution on [0, 1] at each threshold, ``<level>_cdf``, from the kernels of all scores themselves.

    One row per key with thresholds; a plain sum without bins, for checking :func:`kde_thresholds`.
    """
    names = ["low", "medium", "high"]
    at = thresholds.filter("low IS NOT NULL").select(*keys, "bandwidth", *names)
    if at.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys to check thresholds of")
    finite = scores.filter(_finite(score)).select(*keys, F.col(score).cast("double").alias("_s"))
    points = {"low": F.col("low"), "medium": F.col("medium"), "high": F.col("high"), "zero": F.lit(0.0), "one": F.lit(1.0)}
    z = finite.join(F.broadcast(at), keys).withColumns({f"z_{k}": (x - F.col("_s")) / F.col("bandwidth") for k, x in points.items()})
    phi = scoring.with_normal_cdf(z, {f"p_{k}": f"z_{k}" for k in points})
    sums = phi.groupBy(*keys).agg(*[F.avg(f"p_{k}").alias(k) for k in points])
    return sums.select(*keys, *[((F.col(k) - F.col("zero")) / (F.col("one") - F.col("zero"))).alias(f"{k}_cdf") for k in names])


def score_digest(scores: DataFrame, keys: list[str], id_cols: list[str], score: str = "risk_score") -> DataFrame:
    """Order-free digest and count of the calibration scores."""
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("score_count"), F.bit_xor(F.xxhash64(*id_cols, score)).alias("score_digest")
    )


def audit_calibration(
    scores: DataFrame, stored: DataFrame, keys: list[str], id_cols: list[str], config: ModelConfig = ModelConfig()
) -> DataFrame:
    """Recompute count, digest and thresholds and compare with the stored ones (1e-12)."""
    again = kde_thresholds(scores, keys, config).select(*keys, *[F.col(c).alias(f"{c}_again") for c in ("low", "medium", "high")])
    digest = score_digest(scores, keys, id_cols).select(
        *keys, F.col("score_count").alias("count_again"), F.col("score_digest").alias("digest_again")
    )
    close = [F.abs(F.col(c) - F.col(f"{c}_again")) <= 1e-12 for c in ("low", "medium", "high")]
    return stored.join(again, keys).join(digest, keys).select(
        *keys,
        (F.col("score_count") == F.col("count_again")).alias("count_ok"),
        F.col("score_digest").eqNullSafe(F.col("digest_again")).alias("digest_ok"),
        F.coalesce(close[0] & close[1] & close[2], F.lit(False)).alias("thresholds_ok"),
    )


def ring_result(windows: DataFrame, keys: list[str], thresholds: DataFrame, mode: str = "median", config: ModelConfig = ModelConfig()) -> DataFrame:
    """Final score, level and first warning time of rings from their window scores.

    ``windows``: keys, stratum, window_idx, end_time, risk_score. ``thresholds``: stratum,
    low, medium, high.
    """
    aggregates = profiles.window_score_aggregates(windows, keys, "risk_score", config)
    if mode not in ("max", "mean", "median", "pquantile", "topk_mean"):
        raise ValueError(f"unknown aggregation {mode}")
    cut = windows.join(thresholds, "stratum")
    warned = F.when(F.col("risk_score") >= F.col("low"), F.col("window_idx"))
    limits = cut.groupBy(*keys).agg(
        F.first("stratum").alias("stratum"),
        *[F.first(c).alias(c) for c in ("low", "medium", "high")],
        F.min_by("end_time", warned).alias("earliest_time"),
    )
    score = F.col("final_risk")
    return (
        aggregates.select(*keys, F.col(mode).alias("final_risk"))
        .join(limits, keys)
        .withColumn("model_level", profiles.level_name(score, F.col("low"), F.col("medium"), F.col("high")))
        .drop("low", "medium", "high")
    )
