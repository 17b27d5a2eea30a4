"""Registered queries: fill, smoothing, windows, sequences, splits and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.functions.rounding import with_rounded
from ringwatch.operators import calibration, cleaning, profiles, sequences, windows
from ringwatch.operators.ordered import add_index, time_slice
from ringwatch.plans import training
from ringwatch.scratch import materialize, new_folder, stored
from ringwatch.sources import sinks
from ringwatch.plans.registered_joins import _CANDIDATES, _LAST_K, source_candidates
from ringwatch.plans.registered_points import round_sql
from ringwatch.sources import tables
from ringwatch.sources.adapters import oracle_ctes, view

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


TBM = catalog.TBM_FEATURES
TBM_LIST = ", ".join(TBM)
POINTS = oracle_ctes("fx_points")
FUSED = oracle_ctes("fx_fused")
RING = ["shield_id", "ring"]


@register(
    "w1_order_ring_points",
    POINTS
    + """ SELECT shield_id, ring, point_id, row_number() OVER (PARTITION BY shield_id, ring ORDER BY t NULLS LAST, point_id) - 1 AS idx
FROM (SELECT shield_id, ring, point_id, CASE WHEN point_id % 31 = 0 THEN NULL ELSE time END AS t FROM fx_points)""",
)
def w1_order_ring_points(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points")
    raw = F.when(F.col("point_id") % 31 == 0, "no time").otherwise(F.col("time").cast("string"))
    ordered, order = windows.order_by_time(pts.select(*RING, "point_id", raw.alias("timestamp")))
    sliced = ordered.withColumn("_s", time_slice(ordered, "timestamp"))
    return add_index(sliced, RING, "_s", order).select(*RING, "point_id", "idx")


def _fill_sql(source: str, keys: str) -> str:
    parts = ", ".join(
        f"coalesce(last_value({f} IGNORE NULLS) OVER w, 0.0e0) AS {f}_fill, {f} IS NOT NULL AS {f}_ok" for f in TBM
    )
    return f"""filled AS (SELECT {keys}, time, point_id, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY {keys}) AS n, {parts}
FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY time, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _smooth_sql(keys: str) -> str:
    parts = ", ".join(f"quantile_cont({f}_fill, 0.5) OVER w AS {f}_s, {f}_ok" for f in TBM)
    return f"""smoothed AS (SELECT {keys}, time, point_id, idx, n, {parts} FROM filled
WINDOW w AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


_FILL_COLS = ", ".join(f"{f}_fill, {f}_ok" for f in TBM)
_SMOOTH_COLS = ", ".join(f"{f}_s" for f in TBM)


@register(
    "w2_fill_forward",
    POINTS + f", {_fill_sql('fx_points', 'shield_id, ring')} SELECT shield_id, ring, point_id, idx, n, {_FILL_COLS} FROM filled",
)
def w2_fill_forward(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select(*RING, "time", "point_id", *TBM)
    return windows.fill_forward(pts, RING, TBM).drop("time")


@register(
    "w3_rolling_median",
    POINTS
    + f", {_fill_sql('fx_points', 'shield_id, ring')}, {_smooth_sql('shield_id, ring')} SELECT shield_id, ring, point_id, {_SMOOTH_COLS} FROM smoothed",
)
def w3_rolling_median(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select(*RING, "time", "point_id", *TBM)
    return windows.smoothed_points(pts, RING, TBM).select(*RING, "point_id", *_SMOOTH_COLS.split(", "))


def _windows_sql(keys: str) -> str:
    """Cells of all windows in long form, padded ones included."""
    cells = " UNION ALL ".join(
        f"SELECT {keys}, window_idx, partial, '{f}' AS feature, pos, CAST({f}_s AS DOUBLE) AS value, {f}_ok AS ok FROM placed" for f in TBM
    )
    blanks = " UNION ALL ".join(
        f"SELECT {keys}, 0 AS window_idx, true AS partial, '{f}' AS feature, range AS pos, 0.0e0 AS value, false AS ok FROM short, range(48) r WHERE range < 48 - n" for f in TBM
    )
    return f"""placed AS (SELECT *, idx - window_idx * 8 AS pos FROM (SELECT s.*, unnest(range(greatest(0, (idx - 40) // 8), least(idx // 8, (n - 48) // 8) + 1)) AS window_idx, false AS partial
  FROM smoothed s WHERE n >= 48)
  UNION ALL SELECT s.*, 0 AS window_idx, true AS partial, 48 - n + idx AS pos FROM smoothed s WHERE n < 48),
short AS (SELECT DISTINCT {keys}, n FROM smoothed WHERE n < 48),
cells AS ({cells} UNION ALL {blanks})"""


def window_cells(wins, keys):
    size = ModelConfig().window_points
    cell = F.posexplode(F.arrays_zip("vals", "mask")).alias("i", "c")
    long = wins.select(*keys, "window_idx", "partial", cell)
    names = F.array(*[F.lit(f) for f in TBM])
    return long.select(
        *keys,
        "window_idx",
        "partial",
        F.get(names, F.floor(F.col("i") / size).cast("int")).alias("feature"),
        (F.col("i") % size).cast("bigint").alias("pos"),
        F.col("c.vals").alias("value"),
        F.col("c.mask").alias("ok"),
    )


@register(
    "w4_sliding_windows",
    POINTS
    + f", {_fill_sql('fx_points', 'shield_id, ring')}, {_smooth_sql('shield_id, ring')}, {_windows_sql('shield_id, ring')} SELECT * FROM cells",
)
def w4_sliding_windows(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select(*RING, "time", "point_id", *TBM)
    return window_cells(windows.sliding_windows(pts, RING, TBM), RING)


_FKEYS = "stratum, data_source, ring"
_FUSED_CELLS = (
    FUSED
    + f", {_fill_sql('fx_fused', _FKEYS)}, {_smooth_sql(_FKEYS)}, {_windows_sql(_FKEYS)}"
)

_SPLIT_SQL = """ringlist AS (SELECT stratum, data_source, ring, count(*) AS ring_points FROM fx_fused GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum, data_source ORDER BY ring) - 1 AS ring_idx, count(*) OVER (PARTITION BY stratum, data_source) AS ring_count FROM ringlist),
ends AS (SELECT *, greatest(1, CAST(floor(ring_count * 0.6e0) AS BIGINT)) AS te FROM ranked),
ends2 AS (SELECT *, greatest(te, CAST(floor(ring_count * 0.8e0) AS BIGINT)) AS v0 FROM ends),
ends3 AS (SELECT *, CASE WHEN ring_count >= 3 AND v0 = te THEN least(ring_count - 1, te + 1) ELSE v0 END AS ve FROM ends2),
split_rings AS (SELECT stratum, data_source, ring, ring_points, ring_idx, ring_count, CASE WHEN ring_idx < te THEN 'train' WHEN ring_idx < ve THEN 'val' ELSE 'test' END AS split FROM ends3)"""


@register(
    "w10_split_rings",
    FUSED + f", {_SPLIT_SQL} SELECT stratum, data_source, ring, ring_points, ring_idx, ring_count, split FROM split_rings",
)
def w10_split_rings(spark, sf_dir):
    return sequences.split_rings(training.ring_list(view(spark, sf_dir, "fx_fused")), training.SOURCE_KEYS)


_SCALER_SQL = f"""train_cells AS (SELECT c.stratum, c.feature, c.pos, c.value FROM cells c JOIN split_rings s ON c.stratum = s.stratum AND c.data_source = s.data_source AND c.ring = s.ring
  WHERE s.split = 'train' AND NOT c.partial AND c.ok
  UNION ALL SELECT g.stratum, g.feature, p.range AS pos, g.value FROM
    (SELECT *, unnest(range(w)) AS again FROM (SELECT DISTINCT f.stratum, f.ring, {', '.join('f.' + x for x in catalog.GEO_FEATURES)}, CAST(floor((s.ring_points - 48) / 8) AS BIGINT) + 1 AS w
      FROM fx_fused f JOIN split_rings s ON f.stratum = s.stratum AND f.ring = s.ring WHERE s.split = 'train' AND s.ring_points >= 48)
     UNPIVOT (value FOR feature IN ({', '.join(catalog.GEO_FEATURES)}))) g, range(48) p),
med AS (SELECT stratum, feature, pos, quantile_cont(value, 0.5) AS median FROM train_cells GROUP BY ALL),
mads AS (SELECT t.stratum, t.feature, t.pos, quantile_cont(abs(t.value - m.median), 0.5) AS raw FROM train_cells t JOIN med m USING (stratum, feature, pos) GROUP BY ALL),
scalers AS (SELECT stratum, feature, pos, median, CASE WHEN raw > 0 THEN raw * 1.4826e0 ELSE 1.0e0 END AS mad FROM med JOIN mads USING (stratum, feature, pos))"""


@register(
    "a13_robust_scalers",
    _FUSED_CELLS + f", {_SPLIT_SQL}, {_SCALER_SQL} SELECT stratum, feature, pos, {round_sql('median', 9)} AS median, {round_sql('mad', 9)} AS mad FROM scalers",
)
def a13_robust_scalers(spark, sf_dir):
    return with_rounded(training.scalers(view(spark, sf_dir, "fx_fused")), {"median": 9, "mad": 9})


@register(
    "w6_normalize_masked",
    _FUSED_CELLS
    + f""", {_SPLIT_SQL}, {_SCALER_SQL}
SELECT c.stratum, c.data_source, c.ring, c.window_idx, c.partial, c.feature, c.pos,
  {round_sql('CASE WHEN c.ok THEN greatest(-3.5e0, least(3.5e0, (c.value - s.median) / s.mad)) ELSE 0.0e0 END', 6)} AS value
FROM cells c JOIN scalers s USING (stratum, feature, pos)""",
)
def w6_normalize_masked(spark, sf_dir):
    # the view, its rings and its smoothed points are made once; scalers and windows read them
    fused = stored(view(spark, sf_dir, "fx_fused"), "fused")
    blocks, rings = training.point_blocks(fused), materialize(training.ring_table(fused))
    normal = training.normalized_windows(training.windows_of(fused, blocks=blocks, rings=rings), training.scalers(fused, blocks=blocks, rings=rings))
    cells = window_cells(normal.withColumn("vals", F.col("z")), training.RING_KEYS)
    return with_rounded(cells.drop("ok"), {"value": 6})


@register(
    "w7_feature_weights",
    _FUSED_CELLS
    + f""", weight(feature, w) AS (VALUES {', '.join(f"('{f}', {catalog.FEATURE_WEIGHTS[f]}e0)" for f in TBM)})
SELECT c.stratum, c.feature, count(*) FILTER (c.ok) AS measured, {round_sql('w.w * count(*) FILTER (c.ok)', 6)} AS weighted
FROM cells c JOIN weight w ON c.feature = w.feature GROUP BY c.stratum, c.feature, w.w""",
)
def w7_feature_weights(spark, sf_dir):
    wins = training.windows_of(view(spark, sf_dir, "fx_fused"))
    size = ModelConfig().window_points
    flat = windows.flat_weights(TBM)

    def per_feature(j: int, f: str):
        part = F.slice("mask", j * size + 1, size)
        return F.struct(
            F.lit(f).alias("feature"), F.lit(flat[j * size]).alias("w"), F.size(F.filter(part, lambda ok: ok)).alias("measured")
        )

    rows = wins.select("stratum", F.explode(F.array(*[per_feature(j, f) for j, f in enumerate(TBM)])).alias("c")).select("stratum", "c.*")
    out = rows.groupBy("stratum", "feature", "w").agg(F.sum("measured").alias("measured"))
    return with_rounded(out.select("stratum", "feature", "measured", (F.col("w") * F.col("measured")).alias("weighted")), {"weighted": 6})


_WEIGHT_SQL = f"weight(feature, w, fi) AS (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, {catalog.FEATURE_WEIGHTS[f]}e0, {i})' for i, f in enumerate(TBM))})"
# sums instead of regr_slope and stddev_pop, whose running means lose the last digits of exact values
_TREND_SQL = f"""{_WEIGHT_SQL}, trend_sums AS (SELECT c.shield_id, c.ring, c.window_idx, c.feature, w.fi, w.w, CAST(count(*) FILTER (c.ok) AS DOUBLE) AS n,
  sum(c.pos) FILTER (c.ok) AS i, sum(c.pos * c.pos) FILTER (c.ok) AS ii, sum(c.value) FILTER (c.ok) AS y, sum(c.pos * c.value) FILTER (c.ok) AS iy,
  sum(c.value * c.value) FILTER (c.ok) AS yy, arg_max(c.value, c.pos) FILTER (c.ok) - arg_min(c.value, c.pos) FILTER (c.ok) AS ends
  FROM cells c JOIN weight w ON c.feature = w.feature GROUP BY c.shield_id, c.ring, c.window_idx, c.feature, w.fi, w.w),
trends AS (SELECT shield_id, ring, window_idx, feature, fi, w,
  CASE WHEN n >= 3 AND n * ii > i * i THEN (n * iy - i * y) / (n * ii - i * i) * w ELSE 0.0e0 END AS slope,
  CASE WHEN n >= 3 THEN ends * w ELSE 0.0e0 END AS delta,
  CASE WHEN n >= 3 THEN sqrt(n * yy - y * y) / n * w ELSE 0.0e0 END AS spread
  FROM trend_sums)"""
_POINT_CELLS = (
    POINTS
    + f", {_fill_sql('fx_points', 'shield_id, ring')}, {_smooth_sql('shield_id, ring')}, {_windows_sql('shield_id, ring')}"
)


@register(
    "w8_trend_features",
    _POINT_CELLS
    + f""", {_TREND_SQL} SELECT shield_id, ring, window_idx, feature, {round_sql('slope', 9)} AS slope, {round_sql('delta', 9)} AS delta, 0.0e0 AS curvature,
  {round_sql('spread', 9)} AS spread FROM trends""",
)
def w8_trend_features(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select(*RING, "time", "point_id", *TBM)
    trended = windows.point_trends(pts, RING, TBM)
    names = F.array(*[F.lit(f) for f in TBM])
    long = trended.select(*RING, "window_idx", F.posexplode("trends").alias("j", "t")).select(
        *RING, "window_idx", F.get(names, "j").alias("feature"), "t.slope", "t.delta", "t.curvature", "t.spread"
    )
    return with_rounded(long, {"slope": 9, "delta": 9, "spread": 9})


@register(
    "w9_trend_interactions",
    _POINT_CELLS
    + f""", {_TREND_SQL} SELECT a.shield_id, a.ring, a.window_idx, a.feature AS left_feature, b.feature AS right_feature,
  {round_sql('a.w * b.w * a.slope * b.slope', 3)} AS slopes, {round_sql('a.w * b.w * a.delta * b.delta', 3)} AS deltas
FROM trends a JOIN trends b ON a.shield_id = b.shield_id AND a.ring = b.ring AND a.window_idx = b.window_idx AND a.fi < b.fi""",
)
def w9_trend_interactions(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select(*RING, "time", "point_id", *TBM)
    trended = windows.point_trends(pts, RING, TBM)
    both = windows.trend_interactions(trended, TBM)
    pairs = [(a, b) for i, a in enumerate(TBM) for b in TBM[i + 1 :]]
    entries = [
        F.struct(
            F.lit(a).alias("left_feature"),
            F.lit(b).alias("right_feature"),
            F.get("interactions", F.lit(2 * i)).alias("slopes"),
            F.get("interactions", F.lit(2 * i + 1)).alias("deltas"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    long = both.select(*RING, "window_idx", F.explode(F.array(*entries)).alias("e")).select(*RING, "window_idx", "e.*")
    return with_rounded(long, {"slopes": 3, "deltas": 3})


def _groups_sql(source: str, keys: str, name: str) -> str:
    on = " AND ".join(f"g.{k.strip()} = u.{k.strip()}" for k in keys.split(","))
    return f"""{name}_u0 AS (SELECT {keys}, ring, CASE WHEN ring_points >= 48 THEN CAST(floor((ring_points - 48) / 8) AS BIGINT) + 1
    WHEN ring <> max(ring) OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END AS windows, ring = max(ring) OVER (PARTITION BY {keys}) AS is_latest FROM {source}),
{name}_u AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ring) - 1 AS i FROM {name}_u0 WHERE windows > 0),
{name}_g AS (SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.i AS group_idx, count(*) AS members, arg_max(u.ring, u.i) AS end_ring,
    CASE WHEN arg_max(u.is_latest, u.i) THEN arg_max(u.windows, u.i) ELSE min(u.windows) END AS sequences
  FROM {name}_u g JOIN {name}_u u ON {on} AND u.i BETWEEN g.i AND g.i + 5 GROUP BY ALL HAVING count(*) = 6),
{name}_s AS (SELECT g.*, row_number() OVER (PARTITION BY {', '.join('g.' + k.strip() for k in keys.split(','))} ORDER BY group_idx, window_idx) - 1 AS seq_no,
    count(*) OVER (PARTITION BY {', '.join('g.' + k.strip() for k in keys.split(','))}) AS seq_count FROM (SELECT *, unnest(range(sequences)) AS window_idx FROM {name}_g) g)"""


@register(
    "w5_multi_ring_sequences",
    FUSED
    + f""", {_SPLIT_SQL}, {_groups_sql('split_rings', 'stratum, data_source', 'a')}
SELECT s.stratum, s.data_source, s.group_idx, s.window_idx, s.end_ring, s.seq_no, s.seq_count, CAST(u.i - s.group_idx AS BIGINT) AS step, u.ring,
  least(s.window_idx, u.windows - 1) AS step_window_idx
FROM a_s s JOIN a_u u ON s.stratum = u.stratum AND s.data_source = u.data_source AND u.i BETWEEN s.group_idx AND s.group_idx + 5""",
)
def w5_multi_ring_sequences(spark, sf_dir):
    keys = training.SOURCE_KEYS
    seqs = sequences.build_sequences(training.ring_list(view(spark, sf_dir, "fx_fused")), keys)
    steps = sequences.sequence_steps(seqs, keys)
    numbers = seqs.select(*keys, "group_idx", "window_idx", "seq_no", "seq_count")
    return steps.join(numbers, [*keys, "group_idx", "window_idx"])


_SPLIT_SEQ_SQL = f"""{_groups_sql('split_rings', 'stratum, data_source, split', 'b')}, {_groups_sql('split_rings', 'stratum, data_source', 'a')},
mode AS (SELECT t.stratum, t.data_source, t.n >= 3 AND (coalesce(v.nv, 0) = 0 OR coalesce(v.nt, 0) = 0) AS fallback
  FROM (SELECT stratum, data_source, count(*) AS n FROM a_s GROUP BY ALL) t LEFT JOIN
  (SELECT stratum, data_source, count(*) FILTER (split = 'val') AS nv, count(*) FILTER (split = 'test') AS nt FROM b_s GROUP BY ALL) v USING (stratum, data_source)),
cut0 AS (SELECT a.*, greatest(1, CAST(floor(seq_count * 0.6e0) AS BIGINT)) AS te FROM a_s a JOIN mode m USING (stratum, data_source) WHERE m.fallback),
cut1 AS (SELECT *, greatest(te + 1, CAST(floor(seq_count * 0.8e0) AS BIGINT)) AS v0 FROM cut0),
cut2 AS (SELECT *, CASE WHEN v0 >= seq_count THEN seq_count - 1 ELSE v0 END AS ve FROM cut1),
split_seq AS (SELECT b.stratum, b.data_source, b.split, b.group_idx, b.window_idx, b.end_ring, 'ring_level' AS split_mode
  FROM b_s b LEFT JOIN mode m USING (stratum, data_source) WHERE NOT coalesce(m.fallback, false)
  UNION ALL SELECT stratum, data_source, CASE WHEN seq_no < te THEN 'train' WHEN seq_no < ve THEN 'val' ELSE 'test' END, group_idx, window_idx, end_ring, 'sequence_level_fallback' FROM cut2)"""


@register("w11_split_sequences", FUSED + f", {_SPLIT_SQL}, {_SPLIT_SEQ_SQL} SELECT * FROM split_seq")
def w11_split_sequences(spark, sf_dir):
    seqs = sequences.split_sequences(training.ring_list(view(spark, sf_dir, "fx_fused")), training.SOURCE_KEYS)
    return seqs.select(*training.SOURCE_KEYS, "split", "group_idx", "window_idx", "end_ring", "split_mode")


@register(
    "w12_limit_sequences",
    FUSED + f""", {_SPLIT_SQL}, {_SPLIT_SEQ_SQL}, drawn AS (
  SELECT *, row_number() OVER (PARTITION BY stratum, split ORDER BY
    md5(concat_ws('|', stratum, split, data_source, group_idx, window_idx, {ModelConfig().seed}))) AS rn FROM split_seq)
SELECT stratum, split, data_source, group_idx, window_idx FROM drawn WHERE rn <= 40""",
)
def w12_limit_sequences(spark, sf_dir):
    """Seeded sample of at most 40 training sequences per stratum."""
    seqs = sequences.split_sequences(training.ring_list(view(spark, sf_dir, "fx_fused")), training.SOURCE_KEYS)
    drawn = sequences.limit_sequences(
        seqs.drop("rings"), ["stratum", "split"], ["data_source", "group_idx", "window_idx"], 40, ModelConfig().seed)
    return drawn.select("stratum", "split", "data_source", "group_idx", "window_idx")


@register(
    "w15_mud_cake_eligibility",
    oracle_ctes("fx_points", "fx_geo")
    + f""", {_CANDIDATES}, {_LAST_K}, hit AS (SELECT c.shield_id, g.*, row_number() OVER (PARTITION BY c.shield_id, g.ring ORDER BY c.rank) AS rn
  FROM cand c JOIN fx_geo g ON c.source_file = g.source_file),
cur AS (SELECT shield_id, ring, count(*) AS points, {' AND '.join(f'count({f}) > 0' for f in TBM)} AS features_ok FROM fx_points GROUP BY shield_id, ring),
k AS (SELECT shield_id, center_ring, count(*) AS rings FROM last_k GROUP BY ALL)
SELECT k.shield_id, k.center_ring AS ring, k.rings, c.points, k.rings >= 6 AND c.points >= 48 AND c.features_ok AS eligible,
  CAST(coalesce(h.cluster_label, 0) AS VARCHAR) AS stratum
FROM k JOIN cur c ON k.shield_id = c.shield_id AND k.center_ring = c.ring LEFT JOIN hit h ON c.shield_id = h.shield_id AND c.ring = h.ring AND h.rn = 1""",
)
def w15_mud_cake_eligibility(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points")
    geo = tables.geo_by_ring(view(spark, sf_dir, "fx_geo").withColumn("file_order", F.col("ring")), "file_order")
    return training.eligibility(pts, source_candidates(pts), geo)


@register(
    "p24_format_model_points",
    oracle_ctes("fx_points", "fx_geo")
    + f""" SELECT p.point_id, p.shield_id, p.ring, p.time AS timestamp, 1 AS state, coalesce(CAST(g.cluster_label AS DOUBLE), 0.0e0) AS cluster_label,
  {', '.join('p.' + f for f in TBM)}, {', '.join(f'coalesce(g.{f}, 0.0e0) AS {f}' for f in catalog.GEO_FEATURES)}
FROM fx_points p LEFT JOIN fx_geo g ON p.ring = g.ring""",
)
def p24_format_model_points(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select("point_id", "shield_id", "ring", "time", *TBM)
    geo = view(spark, sf_dir, "fx_geo").drop("source_file")
    return cleaning.format_model_points(pts.join(geo, "ring", "left"))


# ---------------------------------------------------------------- calibration on stored scores

SCORES = oracle_ctes("fx_scores")
_BOUNDS_SQL = """bounds AS (SELECT stratum, quantile_cont(ae_error, 0.5) AS ae_low, quantile_cont(ae_error, 0.999) AS ae_high,
  quantile_cont(if_anomaly, 0.5) AS if_low, quantile_cont(if_anomaly, 0.999) AS if_high FROM fx_scores GROUP BY stratum)"""
_COMBINED_SQL = f"""{_BOUNDS_SQL}, combined AS (SELECT s.*, greatest(0.0e0, least(1.0e0, (ae_error - ae_low) / (ae_high - ae_low))) AS ae_scaled,
  greatest(0.0e0, least(1.0e0, (if_anomaly - if_low) / (if_high - if_low))) AS if_scaled FROM fx_scores s JOIN bounds b ON s.stratum = b.stratum),
risk AS (SELECT *, 0.35e0 * ae_scaled + 0.65e0 * if_scaled AS risk_score FROM combined)"""
_LIMITS = (0.4, 0.6, 0.8)
_LEVEL_SQL = "CASE WHEN risk_score >= 0.8e0 THEN 'high' WHEN risk_score >= 0.6e0 THEN 'medium' WHEN risk_score >= 0.4e0 THEN 'low' ELSE 'no_risk' END"


def _scores(spark, sf_dir):
    return view(spark, sf_dir, "fx_scores")


def _combined(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return calibration.combined_scores(scores, calibration.score_bounds(scores, ["stratum"]), ["stratum"])


def _with_limits(df):
    low, medium, high = _LIMITS
    return df.withColumns({"low": F.lit(low), "medium": F.lit(medium), "high": F.lit(high)})


@register(
    "a12_score_bounds",
    SCORES + f", {_BOUNDS_SQL} SELECT stratum, " + ", ".join(f"{round_sql(c, 9)} AS {c}" for c in ("ae_low", "ae_high", "if_low", "if_high")) + " FROM bounds",
)
def a12_score_bounds(spark, sf_dir):
    bounds = calibration.score_bounds(_scores(spark, sf_dir), ["stratum"])
    return with_rounded(bounds, {c: 9 for c in ("ae_low", "ae_high", "if_low", "if_high")})


@register(
    "r7_scale_by_bounds",
    SCORES + f", {_COMBINED_SQL} SELECT seq_id, {round_sql('ae_scaled', 9)} AS ae_scaled, {round_sql('if_scaled', 9)} AS if_scaled FROM combined",
)
def r7_scale_by_bounds(spark, sf_dir):
    from ringwatch.functions.scoring import scale_by_bounds

    scores = _scores(spark, sf_dir)
    joined = scores.join(calibration.score_bounds(scores, ["stratum"]), "stratum")
    scaled = joined.select(
        "seq_id",
        scale_by_bounds(F.col("ae_error"), F.col("ae_low"), F.col("ae_high")).alias("ae_scaled"),
        scale_by_bounds(F.col("if_anomaly"), F.col("if_low"), F.col("if_high")).alias("if_scaled"),
    )
    return with_rounded(scaled, {"ae_scaled": 9, "if_scaled": 9})


@register("r8_combined_risk", SCORES + f", {_COMBINED_SQL} SELECT seq_id, stratum, split, {round_sql('risk_score', 9)} AS risk_score FROM risk")
def r8_combined_risk(spark, sf_dir):
    return with_rounded(_combined(spark, sf_dir).select("seq_id", "stratum", "split", "risk_score"), {"risk_score": 9})


@register("r9_level_from_thresholds", SCORES + f", {_COMBINED_SQL} SELECT seq_id, {_LEVEL_SQL} AS level FROM risk")
def r9_level_from_thresholds(spark, sf_dir):
    level = profiles.level_name(F.col("risk_score"), *[F.lit(v) for v in _LIMITS])
    return _combined(spark, sf_dir).select("seq_id", level.alias("level"))


_RINGED = "CAST(floor(seq_id / 48) AS BIGINT)"


@register(
    "a11_window_score_aggregate",
    SCORES
    + f""", {_COMBINED_SQL}, w AS (SELECT {_RINGED} AS ring, risk_score AS s FROM risk)
SELECT ring, {round_sql('max(s)', 9)} AS max, {round_sql('avg(s)', 9)} AS mean, {round_sql('quantile_cont(s, 0.5)', 9)} AS median,
  {round_sql('quantile_cont(s, 0.75)', 9)} AS pquantile, {round_sql('list_avg(list_slice(list_reverse_sort(list(s)), 1, 3))', 9)} AS topk_mean FROM w GROUP BY ring""",
)
def a11_window_score_aggregate(spark, sf_dir):
    scored = _combined(spark, sf_dir).select(F.floor(F.col("seq_id") / 48).alias("ring"), "risk_score")
    out = profiles.window_score_aggregates(scored, ["ring"])
    return with_rounded(out.drop("n"), {c: 9 for c in ("max", "mean", "median", "pquantile", "topk_mean")})


@register(
    "a14_silverman_bandwidth",
    SCORES
    + f""", {_COMBINED_SQL}, m AS (SELECT stratum, count(*) AS n, stddev_samp(risk_score) AS std, quantile_cont(risk_score, 0.75) - quantile_cont(risk_score, 0.25) AS iqr FROM risk GROUP BY stratum)
SELECT stratum, n, {round_sql('std', 9)} AS std, {round_sql('iqr', 9)} AS iqr,
  {round_sql('0.9e0 * CASE WHEN iqr > 0 THEN least(std, iqr / 1.349e0) ELSE std END * pow(n, -0.2e0)', 9)} AS bandwidth FROM m""",
)
def a14_silverman_bandwidth(spark, sf_dir):
    return with_rounded(calibration.silverman_bandwidth(_combined(spark, sf_dir), ["stratum"]), {c: 9 for c in ("std", "iqr", "bandwidth")})


@register("a15_kde_thresholds")
def a15_kde_thresholds(spark, sf_dir):
    return calibration.kde_thresholds(_combined(spark, sf_dir), ["stratum"])


@register(
    "a15_threshold_levels",
    SCORES
    + f""", {_COMBINED_SQL} SELECT stratum, count(*) AS n, 'ok' AS status, true AS low_hits, true AS medium_hits, true AS high_hits, true AS ordered
FROM risk WHERE isfinite(risk_score) GROUP BY stratum HAVING count(*) >= 20 AND stddev_samp(risk_score) > 1e-12""",
)
def a15_threshold_levels(spark, sf_dir):
    scores = materialize(_combined(spark, sf_dir))
    found = calibration.kde_thresholds(scores, ["stratum"])
    levels = calibration.threshold_levels(scores, found, ["stratum"])
    config = ModelConfig()
    hits = [
        (F.abs(F.col(f"{k}_cdf") - F.lit(p)) <= 1e-9).alias(f"{k}_hits")
        for k, p in (("low", config.cdf_low), ("medium", config.cdf_medium), ("high", config.cdf_high))
    ]
    ordered = ((F.col("low") < F.col("medium")) & (F.col("medium") < F.col("high"))).alias("ordered")
    return found.join(levels, "stratum").select("stratum", "n", "status", *hits, ordered)


@register(
    "a16_risk_level_counts",
    SCORES
    + f""", {_COMBINED_SQL}, c AS (SELECT stratum, split, count(*) AS total, count(*) FILTER (risk_score < 0.4e0) AS no_risk,
  count(*) FILTER (risk_score >= 0.4e0 AND risk_score < 0.6e0) AS low_risk, count(*) FILTER (risk_score >= 0.6e0 AND risk_score < 0.8e0) AS medium_risk,
  count(*) FILTER (risk_score >= 0.8e0) AS high_risk FROM risk GROUP BY stratum, split)
SELECT *, no_risk / total AS no_risk_rate, low_risk / total AS low_rate, medium_risk / total AS medium_rate, high_risk / total AS high_rate,
  (medium_risk + high_risk) / total AS medium_high_rate FROM c""",
)
def a16_risk_level_counts(spark, sf_dir):
    return profiles.risk_level_counts(_with_limits(_combined(spark, sf_dir)), ["stratum", "split"])


@register(
    "a17_score_statistics",
    SCORES
    + f""", {_COMBINED_SQL} SELECT stratum, count(*) AS scores, {round_sql('min(risk_score)', 9)} AS score_min, {round_sql('max(risk_score)', 9)} AS score_max,
  {round_sql('avg(risk_score)', 9)} AS score_mean, {round_sql('stddev_pop(risk_score)', 9)} AS score_std FROM risk GROUP BY stratum""",
)
def a17_score_statistics(spark, sf_dir):
    out = profiles.score_statistics(_combined(spark, sf_dir), ["stratum"])
    return with_rounded(out, {c: 9 for c in ("score_min", "score_max", "score_mean", "score_std")})


@register(
    "a19_risk_histogram",
    SCORES
    + f""", {_BOUNDS_SQL}, e AS (SELECT stratum, split, min(if_anomaly) AS lo, max(if_anomaly) AS hi, count(*) AS n FROM fx_scores GROUP BY ALL),
b AS (SELECT s.stratum, s.split, e.lo, e.hi, e.n, least(59, CAST(floor((s.if_anomaly - e.lo) / (e.hi - e.lo) * 60) AS BIGINT)) AS bin FROM fx_scores s JOIN e ON s.stratum = e.stratum AND s.split = e.split)
SELECT stratum, split, bin, count(*) AS count, {round_sql('lo + bin * (hi - lo) / 60', 9)} AS left_edge, {round_sql('count(*) / n / ((hi - lo) / 60)', 9)} AS density
FROM b GROUP BY stratum, split, bin, lo, hi, n""",
)
def a19_risk_histogram(spark, sf_dir):
    out = profiles.risk_histogram(_scores(spark, sf_dir), ["stratum", "split"], 60, "if_anomaly")
    return with_rounded(out, {"left_edge": 9, "density": 9})


@register(
    "m10_score_density",
    SCORES
    + f""", e AS (SELECT stratum, split, min(ae_error) AS xl, max(ae_error) AS xh, min(if_anomaly) AS yl, max(if_anomaly) AS yh FROM fx_scores GROUP BY ALL),
b AS (SELECT s.stratum, s.split, xl, xh, yl, yh, least(19, CAST(floor((s.ae_error - xl) / (xh - xl) * 20) AS BIGINT)) AS x_bin,
  least(19, CAST(floor((s.if_anomaly - yl) / (yh - yl) * 20) AS BIGINT)) AS y_bin FROM fx_scores s JOIN e ON s.stratum = e.stratum AND s.split = e.split)
SELECT stratum, split, x_bin, y_bin, count(*) AS count, {round_sql('xl + x_bin * (xh - xl) / 20', 9)} AS x_left, {round_sql('yl + y_bin * (yh - yl) / 20', 9)} AS y_left
FROM b GROUP BY stratum, split, x_bin, y_bin, xl, xh, yl, yh""",
)
def m10_score_density(spark, sf_dir):
    out = profiles.score_density(_scores(spark, sf_dir), ["stratum", "split"], bins=20)
    return with_rounded(out, {"x_left": 9, "y_left": 9})


@register(
    "a18_calibration_audit",
    SCORES
    + f""", {_COMBINED_SQL}, s AS (SELECT DISTINCT stratum FROM risk), f AS (SELECT min(stratum) AS first FROM s)
SELECT 'same' AS case, stratum, true AS count_ok, true AS digest_ok, true AS thresholds_ok FROM s
UNION ALL SELECT 'changed', stratum, true, stratum <> first, stratum <> first FROM s, f""",
)
def a18_calibration_audit(spark, sf_dir):
    """Audits written documents against the scores they came from, and against scores of which one differs."""
    scored = materialize(_combined(spark, sf_dir).select("stratum", "seq_id", "risk_score"))
    path = new_folder(spark, "calibration")
    thresholds = calibration.kde_thresholds(scored, ["stratum"])
    documents = thresholds.join(calibration.score_digest(scored, ["stratum"], ["seq_id"]), "stratum")
    sinks.write_documents(documents, path)
    stored = spark.read.schema(documents.schema).json(path)
    first = scored.agg(F.min(F.struct("stratum", "seq_id")).alias("k")).first()["k"]
    here = (F.col("stratum") == first["stratum"]) & (F.col("seq_id") == first["seq_id"])
    changed = scored.withColumn("risk_score", F.when(here, F.col("risk_score") / 2 + 0.1).otherwise(F.col("risk_score")))
    audits = [
        calibration.audit_calibration(rows, stored, ["stratum"], ["seq_id"]).select(F.lit(case).alias("case"), "*")
        for case, rows in (("same", scored), ("changed", changed))
    ]
    return audits[0].unionByName(audits[1])


@register(
    "w16_mud_cake_final",
    SCORES
    + f""", {_COMBINED_SQL}, w AS (SELECT stratum, {_RINGED} AS ring, seq_id % 48 AS window_idx, end_time, risk_score FROM risk)
SELECT stratum, ring, {round_sql('quantile_cont(risk_score, 0.5)', 9)} AS final_risk,
  {_LEVEL_SQL.replace('risk_score', 'quantile_cont(risk_score, 0.5)')} AS model_level,
  arg_min(end_time, window_idx) FILTER (risk_score >= 0.4e0) AS earliest_time FROM w GROUP BY stratum, ring""",
)
def w16_mud_cake_final(spark, sf_dir):
    scored = _combined(spark, sf_dir).select(
        "stratum", F.floor(F.col("seq_id") / 48).alias("ring"), (F.col("seq_id") % 48).alias("window_idx"), "end_time", "risk_score"
    )
    limits = _with_limits(scored.select("stratum").distinct())
    keyed = scored.withColumn("source", F.col("stratum"))
    out = calibration.ring_result(keyed, ["source", "ring"], limits)
    return with_rounded(out.drop("source"), {"final_risk": 9})
