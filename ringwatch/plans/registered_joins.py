"""Registered queries: joins, dictionaries, records, history, profiles and small set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.functions import scoring, text
from ringwatch.functions.rounding import with_rounded
from ringwatch.operators import cleaning, joins, networks, profiles, records, sequences
from ringwatch.operators.ordered import add_index, time_slice
from ringwatch.plans import reports
from ringwatch.plans.registered_points import RUNS_SQL, SCORED_SQL, _values, round_sql
from ringwatch.scratch import new_folder, stored
from ringwatch.sources import point_store, tables
from ringwatch.sources.adapters import oracle_ctes, table, view

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


GEO_COLS = ", ".join(catalog.GEO_FEATURES)

# ---------------------------------------------------------------- geology

_HALVED = f"""halved AS (SELECT source_file, CAST(floor(ring / 2) AS BIGINT) AS ring, ring AS file_order, cluster_label, {GEO_COLS} FROM fx_geo),
geo_last AS (SELECT * EXCLUDE (file_order, rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_file, ring ORDER BY file_order DESC) AS rn FROM halved) WHERE rn = 1)"""


@register("s7_geo_by_ring", oracle_ctes("fx_geo") + f", {_HALVED} SELECT * FROM geo_last")
def s7_geo_by_ring(spark, sf_dir):
    geo = view(spark, sf_dir, "fx_geo")
    halved = geo.withColumns({"file_order": F.col("ring"), "ring": F.floor(F.col("ring") / 2)})
    return tables.geo_by_ring(halved, "file_order")


_FILES = f"""tbm AS (SELECT concat('area_', CAST(floor(ring / 8) AS BIGINT) % 2) AS folder, shield_id AS tbm_file, * EXCLUDE (shield_id) FROM fx_points),
geo AS (SELECT concat('area_', CAST(floor(ring / 8) AS BIGINT) % 2) AS folder, source_file AS geo_file, ring, cluster_label, {GEO_COLS} FROM fx_geo)"""


def _area():
    return F.concat(F.lit("area_"), (F.floor(F.col("ring") / 8) % 2).cast("string"))


def training_files(spark, sf_dir):
    tbm = view(spark, sf_dir, "fx_points").withColumns({"folder": _area(), "tbm_file": F.col("shield_id")})
    geo = view(spark, sf_dir, "fx_geo").withColumns({"folder": _area(), "geo_file": F.col("source_file")})
    return tbm, geo


@register(
    "j1_fuse",
    oracle_ctes("fx_points", "fx_geo")
    + f""", {_FILES}
SELECT t.folder || ':' || t.tbm_file || '+' || g.geo_file AS data_source, t.point_id, t.ring, t.thrust_spd, g.cluster_label, g.water_content
FROM tbm t JOIN geo g ON t.folder = g.folder AND t.ring = g.ring""",
)
def j1_fuse(spark, sf_dir):
    tbm, geo = training_files(spark, sf_dir)
    geo = geo.select("folder", "geo_file", "ring", "cluster_label", "water_content")
    fused = joins.fuse(tbm.select("folder", "tbm_file", "ring", "point_id", "thrust_spd"), geo)
    return fused.select("data_source", "point_id", "ring", "thrust_spd", "cluster_label", "water_content")


@register(
    "j2_common_rings",
    oracle_ctes("fx_points", "fx_geo") + f", {_FILES} SELECT folder, ring FROM tbm INTERSECT SELECT folder, ring FROM geo",
)
def j2_common_rings(spark, sf_dir):
    tbm, geo = training_files(spark, sf_dir)
    return joins.common_rings(tbm, geo, ("folder", "ring"))


_CANDIDATES = """cand AS (SELECT shield_id, shield_id AS source_file, 1 AS rank FROM (SELECT DISTINCT shield_id FROM fx_points)
UNION ALL SELECT shield_id, concat('file_', shield_id), 2 FROM (SELECT DISTINCT shield_id FROM fx_points)
UNION ALL SELECT shield_id, concat('P_', shield_id), 3 FROM (SELECT DISTINCT shield_id FROM fx_points))"""


def source_candidates(points):
    shields = points.select("shield_id").distinct()
    options = F.array(
        F.struct(F.col("shield_id").alias("source_file"), F.lit(1).alias("rank")),
        F.struct(F.concat(F.lit("file_"), "shield_id").alias("source_file"), F.lit(2).alias("rank")),
        F.struct(F.concat(F.lit("P_"), "shield_id").alias("source_file"), F.lit(3).alias("rank")),
    )
    return shields.select("shield_id", F.explode(options).alias("o")).select("shield_id", "o.*")


@register(
    "j3_enrich_geo",
    oracle_ctes("fx_points", "fx_geo")
    + f""", {_CANDIDATES}, hit AS (SELECT c.shield_id, g.*, row_number() OVER (PARTITION BY c.shield_id, g.ring ORDER BY c.rank) AS rn
FROM cand c JOIN fx_geo g ON c.source_file = g.source_file)
SELECT p.point_id, p.shield_id, p.ring,
  CASE WHEN h.cluster_label IS NOT NULL THEN CAST(h.cluster_label AS DOUBLE) ELSE 0.0e0 END AS cluster_label,
  {', '.join(f'CASE WHEN h.cluster_label IS NOT NULL THEN h.{f} ELSE 0.0e0 END AS {f}' for f in catalog.GEO_FEATURES)}
FROM fx_points p LEFT JOIN hit h ON p.shield_id = h.shield_id AND p.ring = h.ring AND h.rn = 1""",
)
def j3_enrich_geo(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select("point_id", "shield_id", "ring")
    geo = tables.geo_by_ring(view(spark, sf_dir, "fx_geo").withColumn("file_order", F.col("ring")), "file_order")
    return joins.enrich_geo(pts, source_candidates(pts), geo)


_TEXTS = f"texts(risk_type, safety_level, fault_measures, fault_reason, fault_reason_analysis) AS (VALUES {_values(catalog.level_text_rows())})"
_CAUSES = f"causes(risk_type, risk_label, full_label, warning_label, fault_cause) AS (VALUES {_values(catalog.risk_catalog_rows())})"


@register(
    "j4_attach_texts",
    oracle_ctes("fx_records")
    + f""", {_TEXTS}, {_CAUSES}
SELECT r.id, r.risk_type, r.risk_level AS safety_level, coalesce(t.fault_measures, '-') AS fault_measures, coalesce(t.fault_reason, '') AS fault_reason,
  coalesce(t.fault_reason_analysis, '{catalog.UNKNOWN_LEVEL_ANALYSIS}') AS fault_reason_analysis, c.fault_cause
FROM fx_records r LEFT JOIN texts t ON r.risk_type = t.risk_type AND r.risk_level = t.safety_level
LEFT JOIN causes c ON r.risk_type = c.risk_type""",
)
def j4_attach_texts(spark, sf_dir):
    rec = view(spark, sf_dir, "fx_records").select("id", "risk_type", F.col("risk_level").alias("safety_level"))
    return joins.attach_texts(rec)


@register(
    "j5_history_mapping",
    oracle_ctes("fx_point_info")
    + """ SELECT point_cn_name, trim(arg_max_null(point_code, row_id)) AS code, coalesce(arg_max_null(point_unit, row_id), '') AS unit
FROM fx_point_info GROUP BY point_cn_name""",
)
def j5_history_mapping(spark, sf_dir):
    info = view(spark, sf_dir, "fx_point_info")
    return joins.history_mapping(info.select("point_cn_name"), info)


_LAST_K = """rings AS (SELECT shield_id, ring, count(*) AS points, row_number() OVER (PARTITION BY shield_id ORDER BY ring) AS i FROM fx_points GROUP BY shield_id, ring),
last_k AS (SELECT c.shield_id, c.ring AS center_ring, r.ring, r.points FROM rings c JOIN rings r ON c.shield_id = r.shield_id AND r.i BETWEEN c.i - 5 AND c.i)"""


@register("j6_last_k_rings", oracle_ctes("fx_points") + f", {_LAST_K} SELECT * FROM last_k")
def j6_last_k_rings(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select("shield_id", "ring")
    near = joins.last_k_rings(joins.rings_with_index(pts))
    return near.join(profiles.ring_sizes(pts, ["shield_id"]), ["shield_id", "ring"])


# ---------------------------------------------------------------- records


@register(
    "s8_risk_records",
    oracle_ctes("fx_records")
    + " SELECT id, risk_type, ring, project_code, risk_level, risk_score FROM fx_records WHERE risk_type = 'clog' AND project_code = 'P_O'",
)
def s8_risk_records(spark, sf_dir):
    return records.risk_records(view(spark, sf_dir, "fx_records"), "clog", " P_O ")


@register(
    "a3_latest_record",
    oracle_ctes("fx_records")
    + """ SELECT risk_type, project_code, max(id) AS id, arg_max(ring, id) AS ring, arg_max(risk_level, id) AS risk_level, arg_max(risk_score, id) AS risk_score
FROM fx_records GROUP BY risk_type, project_code""",
)
def a3_latest_record(spark, sf_dir):
    rows = records.risk_records(view(spark, sf_dir, "fx_records"))
    return records.latest_record(rows, ["risk_type", "project_code"])


_SUMMARY_SQL = """ SELECT risk_type, arg_max(risk_level, id) AS risk_level, CAST(arg_max(ring, id) AS VARCHAR) AS ring FROM fx_records GROUP BY risk_type"""


@register("a4_latest_summary", oracle_ctes("fx_records") + _SUMMARY_SQL)
def a4_latest_summary(spark, sf_dir):
    return records.latest_summary(view(spark, sf_dir, "fx_records"))


_HISTORY = """newest AS (SELECT *, row_number() OVER (PARTITION BY risk_type, project_code ORDER BY id DESC) AS rn FROM fx_records),
warned AS (SELECT * EXCLUDE rn, CASE risk_level WHEN '高风险Ⅳ' THEN 4 WHEN '中风险Ⅲ' THEN 3 WHEN '低风险Ⅱ' THEN 2 ELSE 1 END AS pri FROM newest WHERE rn <= 1000),
history AS (SELECT risk_type, project_code, id, ring, risk_level, warning_time,
  count(*) FILTER (pri = 4) OVER w AS high_risk_count, count(*) FILTER (pri = 3) OVER w AS mid_risk_count, count(*) FILTER (pri = 2) OVER w AS low_risk_count,
  row_number() OVER (PARTITION BY risk_type, project_code ORDER BY ring DESC, id DESC) AS position
  FROM warned WHERE pri >= 2 WINDOW w AS (PARTITION BY risk_type, project_code))"""


@register("a5_risk_history", oracle_ctes("fx_records") + f", {_HISTORY} SELECT * FROM history")
def a5_risk_history(spark, sf_dir):
    out = records.risk_history(view(spark, sf_dir, "fx_records"))
    return out.select(
        "risk_type", "project_code", "id", "ring", "risk_level", "warning_time",
        "high_risk_count", "mid_risk_count", "low_risk_count", "position",
    )


@register(
    "q2_latest_risk",
    oracle_ctes("fx_records")
    + f""", {_CAUSES}, l AS (SELECT risk_type, project_code, arg_max(ring, id) AS ring, arg_max(risk_level, id) AS safety_level, arg_max(risk_score, id) AS s FROM fx_records GROUP BY ALL)
SELECT c.risk_label, l.project_code, CAST(l.ring AS VARCHAR) AS ring, l.safety_level, {round_sql('l.s', 2)} AS risk_score,
  '-' AS fault_measures, '-' AS impact_parameters, '-' AS potential_risk FROM l JOIN causes c ON l.risk_type = c.risk_type""",
)
def q2_latest_risk(spark, sf_dir):
    return reports.latest_risk(view(spark, sf_dir, "fx_records"))


@register("q3_latest_risk_summary", oracle_ctes("fx_records") + f", {_CAUSES} SELECT c.risk_label, s.risk_level, s.ring FROM ({_SUMMARY_SQL}) s JOIN causes c ON s.risk_type = c.risk_type")
def q3_latest_risk_summary(spark, sf_dir):
    return reports.latest_risk_summary(view(spark, sf_dir, "fx_records"))


@register(
    "q4_risk_history",
    oracle_ctes("fx_records")
    + f""", {_HISTORY}, {_CAUSES} SELECT c.risk_label, h.project_code, CAST(h.ring AS VARCHAR) AS ring, h.risk_level, h.warning_time,
  h.high_risk_count, h.mid_risk_count, h.low_risk_count, h.position FROM history h JOIN causes c ON h.risk_type = c.risk_type""",
)
def q4_risk_history(spark, sf_dir):
    return reports.risk_history(view(spark, sf_dir, "fx_records"))


# ---------------------------------------------------------------- dictionaries and history


@register("s9_point_tables", oracle_ctes("fx_point_info") + " SELECT DISTINCT shield_id FROM fx_point_info")
def s9_point_tables(spark, sf_dir):
    return tables.point_tables(view(spark, sf_dir, "fx_point_info"))


@register(
    "s10_resolve_point_table",
    oracle_ctes("fx_point_info") + " SELECT * FROM fx_point_info WHERE shield_id = 's3'",
)
def s10_resolve_point_table(spark, sf_dir):
    return tables.resolve_point_table(view(spark, sf_dir, "fx_point_info"), "s3")


_SCAN_FILTER = "ts >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 8 HOUR AND ts < TIMESTAMP '2024-01-26 00:00:00' - INTERVAL 8 HOUR"


@register("s11_history_scan", f"SELECT event_id, ts AS time, value FROM events WHERE {_SCAN_FILTER}")
def s11_history_scan(spark, sf_dir):
    history = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time"), "value")
    return tables.history_scan(history, "2024-01-05", "2024-01-25")


@register("s11_history_by_day", f"SELECT event_id, ts AS time, value FROM events WHERE {_SCAN_FILTER}")
def s11_history_by_day(spark, sf_dir):
    """The same request from a history written by day."""
    path = new_folder(spark, "history")
    point_store.write_history(table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time"), "value"), path)
    return tables.history_scan(point_store.read_history(spark, path), "2024-01-05", "2024-01-25").drop("day")


@register(
    "q5_available_parameters",
    oracle_ctes("fx_point_info")
    + """ SELECT shield_id, point_cn_name AS name, point_code AS code, point_unit AS unit FROM fx_point_info
WHERE point_unit <> '' AND point_code <> '' AND point_cn_name <> ''""",
)
def q5_available_parameters(spark, sf_dir):
    return reports.available_parameters(view(spark, sf_dir, "fx_point_info"))


_CODES = [f"code_{i}" for i in range(1, 9)]
_PARAMS = ["point_1", "point_2", "point_3", "no such point"]


@register(
    "q6_parameter_history",
    oracle_ctes("fx_point_info")
    + f""", m AS (SELECT point_cn_name, trim(arg_max_null(point_code, row_id)) AS code, coalesce(arg_max_null(point_unit, row_id), '') AS unit
  FROM fx_point_info WHERE point_cn_name IN ('point_1', 'point_2', 'point_3') GROUP BY point_cn_name),
h AS (SELECT event_id, ts, {', '.join(f'CASE WHEN event_id % {i + 3} = 0 THEN NULL ELSE event_id / {2 ** i}.0e0 END AS {c}' for i, c in enumerate(_CODES))} FROM events WHERE {_SCAN_FILTER}),
u AS (SELECT * FROM h UNPIVOT INCLUDE NULLS (v FOR code IN ({', '.join(_CODES)})))
SELECT u.event_id, strftime(u.ts + INTERVAL 8 HOUR, '%Y/%m/%d %H:%M:%S') AS time, m.point_cn_name AS name, coalesce(u.v, 0.0e0) AS value, m.unit
FROM u JOIN m ON u.code = m.code""",
)
def q6_parameter_history(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    cols = [F.when(e % (i + 3) != 0, e / float(2**i)).alias(c) for i, c in enumerate(_CODES)]
    history = events.select("event_id", F.col("ts").alias("time"), *cols)
    info = view(spark, sf_dir, "fx_point_info")
    return reports.parameter_history(history, info, _PARAMS, "2024-01-05", "2024-01-25", keep=["event_id"])


# ---------------------------------------------------------------- profiles

FUSED = oracle_ctes("fx_fused")


@register(
    "p25_drop_all_null_features",
    FUSED + f" SELECT point_id, ring FROM fx_fused WHERE coalesce({', '.join(catalog.FEATURES)}) IS NOT NULL",
)
def p25_drop_all_null_features(spark, sf_dir):
    return cleaning.drop_all_null_features(view(spark, sf_dir, "fx_fused")).select("point_id", "ring")


@register(
    "a6_feature_coverage",
    FUSED
    + f""", c AS (SELECT stratum, count(*) AS n, {', '.join(f'count({f}) AS {f}' for f in catalog.FEATURES)} FROM fx_fused GROUP BY stratum),
u AS (UNPIVOT c ON {', '.join(catalog.FEATURES)} INTO NAME feature VALUE valid_count)
SELECT stratum, feature, valid_count, valid_count / n AS valid_ratio FROM u""",
)
def a6_feature_coverage(spark, sf_dir):
    return profiles.feature_coverage(view(spark, sf_dir, "fx_fused"), ["stratum"])


STRATUM_SUMMARY = """ SELECT stratum, CAST(sum(points) AS BIGINT) AS rows, count(*) AS rings, min(ring) AS ring_min, max(ring) AS ring_max, min(points) AS points_per_ring_min,
  median(points) AS points_per_ring_median, max(points) AS points_per_ring_max, 16 AS features, 768 AS feature_dim
FROM (SELECT stratum, ring, count(*) AS points FROM fx_fused GROUP BY stratum, ring) GROUP BY stratum"""


@register("a7_stratum_summary", FUSED + STRATUM_SUMMARY)
def a7_stratum_summary(spark, sf_dir):
    return profiles.stratum_summary(view(spark, sf_dir, "fx_fused"))


@register(
    "a8_alignment_summary",
    oracle_ctes("fx_points", "fx_geo")
    + f""", {_FILES}, t AS (SELECT folder, ring, count(*) AS points FROM tbm GROUP BY ALL), g AS (SELECT DISTINCT folder, ring FROM geo),
tb AS (SELECT folder, count(*) AS tbm_rings_before FROM t GROUP BY folder), gb AS (SELECT folder, count(*) AS geo_rings_before FROM g GROUP BY folder),
c AS (SELECT folder, count(*) AS common_rings, min(ring) AS common_ring_min, max(ring) AS common_ring_max, CAST(sum(points) AS BIGINT) AS aligned_tbm_rows,
  min(points) AS points_per_ring_min, median(points) AS points_per_ring_median, max(points) AS points_per_ring_max,
  count(*) FILTER (points >= 48) AS rings_with_ge48_points,
  CAST(sum(CASE WHEN points >= 48 THEN CAST(floor((points - 48) / 8) AS BIGINT) + 1 ELSE 0 END) AS BIGINT) AS estimated_windows
  FROM t JOIN g USING (folder, ring) GROUP BY folder)
SELECT * FROM tb JOIN gb USING (folder) JOIN c USING (folder)""",
)
def a8_alignment_summary(spark, sf_dir):
    tbm, geo = training_files(spark, sf_dir)
    return profiles.alignment_summary(tbm.select("folder", "ring"), geo.select("folder", "ring"))


@register(
    "a9_tbm_profile",
    FUSED
    + f""", l AS (SELECT * FROM (SELECT stratum, {', '.join(catalog.TBM_FEATURES)} FROM fx_fused) UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(catalog.TBM_FEATURES)})))
SELECT stratum, feature, count(*) AS rows, count(v) AS non_null, 1 - count(v) / count(*) AS missing_rate, {round_sql('avg(v)', 6)} AS mean,
  {round_sql('stddev_samp(v)', 6)} AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median FROM l GROUP BY stratum, feature""",
)
def a9_tbm_profile(spark, sf_dir):
    return with_rounded(profiles.tbm_profile(view(spark, sf_dir, "fx_fused")), {"mean": 6, "std": 6})


@register(
    "a10_geo_profile",
    oracle_ctes("fx_geo")
    + f""", l AS (SELECT * FROM (SELECT CAST(cluster_label AS VARCHAR) AS stratum, {GEO_COLS} FROM fx_geo WHERE cluster_label IS NOT NULL) UNPIVOT INCLUDE NULLS (v FOR feature IN ({GEO_COLS})))
SELECT stratum, feature, count(*) AS rings, count(v) AS non_null, count(DISTINCT v) AS unique_non_null, avg(v) AS mean, 1 - count(v) / count(*) AS missing_rate
FROM l GROUP BY stratum, feature""",
)
def a10_geo_profile(spark, sf_dir):
    geo = view(spark, sf_dir, "fx_geo").filter("cluster_label IS NOT NULL")
    return profiles.geo_profile(geo.withColumn("stratum", text.stratum_key(F.col("cluster_label"))))


# ---------------------------------------------------------------- sampling and key parameters

_INDEXED = "indexed AS (SELECT *, row_number() OVER (PARTITION BY shield_id, ring ORDER BY time, point_id) - 1 AS idx, count(*) OVER (PARTITION BY shield_id, ring) AS n FROM fx_points)"


def _sample_sql(k: int) -> str:
    return f"""sampled AS (SELECT * FROM indexed WHERE n <= {k} OR idx IN (SELECT 0) OR EXISTS (
  SELECT 1 FROM range({k}) j WHERE CAST(floor(j.range * (n - 1) / {k - 1}) AS BIGINT) = idx))"""


def indexed_points(pts):
    sliced = pts.withColumn("_s", time_slice(pts))
    return add_index(sliced, ["shield_id", "ring"], "_s", ["time", "point_id"], total="n").drop("_s")


@register(
    "w13_evenly_sample",
    oracle_ctes("fx_points") + f", {_INDEXED}, {_sample_sql(20)} SELECT shield_id, ring, point_id, idx FROM sampled",
)
def w13_evenly_sample(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select("shield_id", "ring", "time", "point_id")
    return sequences.evenly_sampled(indexed_points(pts), 20).select("shield_id", "ring", "point_id", "idx")


_KEYS = catalog.key_parameter_fields()


@register(
    "w14_key_parameters",
    oracle_ctes("fx_points")
    + f""", {_INDEXED}, {_sample_sql(20)}, {_LAST_K}
SELECT k.shield_id, k.center_ring, s.ring, s.point_id, strftime(s.time + INTERVAL 8 HOUR, '%Y/%-m/%-d %-H:%M:%S') AS time_text,
  {', '.join(f'{round_sql("s." + f, 2)} AS {f}' for f in _KEYS)}
FROM last_k k JOIN sampled s ON k.shield_id = s.shield_id AND k.ring = s.ring""",
)
def w14_key_parameters(spark, sf_dir):
    return reports.key_parameters(view(spark, sf_dir, "fx_points"), sample=20)


# ---------------------------------------------------------------- sorts, limits and set operations


@register(
    "t1_order_by_time",
    oracle_ctes("fx_points") + " SELECT shield_id, time, point_id FROM fx_points ORDER BY shield_id, time",
)
def t1_order_by_time(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("shield_id", "time", "point_id").orderBy("shield_id", "time")


@register(
    "t2_order_by_ring_desc",
    oracle_ctes("fx_records")
    + """ SELECT id, ring_text, coalesce(CAST(trunc(TRY_CAST(ring_text AS DOUBLE)) AS BIGINT), -1) AS ring_order
FROM (SELECT id, CASE WHEN id % 9 = 0 THEN '-' ELSE CAST(ring AS VARCHAR) END AS ring_text FROM fx_records)""",
)
def t2_order_by_ring_desc(spark, sf_dir):
    label = F.when(F.col("id") % 9 == 0, "-").otherwise(F.col("ring").cast("string"))
    rows = view(spark, sf_dir, "fx_records").select("id", label.alias("ring_text"))
    keyed = rows.withColumn("ring_order", F.coalesce(text.to_ring(F.col("ring_text")), F.lit(-1)))
    return keyed.orderBy(F.col("ring_order").desc(), F.col("id").desc())


@register("t3_top_by_id", oracle_ctes("fx_records") + " SELECT * FROM fx_records ORDER BY id DESC LIMIT 100")
def t3_top_by_id(spark, sf_dir):
    return view(spark, sf_dir, "fx_records").orderBy(F.col("id").desc()).limit(100)


@register(
    "t4_last_rings",
    oracle_ctes("fx_points")
    + """, d AS (SELECT DISTINCT shield_id, ring FROM fx_points), top AS (SELECT CAST(floor(max(ring) * 3 / 4) AS BIGINT) AS c FROM fx_points),
r AS (SELECT shield_id, ring, row_number() OVER (PARTITION BY shield_id ORDER BY ring DESC) AS rn FROM d, top WHERE ring <= c)
SELECT p.shield_id, p.ring, count(*) AS points FROM fx_points p JOIN r ON p.shield_id = r.shield_id AND p.ring = r.ring AND r.rn <= 6 GROUP BY ALL""",
)
def t4_last_rings(spark, sf_dir):
    pts = view(spark, sf_dir, "fx_points").select("shield_id", "ring")
    center = pts.agg(F.floor(F.max("ring") * 3 / 4).cast("bigint")).first()[0]
    return profiles.ring_sizes(joins.last_k_rings_of(pts, center), ["shield_id"])


@register(
    "t5_union_splits",
    oracle_ctes("fx_scores") + " SELECT seq_id, split, ae_error FROM fx_scores",
)
def t5_union_splits(spark, sf_dir):
    scores = view(spark, sf_dir, "fx_scores")
    parts = [scores.filter(F.col("split") == s).select("seq_id", "split", "ae_error") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "t6_set_operations",
    oracle_ctes("fx_points", "fx_geo")
    + """, a AS (SELECT DISTINCT ring FROM fx_points), b AS (SELECT DISTINCT ring FROM fx_geo)
SELECT ring, 'both' AS side FROM (SELECT ring FROM a INTERSECT SELECT ring FROM b)
UNION ALL SELECT ring, 'points only' FROM (SELECT ring FROM a EXCEPT SELECT ring FROM b)""",
)
def t6_set_operations(spark, sf_dir):
    a = view(spark, sf_dir, "fx_points").select("ring").distinct()
    b = view(spark, sf_dir, "fx_geo").select("ring").distinct()
    both = a.join(b, "ring", "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(a.join(b, "ring", "left_anti").withColumn("side", F.lit("points only")))


# ---------------------------------------------------------------- ring report of the rule risks

_REPORT_COLUMNS = "shield_id, ring, risk_label, safety_level, risk_level, probability, risk_score, potential_risk, fault_cause, fault_reason, fault_measures, impact_parameters, warning_text, warning_parameters"


def _warning_params_sql() -> str:
    parts = []
    for key in catalog.RULE_RISKS:
        cells = []
        for f in catalog.RISKS[key].fields:
            value = round_sql(f"p.{f}", 2)
            cells.append(f"'{catalog.FIELD_LABELS[f]}=' || coalesce(CAST({value} AS VARCHAR) || '{catalog.field_unit(f)}', '-')")
        parts.append(f"WHEN '{key}' THEN " + " || '；' || ".join(cells))
    return "CASE r.risk_type " + " ".join(parts) + " END"


_DISP = f"disp(risk_type, pos, field, label, unit, is_key) AS (VALUES {_values(catalog.display_field_rows())}), impact AS (SELECT risk_type, string_agg(label, '，' ORDER BY pos) AS impact_parameters FROM disp GROUP BY risk_type)"


@register(
    "q1_ring_rule_report",
    oracle_ctes("fx_points_raw").replace("fx_points_raw AS", "fx_raw AS", 1)
    + f""", fx_points_clean AS (SELECT * EXCLUDE dn FROM (SELECT *, row_number() OVER (PARTITION BY shield_id, time ORDER BY point_id) AS dn FROM fx_raw) WHERE dn = 1),
{SCORED_SQL.replace('FROM fx_points', 'FROM fx_points_clean')}, {RUNS_SQL}, {_TEXTS}, {_CAUSES}, {_DISP}
SELECT r.shield_id, r.ring, c.risk_label, r.safety_level,
  CASE r.priority WHEN 4 THEN 'Ⅳ' WHEN 3 THEN 'Ⅲ' WHEN 2 THEN 'Ⅱ' ELSE 'Ⅰ' END AS risk_level, r.probability, r.risk_score, r.potential_risk,
  c.fault_cause, t.fault_reason, t.fault_measures, i.impact_parameters,
  coalesce(strftime(r.warning_time + INTERVAL 8 HOUR, '%Y/%-m/%-d %-H:%M:%S'), '-') AS warning_text,
  CASE WHEN r.warning_time IS NULL THEN '-' ELSE {_warning_params_sql()} END AS warning_parameters
FROM ring_risk r JOIN causes c ON r.risk_type = c.risk_type
JOIN texts t ON r.risk_type = t.risk_type AND r.safety_level = t.safety_level JOIN impact i ON r.risk_type = i.risk_type
LEFT JOIN fx_points_clean p ON r.shield_id = p.shield_id AND r.ring = p.ring AND r.warning_time = p.time""",
)
def q1_ring_rule_report(spark, sf_dir):
    return reports.ring_rule_report(view(spark, sf_dir, "fx_points_raw")).select(*_REPORT_COLUMNS.split(", "))


# ---------------------------------------------------------------- dormant lookups

_EDGES = """edges AS (SELECT o_orderkey AS edge_id, concat('n', o_custkey % 97) AS start_node, concat('n', (o_custkey * 31 + o_orderkey) % 97) AS end_node,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey % 201 - 100) / 128.0e0 END AS correlation FROM orders),
adj AS (SELECT edge_id, 0 AS side, start_node AS parameter, end_node AS name, correlation FROM edges WHERE correlation IS NOT NULL
  UNION ALL SELECT edge_id, 1, end_node, start_node, correlation FROM edges WHERE correlation IS NOT NULL),
sys AS (SELECT concat('n', range) AS parameter, concat('system_', range % 5) AS system FROM range(80))"""


def _edges(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("edge_id"),
        F.concat(F.lit("n"), (cust % 97).cast("string")).alias("start_node"),
        F.concat(F.lit("n"), ((cust * 31 + key) % 97).cast("string")).alias("end_node"),
        F.when(key % 50 != 0, (key % 201 - 100) / 128.0).alias("correlation"),
    )


def _systems(spark):
    ids = spark.range(80)
    return ids.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("parameter"), F.concat(F.lit("system_"), (F.col("id") % 5).cast("string")).alias("system"))


@register("d1_adjacency", f"WITH {_EDGES} SELECT * FROM adj")
def d1_adjacency(spark, sf_dir):
    return networks.adjacency(_edges(spark, sf_dir))


@register(
    "d2_top_neighbours",
    f"""WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY abs(correlation) DESC, edge_id, side) AS place FROM adj)
SELECT r.parameter, r.place, r.name, r.correlation, coalesce(s.system, '未知系统') AS system FROM r LEFT JOIN sys s ON r.name = s.parameter WHERE place <= 5""",
)
def d2_top_neighbours(spark, sf_dir):
    top = networks.top_neighbours(networks.adjacency(_edges(spark, sf_dir)), _systems(spark))
    return top.select("parameter", "place", "name", "correlation", "system")


@register(
    "d3_system_parameters",
    """SELECT DISTINCT concat('system_', o_custkey % 7) AS system, concat('n', x) AS parameter
FROM (SELECT o_custkey, unnest([o_custkey % 97, o_orderkey % 97]) AS x FROM orders)""",
)
def d3_system_parameters(spark, sf_dir):
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 97).cast("string"))
    nodes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("system_"), (F.col("o_custkey") % 7).cast("string")).alias("system"),
        F.array(name("o_custkey"), name("o_orderkey")).alias("parameters"),
    )
    return networks.system_parameters(nodes)


@register(
    "d4_latest_state",
    """SELECT user_id % 50 AS machine, max(ts) AS time, arg_max(event_id % 4, ts) AS state,
  CASE arg_max(event_id % 4, ts) WHEN 0 THEN '停机' WHEN 1 THEN '掘进' WHEN 2 THEN '拼环' ELSE '-' END AS remark FROM events GROUP BY user_id % 50""",
)
def d4_latest_state(spark, sf_dir):
    states = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("machine"), F.col("ts").alias("time"), (F.col("event_id") % 4).alias("state")
    )
    return networks.latest_state(states, ["machine"])


def _inverse_sql(points_) -> str:
    parts = [f"WHEN s >= {points_[0][1]}e0 THEN {points_[0][0]}e0", f"WHEN s <= {points_[-1][1]}e0 THEN {points_[-1][0]}e0"]
    for (p0, s0), (p1, s1) in zip(points_, points_[1:]):
        parts.append(f"WHEN s >= {s1}e0 THEN {p0}e0 + ({s0}e0 - s) / ({s0 - s1}e0) * ({p1 - p0!r}::DOUBLE)")
    return "CASE " + " ".join(parts) + " END"


@register(
    "d5_score_to_probability",
    oracle_ctes("fx_records")
    + f""" SELECT risk_type, project_code, {round_sql("CASE risk_type " + " ".join(f"WHEN '{k}' THEN {_inverse_sql(r.score_points)}" for k, r in catalog.RISKS.items()) + " END", 3)} AS probability
FROM (SELECT risk_type, project_code, arg_max(risk_score, id) AS s FROM fx_records GROUP BY risk_type, project_code)""",
)
def d5_score_to_probability(spark, sf_dir):
    latest = records.latest_record(view(spark, sf_dir, "fx_records"), ["risk_type", "project_code"])
    expr = F.lit(None).cast("double")
    for key, risk in catalog.RISKS.items():
        expr = F.when(F.col("risk_type") == key, scoring.score_to_probability(F.col("risk_score"), risk.score_points)).otherwise(expr)
    return with_rounded(latest.select("risk_type", "project_code", expr.alias("probability")), {"probability": 3})


_CLEAN = oracle_ctes("fx_points_raw").replace("fx_points_raw AS", "fx_raw AS", 1) + """, fx_points_clean AS (
  SELECT * EXCLUDE dn FROM (SELECT *, row_number() OVER (PARTITION BY shield_id, time ORDER BY point_id) AS dn FROM fx_raw) WHERE dn = 1)"""


def _key_totals_sql() -> str:
    cells = {key: " + ".join(f"coalesce({round_sql('s.' + f, 2)}, 0e0)" for f in catalog.RISKS[key].key_fields) for key in catalog.RISKS}
    return " UNION ALL ".join(
        f"SELECT k.shield_id, k.center_ring AS ring, '{key}' AS risk_type, s.time, s.point_id, 0e0 + {total} AS total, {len(catalog.RISKS[key].key_fields)} AS n_values FROM near k"
        " JOIN sampled s ON k.shield_id = s.shield_id AND k.ring = s.ring"
        for key, total in cells.items()
    )


@register(
    "q1_report_key_parameters",
    _CLEAN
    + f""", {_INDEXED.replace('fx_points', 'fx_points_clean')}, {_sample_sql(20)}, {_LAST_K.replace('fx_points', 'fx_points_clean')}, near AS (SELECT * FROM last_k),
t AS ({_key_totals_sql()})
SELECT shield_id, ring, risk_type, concat('P_', shield_id) AS project_code,
  row_number() OVER (PARTITION BY shield_id, ring, risk_type ORDER BY time, point_id) - 1 AS position,
  strftime(time + INTERVAL 8 HOUR, '%Y/%-m/%-d %-H:%M:%S') AS time, CAST(n_values AS BIGINT) AS n_values, total
FROM t""",
)
def q1_report_key_parameters(spark, sf_dir):
    """Entries of the report's ``key_parameters``, each with the sum of its values."""
    pts = stored(cleaning.dedupe_by_time(view(spark, sf_dir, "fx_points_raw")), "report-points")
    shields = pts.select("shield_id").distinct().withColumn("project_code", F.concat(F.lit("P_"), "shield_id"))
    rows = joins.rings_with_index(pts).select("shield_id", "ring", F.explode(F.array(*[F.lit(r) for r in catalog.RISKS])).alias("risk_type"))
    report = reports.with_request_parts(rows, pts, shields, sample=20)
    entries = report.select("shield_id", "ring", "risk_type", "project_code", F.posexplode("key_parameters").alias("position", "e"))
    total = F.aggregate(F.map_values("e.values"), F.lit(0.0), lambda s, x: s + F.coalesce(x["value"], F.lit(0.0)))
    return entries.select(
        "shield_id", "ring", "risk_type", "project_code", F.col("position").cast("bigint").alias("position"),
        F.col("e.time").alias("time"), F.size("e.values").cast("bigint").alias("n_values"), total.alias("total"),
    )
