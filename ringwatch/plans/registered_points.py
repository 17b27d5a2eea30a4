"""Registered queries over sensor points: scans, cleaning, rule scores and ring results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.functions import scoring, text
from ringwatch.functions.rounding import round_exact
from ringwatch.operators import cleaning, rules, triggers
from ringwatch.scratch import new_folder
from ringwatch.sources import point_store, tables
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


POINTS = oracle_ctes("fx_points")
RAW = oracle_ctes("fx_points_raw")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_points")


# ---------------------------------------------------------------- scans

_SHOWN = "shield_id, ring, point_id, time, work_prs, exc_prs"


@register(
    "s5_ring_points",
    RAW
    + f""", l AS (SELECT *, row_number() OVER (PARTITION BY shield_id, ring ORDER BY time, point_id) AS rn FROM fx_points_raw),
d AS (SELECT *, row_number() OVER (PARTITION BY shield_id, time ORDER BY point_id) AS dn FROM l WHERE rn <= 60)
SELECT {_SHOWN} FROM d WHERE dn = 1""",
)
def s5_ring_points(spark, sf_dir):
    raw = view(spark, sf_dir, "fx_points_raw")
    return tables.ring_points(raw, ["work_prs", "exc_prs"], limit=60)


@register(
    "s6_ring_range_points",
    RAW
    + f""", b AS (SELECT CAST(floor(max(ring) / 4) AS BIGINT) AS lo, CAST(floor(max(ring) * 3 / 4) AS BIGINT) AS hi FROM fx_points_raw),
d AS (SELECT p.*, row_number() OVER (PARTITION BY shield_id, time ORDER BY point_id) AS dn
      FROM fx_points_raw p, b WHERE ring >= lo AND ring < hi)
SELECT {_SHOWN} FROM d WHERE dn = 1""",
)
def s6_ring_range_points(spark, sf_dir):
    raw = view(spark, sf_dir, "fx_points_raw")
    bounds = raw.agg(
        F.floor(F.max("ring") / 4).cast("bigint").alias("lo"), F.floor(F.max("ring") * 3 / 4).cast("bigint").alias("hi")
    ).first()
    return tables.ring_range_points(raw, bounds["lo"], bounds["hi"], ["work_prs", "exc_prs"])


@register("s6_stored_ring_range", ORACLES["s6_ring_range_points"])
def s6_stored_ring_range(spark, sf_dir):
    """The same request from points written by shield and ring."""
    path = new_folder(spark, "points")
    raw = view(spark, sf_dir, "fx_points_raw")
    point_store.write_points(raw.select("shield_id", "ring", "point_id", "time", "work_prs", "exc_prs"), path, span=16)
    top = point_store.read_points(spark, path).agg(F.max("ring")).first()[0]
    near = point_store.read_points(spark, path, start=top // 4, end=top * 3 // 4)
    return tables.ring_range_points(near, top // 4, top * 3 // 4, ["work_prs", "exc_prs"])


# ---------------------------------------------------------------- cleaning


@register(
    "p1_normalize_ring",
    POINTS
    + """ SELECT point_id, CAST(trunc(TRY_CAST(r AS DOUBLE)) AS BIGINT) AS ring
FROM (SELECT point_id, CASE WHEN point_id % 41 = 0 THEN 'n/a' ELSE CAST(ring_no AS VARCHAR) END AS r FROM fx_points)
WHERE TRY_CAST(r AS DOUBLE) IS NOT NULL""",
)
def p1_normalize_ring(spark, sf_dir):
    label = F.when(F.col("point_id") % 41 == 0, "n/a").otherwise(F.col("ring_no").cast("string"))
    return cleaning.normalize_ring(points(spark, sf_dir).select("point_id", label.alias("Ring_No")))


@register(
    "p2_normalize_tbm",
    POINTS
    + """ SELECT point_id, ring, thrust_spd, ch_spd, ch_torque, thrust_force, ch_contact_force FROM (
SELECT point_id, ring, CASE WHEN point_id % 3 = 0 THEN NULL ELSE thrust_spd END AS thrust_spd,
  CASE WHEN point_id % 6 < 4 THEN NULL ELSE ch_spd END AS ch_spd,
  CASE WHEN point_id % 3 < 2 THEN NULL ELSE ch_torque END AS ch_torque,
  CASE WHEN point_id % 3 <> 1 THEN NULL ELSE thrust_force END AS thrust_force,
  CASE WHEN point_id % 9 <> 4 THEN NULL ELSE ch_contact_force END AS ch_contact_force FROM fx_points)
WHERE coalesce(thrust_spd, ch_spd, ch_torque, thrust_force, ch_contact_force) IS NOT NULL""",
)
def p2_normalize_tbm(spark, sf_dir):
    e = F.col("point_id")
    gaps = {
        "thrust_spd": e % 3 == 0,
        "ch_spd": e % 6 < 4,
        "ch_torque": e % 3 < 2,
        "thrust_force": e % 3 != 1,
        "ch_contact_force": e % 9 != 4,
    }
    # as a text file would bring it: unreadable cells and a ring under its raw name
    cols = [F.when(gap, "--").otherwise(F.col(f).cast("string")).alias(f) for f, gap in gaps.items()]
    raw = points(spark, sf_dir).select("point_id", F.col("ring_no").cast("string").alias("RING"), *cols)
    return cleaning.normalize_tbm(raw)


@register(
    "p3_normalize_geo",
    oracle_ctes("fx_geo")
    + f""" SELECT CAST(floor(ring / 2) AS BIGINT) AS ring,
  arg_min(CAST(cluster_label AS DOUBLE), ring) FILTER (cluster_label IS NOT NULL) AS cluster_label,
  {', '.join(f'arg_min(coalesce({f}, 0.0e0), ring) AS {f}' for f in catalog.GEO_FEATURES)}
FROM fx_geo GROUP BY CAST(floor(ring / 2) AS BIGINT)""",
)
def p3_normalize_geo(spark, sf_dir):
    geo = view(spark, sf_dir, "fx_geo")
    halved = geo.withColumns({"file_order": F.col("ring"), "Ring_Index": F.floor(F.col("ring") / 2)}).drop("ring")
    return cleaning.normalize_geo(halved, "file_order").select("ring", "cluster_label", *catalog.GEO_FEATURES)


def _valid_sql(fields) -> str:
    return "coalesce(" + " AND ".join(f"({f} IS NOT NULL AND {f} >= 0 AND {f} < 'infinity'::DOUBLE)" for f in fields) + ", false)"


@register(
    "p5_valid_sensors",
    POINTS
    + f""" SELECT shield_id, ring, count(*) AS points,
  count(*) FILTER ({_valid_sql(catalog.RISKS['clog'].fields)}) AS clog_valid,
  count(*) FILTER ({_valid_sql(catalog.RISKS['mdr_seal'].fields)}) AS mdr_seal_valid,
  count(*) FILTER ({_valid_sql(catalog.RISKS['tail_seal'].fields)}) AS tail_seal_valid
FROM fx_points GROUP BY shield_id, ring""",
)
def p5_valid_sensors(spark, sf_dir):
    counts = [F.count_if(scoring.valid_sensors(catalog.RISKS[r].fields)).alias(f"{r}_valid") for r in catalog.RULE_RISKS]
    return points(spark, sf_dir).groupBy("shield_id", "ring").agg(F.count(F.lit(1)).alias("points"), *counts)


@register(
    "p6_dedupe_by_time",
    RAW
    + f""" SELECT {_SHOWN} FROM (
SELECT *, row_number() OVER (PARTITION BY shield_id, time ORDER BY point_id) AS dn FROM fx_points_raw) WHERE dn = 1""",
)
def p6_dedupe_by_time(spark, sf_dir):
    return cleaning.dedupe_by_time(view(spark, sf_dir, "fx_points_raw")).select(*_SHOWN.split(", "))


_RING_NAMES = """SELECT point_id,
  CASE WHEN point_id % 5 = 0 THEN NULL WHEN point_id % 43 = 1 THEN 'lost' ELSE CAST(ring_no AS VARCHAR(30)) END AS "Ring.No",
  CASE WHEN point_id % 10 = 0 THEN NULL ELSE CAST(ring AS VARCHAR(30)) END AS "RING",
  CASE WHEN point_id % 20 = 0 THEN NULL ELSE CAST(ring AS VARCHAR(30)) END AS ring_text
FROM fx_points"""


@register(
    "p7_ring_of_point",
    POINTS
    + f""", n AS ({_RING_NAMES}), c AS (SELECT point_id, coalesce("Ring.No", "RING", ring_text) AS r FROM n)
SELECT point_id, CAST(trunc(TRY_CAST(r AS DOUBLE)) AS BIGINT) AS ring FROM c WHERE TRY_CAST(r AS DOUBLE) IS NOT NULL""",
)
def p7_ring_of_point(spark, sf_dir):
    e, ring = F.col("point_id"), F.col("ring").cast("string")
    raw = points(spark, sf_dir).select(
        "point_id",
        F.when(e % 5 == 0, None).when(e % 43 == 1, "lost").otherwise(F.col("ring_no").cast("string")).alias("Ring.No"),
        F.when(e % 10 != 0, ring).alias("RING"),
        F.when(e % 20 != 0, ring).alias("ring_text"),
    )
    return cleaning.ring_of_point(raw, ["Ring.No", "RING", "ring_text"]).select("point_id", "ring")


@register(
    "p8_stratum_key",
    oracle_ctes("fx_geo")
    + """ SELECT ring, CASE WHEN ring % 5 = 0 THEN CAST(cluster_label AS VARCHAR) || '_5'
  WHEN ring % 7 = 0 THEN 'clay' ELSE CAST(cluster_label AS VARCHAR) END AS stratum FROM fx_geo""",
)
def p8_stratum_key(spark, sf_dir):
    label = F.col("cluster_label").cast("double")
    raw = (
        F.when(F.col("ring") % 5 == 0, (label + 0.5).cast("string"))
        .when(F.col("ring") % 7 == 0, F.lit(" clay "))
        .otherwise(label.cast("string"))
    )
    return view(spark, sf_dir, "fx_geo").select("ring", text.stratum_key(raw).alias("stratum"))


@register(
    "p9_filter_by_stratum",
    oracle_ctes("fx_geo") + " SELECT source_file, ring, water_content FROM fx_geo WHERE cluster_label = 3",
)
def p9_filter_by_stratum(spark, sf_dir):
    return cleaning.filter_by_stratum(view(spark, sf_dir, "fx_geo"), "3").select("source_file", "ring", "water_content")


@register(
    "p10_available_strata",
    oracle_ctes("fx_geo")
    + """, have AS (SELECT DISTINCT CAST(cluster_label AS VARCHAR) AS stratum FROM fx_geo WHERE cluster_label IS NOT NULL),
want AS (SELECT CAST(range AS VARCHAR) AS stratum FROM range(8))
SELECT stratum, 'present' AS state FROM have UNION ALL
SELECT stratum, 'missing' AS state FROM want WHERE stratum NOT IN (SELECT stratum FROM have)""",
)
def p10_available_strata(spark, sf_dir):
    geo = view(spark, sf_dir, "fx_geo")
    wanted = [str(k) for k in range(8)]  # two more than there are
    present = cleaning.available_strata(geo).withColumn("state", F.lit("present"))
    return present.unionByName(cleaning.missing_strata(geo, wanted).withColumn("state", F.lit("missing")))


def _values(rows) -> str:
    def lit(v):
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_FIELDS = list(catalog.FIELD_LABELS)
_LONG_SQL = f"long AS (UNPIVOT (SELECT point_id, shield_id, ring, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _FIELDS)} FROM fx_points) ON {', '.join(_FIELDS)} INTO NAME field VALUE v)"
_DISPLAY_SQL = f"disp(risk_type, pos, field, label, unit, is_key) AS (VALUES {_values(catalog.display_field_rows())})"


def long_readings(spark, sf_dir, keep=("point_id", "shield_id", "ring")):
    """One row per point and field with a reading."""
    df = points(spark, sf_dir).select(*keep, *[F.col(f).cast("double").alias(f) for f in _FIELDS])
    return df.unpivot(list(keep), _FIELDS, "field", "v").filter("v IS NOT NULL")


@register(
    "p12_display_fields",
    POINTS
    + f""", {_LONG_SQL}, {_DISPLAY_SQL}
SELECT d.risk_type, d.field, d.label, d.unit, d.is_key, count(l.v) AS readings, max(l.v) AS top
FROM disp d LEFT JOIN long l ON d.field = l.field GROUP BY ALL""",
)
def p12_display_fields(spark, sf_dir):
    # readings are aggregated before the join, so the catalogue does not multiply them
    totals = long_readings(spark, sf_dir).groupBy("field").agg(F.count("v").alias("readings"), F.max("v").alias("top"))
    shown = catalog.display_fields(spark).join(totals, "field", "left").na.fill(0, ["readings"])
    return shown.select("risk_type", "field", "label", "unit", "is_key", "readings", "top")


_IMPACT_SQL = f"""{_DISPLAY_SQL}, impact AS (SELECT risk_type, string_agg(label, '，' ORDER BY pos) AS impact_parameters FROM disp GROUP BY risk_type)"""


def impact_parameters(spark):
    ordered = F.sort_array(F.collect_list(F.struct("pos", "label")))
    return catalog.display_fields(spark).groupBy("risk_type").agg(
        F.array_join(F.transform(ordered, lambda x: x["label"]), "，").alias("impact_parameters")
    )


@register(
    "p13_impact_parameters",
    oracle_ctes("fx_records")
    + f""", {_IMPACT_SQL}
SELECT r.risk_type, i.impact_parameters, count(*) AS records FROM fx_records r JOIN impact i ON r.risk_type = i.risk_type
GROUP BY r.risk_type, i.impact_parameters""",
)
def p13_impact_parameters(spark, sf_dir):
    counts = view(spark, sf_dir, "fx_records").groupBy("risk_type").agg(F.count(F.lit(1)).alias("records"))
    return counts.join(F.broadcast(impact_parameters(spark)), "risk_type")


@register(
    "p14_round2",
    """SELECT event_id, CAST(printf('%.2f', value) AS DOUBLE) AS value2, CAST(event_id % 400 AS DOUBLE) / 200 AS exact_value,
  CAST(printf('%.2f', (event_id % 400) / 200.0e0) AS DOUBLE) AS exact2,
  CASE WHEN event_id % 3 = 0 THEN CAST(CAST(printf('%.2f', (event_id % 4096) / 64.0e0) AS DOUBLE) AS VARCHAR) ELSE 'n/a' END AS parsed2 FROM events""",
)
def p14_round2(spark, sf_dir):
    e = F.col("event_id")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("value").alias("value2"),
        ((e % 400) / 200).alias("exact_value"),
        ((e % 400) / 200).alias("exact2"),
        F.when(e % 3 == 0, ((e % 4096) / 64).cast("string")).otherwise("n/a").alias("parsed2"),
    )
    return cleaning.round_columns(raw, ["value2", "exact2", "parsed2"])


@register(
    "p15_clean_json_value",
    """WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 10
  WHEN 0 THEN '' WHEN 1 THEN ' null ' WHEN 2 THEN 'None' WHEN 3 THEN concat('["step ', o_custkey, '", "check"]')
  WHEN 4 THEN concat('"quoted ', o_custkey, '"') WHEN 5 THEN concat('{"a": ', o_custkey, '}')
  WHEN 6 THEN concat(chr(39), 'single ', o_custkey, chr(39)) WHEN 7 THEN concat('[broken ', o_custkey)
  WHEN 8 THEN NULL ELSE concat('  plain ', o_custkey, ' ') END AS raw FROM orders)
SELECT id, CASE id % 10 WHEN 0 THEN '-' WHEN 1 THEN '-' WHEN 2 THEN '-' WHEN 8 THEN '-'
  WHEN 3 THEN replace(replace(replace(raw, '["', ''), '", "', '，'), '"]', '')
  WHEN 4 THEN replace(raw, '"', '')
  WHEN 6 THEN substr(raw, 2, length(raw) - 2)
  ELSE trim(raw) END AS cleaned FROM j""",
)
def p15_clean_json_value(spark, sf_dir):
    kind, n = F.col("o_orderkey") % 10, F.col("o_custkey").cast("string")
    raw = (
        F.when(kind == 0, "")
        .when(kind == 1, " null ")
        .when(kind == 2, "None")
        .when(kind == 3, F.concat(F.lit('["step '), n, F.lit('", "check"]')))
        .when(kind == 4, F.concat(F.lit('"quoted '), n, F.lit('"')))
        .when(kind == 5, F.concat(F.lit('{"a": '), n, F.lit("}")))
        .when(kind == 6, F.concat(F.lit("'single "), n, F.lit("'")))
        .when(kind == 7, F.concat(F.lit("[broken "), n))
        .when(kind == 9, F.concat(F.lit("  plain "), n, F.lit(" ")))
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), text.clean_json_value(raw).alias("cleaned"))


@register(
    "p16_value_with_unit",
    POINTS
    + f""", {_LONG_SQL}, {_DISPLAY_SQL}, lab AS (SELECT DISTINCT field, label, unit FROM disp)
SELECT l.point_id, b.label, l.v AS value, b.unit FROM long l JOIN lab b ON l.field = b.field""",
)
def p16_value_with_unit(spark, sf_dir):
    wrapped = tables.wrap_values(points(spark, sf_dir), ["point_id"], _FIELDS)
    pairs = wrapped.select("point_id", F.explode("values").alias("label", "cell"))
    return pairs.select("point_id", "label", "cell.value", "cell.unit").filter("value IS NOT NULL")


@register(
    "p17_append_units",
    POINTS
    + """ SELECT point_id, CASE WHEN work_prs IS NULL THEN '-' ELSE CAST(work_prs AS VARCHAR) || 'bar' END AS work_prs,
  CASE WHEN thrust_spd IS NULL THEN '-' ELSE CAST(thrust_spd AS VARCHAR) || 'mm/min' END AS thrust_spd FROM fx_points""",
)
def p17_append_units(spark, sf_dir):
    cells = {
        f: text.value_with_unit(F.col(f), F.lit(catalog.field_unit(f))).alias(f) for f in ("work_prs", "thrust_spd")
    }
    return points(spark, sf_dir).select("point_id", *cells.values())


@register(
    "p18_parse_time",
    """SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL
  WHEN event_id % 7 IN (0, 2) THEN date_trunc('second', ts) + INTERVAL 8 HOUR
  WHEN event_id % 7 = 1 THEN ts + INTERVAL 8 HOUR
  WHEN event_id % 7 IN (3, 4) THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS local_time FROM events""",
)
def p18_parse_time(spark, sf_dir):
    layouts = [
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
        "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
        "yyyy-MM-dd HH:mm:ss",
        "MM/dd/yyyy HH:mm:ss",
        "MM/dd/yyyy HH:mm",
    ]
    raw = F.lit("soon")
    for i, layout in enumerate(layouts):
        raw = F.when(F.col("event_id") % 7 == i, F.date_format("ts", layout)).otherwise(raw)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", text.parse_time(raw).alias("local_time"))


@register(
    "p19_format_time_local",
    """SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y/%-m/%-d %-H:%M:%S') AS local_text FROM events""",
)
def p19_format_time_local(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", text.format_time_local(text.shift_to_local(F.col("ts"))).alias("local_text"))


_LEVEL_NAMES = ["high", "中风险", "II", "no_risk", "Ⅳ", "低风险Ⅱ", "normal", "III", "odd", "无风险Ⅰ"]


@register(
    "p20_level_names",
    f"""WITH n AS (SELECT o_orderkey AS id, (ARRAY{_LEVEL_NAMES})[1 + o_orderkey % 10] AS level FROM orders)
SELECT id, level,
  CASE WHEN level IN ('high', 'Ⅳ') THEN '高风险Ⅳ' WHEN level IN ('中风险', 'III') THEN '中风险Ⅲ'
       WHEN level IN ('II', '低风险Ⅱ') THEN '低风险Ⅱ' WHEN level IN ('no_risk', 'normal', '无风险Ⅰ') THEN '无风险Ⅰ' END AS from_model,
  CASE WHEN level = 'Ⅳ' THEN 'Ⅳ' WHEN level = '低风险Ⅱ' THEN 'Ⅱ' WHEN level = '无风险Ⅰ' THEN 'Ⅰ' ELSE '-' END AS symbol,
  CASE WHEN level = 'Ⅳ' THEN 4 WHEN level IN ('中风险', 'III') THEN 3 WHEN level IN ('II', '低风险Ⅱ') THEN 2
       WHEN level = '无风险Ⅰ' THEN 1 ELSE 0 END AS priority,
  CASE WHEN level IN ('Ⅳ', '低风险Ⅱ', '无风险Ⅰ') THEN level WHEN level = '中风险' THEN '中风险Ⅲ' ELSE '无风险Ⅰ' END AS safety
FROM n""",
)
def p20_level_names(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = F.array(*[F.lit(n) for n in _LEVEL_NAMES])
    named = orders.select(F.col("o_orderkey").alias("id"), F.get(names, (F.col("o_orderkey") % 10).cast("int")).alias("level"))
    level = F.col("level")
    return named.select(
        "id",
        "level",
        text.level_from_model_text(level).alias("from_model"),
        text.level_symbol(level).alias("symbol"),
        text.level_priority(level).alias("priority"),
        text.safety_level(level).alias("safety"),
    )


@register(
    "p23_resolve_shield",
    POINTS
    + """, d AS (SELECT DISTINCT shield_id, concat('P_', shield_id) AS project_code FROM fx_points),
q AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' S1 ' WHEN 1 THEN 's0' WHEN 2 THEN 'bad-id' WHEN 3 THEN ' ' WHEN 4 THEN 's9' END AS requested FROM customer)
SELECT c_custkey, requested, d.project_code,
  CASE WHEN coalesce(trim(requested), '') = '' THEN 'missing' WHEN requested = 'bad-id' THEN 'malformed'
       WHEN d.project_code IS NULL THEN 'unknown' ELSE 'ok' END AS status
FROM q LEFT JOIN d ON lower(trim(requested)) = d.shield_id""",
)
def p23_resolve_shield(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.col("c_custkey") % 6
    asked = F.when(kind == 0, " S1 ").when(kind == 1, "s0").when(kind == 2, "bad-id").when(kind == 3, " ").when(kind == 4, "s9")
    shields = points(spark, sf_dir).select("shield_id").distinct().withColumn("project_code", F.concat(F.lit("P_"), "shield_id"))
    requests = customer.select("c_custkey", asked.alias("requested"))
    return cleaning.resolve_shield(requests, shields).select("c_custkey", "requested", "project_code", "status")


# ---------------------------------------------------------------- rule scores

CLOG_CASE = """CASE WHEN work_prs - exc_prs < -1 AND work_prs - pump_prs > 2 THEN 4
  WHEN work_prs - exc_prs < -1 OR work_prs - pump_prs > 2 THEN 3
  WHEN work_prs - exc_prs BETWEEN -1 AND -0.5e0 OR work_prs - pump_prs BETWEEN 1 AND 2 THEN 2 ELSE 1 END"""


def _soft(x: str, k: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0.0e0 ELSE 1.0e0 - exp(-({x}) / {k}) END"


_S1 = f"greatest({_soft('work_prs - ep2_prs - 1.0e0', '1.0e0')}, {_soft('ep2_prs - tele_prs', '10.0e0')})"
_S2 = f"greatest({_soft('gear_prs - tele_prs', '10.0e0')}, {_soft('tele_prs - gear_prs - 29.0e0', '10.0e0')})"
_S3 = f"greatest({_soft('leak_prs - gear_prs', '5.0e0')}, {_soft('gear_prs - leak_prs - 4.0e0', '5.0e0')})"
MDR_P = f"(1.0e0 - (1.0e0 - 0.35e0 * {_S1}) * (1.0e0 - 0.35e0 * {_S2}) * (1.0e0 - 0.3e0 * {_S3}))"
TAIL_P = "least(1.0e0, 0.0e0 " + " ".join(
    f"+ CASE WHEN {g} > {s} THEN 0.0625e0 ELSE 0.0e0 END + CASE WHEN {s} >= 50 THEN 0.0625e0 WHEN {s} >= 40 THEN ({s} - 40) / 160 ELSE 0.0e0 END"
    for s, g in zip(catalog.SEAL_FIELDS, catalog.GROUT_FIELDS)
) + ")"


def _cuts(p: str) -> str:
    return f"CASE WHEN {p} >= 0.9e0 THEN 4 WHEN {p} >= 0.5e0 THEN 3 WHEN {p} >= 0.3e0 THEN 2 ELSE 1 END"


def score_sql(p: str, points_) -> str:
    parts = [f"WHEN {p} <= {points_[0][0]}e0 THEN {points_[0][1]}e0"]
    for (p0, s0), (p1, s1) in zip(points_, points_[1:]):
        parts.append(f"WHEN {p} <= {p1}e0 THEN {s0}e0 + ({p} - {p0}e0) / ({max(p1 - p0, 1e-9)!r}::DOUBLE) * ({s1 - s0}e0)")
    return "CASE " + " ".join(parts) + f" ELSE {points_[-1][1]}e0 END"




def round_sql(x: str, digits: int) -> str:
    """Exact half-even rounding in DuckDB."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


_ROUNDED = round_sql(round_sql("{p}", 3), 2)
_LEVEL_SQL = "CASE priority WHEN 4 THEN '高风险Ⅳ' WHEN 3 THEN '中风险Ⅲ' WHEN 2 THEN '低风险Ⅱ' WHEN 1 THEN '无风险Ⅰ' END"
_SCORE_CASE = "CASE risk_type " + " ".join(
    f"WHEN '{r}' THEN {score_sql('probability', catalog.RISKS[r].score_points)}" for r in catalog.RULE_RISKS
) + " END"
_WARN_CASE = "CASE WHEN priority >= 3 THEN CASE risk_type " + " ".join(
    f"WHEN '{r}' THEN '{catalog.RISKS[r].warning_label}'" for r in catalog.RULE_RISKS
) + " END ELSE '-' END"
SCORED_SQL = f"""scored AS (
SELECT shield_id, ring, time, point_id, 'clog' AS risk_type, {CLOG_CASE} AS priority,
  CASE {CLOG_CASE} WHEN 4 THEN 0.9e0 WHEN 3 THEN 0.7e0 WHEN 2 THEN 0.3e0 ELSE 0.0e0 END AS probability
FROM fx_points WHERE {_valid_sql(catalog.RISKS['clog'].fields)}
UNION ALL
SELECT shield_id, ring, time, point_id, 'mdr_seal', {_cuts(MDR_P)}, {_ROUNDED.format(p=MDR_P)}
FROM fx_points WHERE {_valid_sql(catalog.RISKS['mdr_seal'].fields)}
UNION ALL
SELECT shield_id, ring, time, point_id, 'tail_seal', {_cuts(TAIL_P)}, {_ROUNDED.format(p=TAIL_P)}
FROM fx_points WHERE {_valid_sql(catalog.RISKS['tail_seal'].fields)})"""


@register(
    "r1_clog_risk",
    POINTS
    + f""" SELECT point_id, {CLOG_CASE} AS priority,
  CASE {CLOG_CASE} WHEN 4 THEN 0.9e0 WHEN 3 THEN 0.7e0 WHEN 2 THEN 0.3e0 ELSE 0.0e0 END AS probability
FROM fx_points WHERE {_valid_sql(catalog.RISKS['clog'].fields)}""",
)
def r1_clog_risk(spark, sf_dir):
    scored = rules.with_probabilities(points(spark, sf_dir), ["point_id"], ["clog"])
    return rules.long_form(scored, ["point_id"], ["clog"]).select("point_id", "priority", F.col("raw_p").alias("probability"))


@register(
    "r2_main_drive_seal_risk",
    POINTS
    + f""" SELECT point_id, {_cuts(MDR_P)} AS priority, {round_sql(MDR_P, 3)} AS probability,
  {round_sql(_S1, 6)} AS s1, {round_sql(_S2, 6)} AS s2, {round_sql(_S3, 6)} AS s3
FROM fx_points WHERE {_valid_sql(catalog.RISKS['mdr_seal'].fields)}""",
)
def r2_main_drive_seal_risk(spark, sf_dir):
    parts = [s.alias(f"s{i}") for i, s in enumerate(scoring.main_drive_parts(), start=1)]
    keep = ["point_id", "s1", "s2", "s3"]
    staged = points(spark, sf_dir).select("*", *parts)
    scored = rules.long_form(rules.with_probabilities(staged, keep, ["mdr_seal"]), keep, ["mdr_seal"])
    return scored.select(
        "point_id",
        "priority",
        round_exact(F.col("raw_p"), 3).alias("probability"),
        *[round_exact(F.col(c), 6).alias(c) for c in keep[1:]],
    )


@register(
    "r3_tail_seal_risk",
    POINTS
    + f""" SELECT point_id, {_cuts(TAIL_P)} AS priority, {TAIL_P} AS raw_p, {round_sql(TAIL_P, 3)} AS probability
FROM fx_points WHERE {_valid_sql(catalog.RISKS['tail_seal'].fields)}""",
)
def r3_tail_seal_risk(spark, sf_dir):
    scored = rules.with_probabilities(points(spark, sf_dir), ["point_id"], ["tail_seal"])
    long = rules.long_form(scored, ["point_id"], ["tail_seal"])
    return long.select("point_id", "priority", "raw_p", round_exact(F.col("raw_p"), 3).alias("probability"))


@register(
    "r4_probability_to_score",
    "SELECT event_id, "
    + ", ".join(f"{score_sql('p', r.score_points)} AS {k}_score" for k, r in catalog.RISKS.items())
    + " FROM (SELECT event_id, greatest(0.0e0, least(1.0e0, (event_id % 150) / 128.0e0 - 0.0625e0)) AS p FROM events)",
)
def r4_probability_to_score(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = (F.col("event_id") % 150) / 128.0 - 0.0625
    return events.select(
        "event_id",
        *[scoring.probability_to_score(p, r.score_points).alias(f"{k}_score") for k, r in catalog.RISKS.items()],
    )


@register(
    "r5_assess_points",
    POINTS
    + f""", {SCORED_SQL}
SELECT shield_id, ring, time, point_id, risk_type, probability, priority, {_LEVEL_SQL} AS safety_level,
  {round_sql(_SCORE_CASE, 2)} AS risk_score, {_WARN_CASE} AS potential_risk FROM scored""",
)
def r5_assess_points(spark, sf_dir):
    return rules.assess_points(points(spark, sf_dir))


@register(
    "r6_rule_details",
    POINTS
    + f""" SELECT point_id, 'clog' AS risk_type, printf('exc=%.2f, pump=%.2f', work_prs - exc_prs, work_prs - pump_prs) AS details
FROM fx_points WHERE {_valid_sql(catalog.RISKS['clog'].fields)}
UNION ALL SELECT point_id, 'mdr_seal', printf('prob=%.3f (s1=%.2f, s2=%.2f, s3=%.2f)', {MDR_P}, {_S1}, {_S2}, {_S3})
FROM fx_points WHERE {_valid_sql(catalog.RISKS['mdr_seal'].fields)}
UNION ALL SELECT point_id, 'tail_seal', printf('points 8/8, prob=%.3f', {TAIL_P})
FROM fx_points WHERE {_valid_sql(catalog.RISKS['tail_seal'].fields)}""",
)
def r6_rule_details(spark, sf_dir):
    return rules.rule_details(points(spark, sf_dir))


@register(
    "r10_potential_warning",
    POINTS
    + f""", {SCORED_SQL} SELECT risk_type, {_WARN_CASE} AS potential_risk, count(*) AS points FROM scored GROUP BY ALL""",
)
def r10_potential_warning(spark, sf_dir):
    scored = rules.score_points(points(spark, sf_dir))
    label = rules.warning_label(F.col("risk_type"), F.col("priority")).alias("potential_risk")
    return scored.groupBy("risk_type", label).agg(F.count(F.lit(1)).alias("points"))


# ---------------------------------------------------------------- ring results

RUNS_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY shield_id, ring, risk_type ORDER BY time, point_id) AS rn FROM scored),
islands AS (SELECT n.shield_id, n.ring, n.risk_type, n.time, n.probability, n.rn, t.lv,
  n.rn - row_number() OVER (PARTITION BY n.shield_id, n.ring, n.risk_type, t.lv ORDER BY n.rn) AS isl
  FROM numbered n, (VALUES (4), (3), (2)) t(lv) WHERE n.priority >= t.lv),
runs AS (SELECT shield_id, ring, risk_type, lv, isl, min(rn) AS first_rn, max(probability) AS p, arg_min(time, rn) AS t
  FROM islands GROUP BY ALL HAVING count(*) >= 3),
firsts AS (SELECT shield_id, ring, risk_type,
  arg_min(p, first_rn) FILTER (lv = 4) AS high_p, arg_min(p, first_rn) FILTER (lv = 3) AS medium_p,
  arg_min(t, first_rn) FILTER (lv = 2) AS warning_time FROM runs GROUP BY ALL),
totals AS (SELECT shield_id, ring, risk_type, count(*) AS points, max(probability) FILTER (priority = 2) AS low_p,
  max(probability) FILTER (priority = 1) AS none_p, max(probability) AS any_p FROM scored GROUP BY ALL),
ringed AS (SELECT t.shield_id, t.ring, t.risk_type, t.points, f.warning_time,
  CASE WHEN high_p IS NOT NULL THEN 4 WHEN medium_p IS NOT NULL THEN 3 WHEN low_p IS NOT NULL THEN 2 ELSE 1 END AS priority,
  coalesce(high_p, medium_p, low_p, none_p, any_p) AS probability
  FROM totals t LEFT JOIN firsts f ON t.shield_id = f.shield_id AND t.ring = f.ring AND t.risk_type = f.risk_type),
ring_risk AS (SELECT *, """ + _LEVEL_SQL + f""" AS safety_level, {round_sql(_SCORE_CASE, 2)} AS risk_score, {_WARN_CASE} AS potential_risk FROM ringed)"""

_RING_RISK_COLUMNS = "shield_id, ring, risk_type, points, priority, safety_level, probability, risk_score, potential_risk, warning_time"


@register("a1_ring_risk_trigger", POINTS + f", {SCORED_SQL}, {RUNS_SQL} SELECT {_RING_RISK_COLUMNS} FROM ring_risk")
def a1_ring_risk_trigger(spark, sf_dir):
    return triggers.ring_risk(rules.score_points(points(spark, sf_dir)))


@register(
    "a2_earliest_warning",
    POINTS
    + f""", {SCORED_SQL}, {RUNS_SQL}
SELECT r.shield_id, r.ring, r.risk_type, r.warning_time, p.point_id, p.work_prs, p.exc_prs, p.pump_prs
FROM ring_risk r JOIN fx_points p ON r.shield_id = p.shield_id AND r.ring = p.ring AND r.warning_time = p.time
WHERE r.warning_time IS NOT NULL""",
)
def a2_earliest_warning(spark, sf_dir):
    pts = points(spark, sf_dir)
    runs = triggers.warning_runs(rules.score_points(pts)).filter("warning_time IS NOT NULL")
    warned = runs.select("shield_id", "ring", "risk_type", "warning_time")
    params = pts.select("shield_id", "ring", F.col("time").alias("warning_time"), "point_id", "work_prs", "exc_prs", "pump_prs")
    return warned.join(params, ["shield_id", "ring", "warning_time"])


@register(
    "a20_ring_point_counts",
    POINTS + " SELECT shield_id, ring, count(*) AS points FROM fx_points GROUP BY shield_id, ring",
)
def a20_ring_point_counts(spark, sf_dir):
    return points(spark, sf_dir).groupBy("shield_id", "ring").agg(F.count(F.lit(1)).alias("points"))
