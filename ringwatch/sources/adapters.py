"""Views that give the given test tables the shapes of the library's inputs.

Each view is one SQL text that Spark and DuckDB both run; ``{table}`` stands for a base
table. Views may build on earlier views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringwatch import catalog

_SEAL = ",\n  ".join(f"seal AS seal_{i}" for i in range(1, 9))
_GROUT = ",\n  ".join(f"seal + sign(n_over - {i - 0.5}e0) AS grout_{i}" for i in range(1, 9))

# a ring that gets a third of all points: every fourth ring's, and the last points of short rings
HOT_RING = 2
POINTS = f"""
WITH b AS (
  SELECT event_id AS e, ts, value,
         CAST(floor(event_id / 64) AS BIGINT) AS own, event_id % 64 AS k
  FROM {{events}} WHERE event_id IS NOT NULL),
r AS (
  SELECT b.*, own % 8 AS rg, CAST(floor(k / 8) AS BIGINT) AS blk,
         CASE WHEN own % 4 = 1 OR (own % 5 = 0 AND k >= 40) OR (own % 7 = 3 AND k >= 56) THEN {HOT_RING} ELSE own END AS ring
  FROM b),
p AS (
  SELECT r.*,
         CASE WHEN (rg + blk) % 8 = 0 AND rg IN (1, 2) THEN 4
              WHEN blk = rg AND rg BETWEEN 3 AND 5 THEN 3
              WHEN rg = 6 AND k % 16 = 0 THEN 2
              ELSE 1 END AS regime
  FROM r),
q AS (
  SELECT p.*,
         CASE regime WHEN 4 THEN 55.0e0 WHEN 3 THEN 45.0e0 WHEN 2 THEN 42.0e0 ELSE 20.0e0 END AS seal,
         CASE regime WHEN 4 THEN 7 WHEN 3 THEN 5 WHEN 2 THEN 4 ELSE 0 END AS n_over
  FROM p)
SELECT
  concat('s', CAST(floor(ring / 8) AS BIGINT) % 5) AS shield_id,
  e AS point_id, ts AS time,
  ring + (k % 8) / 16.0e0 AS ring_no, ring,
  CASE WHEN e % 97 = 0 THEN NULL
       WHEN e % 89 = 0 THEN -1.0e0
       ELSE CASE regime WHEN 4 THEN 6.0e0 WHEN 3 THEN 3.0e0 ELSE 4.0e0 END + (e % 5) / 16.0e0
       END AS work_prs,
  CASE regime WHEN 4 THEN 8.0e0
              WHEN 3 THEN CASE WHEN rg = 5 THEN 3.0e0 ELSE 5.0e0 + (e % 2) END
              WHEN 2 THEN CASE WHEN k % 32 = 0 THEN 4.75e0 ELSE 3.75e0 END
              ELSE 3.75e0 END AS exc_prs,
  CASE regime WHEN 4 THEN 3.0e0
              WHEN 3 THEN CASE WHEN rg = 5 THEN 0.5e0 ELSE 2.5e0 END
              WHEN 2 THEN CASE WHEN k % 32 = 0 THEN 3.75e0 ELSE 2.75e0 END
              ELSE 3.75e0 END AS pump_prs,
  CASE regime WHEN 4 THEN 60.0e0 WHEN 3 THEN 25.0e0 ELSE 5.5e0 END AS ep2_prs,
  CASE regime WHEN 4 THEN 5.0e0 WHEN 3 THEN 20.0e0 ELSE 5.0e0 END AS tele_prs,
  CASE regime WHEN 4 THEN 80.0e0 WHEN 3 THEN 30.0e0 WHEN 2 THEN 12.0e0 ELSE 4.5e0 END AS gear_prs,
  CASE regime WHEN 4 THEN 5.0e0 WHEN 3 THEN 8.0e0 ELSE 4.0e0 END AS leak_prs,
  {_SEAL},
  {_GROUT},
  CASE WHEN e % 53 = 0 THEN NULL ELSE 20.0e0 + (e * 7 % 37) / 4.0e0 END AS thrust_spd,
  CASE WHEN e % 61 = 0 THEN NULL ELSE 0.75e0 + (e * 3 % 16) / 64.0e0 END AS ch_spd,
  CASE WHEN e % 67 = 0 THEN NULL ELSE 4.0e0 + (e * 11 % 29) / 8.0e0 + regime END AS ch_torque,
  100000.0e0 + (e * 13 % 101) * 64 AS thrust_force,
  CASE WHEN k < 2 THEN NULL ELSE 21000.0e0 + (e * 17 % 83) * 16 END AS ch_contact_force
FROM q
"""

_POINT_TAIL = ", ".join(
    ["work_prs", "exc_prs", "pump_prs", "ep2_prs", "tele_prs", "gear_prs", "leak_prs"]
    + catalog.SEAL_FIELDS
    + catalog.GROUT_FIELDS
    + catalog.TBM_FEATURES
)
POINTS_RAW = f"""
SELECT * FROM {{fx_points}}
UNION ALL
SELECT shield_id, point_id + 10000000 AS point_id, time, ring_no, ring, {_POINT_TAIL}
FROM {{fx_points}} WHERE point_id % 50 = 0
"""

# each geology feature: offset of its missing rows, base value, divisor of the size
_GEO_SHAPE = [
    ("water_content", "20.0e0 + p_size / 4.0e0"),
    ("unit_weight", "18.0e0 + p_size / 8.0e0"),
    ("void_ratio", "p_size / 64.0e0"),
    ("plasticity_index", "10.0e0 + p_size / 8.0e0"),
    ("liquidity_index", "p_size / 32.0e0"),
    ("friction_angle", "12.0e0 + p_size / 2.0e0"),
    ("cohesion", "8.0e0 + p_size / 2.0e0"),
    ("ucs_saturated", "14.0e0 + p_size / 4.0e0"),
    ("integrity_index", "p_size / 64.0e0"),
    ("poisson_ratio", "0.25e0 + p_size / 256.0e0"),
    ("dpt_blows", "13.0e0 + p_size / 4.0e0"),
]
_GEO_COLUMNS = ",\n       ".join(
    f"CASE WHEN (p_partkey + {i}) % 11 = 0 THEN NULL ELSE {expr} END AS {name}"
    for i, (name, expr) in enumerate(_GEO_SHAPE)
)
GEO = f"""
SELECT CASE WHEN p_partkey % 2 = 0
            THEN concat('s', CAST(floor(p_partkey / 8) AS BIGINT) % 5)
            ELSE concat('file_s', CAST(floor(p_partkey / 8) AS BIGINT) % 5) END AS source_file,
       CASE WHEN p_partkey % 4 = 3 THEN p_partkey + 1000000 ELSE p_partkey END AS ring,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size % 6 END AS cluster_label,
       {_GEO_COLUMNS}
FROM {{part}}
"""

RECORDS = """
SELECT o_orderkey AS id, o_custkey AS ring,
       CASE o_orderstatus WHEN 'F' THEN 'P_F' WHEN 'O' THEN 'P_O' ELSE 'P_P' END AS project_code,
       CASE o_orderkey % 4 WHEN 0 THEN 'clog' WHEN 1 THEN 'mdr_seal' WHEN 2 THEN 'mud_cake' ELSE 'tail_seal' END AS risk_type,
       CASE o_orderpriority WHEN '1-URGENT' THEN '高风险Ⅳ' WHEN '2-HIGH' THEN '中风险Ⅲ'
                            WHEN '3-MEDIUM' THEN '低风险Ⅱ' WHEN '5-LOW' THEN '-' ELSE '无风险Ⅰ' END AS risk_level,
       (o_orderkey % 129) / 32.0e0 AS risk_score,
       o_orderdate AS warning_time
FROM {orders}
"""

POINT_INFO = """
SELECT concat('s', s_suppkey % 5) AS shield_id,
       s_suppkey AS row_id,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE concat(' code_', s_suppkey, ' ') END AS point_code,
       concat('point_', CAST(floor(s_suppkey / 2) AS BIGINT)) AS point_cn_name,
       CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'bar' END AS point_unit
FROM {supplier}
"""

SCORES = """
SELECT event_id AS seq_id,
       CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
       concat('c', event_id % 6) AS stratum,
       value / (value + 50.0e0) AS ae_error,
       (event_id * 37 % 1009) / 1024.0e0 - 0.25e0 AS if_anomaly,
       ts AS end_time
FROM {events}
"""

# geology keyed by ring: zero for missing features, first known label in file order
_GEO_FILLED = ", ".join(f"coalesce({f}, 0.0e0) AS {f}" for f in catalog.GEO_FEATURES)
FUSED = f"""
SELECT concat('cluster_', g.cluster_label, ':points+geology') AS data_source,
       CAST(g.cluster_label AS VARCHAR(20)) AS stratum,
       t.ring, t.time, t.point_id, {', '.join('t.' + f for f in catalog.TBM_FEATURES)},
       {', '.join('g.' + f for f in catalog.GEO_FEATURES)}
FROM {{fx_points}} t
JOIN (SELECT ring, cluster_label, {_GEO_FILLED} FROM {{fx_geo}} WHERE cluster_label IS NOT NULL) g
  ON t.ring = g.ring
"""

VIEWS = {
    "fx_points": POINTS,
    "fx_points_raw": POINTS_RAW,
    "fx_geo": GEO,
    "fx_records": RECORDS,
    "fx_point_info": POINT_INFO,
    "fx_scores": SCORES,
    "fx_fused": FUSED,
}
BASE_TABLES = ["events", "part", "orders", "supplier", "customer", "nation", "region", "lineitem"]


def _needs(text: str) -> list[str]:
    return [name for name in [*VIEWS, *BASE_TABLES] if "{" + name + "}" in text]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view as a DataFrame over the tables in ``sf_dir``."""
    text = VIEWS[name]
    inputs = {
        need: view(spark, sf_dir, need) if need in VIEWS else table(spark, sf_dir, need) for need in _needs(text)
    }
    return spark.sql(text, **inputs)


def oracle_ctes(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they build on) over base tables."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs = _needs(VIEWS[name])
        for need in needs:
            if need in VIEWS:
                add(need)
        done[name] = VIEWS[name].format(**{n: n for n in needs})

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in done.items())
