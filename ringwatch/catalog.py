"""Static descriptions of the four risks: fields, labels, units, score curves and texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Column order, display labels and units of the input fields.
TBM_FEATURES = ["thrust_spd", "ch_spd", "ch_torque", "thrust_force", "ch_contact_force"]
GEO_FEATURES = [
    "water_content",
    "unit_weight",
    "void_ratio",
    "plasticity_index",
    "liquidity_index",
    "friction_angle",
    "cohesion",
    "ucs_saturated",
    "integrity_index",
    "poisson_ratio",
    "dpt_blows",
]
FEATURES = TBM_FEATURES + GEO_FEATURES
GEO_LABELS = dict(
    zip(
        GEO_FEATURES,
        [
            "含水率",
            "容重（重度）",
            "孔隙比",
            "塑性指数",
            "液性指数",
            "内摩擦角",
            "黏聚力",
            "饱和单轴抗压强度标准值",
            "完整性指数",
            "泊松比",
            "重型圆锥动力触探锤击数N",
        ],
    )
)
SEAL_FIELDS = [f"seal_{i}" for i in range(1, 9)]
GROUT_FIELDS = [f"grout_{i}" for i in range(1, 9)]
FIELD_LABELS = {
    "work_prs": "1#工作仓压力",
    "exc_prs": "4#开挖仓压力",
    "pump_prs": "排浆泵P2.1进口压力",
    "ep2_prs": "1#主驱动EP2外密封油脂压力",
    "tele_prs": "主驱动伸缩密封油脂压力01",
    "gear_prs": "齿轮油油气密封压力",
    "leak_prs": "油气密封泄露检测腔压力",
    "thrust_spd": "推进速度",
    "ch_spd": "刀盘转速",
    "ch_torque": "刀盘扭矩",
    "thrust_force": "推力",
    "ch_contact_force": "刀盘总挤压力",
    **{f"seal_{i}": f"{2 * i}#盾尾密封后压力" for i in range(1, 9)},
    **{f"grout_{i}": f"{i}#A液泵出口压力" for i in range(1, 9)},
}
TBM_UNITS = {
    "thrust_spd": "mm/min",
    "ch_spd": "rpm",
    "ch_torque": "kNm",
    "thrust_force": "kN",
    "ch_contact_force": "kN",
}

# Level labels with priority, symbol and model name, mildest first.
LEVELS = [
    (1, "无风险Ⅰ", "Ⅰ", "no_risk"),
    (2, "低风险Ⅱ", "Ⅱ", "low"),
    (3, "中风险Ⅲ", "Ⅲ", "medium"),
    (4, "高风险Ⅳ", "Ⅳ", "high"),
]
LEVEL_TEXT = {priority: text for priority, text, _, _ in LEVELS}
TRIGGER_LENGTH = 3

# Names under which the sort column of a raw table may appear, in order.
SORT_CANDIDATES = [
    "time",
    "ts(Asia/Shanghai)",
    "timestamp",
    "TIME",
    "Timestamp",
    "time_stamp",
    "采样时间",
    "DATETIME",
    "Date",
    "date",
    "时间",
    "POINT_NO",
    "ts",
]


@dataclass(frozen=True)
class Risk:
    key: str
    label: str
    fields: tuple[str, ...]
    key_fields: tuple[str, ...]
    score_points: tuple[tuple[float, float], ...]
    cause: str

    @property
    def full_label(self) -> str:
        return self.label + "风险"

    @property
    def warning_label(self) -> str:
        return self.label + "预警"


# Risk labels, field lists and score curves.
RISKS = {
    "clog": Risk(
        "clog",
        "滞排",
        ("work_prs", "exc_prs", "pump_prs"),
        ("work_prs", "exc_prs", "pump_prs"),
        ((0.0, 4.0), (0.3, 3.5), (0.7, 2.0), (0.9, 0.5), (1.0, 0.0)),
        "muck flows poorly and settles in the discharge line",
    ),
    "mdr_seal": Risk(
        "mdr_seal",
        "主驱动密封失效",
        ("work_prs", "ep2_prs", "tele_prs", "gear_prs", "leak_prs"),
        ("work_prs", "ep2_prs", "tele_prs", "gear_prs", "leak_prs"),
        ((0.0, 4.0), (0.5, 2.0), (0.95, 0.5), (1.0, 0.0)),
        "worn bearing seals or low grease pressure let ground water in",
    ),
    "mud_cake": Risk(
        "mud_cake",
        "结泥饼",
        tuple(TBM_FEATURES),
        tuple(TBM_FEATURES),
        ((0.0, 4.0), (0.3, 3.5), (0.65, 2.0), (0.9, 0.5), (1.0, 0.0)),
        "clay hardens on the cutter head or in the chamber",
    ),
    "tail_seal": Risk(
        "tail_seal",
        "盾尾密封失效",
        tuple(SEAL_FIELDS + GROUT_FIELDS),
        ("grout_1", "grout_2", "seal_1", "seal_2"),
        ((0.0, 4.0), (0.3, 3.5), (0.5, 2.0), (0.9, 0.5), (1.0, 0.0)),
        "worn or torn brush seals let grout and water through",
    ),
}
RULE_RISKS = ["clog", "mdr_seal", "tail_seal"]

UNKNOWN_LEVEL_ANALYSIS = "no further analysis for this level"
_ADVICE = {
    1: ("keep current parameters", "readings are stable"),
    2: ("watch the trend more often", "readings drift slightly"),
    3: ("raise monitoring and adjust parameters", "readings are clearly off"),
    4: ("stop the drive and inspect", "readings are critical"),
}


def field_unit(field: str) -> str:
    return TBM_UNITS.get(field, "bar")


def key_parameter_fields() -> list[str]:
    """Distinct key-parameter fields over all risks, mud cake first."""
    order = ["mud_cake", "clog", "mdr_seal", "tail_seal"]
    return list(dict.fromkeys(f for key in order for f in RISKS[key].key_fields))


def risk_catalog_rows() -> list[tuple]:
    return [(r.key, r.label, r.full_label, r.warning_label, r.cause) for r in RISKS.values()]


def risk_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        risk_catalog_rows(),
        "risk_type string, risk_label string, full_label string, warning_label string, fault_cause string",
    )


def display_field_rows() -> list[tuple]:
    rows = []
    for risk in RISKS.values():
        for pos, field in enumerate(risk.fields, start=1):
            rows.append((risk.key, pos, field, FIELD_LABELS[field], field_unit(field), field in risk.key_fields))
    return rows


def display_fields(spark: SparkSession) -> DataFrame:
    """One row per (risk, displayed field), flagged when it is also a key parameter."""
    return spark.createDataFrame(
        display_field_rows(),
        "risk_type string, pos bigint, field string, label string, unit string, is_key boolean",
    )


def level_text_rows() -> list[tuple]:
    rows = []
    for risk in RISKS.values():
        for priority, text, _, _ in LEVELS:
            measures, reason = _ADVICE[priority]
            rows.append(
                (
                    risk.key,
                    text,
                    f"{risk.key}: {measures}",
                    f"{risk.key}: {reason}",
                    f"{risk.key}: {reason}; {risk.cause}",
                )
            )
    return rows


def level_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        level_text_rows(),
        "risk_type string, safety_level string, fault_measures string, fault_reason string, "
        "fault_reason_analysis string",
    )


@dataclass(frozen=True)
class ModelConfig:
    """Settings of the mud cake model jobs."""

    # Window geometry, weights, model size and calibration levels.
    rings_per_sequence: int = 6
    window_points: int = 48
    window_stride: int = 8
    sequence_stride: int = 1
    smoothing_window: int = 5
    clip_zscore: float = 3.5
    reconstruction_weight: float = 0.35
    isolation_weight: float = 0.65
    components: int = 48
    contamination: float = 0.01
    trees: int = 200
    samples_per_tree: int = 2048
    seed: int = 42
    scale_low_quantile: float = 0.50
    scale_high_quantile: float = 0.999
    cdf_low: float = 0.95
    cdf_medium: float = 0.995
    cdf_high: float = 0.999
    quantile_p: float = 0.75
    topk_k: int = 3


EXPECTED_STRATA = [str(i) for i in range(6)]

# Model weight of each feature.
FEATURE_WEIGHTS = {
    "thrust_spd": 1.5,
    "ch_spd": 0.7,
    "ch_torque": 0.7,
    "thrust_force": 1.5,
    "ch_contact_force": 1.5,
    **{f: 1.1 for f in GEO_FEATURES},
}
