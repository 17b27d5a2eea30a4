"""Point-level scoring of the three rule risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.functions import scoring
from ringwatch.functions.rounding import round_exact, with_rounded


def with_probabilities(points: DataFrame, keep, risks=None) -> DataFrame:
    """``keep`` columns plus one raw probability per rule risk, NULL where a sensor is not valid."""
    formulas = {
        "clog": scoring.clog_probability,
        "mdr_seal": scoring.main_drive_probability,
        "tail_seal": scoring.tail_seal_probability,
    }
    cols = [
        F.when(scoring.valid_sensors(catalog.RISKS[r].fields), formulas[r]()).alias(f"{r}_p")
        for r in risks or catalog.RULE_RISKS
    ]
    # a missing reading becomes NaN, which no check accepts: later steps then need no NULL handling
    used = sorted({f for r in risks or catalog.RULE_RISKS for f in catalog.RISKS[r].fields})
    kept = [c for c in keep if c not in used]
    return points.select(*kept, *[F.expr(f"coalesce(CAST({f} AS DOUBLE), double('NaN')) AS {f}") for f in used]).select(*kept, *cols)


def rule_priority(risk: str, p: Column) -> Column:
    """Level of an unrounded rule probability; the clog rule has one probability per level."""
    if risk == "clog":
        return scoring.level_by_cuts(p, low=0.3, medium=0.7, high=0.9)
    return scoring.level_by_cuts(p)


def long_form(probabilities: DataFrame, keep, risks=None) -> DataFrame:
    """One row per kept row and rule risk with a probability."""
    entries = [
        F.struct(
            F.lit(r).alias("risk_type"),
            F.col(f"{r}_p").alias("raw_p"),
            rule_priority(r, F.col(f"{r}_p")).alias("priority"),
        )
        for r in risks or catalog.RULE_RISKS
    ]
    return (
        probabilities.select(*keep, F.explode(F.array(*entries)).alias("_e"))
        .select(*keep, "_e.risk_type", "_e.raw_p", "_e.priority")
        .filter(F.col("raw_p").isNotNull())
    )


def score_points(points: DataFrame, keep=("shield_id", "ring", "time", "point_id")) -> DataFrame:
    """Long form: one row per point and rule risk with valid sensors. Narrow, no shuffle.

    The level comes from the unrounded probability ``raw_p``; ``probability`` is rounded.
    """
    long = long_form(with_probabilities(points, keep), keep)
    # three decimals from the rule, then two for the report
    three = long.withColumn("probability", round_exact(F.col("raw_p"), 3))
    return with_rounded(three, {"probability": 2})


def level_text(priority: Column) -> Column:
    expr = F.lit(None).cast("string")
    for value, label in catalog.LEVEL_TEXT.items():
        expr = F.when(priority == value, label).otherwise(expr)
    return expr


def warning_label(risk_type: Column, priority: Column) -> Column:
    """Warning text of medium and high results, '-' for the rest."""
    expr = F.lit("-")
    for key, risk in catalog.RISKS.items():
        expr = F.when(risk_type == key, risk.warning_label).otherwise(expr)
    return F.when(priority >= 3, expr).otherwise("-")


def with_score(results: DataFrame, risks=None) -> DataFrame:
    """Add level text, two-decimal score and warning text from priority and probability."""
    scored = results.withColumn(
        "risk_score", scoring.score_for_risk(F.col("risk_type"), F.col("probability"), risks or catalog.RULE_RISKS)
    )
    return with_rounded(scored, {"risk_score": 2}).withColumns(
        {
            "safety_level": level_text(F.col("priority")),
            "potential_risk": warning_label(F.col("risk_type"), F.col("priority")),
        }
    )


def assess_points(points: DataFrame) -> DataFrame:
    """Scored long form with level, score and warning text."""
    return with_score(score_points(points)).drop("raw_p")


def rule_details(points: DataFrame) -> DataFrame:
    """Readable explanation per valid point and rule risk."""
    exc, pump = scoring.clog_differences()
    s1, s2, s3 = scoring.main_drive_parts()
    numbers = {
        "exc": (exc, 2),
        "pump": (pump, 2),
        "prob": (scoring.main_drive_probability(), 3),
        "s1": (s1, 2),
        "s2": (s2, 2),
        "s3": (s3, 2),
        "tail": (scoring.tail_seal_probability(), 3),
    }
    valid = {r: scoring.valid_sensors(catalog.RISKS[r].fields) for r in catalog.RULE_RISKS}
    raw = points.select(
        "point_id", *[v.alias(f"{r}_ok") for r, v in valid.items()], *[c.alias(n) for n, (c, _) in numbers.items()]
    )
    shown = with_rounded(raw, {n: digits for n, (_, digits) in numbers.items()})
    texts = {
        "clog": F.format_string("exc=%.2f, pump=%.2f", "exc", "pump"),
        "mdr_seal": F.format_string("prob=%.3f (s1=%.2f, s2=%.2f, s3=%.2f)", "prob", "s1", "s2", "s3"),
        "tail_seal": F.format_string("points 8/8, prob=%.3f", "tail"),
    }
    entries = [
        F.struct(F.lit(r).alias("risk_type"), F.when(F.col(f"{r}_ok"), t).alias("details")) for r, t in texts.items()
    ]
    return (
        shown.select("point_id", F.explode(F.array(*entries)).alias("_e"))
        .select("point_id", "_e.risk_type", "_e.details")
        .filter(F.col("details").isNotNull())
    )
