"""Scalar scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog


def valid_sensors(fields) -> Column:
    """True when every field is present, finite and not negative.

    Zero times a reading is 0 only for finite ones (NULL, NaN and infinity carry through),
    which keeps the generated code small for many fields.
    """
    zeros = " + ".join(f"{f} * 0D" for f in fields)
    return F.expr(f"coalesce(least({', '.join(fields)}) >= 0D AND {zeros} = 0D, false)" if len(fields) > 1 else f"coalesce({fields[0]} >= 0D AND {zeros} = 0D, false)")


def clog_differences() -> tuple[Column, Column]:
    work = F.col("work_prs")
    return work - F.col("exc_prs"), work - F.col("pump_prs")


def clog_probability() -> Column:
    """Probability of the muck-discharge rule; the first matching case wins."""
    exc, pump = clog_differences()
    return (
        F.when((exc < -1) & (pump > 2), 0.9)
        .when((exc < -1) | (pump > 2), 0.7)
        .when(exc.between(-1, -0.5) | pump.between(1, 2), 0.3)
        .otherwise(0.0)
    )


def main_drive_parts() -> tuple[Column, Column, Column]:
    """Partial scores of the three seal stages.

    A stage takes the larger of two saturating terms 1 - exp(-x / k), each 0 for x <= 0;
    as the curve only rises, the larger x / k decides and one exponential is enough.
    """
    p0, p1, p2, p3, p4 = catalog.RISKS["mdr_seal"].fields
    outer = F.expr(f"1D - exp(-greatest(0D, {p0} - {p1} - 1D, ({p1} - {p2}) / 10D))")
    middle = F.expr(f"1D - exp(-greatest(0D, ({p3} - {p2}) / 10D, ({p2} - {p3} - 29D) / 10D))")
    inner = F.expr(f"1D - exp(-greatest(0D, ({p4} - {p3}) / 5D, ({p3} - {p4} - 4D) / 5D))")
    return outer, middle, inner


def main_drive_probability() -> Column:
    outer, middle, inner = main_drive_parts()
    one = F.lit(1.0)
    return one - (one - 0.35 * outer) * (one - 0.35 * middle) * (one - 0.3 * inner)


def tail_seal_probability() -> Column:
    """Sum over the eight seal/grout pairs; terms are added in pair order, grout first.

    A pair adds 1/16 when grout exceeds seal and up to 1/16 as seal rises from 40 to 50.
    """
    terms = [
        f"CAST({grout} > {seal} AS DOUBLE) * {1 / 16}D + least(greatest({seal} - 40D, 0D), 10D) / 160D"
        for seal, grout in zip(catalog.SEAL_FIELDS, catalog.GROUT_FIELDS)
    ]
    return F.expr(f"least({' + '.join(terms)}, 1D)")


def level_by_cuts(p: Column, low: float = 0.3, medium: float = 0.5, high: float = 0.9) -> Column:
    return F.when(p >= high, 4).when(p >= medium, 3).when(p >= low, 2).otherwise(1)


def probability_to_score(p: Column, points) -> Column:
    """Piecewise-linear map, constant outside the points; a missing probability counts as 0."""
    first, last = points[0], points[-1]
    expr = F.when(p.isNull() | (p <= first[0]), first[1])
    for (p0, s0), (p1, s1) in zip(points, points[1:]):
        expr = expr.when(p <= p1, F.lit(s0) + (p - F.lit(p0)) / F.lit(max(p1 - p0, 1e-9)) * F.lit(s1 - s0))
    return expr.otherwise(last[1])


def score_to_probability(score: Column, points) -> Column:
    """Inverse of :func:`probability_to_score`, clamped to the score range."""
    expr = F.lit(points[0][0])
    for (p0, s0), (p1, s1) in zip(points, points[1:]):
        line = F.lit(p0) + (F.lit(s0) - score) / F.lit(s0 - s1) * F.lit(p1 - p0)
        expr = F.when((score <= s0) & (score >= s1), line).otherwise(expr)
    return F.when(score >= points[0][1], points[0][0]).when(score <= points[-1][1], points[-1][0]).otherwise(expr)


def score_for_risk(risk_type: Column, p: Column, risks=None) -> Column:
    expr = F.lit(None).cast("double")
    for key in risks or list(catalog.RISKS):
        expr = F.when(risk_type == key, probability_to_score(p, catalog.RISKS[key].score_points)).otherwise(expr)
    return expr


def scale_by_bounds(x: Column, low: Column, high: Column) -> Column:
    width = high - low
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / width))
    return F.when(width <= F.lit(1e-12), F.lit(0.0)).otherwise(scaled)


def combined_risk(scaled_reconstruction: Column, scaled_isolation: Column, w_rec: float, w_iso: float) -> Column:
    total = w_rec + w_iso
    if not (w_rec >= 0 and w_iso >= 0 and 0 < total < float("inf")):
        raise ValueError("fusion weights must be finite, not negative and not both zero")
    return F.lit(w_rec / total) * scaled_reconstruction + F.lit(w_iso / total) * scaled_isolation


def checked_thresholds(limits: DataFrame, name: str = "stratum") -> DataFrame:
    """Thresholds ``low, medium, high`` that must be finite and rise strictly within [0, 1]; other rows fail the job."""
    rising = (F.col("low") >= 0) & (F.col("low") < F.col("medium")) & (F.col("medium") < F.col("high")) & (F.col("high") <= 1)
    text = F.concat(F.lit("thresholds must rise strictly within [0, 1]: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    bad = F.raise_error(text).cast("double")
    return limits.withColumns({c: F.when(F.coalesce(rising, F.lit(False)), F.col(c)).otherwise(bad) for c in ("low", "medium", "high")})


# Rational coefficients of the error function, W. J. Cody,
# "Rational Chebyshev Approximations for the Error Function", Math. Comp. 23 (1969).
_ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MIDDLE = (
    (
        2.15311535474403846e-8,
        5.64188496988670089e-1,
        8.88314979438837594e0,
        6.61191906371416295e1,
        2.98635138197400131e2,
        8.81952221241769090e2,
        1.71204761263407058e3,
        2.05107837782607147e3,
        1.23033935479799725e3,
    ),
    (
        1.0,
        1.57449261107098347e1,
        1.17693950891312499e2,
        5.37181101862009858e2,
        1.62138957456669019e3,
        3.29079923573345963e3,
        4.36261909014324716e3,
        3.43936767414372164e3,
        1.23033935480374942e3,
    ),
)
_ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
_INV_SQRT_PI = 5.6418958354775628695e-1


def _poly(coefficients, x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def with_normal_cdf(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the standard normal distribution function of columns (``{output: input}``).

    Built from arithmetic, as Spark has no error function. Powers are staged as columns so
    that each is computed once.
    """
    staged = df.withColumns({f"_y_{o}": F.abs(F.col(c)) / F.lit(2.0**0.5) for o, c in columns.items()})
    staged = staged.withColumns({f"_q_{o}": F.col(f"_y_{o}") * F.col(f"_y_{o}") for o in columns})
    staged = staged.withColumns({f"_e_{o}": F.exp(-F.col(f"_q_{o}")) for o in columns})
    staged = staged.withColumns({f"_i_{o}": F.try_divide(F.lit(1.0), F.col(f"_q_{o}")) for o in columns})
    tails = {}
    for o in columns:
        y, square, decay, inverse = (F.col(f"_{p}_{o}") for p in "yqei")
        near = F.lit(1.0) - y * _poly(_ERF_NEAR[0], square) / _poly(_ERF_NEAR[1], square)
        middle = decay * _poly(_ERFC_MIDDLE[0], y) / _poly(_ERFC_MIDDLE[1], y)
        far = decay / y * (F.lit(_INV_SQRT_PI) - inverse * _poly(_ERFC_FAR[0], inverse) / _poly(_ERFC_FAR[1], inverse))
        tails[f"_t_{o}"] = F.when(y <= 0.46875, near).when(y <= 4.0, middle).otherwise(far) * F.lit(0.5)
    out = staged.withColumns(tails)
    out = out.withColumns(
        {o: F.when(F.col(c) < 0, F.col(f"_t_{o}")).otherwise(F.lit(1.0) - F.col(f"_t_{o}")) for o, c in columns.items()}
    )
    return out.drop(*[f"_{p}_{o}" for p in "yqeit" for o in columns])
