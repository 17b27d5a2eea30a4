"""Ring-level results from runs of consecutive warning points.

A run is a stretch of valid points, in time order, at or above a priority. Runs are found
inside time slices and joined across slice borders afterwards: within a ring every run has
a distinct number of milder points before it, so local counts plus slice offsets identify
a run wherever its pieces lie. Only a few rows per slice leave the big shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.operators import rules
from ringwatch.operators.ordered import SLICE_SECONDS, time_slice

RING_KEYS = ["shield_id", "ring", "risk_type"]
THRESHOLDS = (4, 3, 2)


def slice_summaries(scored: DataFrame, n: int) -> DataFrame:
    """One row per (ring, risk, slice, threshold): break count, border runs, first inner run."""
    part = [*RING_KEYS, "slice"]
    order = Window.partitionBy(*part).orderBy("time", "point_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pri, p = F.col("priority"), F.col("probability")
    cols = [*part, "time", "priority", "probability", F.row_number().over(order).alias("rn")]
    for t in THRESHOLDS:
        miss = F.when(pri < t, 1).otherwise(0)
        cols += [F.sum(miss).over(so_far).alias(f"b{t}"), F.sum(miss).over(whole).alias(f"nb{t}")]
    cols += [
        F.count(F.lit(1)).over(whole).alias("points"),
        F.max(F.when(pri == 2, p)).over(whole).alias("low_p"),
        F.max(F.when(pri == 1, p)).over(whole).alias("none_p"),
        F.max(p).over(whole).alias("any_p"),
    ]
    # calm rows only count; one row per slice is kept to carry the totals
    placed = scored.select(*cols).filter("priority >= 2 OR rn = 1")
    per_threshold = F.explode(
        F.array(*[F.struct(F.lit(t).alias("level"), F.col(f"b{t}").alias("b"), F.col(f"nb{t}").alias("nb")) for t in THRESHOLDS])
    )
    long = placed.select(*part, "time", "priority", "probability", "points", "low_p", "none_p", "any_p", per_threshold.alias("e")).select(
        "*", "e.level", "e.b", "e.nb"
    )
    hit = F.col("priority") >= F.col("level")
    runs = long.groupBy(*part, "level", "b").agg(
        F.count_if(hit).alias("len"),
        F.max(F.when(hit, F.col("probability"))).alias("p"),
        F.min(F.when(hit, F.col("time"))).alias("t"),
        *[F.max(c).alias(c) for c in ("nb", "points", "low_p", "none_p", "any_p")],
    )
    first, last = F.col("b") == 0, (F.col("b") == F.col("nb")) & (F.col("b") > 0)
    inner = (F.col("len") >= n) & (F.col("b") > 0) & (F.col("b") < F.col("nb"))
    b_inner = F.when(inner, F.col("b"))
    return runs.groupBy(*part, "level").agg(
        *[F.max(c).alias(c) for c in ("nb", "points", "low_p", "none_p", "any_p")],
        *[F.max(F.when(first, F.col(c))).alias(f"first_{c}") for c in ("len", "p", "t")],
        *[F.max(F.when(last, F.col(c))).alias(f"last_{c}") for c in ("len", "p", "t")],
        F.min(b_inner).alias("inner_b"),
        *[F.min_by(c, b_inner).alias(f"inner_{c}") for c in ("len", "p", "t")],
    )


def warning_runs(scored: DataFrame, n: int = catalog.TRIGGER_LENGTH, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Per (ring, risk): point totals and the first run of ``n`` points at each threshold."""
    sliced = scored.withColumn("slice", time_slice(scored, "time", seconds))
    return merged_runs(slice_summaries(sliced, n), n, ["slice"])


def merged_runs(summary: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Totals and first runs from the summaries of pieces that follow each other by ``order``.

    The merge is associative: pieces may come from anywhere, as long as their spans do not overlap.
    """
    earlier = Window.partitionBy(*RING_KEYS, "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("offset", F.coalesce(F.sum("nb").over(earlier), F.lit(0)))

    def piece(b, name):
        return F.struct(
            (F.col("offset") + b).alias("run"),
            F.col(f"{name}_len").alias("len"),
            F.col(f"{name}_p").alias("p"),
            F.col(f"{name}_t").alias("t"),
        )

    pieces = F.array(piece(F.lit(0), "first"), piece(F.col("inner_b"), "inner"), piece(F.col("nb"), "last"))
    joined = (
        placed.select(*RING_KEYS, "level", F.explode(pieces).alias("r"))
        .select(*RING_KEYS, "level", "r.*")
        .filter("len > 0")
        .groupBy(*RING_KEYS, "level", "run")
        .agg(F.sum("len").alias("len"), F.max("p").alias("p"), F.min("t").alias("t"))
        .filter(F.col("len") >= n)
        .groupBy(*RING_KEYS, "level")
        .agg(F.min_by("p", "run").alias("p"), F.min_by("t", "run").alias("t"))
    )
    firsts = joined.groupBy(*RING_KEYS).agg(
        F.max(F.when(F.col("level") == 4, F.col("p"))).alias("high_p"),
        F.max(F.when(F.col("level") == 3, F.col("p"))).alias("medium_p"),
        F.max(F.when(F.col("level") == 2, F.col("t"))).alias("warning_time"),
    )
    totals = (
        summary.filter("level = 2")
        .groupBy(*RING_KEYS)
        .agg(
            F.sum("points").alias("points"),
            F.max("low_p").alias("low_p"),
            F.max("none_p").alias("none_p"),
            F.max("any_p").alias("any_p"),
        )
    )
    return totals.join(firsts, RING_KEYS, "left")


def ring_risk(scored: DataFrame, n: int = catalog.TRIGGER_LENGTH, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Final level, probability, score and first warning time of every ring and rule risk.

    Isolated medium or high points without low or calm ones end as no risk but keep their probability.
    """
    return run_results(warning_runs(scored, n, seconds))


def run_results(runs: DataFrame) -> DataFrame:
    """Level, probability, score and first warning time from totals and first runs."""
    priority = (
        F.when(F.col("high_p").isNotNull(), 4)
        .when(F.col("medium_p").isNotNull(), 3)
        .when(F.col("low_p").isNotNull(), 2)
        .otherwise(1)
    )
    probability = F.coalesce("high_p", "medium_p", "low_p", "none_p", "any_p")
    out = runs.select(*RING_KEYS, "points", "warning_time", priority.alias("priority"), probability.alias("probability"))
    return rules.with_score(out)
