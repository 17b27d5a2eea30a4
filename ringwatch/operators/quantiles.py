"""Exact, linearly interpolated quantiles of groups of any size.

``percentile`` merges every distinct value of a group in one task. Here equal values are
counted first, each group is cut into slices at sketched quantiles, and only the slices
that hold a wanted rank are ordered, each in its own task. The sketch only balances the
slices; ranks come from exact counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 8


def _slice_of(value: Column, cuts: Column) -> Column:
    """Number of cuts below the value, by binary search over the padded cut array."""
    steps = F.array(*[F.lit(2**b) for b in reversed(range(SLICE_BITS))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(
            (pos + step <= F.size(cuts)) & (F.get(cuts, pos + step - 1) < value), pos + step
        ).otherwise(pos),
    )


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """One row per key: ``n`` and one column per entry of ``probs``. NULL values are ignored."""
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # a constant stands in for the key when there is one group only
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    keys_ = keys or ["_all"]
    counted = (
        keyed.filter(F.col(value).isNotNull())
        .groupBy(*keys_, F.col(value).alias("_v"))
        .agg(many.alias("_c"))
        .filter("_c > 0")
    )
    grid = [i / 2**SLICE_BITS for i in range(1, 2**SLICE_BITS)]
    cuts = counted.groupBy(*keys_).agg(
        F.percentile_approx("_v", grid, 10000).alias("_cuts"), F.sum("_c").alias("n")
    )
    sliced = counted.join(cuts, keys_).select(
        *keys_, "_v", "_c", "n", _slice_of(F.col("_v"), F.col("_cuts")).alias("_slice")
    )
    totals = sliced.groupBy(*keys_, "_slice").agg(F.sum("_c").alias("_t"), F.first("n").alias("_n"))
    earlier = Window.partitionBy(*keys_).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))

    names = list(probs)

    def rank(n: Column, p: float) -> Column:
        return F.lit(float(p)) * (n - 1).cast("double")

    def low_rank(n: Column, p: float) -> Column:
        return F.floor(rank(n, p)).cast("bigint")

    def high_rank(n: Column, p: float) -> Column:
        return F.least(low_rank(n, p) + 1, n - 1)

    wanted = reduce(
        lambda a, b: a | b,
        [
            (F.col("_before") <= high_rank(F.col("_n"), probs[q]))
            & (F.col("_before") + F.col("_t") > low_rank(F.col("_n"), probs[q]))
            for q in names
        ],
    )
    picked = totals.filter(wanted).select(*keys_, "_slice", "_before")
    run = Window.partitionBy(*keys_, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sliced.join(picked, [*keys_, "_slice"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(run))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_start") <= r) & (F.col("_end") > r), F.col("_v")))

    aggs = [F.first("n").alias("n")]
    for i, q in enumerate(names):
        aggs.append(at(low_rank(F.col("n"), probs[q])).alias(f"_lo{i}"))
        aggs.append(at(high_rank(F.col("n"), probs[q])).alias(f"_hi{i}"))
    out = placed.groupBy(*keys_).agg(*aggs)
    cols = [*keys, "n"]
    for i, q in enumerate(names):
        part = rank(F.col("n"), probs[q]) - low_rank(F.col("n"), probs[q]).cast("double")
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(q))
    return out.select(*cols)
