"""Consecutive-trigger results kept up to date on a stream of points.

The state is a table of run summaries: for every ring, risk and time slice, pieces of consecutive points
with their span in time, as the batch operator makes them for slices. A micro-batch is summarised in
Spark, with a row per piece; pieces that follow each other merge at any later time, whatever
batch they came in. Points that fall between points of an earlier batch (late ones) make their slice be
summarised again, from the stored points of this slice alone. No task holds a ring, and nothing goes
over points one by one.

Every micro-batch writes folders of its own (points, pieces, results), so that a batch that is run again
replaces what it wrote, and reads those of earlier batches only. Nothing is dropped by a watermark:
a ring goes on whenever its next points come.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ringwatch import catalog
from ringwatch.operators import rules
from ringwatch.operators.ordered import SLICE_SECONDS, time_slice
from ringwatch.operators.triggers import RING_KEYS, merged_runs, run_results, slice_summaries

SLICE_KEYS = [*RING_KEYS, "slice"]


def pieces_of(points: DataFrame, n: int) -> DataFrame:
    """Run summaries of the points' slices, with the first and last point of each."""
    place = F.struct("time", "point_id")
    spans = points.groupBy(*SLICE_KEYS).agg(F.min(place).alias("first_point"), F.max(place).alias("last_point"))
    return slice_summaries(points, n).join(spans, SLICE_KEYS)


def _saved(spark, folder: str, like: DataFrame, below: int) -> DataFrame | None:
    """What earlier batches wrote below a folder; None if there are none."""
    schema = StructType([*like.schema.fields, StructField("batch", LongType())])
    try:
        found = spark.read.schema(schema).parquet(folder).filter(F.col("batch") < below)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found


def _current(pieces: DataFrame) -> DataFrame:
    """Pieces that count: those written since their slice was last summarised as a whole."""
    whole = pieces.filter("whole").groupBy(*SLICE_KEYS).agg(F.max("batch").alias("_since"))
    return pieces.join(whole, SLICE_KEYS, "left").filter("_since IS NULL OR batch >= _since").drop("_since")


def advance(points: DataFrame, batch_id: int, folder: str, n: int = catalog.TRIGGER_LENGTH) -> None:
    """Take in one micro-batch of scored points (with their ``slice``) and write the results of the rings it touches."""
    spark = points.sparkSession
    points.write.mode("overwrite").parquet(f"{folder}/points/batch={batch_id}")
    now = spark.read.schema(points.schema).parquet(f"{folder}/points/batch={batch_id}")
    new = pieces_of(now, n).withColumn("whole", F.lit(False))
    before = _saved(spark, f"{folder}/pieces", new, batch_id)
    if before is not None:
        spans = [*SLICE_KEYS, "first_point", "last_point"]
        own = new.filter("level = 2").select(*spans)
        there = _current(before).filter("level = 2").select(*SLICE_KEYS, F.col("first_point").alias("_first"), F.col("last_point").alias("_last"))
        crossed = own.join(there, SLICE_KEYS).filter("first_point <= _last AND _first <= last_point").select(*SLICE_KEYS).distinct()
        past = _saved(spark, f"{folder}/points", points, batch_id).drop("batch")
        again = past.unionByName(now).join(crossed, SLICE_KEYS, "left_semi")
        new = new.join(crossed, SLICE_KEYS, "left_anti").unionByName(pieces_of(again, n).withColumn("whole", F.lit(True)))
    new.write.mode("overwrite").parquet(f"{folder}/pieces/batch={batch_id}")
    pieces = _current(_saved(spark, f"{folder}/pieces", new, batch_id + 1))
    touched = pieces.filter(F.col("batch") == batch_id).select(*RING_KEYS).distinct()
    runs = merged_runs(pieces.join(touched, RING_KEYS, "left_semi"), n, ["slice", "first_point"])
    run_results(runs).write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")


def run_trigger(points: DataFrame, folder: str, n: int = catalog.TRIGGER_LENGTH, seconds: int = SLICE_SECONDS) -> StreamingQuery:
    """Keep the results of every ring and rule risk up to date in ``folder`` until the available points are taken in."""
    scored = rules.score_points(points).select(*RING_KEYS, "point_id", "time", "priority", "probability")
    sliced = scored.withColumn("slice", time_slice(scored, "time", seconds))
    return (
        sliced.writeStream.foreachBatch(lambda batch, batch_id: advance(batch, batch_id, folder, n))
        .option("checkpointLocation", f"{folder}/offsets")
        .trigger(availableNow=True)
        .start()
    )


def latest_results(spark, folder: str) -> DataFrame:
    """Newest result of each ring and risk."""
    saved = spark.read.parquet(f"{folder}/results")
    rest = [c for c in saved.columns if c not in (*RING_KEYS, "batch")]
    best = saved.groupBy(*RING_KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return best.select(*RING_KEYS, "r.*")
