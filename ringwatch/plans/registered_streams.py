"""Registered queries that run the point adapter as a file stream; same SQL as the batch ones."""

from __future__ import annotations

from ringwatch.plans.registered_points import ORACLES as BATCH
from ringwatch.scratch import new_folder
from ringwatch.sources.adapters import VIEWS, table
from ringwatch.streaming import rules as stream_rules
from ringwatch.streaming import triggers as stream_triggers

QUERIES: dict = {}
ORACLES: dict = {}


def _point_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = stream_rules.read_files(spark, sf_dir, schema, "events.parquet")
    return spark.sql(VIEWS["fx_points"], events=events)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def st1_stream_scores(spark, sf_dir):
    out = new_folder(spark, "scores")
    _finish(stream_rules.write_scores(stream_rules.score_stream(_point_stream(spark, sf_dir)), out, out + "-state"))
    return spark.read.parquet(out)


def st2_stream_ring_risk(spark, sf_dir):
    folder = new_folder(spark, "ring-risk")
    _finish(stream_triggers.run_trigger(_point_stream(spark, sf_dir), folder))
    return stream_triggers.latest_results(spark, folder)


QUERIES["st1_stream_scores"] = st1_stream_scores
ORACLES["st1_stream_scores"] = BATCH["r5_assess_points"]
QUERIES["st2_stream_ring_risk"] = st2_stream_ring_risk
ORACLES["st2_stream_ring_risk"] = BATCH["a1_ring_risk_trigger"]
