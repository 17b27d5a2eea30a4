"""End-to-end reports, each over all shields and rings at once; a single request is the same
plan with a filter in front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.functions import text
from ringwatch.functions.rounding import with_rounded
from ringwatch.operators import cleaning, joins, profiles, records, rules, sequences, triggers
from ringwatch.operators.ordered import add_index, first_per_key, time_slice
from ringwatch.plans import training
from ringwatch.scratch import materialize, stored
from ringwatch.sources import tables

KEY_PARAMETER_SAMPLE = 300


def _labels(spark) -> DataFrame:
    # four rows
    return F.broadcast(catalog.risk_catalog(spark).select("risk_type", "risk_label"))


def latest_risk(rows: DataFrame) -> DataFrame:
    """Latest record per (risk, project) with cleaned texts; absent columns show as '-'."""
    best = records.latest_record(records.risk_records(rows), ["risk_type", "project_code"])

    def shown(name: str):
        return text.clean_json_value(F.col(name)) if name in best.columns else F.lit("-")

    safety = F.col("safety_level") if "safety_level" in best.columns else F.lit(None).cast("string")
    safety = F.when(F.coalesce(F.trim(safety), F.lit("")) == "", F.col("risk_level")).otherwise(safety)
    measures = shown("fault_measures" if "fault_measures" in best.columns else "measures")
    out = best.select(
        "risk_type",
        "project_code",
        F.coalesce(text.to_ring(F.col("ring")).cast("string"), F.lit("-")).alias("ring"),
        text.clean_json_value(safety).alias("safety_level"),
        F.col("risk_score").cast("string").try_cast("double").alias("risk_score"),
        measures.alias("fault_measures"),
        shown("impact_parameters").alias("impact_parameters"),
        shown("potential_risk").alias("potential_risk"),
    )
    return with_rounded(out, {"risk_score": 2}).join(_labels(rows.sparkSession), "risk_type").drop("risk_type")


def latest_risk_summary(rows: DataFrame) -> DataFrame:
    return records.latest_summary(rows).join(_labels(rows.sparkSession), "risk_type").drop("risk_type")


def risk_history(rows: DataFrame, limit=records.DEFAULT_LIMIT) -> DataFrame:
    """Warning records with counts, in report order (``position``)."""
    found = records.risk_history(rows, limit)
    return found.join(_labels(rows.sparkSession), "risk_type").select(
        "risk_label",
        "project_code",
        F.coalesce(text.to_ring(F.col("ring")).cast("string"), F.lit("-")).alias("ring"),
        text.clean_json_value(F.col("risk_level")).alias("risk_level"),
        "warning_time",
        "high_risk_count",
        "mid_risk_count",
        "low_risk_count",
        "position",
    )


def available_parameters(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows with a name, a code and a unit."""
    named = dictionary.filter("point_unit <> '' AND point_code <> '' AND point_cn_name <> ''")
    return named.select(
        "shield_id", F.col("point_cn_name").alias("name"), F.col("point_code").alias("code"), F.col("point_unit").alias("unit")
    )


def parameter_history(
    history: DataFrame, dictionary: DataFrame, names: list[str], start: str, end: str, keep: list[str] = ()
) -> DataFrame:
    """Local time, value and unit of the named parameters; missing readings count as 0."""
    if not names:
        raise ValueError("name at least one parameter")
    spark = history.sparkSession
    requested = spark.createDataFrame([(n,) for n in names], "point_cn_name string")
    # a row per name: they choose the columns to read
    mapping = {r["point_cn_name"]: r for r in joins.history_mapping(requested, dictionary).take(len(names))}
    found = [mapping[n] for n in names if n in mapping and mapping[n]["code"] in history.columns]
    if not found:
        raise ValueError("no matching parameters")
    rows = tables.history_scan(history.select(*keep, "time", *dict.fromkeys(r["code"] for r in found)), start, end)
    cells = F.array(
        *[
            F.struct(
                F.lit(r["point_cn_name"]).alias("name"),
                F.coalesce(F.col(r["code"]).cast("double"), F.lit(0.0)).alias("value"),
                F.lit(r["unit"]).alias("unit"),
            )
            for r in found
        ]
    )
    local = F.date_format(text.shift_to_local(F.col("time")), "yyyy/MM/dd HH:mm:ss").alias("time")
    return rows.select(*keep, local, F.explode(cells).alias("c")).select(*keep, "time", "c.*")


def training_data_summary(spark, files: str, expected=None) -> DataFrame:
    """Dry run of the training input: read, fuse and check the files, summarise their strata."""
    return profiles.stratum_summary(training.training_input(spark, files, expected))


def key_parameters(points: DataFrame, k: int = 6, sample: int = KEY_PARAMETER_SAMPLE) -> DataFrame:
    """Sampled readings of the last k rings for every center ring, values to two decimals.

    Rings are sampled once each; only the samples are copied to the centers they serve.
    """
    return _key_samples(points, k, sample).drop("time")


def _key_samples(points: DataFrame, k: int, sample: int) -> DataFrame:
    fields = catalog.key_parameter_fields()
    pts = points.select("shield_id", "ring", "time", "point_id", *fields)
    sliced = pts.withColumn("_s", time_slice(pts))
    indexed = add_index(sliced, ["shield_id", "ring"], "_s", ["time", "point_id"], total="n")
    sampled = sequences.evenly_sampled(indexed, sample).withColumn(
        "time_text", text.format_time_local(text.shift_to_local(F.col("time")))
    )
    rounded = cleaning.round_columns(sampled.select("shield_id", "ring", "point_id", "time", "time_text", *fields), fields)
    near = joins.last_k_rings(joins.rings_with_index(points), k)
    return near.join(rounded, ["shield_id", "ring"]).select(
        "shield_id", "center_ring", "ring", "point_id", "time", "time_text", *fields
    )


def key_parameter_lists(points: DataFrame, risks: list[str] | None = None, k: int = 6, sample: int = KEY_PARAMETER_SAMPLE) -> DataFrame:
    """``shield_id, ring, risk_type, key_parameters`` for every ring and risk.

    ``key_parameters`` is an array in time order of ``time`` (local text) and ``values``, a map from
    a field's label to its value and unit. It holds the samples of the last ``k`` rings, so at most
    ``k * sample`` entries whatever the size of a ring; entries without a time come last.
    """
    fields = catalog.key_parameter_fields()
    entry = F.struct(F.col("time").isNull().alias("untimed"), "time", "point_id", "time_text", *fields)
    lists = _key_samples(points, k, sample).groupBy("shield_id", F.col("center_ring").alias("ring")).agg(
        F.sort_array(F.collect_list(entry)).alias("samples")  # k * sample entries at most
    )

    def shown(risk: str):
        own = catalog.RISKS[risk].key_fields
        labels = F.array(*[F.lit(catalog.FIELD_LABELS[f]) for f in own])

        def item(x):
            cells = [F.struct(x[f].cast("double").alias("value"), F.lit(catalog.field_unit(f)).alias("unit")) for f in own]
            return F.struct(x["time_text"].alias("time"), F.map_from_arrays(labels, F.array(*cells)).alias("values"))

        return F.transform("samples", item)

    per_risk = [F.struct(F.lit(r).alias("risk_type"), shown(r).alias("key_parameters")) for r in risks or list(catalog.RISKS)]
    return lists.select("shield_id", "ring", F.explode(F.array(*per_risk)).alias("e")).select("shield_id", "ring", "e.*")


def with_request_parts(report: DataFrame, points: DataFrame, shields: DataFrame, risks: list[str] | None = None, sample: int = KEY_PARAMETER_SAMPLE) -> DataFrame:
    """Report rows with the project code of their shield and the key parameters of their risk.

    ``shields`` is (shield_id, project_code); an unlisted shield has a null code.
    """
    lists = key_parameter_lists(points, risks, sample=sample)
    return report.join(shields.select("shield_id", "project_code"), "shield_id", "left").join(lists, ["shield_id", "ring", "risk_type"], "left")


def warning_parameter_text(risk_type, fields_by_risk: dict):
    """'label=value+unit' cells of a risk's fields, in display order."""
    expr = F.lit("-")
    for key, fields in fields_by_risk.items():
        cells = [
            F.concat(F.lit(catalog.FIELD_LABELS[f] + "="), text.value_with_unit(F.col(f), F.lit(catalog.field_unit(f))))
            for f in fields
        ]
        expr = F.when(risk_type == key, F.concat_ws("；", *cells)).otherwise(expr)
    return expr


def ring_rule_report(raw_points: DataFrame) -> DataFrame:
    """One row per (shield, ring, rule risk) with level, score, texts and first warning."""
    return _rule_rows(cleaning.dedupe_by_time(raw_points))


def _rule_rows(points: DataFrame) -> DataFrame:
    # one row per ring and risk, read twice below
    result = materialize(triggers.ring_risk(rules.score_points(points)))
    fields = list(dict.fromkeys(f for r in catalog.RULE_RISKS for f in catalog.RISKS[r].fields))
    warned = result.filter("warning_time IS NOT NULL").select("shield_id", "ring", "risk_type", F.col("warning_time").alias("time"))
    readings = points.select("shield_id", "ring", "time", *fields).join(
        warned.select("shield_id", "ring", "time").distinct(), ["shield_id", "ring", "time"], "left_semi"
    )
    at_warning = cleaning.round_columns(warned.join(readings, ["shield_id", "ring", "time"]), fields).select(
        "shield_id",
        "ring",
        "risk_type",
        warning_parameter_text(F.col("risk_type"), {r: catalog.RISKS[r].fields for r in catalog.RULE_RISKS}).alias(
            "warning_parameters"
        ),
    )
    with_params = result.join(at_warning, ["shield_id", "ring", "risk_type"], "left")
    texts = joins.attach_texts(with_params)
    return (
        texts.join(_labels(points.sparkSession), "risk_type")
        .join(F.broadcast(impact_parameters(points.sparkSession)), "risk_type")
        .withColumns(
            {
                "risk_level": text.level_symbol(F.col("safety_level")),
                "warning_text": F.coalesce(text.format_time_local(text.shift_to_local(F.col("warning_time"))), F.lit("-")),
                "warning_parameters": F.coalesce("warning_parameters", F.lit("-")),
            }
        )
    )


def impact_parameters(spark) -> DataFrame:
    """Labels of each risk's displayed fields in one text (four rows)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "label")))
    return catalog.display_fields(spark).groupBy("risk_type").agg(
        F.array_join(F.transform(ordered, lambda x: x["label"]), "，").alias("impact_parameters")
    )


def ring_risk_report(raw_points: DataFrame, candidates: DataFrame, geo: DataFrame, models, shields: DataFrame | None = None, sample: int = KEY_PARAMETER_SAMPLE) -> DataFrame:
    """All four risks per (shield, ring). Mud cake parameters come from the ring's first point.

    With ``shields`` (shield_id, project_code) the rows also bear ``project_code`` and ``key_parameters``.
    Points are deduplicated once, into a table that all parts of the report read.
    """
    points = stored(cleaning.dedupe_by_time(raw_points), "report-points")
    rule_rows = _rule_rows(points)
    scores = training.score_shields(points, candidates, geo, models)
    mud = training.mud_cake_results(points, scores, models)
    fields = list(catalog.RISKS["mud_cake"].fields)
    first = first_per_key(points.select("shield_id", "ring", "time", "point_id", *fields), ["shield_id", "ring"], ["time", "point_id"])
    params = first.select(
        "shield_id",
        "ring",
        warning_parameter_text(F.lit("mud_cake"), {"mud_cake": fields}).alias("warning_parameters"),
    )
    spark = raw_points.sparkSession
    mud_rows = (
        joins.attach_texts(mud.join(params, ["shield_id", "ring"]))
        .join(_labels(spark), "risk_type")
        .join(F.broadcast(impact_parameters(spark)), "risk_type")
        .withColumns(
            {
                "risk_level": text.level_symbol(F.col("safety_level")),
                "warning_text": F.coalesce(text.format_time_local(text.shift_to_local(F.col("warning_time"))), F.lit("-")),
            }
        )
    )
    columns = [
        "shield_id", "ring", "risk_type", "risk_label", "safety_level", "risk_level", "probability", "risk_score", "potential_risk",
        "fault_cause", "fault_reason", "fault_reason_analysis", "fault_measures", "impact_parameters", "warning_text", "warning_parameters",
    ]
    rows = rule_rows.select(*columns).unionByName(mud_rows.select(*columns))
    return rows if shields is None else with_request_parts(rows, points, shields, sample=sample)
