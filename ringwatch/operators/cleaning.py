"""Column normalisation, row filters and deduplication."""

from __future__ import annotations

import logging


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import catalog
from ringwatch.functions import rounding, text
from ringwatch.operators.ordered import first_per_key

# Names a ring column may have.
RING_COLUMNS = ["ring_no", "Ring.No", "Ring_Index", "Ring_No", "RING", "ring"]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def normalize_ring(df: DataFrame, candidates=None) -> DataFrame:
    """Whole-number ``ring`` from the first ring column present; unreadable rows are dropped."""
    source = next((c for c in candidates or RING_COLUMNS if c in df.columns), None)
    if source is None:
        raise ValueError("no ring column present")
    ring = text.to_ring(_quoted(source))
    rest = [_quoted(c) for c in df.columns if c not in (source, "ring")]
    return df.select(ring.alias("ring"), *rest).filter(F.col("ring").isNotNull())


def to_double(df: DataFrame, columns) -> DataFrame:
    """Numeric text to double; unreadable text and NaN become NULL."""
    return df.withColumns(
        {c: F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double")) for c in columns}
    )


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))


def normalize_tbm(df: DataFrame) -> DataFrame:
    """Excavation rows with a ring and at least one of the five machine features."""
    require_columns(df, catalog.TBM_FEATURES)
    out = to_double(normalize_ring(df), catalog.TBM_FEATURES)
    return out.na.drop(how="all", subset=catalog.TBM_FEATURES)


def normalize_geo(df: DataFrame, order_col: str, keys=()) -> DataFrame:
    """One geology row per ring: features zero-filled, first known value per column in file order."""
    require_columns(df, ["cluster_label", *catalog.GEO_FEATURES])
    value_columns = ["cluster_label", *catalog.GEO_FEATURES]
    filled = to_double(normalize_ring(df), value_columns).na.fill(0.0, catalog.GEO_FEATURES)

    def first_known(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c)

    return filled.groupBy(*keys, "ring").agg(*[first_known(c) for c in value_columns])


def dedupe_by_time(df: DataFrame, keys=("shield_id",), time_col="time", tie="point_id") -> DataFrame:
    """First arriving row of each sampling instant of a shield."""
    return first_per_key(df, [*keys, time_col], [F.col(tie)])


def ring_of_point(df: DataFrame, candidates) -> DataFrame:
    """Ring from the first present value among several columns; unreadable rows are dropped."""
    ring = text.to_ring(F.coalesce(*[_quoted(c).cast("string") for c in candidates]))
    return df.withColumn("ring", ring).filter(F.col("ring").isNotNull())


def drop_all_null_features(df: DataFrame, features=None) -> DataFrame:
    return df.na.drop(how="all", subset=list(features or catalog.FEATURES))


def filter_by_stratum(df: DataFrame, target: str, label_col: str = "cluster_label") -> DataFrame:
    number = F.col(label_col).cast("string").try_cast("double")
    return df.filter(text.stratum_key(number) == F.lit(str(target)))


def available_strata(df: DataFrame, label_col: str = "cluster_label") -> DataFrame:
    number = F.col(label_col).cast("string").try_cast("double")
    return df.select(text.stratum_key(number).alias("stratum")).filter(F.col("stratum").isNotNull()).distinct()


def missing_strata(df: DataFrame, expected=None, label_col: str = "cluster_label") -> DataFrame:
    """Expected labels without any row; the job may start only when this is empty."""
    labels = expected or catalog.EXPECTED_STRATA
    wanted = df.sparkSession.createDataFrame([(s,) for s in labels], "stratum string")
    return wanted.join(available_strata(df, label_col), "stratum", "left_anti")


def check_strata(df: DataFrame, expected=None) -> DataFrame:
    """Rows of ``df`` (``stratum``) with an expected label; fails if an expected label has no row.

    The check is part of the plan of one aggregate, which also counts the rows of other labels; their
    number is logged and they are left out.
    """
    labels = list(expected or catalog.EXPECTED_STRATA)
    wanted = F.array(*[F.lit(s) for s in labels])
    found = df.agg(F.collect_set(F.when(F.col("stratum").isin(labels), F.col("stratum"))).alias("have"),
                   F.count_if(~F.col("stratum").isin(labels)).alias("extra"))
    missing = F.array_except(wanted, "have")
    said = F.concat(F.lit("missing strata: "), F.array_join(missing, ", "))
    extra = found.select("extra", F.assert_true(F.size(missing) == 0, said).alias("ok")).first()["extra"]
    if extra:
        logging.getLogger(__name__).warning("%d rows of other strata are left out", extra)
    return df.filter(F.col("stratum").isin(labels))


def round_columns(df: DataFrame, columns, digits: int = 2) -> DataFrame:
    """Numbers and numeric text to ``digits`` decimals; other text stays as it is.

    Columns of numbers become doubles, columns of text remain text.
    """
    kinds = dict(df.dtypes)
    as_text = [c for c in columns if kinds[c] == "string"]
    kept = df.withColumns({f"__{c}": F.col(c) for c in as_text})
    numbers = kept.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
    rounded = rounding.with_rounded(numbers, {c: digits for c in columns})
    texts = {c: F.coalesce(F.col(c).cast("string"), F.col(f"__{c}")) for c in as_text}
    return rounded.withColumns(texts).drop(*[f"__{c}" for c in as_text])


def resolve_shield(requests: DataFrame, shields: DataFrame) -> DataFrame:
    """Project code of each requested shield; ``status`` tells why one could not be resolved."""
    wanted = requests.withColumn("shield_id", F.lower(F.trim(F.col("requested"))))
    status = (
        F.when(F.coalesce(F.col("shield_id"), F.lit("")) == "", "missing")
        .when(~F.col("shield_id").rlike("^[A-Za-z0-9_]+$"), "malformed")
        .when(F.col("project_code").isNull(), "unknown")
        .otherwise("ok")
    )
    return wanted.join(shields, "shield_id", "left").withColumn("status", status)


def format_model_points(df: DataFrame, label_col: str = "cluster_label") -> DataFrame:
    """Model input columns: absent geology counts as zero, absent machine readings stay NULL."""
    cols = [F.nanvl(F.col(f).try_cast("double"), F.lit(None).cast("double")).alias(f) for f in catalog.TBM_FEATURES]
    cols += [
        F.coalesce(F.nanvl(F.col(f).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(f)
        for f in catalog.GEO_FEATURES
    ]
    label = F.coalesce(F.col(label_col).cast("string").try_cast("double"), F.lit(0.0)).alias("cluster_label")
    state = (F.coalesce(F.col("state"), F.lit(1)) if "state" in df.columns else F.lit(1)).alias("state")
    return df.select("shield_id", "point_id", "ring", F.col("time").alias("timestamp"), state, label, *cols)
