"""String, level and time helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ring(c: Column) -> Column:
    """Numeric text or number to a whole ring, cut toward zero; anything else is NULL."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def stratum_key(c: Column) -> Column:
    """Whole numbers as integer text, other numbers with '_' for '.', else trimmed text."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    whole = number.try_cast("bigint")
    return (
        F.when(whole.isNotNull() & (whole.cast("double") == number), whole.cast("string"))
        .when(number.isNotNull(), F.regexp_replace(number.cast("string"), "\\.", "_"))
        .otherwise(text)
    )


def level_from_model_text(c: Column) -> Column:
    """Model or rule level names to the four labels; unknown names give NULL."""
    t = F.trim(c)
    return (
        F.when(t.isin("high", "高风险", "高风险Ⅳ", "Ⅳ", "IV"), "高风险Ⅳ")
        .when(t.isin("medium", "中风险", "中风险Ⅲ", "Ⅲ", "III"), "中风险Ⅲ")
        .when(t.isin("low", "低风险", "低风险Ⅱ", "Ⅱ", "II"), "低风险Ⅱ")
        .when(t.isin("no_risk", "none", "normal", "无风险", "无风险Ⅰ", "Ⅰ", "I"), "无风险Ⅰ")
    )


def level_symbol(c: Column) -> Column:
    expr = F.lit("-")
    for symbol in ("Ⅳ", "Ⅲ", "Ⅱ", "Ⅰ"):
        expr = F.when(c.contains(symbol), symbol).otherwise(expr)
    return expr


def level_priority(c: Column) -> Column:
    return (
        F.when(c.contains("Ⅳ") | c.contains("IV") | c.contains("高风险"), 4)
        .when(c.contains("Ⅲ") | c.contains("III") | c.contains("中风险"), 3)
        .when(c.contains("Ⅱ") | c.contains("II") | c.contains("低风险"), 2)
        .when(c.contains("Ⅰ") | c.contains("无风险"), 1)
        .otherwise(0)
    )


def safety_level(c: Column) -> Column:
    """Keep text that carries a level symbol, else complete the bare name; default none."""
    return (
        F.when(c.rlike("[ⅠⅡⅢⅣ]"), c)
        .when(c.contains("高风险"), "高风险Ⅳ")
        .when(c.contains("中风险"), "中风险Ⅲ")
        .when(c.contains("低风险"), "低风险Ⅱ")
        .otherwise("无风险Ⅰ")
    )


def clean_json_value(c: Column) -> Column:
    """Blank or null-like text to '-', JSON lists joined, JSON strings unquoted, the rest trimmed."""
    s = F.trim(c)
    items = F.from_json(s, "array<string>", {"allowSingleQuotes": "false"})
    parsed = F.try_parse_json(s)
    listed = F.array_join(
        F.transform(
            items,
            lambda x: F.when(x.isNull() | (F.lower(F.trim(x)).isin("", "null", "none")), "None").otherwise(F.trim(x)),
        ),
        "，",
    )
    unquoted = F.trim(F.try_variant_get(parsed, "$", "string"))
    double_quoted = s.startswith('"') & s.endswith('"') & (F.length(s) >= 2)
    single_quoted = s.startswith("'") & s.endswith("'") & (F.length(s) >= 2)
    stripped = F.substring(s, F.lit(2), F.length(s) - 2)
    return (
        F.when(s.isNull() | F.lower(s).isin("", "null", "none"), "-")
        .when(s.startswith("[") & parsed.isNotNull(), listed)
        .when(
            double_quoted & parsed.isNotNull(),
            F.when(F.lower(unquoted).isin("", "null", "none"), "-").otherwise(unquoted),
        )
        .when(double_quoted | single_quoted, stripped)
        .otherwise(s)
    )


# Accepted time formats; the first three are UTC and move to local time.
_UTC_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"]
_GMT_TEXT = r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$"
_LOCAL_FORMATS = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm"]
LOCAL_OFFSET_HOURS = 8


def _ntz(c: Column, fmt: str) -> Column:
    # parsed as zone-less wall time, so the session zone cannot move it
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def shift_to_local(c: Column) -> Column:
    return c + F.expr(f"INTERVAL '{LOCAL_OFFSET_HOURS}' HOUR")


def parse_time(c: Column) -> Column:
    """Text in one of six layouts to local wall time; unknown text gives NULL."""
    s = F.trim(c)
    gmt = _ntz(F.regexp_extract(s, _GMT_TEXT, 1), "dd MMM yyyy HH:mm:ss")
    fraction = F.regexp_extract(s, r"\.(\d{1,6})Z$", 1)
    padded = F.regexp_replace(s, r"\.\d{1,6}Z$", F.concat(F.lit("."), F.rpad(fraction, 6, "0"), F.lit("Z")))
    return F.coalesce(
        shift_to_local(_ntz(s, _UTC_FORMATS[0])),
        shift_to_local(_ntz(padded, _UTC_FORMATS[1])),
        shift_to_local(gmt),
        *[_ntz(s, fmt) for fmt in _LOCAL_FORMATS],
    )


def format_time_local(c: Column) -> Column:
    """year/month/day hour:minute:second with unpadded month, day and hour."""
    return F.date_format(c, "y/M/d H:mm:ss")


def value_with_unit(value: Column, unit: Column) -> Column:
    """Text of a value followed by its unit; a missing or blank value is '-'."""
    text = value.cast("string")
    blank = text.isNull() | F.lower(F.trim(text)).isin("", "null", "none", "-")
    return F.when(blank, "-").otherwise(F.concat(text, F.coalesce(unit, F.lit(""))))
