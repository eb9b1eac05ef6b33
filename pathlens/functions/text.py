"""Text rendering with built-in string functions (X14) and JSON payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import market_label

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders with string columns (null -> 'None')."""
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(values[m.group(1)].cast("string"), F.lit("None")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def money(c: Column) -> Column:
    """Two decimals with thousands separators (``{:,.2f}``)."""
    return F.format_number(c, 2)


def grouped_int(c: Column) -> Column:
    """Whole number with thousands separators (``{:,}``)."""
    return F.format_number(c.cast("long"), 0)


def one_decimal(c: Column) -> Column:
    """One decimal, no separators (``{:.1f}``)."""
    return F.regexp_replace(F.format_number(c, 1), ",", "")


def two_decimals(c: Column) -> Column:
    """Two decimals, no separators (``{:.2f}``)."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


# ---------------------------------------------------------------- payloads ----

WEATHER_PAYLOAD = T.StructType([
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()), T.StructField("humidity", T.LongType()),
        T.StructField("pressure", T.LongType())])),
    T.StructField("weather", T.ArrayType(T.StructType([
        T.StructField("main", T.StringType()), T.StructField("description", T.StringType())]))),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
    T.StructField("visibility", T.DoubleType()),
])

QUOTE_FIELDS = ("05. price", "06. volume", "09. change", "10. change percent")
QUOTE_PAYLOAD = T.StructType([T.StructField("Global Quote", T.StructType(
    [T.StructField(f, T.StringType()) for f in QUOTE_FIELDS]))])


def parse_weather(payload: Column) -> Column:
    """Weather JSON -> flat struct; visibility metres -> km (missing -> 0)."""
    w = F.from_json(payload, WEATHER_PAYLOAD)
    return F.struct(
        w["main"]["temp"].alias("temperature"),
        w["main"]["humidity"].alias("humidity"),
        F.get(w["weather"], 0)["main"].alias("weather_condition"),
        F.get(w["weather"], 0)["description"].alias("weather_description"),
        w["wind"]["speed"].alias("wind_speed"),
        w["main"]["pressure"].alias("pressure"),
        (F.coalesce(w["visibility"], F.lit(0.0)) / 1000).alias("visibility"))


def parse_quote(payload: Column) -> Column:
    """X11: quote JSON -> flat struct; numbers from text, '%' stripped, missing -> 0."""
    q = F.from_json(payload, QUOTE_PAYLOAD)["Global Quote"]

    def num(field, default, dtype):
        return F.coalesce(F.coalesce(q[field], F.lit(default)).try_cast(dtype), F.lit(0).cast(dtype))

    change = num("09. change", "0", "double")
    pct = F.replace(F.coalesce(q["10. change percent"], F.lit("0%")), F.lit("%"), F.lit(""))
    return F.struct(
        num("05. price", "0", "double").alias("price"),
        change.alias("change"),
        F.coalesce(pct.try_cast("double"), F.lit(0.0)).alias("change_percent"),
        num("06. volume", "0", "long").alias("volume"),
        market_label(change).alias("market_sentiment"))
