"""Cleaning of raw and derived tables.

Numbers are parsed leniently (bad text -> 0, never an error, H10), decimals
truncate to whole numbers where the schema wants them, NaN counts as missing
(H9), and missing text becomes ''. Columns that are absent are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerce_numeric
from ..functions.scalars import lenient_double, nan_to_null


def _number(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    x = F.col(c) if isinstance(dtype, T.NumericType) else lenient_double(F.col(c))
    return nan_to_null(x.cast("double"))


def _whole_or_zero(df: DataFrame, c: str) -> Column:
    return F.coalesce(_number(df, c).try_cast("long"), F.lit(0).cast("long"))


def _as_timestamp(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    return F.col(c).cast("timestamp") if not isinstance(dtype, T.StringType) \
        else F.col(c).try_cast("timestamp")


def _as_date(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    return F.to_date(F.col(c)) if not isinstance(dtype, T.StringType) \
        else F.col(c).try_cast("timestamp").cast("date")


def clean_interactions(df: DataFrame) -> DataFrame:
    """P2."""
    cols = {c: _whole_or_zero(df, c) for c in ("session_duration_minutes", "pages_viewed")
            if c in df.columns}
    if "revenue" in df.columns:
        cols["revenue"] = F.coalesce(_number(df, "revenue"), F.lit(0.0))
    if "timestamp" in df.columns:
        cols["timestamp"] = _as_timestamp(df, "timestamp")
    for c in ("device_type", "referrer_source", "campaign_id"):
        if c in df.columns:
            cols[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.withColumns(cols)


def clean_customers(df: DataFrame) -> DataFrame:
    """P3."""
    cols = {}
    if "age" in df.columns:
        cols["age"] = _whole_or_zero(df, "age")
    if "lifetime_value" in df.columns:
        cols["lifetime_value"] = F.coalesce(_number(df, "lifetime_value"), F.lit(0.0))
    if "registration_date" in df.columns:
        cols["registration_date"] = _as_date(df, "registration_date")
    for c in ("phone", "city", "state", "country"):
        if c in df.columns:
            cols[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.withColumns(cols)


def clean_derived(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Lenient numeric coercion of a derived table read from text."""
    return coerce_numeric(df, threshold)


def clean_all(customers: DataFrame, interactions: DataFrame,
              derived: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """P5: clean both raw tables and every derived table given."""
    out = {"customers": clean_customers(customers), "interactions": clean_interactions(interactions)}
    for name, df in (derived or {}).items():
        out[name] = clean_derived(df)
    return out
