"""Real-time views as batch queries over the real-time table.

``as_of`` stands for "now" (H1). Event-time filters (``timestamp``) reach the
parquet scan as pushed filters; processing-time ones filter ``processed_timestamp``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import is_conversion
from ..session import written


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


def to_realtime(interactions: DataFrame, customers: DataFrame | None = None,
                processed_at: Column | None = None) -> DataFrame:
    """The eight-column real-time record; missing segment -> ''.

    ``processed_at`` defaults to the current time; replays pass a column.
    With ``customers`` the segment comes from an equi left join on customer_id.
    """
    df = interactions
    if customers is not None and "customer_segment" not in df.columns:
        df = df.join(customers.select("customer_id", "customer_segment"), "customer_id", "left")
    seg = F.col("customer_segment") if "customer_segment" in df.columns else F.lit(None)
    return df.select(
        "interaction_id", "customer_id", "touchpoint", "timestamp", "revenue", "action_taken",
        F.coalesce(seg.cast("string"), F.lit("")).alias("customer_segment"),
        (processed_at if processed_at is not None else F.current_timestamp())
        .alias("processed_timestamp"))


def last_hour(df: DataFrame, as_of, hours: int = config.LAST_HOUR_HOURS,
              column: str = "timestamp") -> DataFrame:
    """``as_of - hours <= column <= as_of``. With a wall clock "now" closes the window by
    itself; a replay has to."""
    return df.where((F.col(column) >= _ts(as_of) - F.make_dt_interval(hours=F.lit(hours)))
                    & (F.col(column) <= _ts(as_of)))


def recent(df: DataFrame, as_of, minutes: int, column: str = "processed_timestamp") -> DataFrame:
    """``as_of - minutes < column <= as_of`` (strict below)."""
    return df.where((F.col(column) > _ts(as_of) - F.make_dt_interval(mins=F.lit(minutes)))
                    & (F.col(column) <= _ts(as_of)))


def last_hour_summary(realtime: DataFrame, as_of) -> DataFrame:
    """A11."""
    return last_hour(realtime, as_of).agg(
        F.count("*").alias("interactions"), F.sum("revenue").alias("total_revenue"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.avg("revenue").alias("avg_revenue"))


def last_hour_touchpoints(realtime: DataFrame, as_of) -> DataFrame:
    """A12."""
    return (last_hour(realtime, as_of).groupBy("touchpoint")
            .agg(F.count("*").alias("interactions"), F.sum("revenue").alias("revenue"),
                 F.countDistinct("customer_id").alias("unique_customers"))
            .orderBy(F.desc("revenue"), "touchpoint"))


def minute_trends(realtime: DataFrame, as_of) -> DataFrame:
    """Per event-time minute over the last hour."""
    return (last_hour(realtime, as_of)
            .groupBy(F.date_trunc("minute", "timestamp").alias("minute"))
            .agg(F.count("*").alias("interactions"), F.sum("revenue").alias("revenue"))
            .orderBy("minute"))


def recent_minute_trends(buffer: DataFrame, as_of,
                         minutes: int = config.RECENT_TREND_MINUTES) -> DataFrame:
    """Per processing minute over the last ``minutes``."""
    return (recent(buffer, as_of, minutes)
            .groupBy(F.date_trunc("minute", "processed_timestamp").alias("minute"))
            .agg(F.count("interaction_id").alias("interactions"),
                 F.sum("revenue").alias("revenue"),
                 F.countDistinct("customer_id").alias("unique_customers")))


def recent_touchpoints(buffer: DataFrame, as_of,
                       minutes: int = config.RECENT_TOUCHPOINT_MINUTES) -> DataFrame:
    """Per touchpoint over the last ``minutes`` of processing time."""
    return (recent(buffer, as_of, minutes).groupBy("touchpoint")
            .agg(F.count("interaction_id").alias("interactions"),
                 F.sum("revenue").alias("revenue"),
                 F.countDistinct("customer_id").alias("unique_customers")))


def conversion_window(buffer: DataFrame, as_of,
                      minutes: int = config.CONVERSION_WINDOW_MINUTES) -> DataFrame:
    """T2 at one instant: conversion % and mean session over the last ``minutes``."""
    return recent(buffer, as_of, minutes).agg(
        F.count("*").alias("interactions"),
        F.try_divide(F.count(F.when(is_conversion("revenue"), 1)) * F.lit(100.0), F.count("*"))
        .alias("conversion_rate"),
        F.avg("session_duration_minutes").alias("avg_session_duration"))


def latest_interactions(buffer: DataFrame, n: int = config.LATEST_INTERACTIONS) -> DataFrame:
    """K5: the last ``n`` interactions by arrival (top-k, no full sort)."""
    return buffer.orderBy(F.desc("processed_timestamp"), F.desc("interaction_id")).limit(n)


ENRICHED_DISPLAY = ("interaction_id", "touchpoint", "revenue", "weather_condition",
                    "weather_temperature", "market_sentiment", "news_sentiment")


def _latest(df: DataFrame, n: int, order_column: str) -> DataFrame:
    order = order_column if order_column in df.columns else "timestamp"
    return df.orderBy(F.desc(order), F.desc("interaction_id")).limit(n)


def enriched_recent(enriched: DataFrame, n: int = 10,
                    order_column: str = "processed_timestamp") -> DataFrame:
    """P11 over stored enriched rows: the display columns that exist, for the latest ``n``."""
    cols = [c for c in ENRICHED_DISPLAY if c in enriched.columns]
    return _latest(enriched, n, order_column).select(*cols)


def recent_enriched(events: DataFrame, enrich: Callable[[DataFrame], DataFrame], n: int = 10,
                    order_column: str = "processed_timestamp") -> DataFrame:
    """P11 from events: the latest ``n`` are taken first (top-k), and only they are enriched.
    Enrichment neither drops nor repeats an event, so the rows are the same."""
    out = enrich(written(_latest(events, n, order_column), "latest"))
    return enriched_recent(out, n, order_column)
