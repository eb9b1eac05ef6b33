"""Incremental build: a day's interactions become stored partials, the derived tables merge them.

Two partial tables below ``base/partials``, by date: ``pieces``, the journey pieces per (customer,
hour), and ``days``, the activity per (customer, touchpoint). ``add_days`` replaces the partitions
of the days that it is given and touches no other; ``derived`` merges partials, so no interaction of
an old day is read again. ``build`` does both and publishes the four tables as one version.

Defined cases: rows without a time are in the partition without a date, which is replaced like a
day; a day given again replaces what it had; rows without customer count in the touchpoint and daily
tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import quantiles
from ..functions.scalars import is_conversion, nan_to_null, whole_days_between
from ..operators import derive
from ..operators.derive import rounded
from ..session import written
from ..sources import versions
from ..sources.io import path_exists


def _partial(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/partials/{name}"


def activity(interactions: DataFrame) -> DataFrame:
    """Sums per (date, customer, touchpoint) that add up over days."""
    return interactions.groupBy(F.to_date("timestamp").alias("date"), "customer_id", "touchpoint").agg(
        F.count("interaction_id").alias("n"), F.sum(nan_to_null("revenue")).alias("revenue"), F.count(nan_to_null("revenue")).alias("revenue_n"),
        F.sum("session_duration_minutes").alias("session"), F.count("session_duration_minutes").alias("session_n"),
        F.count(F.when(is_conversion("revenue"), F.col("interaction_id"))).alias("conversions"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def add_days(spark: SparkSession, base: str, interactions: DataFrame) -> None:
    """Replaces the partials of the days in ``interactions``, which holds all rows of these days
    (cleaned). Run again after a failure it gives the same."""
    pieces = derive.journey_pieces(interactions).withColumn("date", F.to_date(F.timestamp_seconds(F.unix_seconds("first.t"))))
    for name, rows in (("days", activity(interactions)), ("pieces", pieces)):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(_partial(base, name)))


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    if not path_exists(spark, _partial(base, name)):
        raise FileNotFoundError(f"no partials below {base}")
    return spark.read.parquet(_partial(base, name))


def _sum0(c: str):
    return F.coalesce(F.sum(c), F.lit(0.0))


def _mean(total: str, n: str):
    return F.try_divide(F.sum(total).cast("double"), F.sum(n))


SUMS = ("n", "revenue", "revenue_n", "session", "session_n", "conversions")


def touchpoint_analysis(days: DataFrame, round_to: int | None = 2) -> DataFrame:
    """A1 from the partials; customers are counted as rows per (touchpoint, customer)."""
    per = days.where(F.col("touchpoint").isNotNull()).groupBy("touchpoint", "customer_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    agg = per.groupBy("touchpoint").agg(
        F.sum("n").alias("total_interactions"), _sum0("revenue").alias("revenue"), _mean("revenue", "revenue_n").alias("mean"),
        _mean("session", "session_n").alias("session"), F.count("customer_id").alias("unique_customers"), F.sum("conversions").alias("conversions"))
    rate = F.coalesce(F.try_divide(F.col("conversions") * F.lit(100.0), F.col("total_interactions")), F.lit(0.0))
    return agg.select("touchpoint", "total_interactions", rounded(F.col("revenue"), round_to).alias("total_revenue"),
                      rounded(F.col("mean"), round_to).alias("avg_revenue_per_interaction"),
                      rounded(F.col("session"), round_to).alias("avg_session_duration"), "unique_customers",
                      rounded(rate, round_to).alias("conversion_rate"))


def customer_behavior(days: DataFrame, round_to: int | None = 2) -> DataFrame:
    """A3 from the partials."""
    per = days.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "touchpoint").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("first").alias("first"), F.max("last").alias("last"))
    agg = per.groupBy("customer_id").agg(
        F.sum("n").alias("total_interactions"), _sum0("revenue").alias("revenue"), F.count("touchpoint").alias("unique_touchpoints_used"),
        _mean("session", "session_n").alias("session"), F.min("first").alias("first_interaction"), F.max("last").alias("last_interaction"))
    return agg.select("customer_id", "total_interactions", rounded(F.col("revenue"), round_to).alias("total_revenue"), "unique_touchpoints_used",
                      rounded(F.col("session"), round_to).alias("avg_session_duration"), "first_interaction", "last_interaction")


def customer_segments(customers: DataFrame, days: DataFrame, as_of, round_to: int | None = 2) -> DataFrame:
    """A4 from the partials."""
    behavior = customer_behavior(days, round_to).withColumn(
        "recency_days", whole_days_between(F.col("last_interaction"), F.lit(as_of).cast("timestamp")))
    scored = quantiles.with_tertiles(written(behavior, "behavior"), {
        "frequency_score": ("total_interactions", config.FREQUENCY_LABELS), "monetary_score": ("total_revenue", config.MONETARY_LABELS),
        "recency_score": ("recency_days", config.RECENCY_LABELS)})
    return customers.join(scored, "customer_id", "left")


def time_series(days: DataFrame, touchpoints: Sequence[str] = config.TOUCHPOINTS, round_to: int | None = 2) -> DataFrame:
    """A5 from the partials: a day's row needs its own partition only."""
    counts = [F.sum(F.when(F.col("touchpoint") == tp, F.col("n")).otherwise(0)).alias(f"daily_{tp}_interactions") for tp in touchpoints]
    per = days.where(F.col("date").isNotNull()).groupBy("date", "customer_id").agg(
        *[F.sum(c).alias(c) for c in SUMS], *counts)
    agg = per.groupBy("date").agg(
        F.sum("n").alias("daily_interactions"), F.count("customer_id").alias("daily_unique_customers"), _sum0("revenue").alias("revenue"),
        _mean("session", "session_n").alias("session"), *[F.sum(f"daily_{tp}_interactions").alias(f"daily_{tp}_interactions") for tp in touchpoints])
    return agg.select("date", "daily_interactions", "daily_unique_customers", rounded(F.col("revenue"), round_to).alias("daily_revenue"),
                      rounded(F.col("session"), round_to).alias("avg_session_duration"), *[f"daily_{tp}_interactions" for tp in touchpoints])


def derived(spark: SparkSession, base: str, customers: DataFrame, as_of, round_to: int | None = 2) -> dict[str, DataFrame]:
    """The four derived tables over all days so far."""
    days = _read(spark, base, "days")
    return {"customer_journeys": derive.journeys_of(_read(spark, base, "pieces").drop("date")),
            "touchpoint_analysis": touchpoint_analysis(days, round_to),
            "customer_segments": customer_segments(customers, days, as_of, round_to),
            "time_series_data": time_series(days, round_to=round_to)}


def build(spark: SparkSession, base: str, customers: DataFrame, new_days: DataFrame, as_of, round_to: int | None = 2,
          database: str | None = None) -> str:
    """Adds ``new_days`` and publishes the derived tables as the new version of ``base``."""
    add_days(spark, base, new_days)
    return versions.publish(spark, base, derived(spark, base, customers, as_of, round_to), database)
