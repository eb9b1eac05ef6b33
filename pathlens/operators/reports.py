"""Standing reports over the derived tables.

Inputs are the derived tables (one row per touchpoint / segment / customer /
day), so these are small aggregates; orderings carry explicit tie keys so
limits are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import quantiles
from ..functions.scalars import nan_to_null
from ..session import written


# ------------------------------------------------------------- segments -------

def segment_summary(segments: DataFrame) -> DataFrame:
    """Customers, average revenue and interactions per segment."""
    return (segments.groupBy("customer_segment")
            .agg(F.count("*").alias("customer_count"),
                 F.avg("total_revenue").alias("avg_revenue"),
                 F.avg("total_interactions").alias("avg_interactions"))
            .orderBy(F.desc("avg_revenue"), "customer_segment"))


def segment_counts(segments: DataFrame) -> DataFrame:
    """A7, short form: segment, count, average revenue."""
    return (segments.groupBy("customer_segment")
            .agg(F.count("*").alias("count"), F.avg("total_revenue").alias("avg_revenue"))
            .orderBy(F.desc("avg_revenue"), "customer_segment"))


def overview_metrics(segments: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    return segments.agg(F.countDistinct("customer_id").alias("total_customers"),
                        F.sum("total_revenue").alias("total_revenue"),
                        F.sum("total_interactions").alias("total_interactions"),
                        F.avg("total_revenue").alias("avg_customer_value"))


def segment_stats(segments: DataFrame) -> DataFrame:
    """Per segment count (of known revenue), mean and sum revenue, mean activity."""
    rev = nan_to_null("total_revenue")
    return (segments.where(F.col("customer_segment").isNotNull())
            .groupBy("customer_segment")
            .agg(F.count(rev).alias("customer_count"),
                 F.avg(rev).alias("avg_revenue"),
                 F.coalesce(F.sum(rev), F.lit(0.0)).alias("total_revenue"),
                 F.avg("total_interactions").alias("avg_interactions"),
                 F.avg("unique_touchpoints_used").alias("avg_touchpoints")))


def _first_best(df: DataFrame, metric: str, tie: str) -> Column:
    """The whole row with the largest ``metric``; ties go to the smallest ``tie``
    (the first row of a table kept in ``tie`` order, like ``idxmax``)."""
    key = F.struct((-F.col(metric)).alias("m"), F.col(tie).alias("t"))
    return F.min_by(F.struct(*[F.col(c) for c in df.columns]), key)


def best_segments(stats: DataFrame) -> DataFrame:
    """Segment with the largest revenue sum and the one with most customers."""
    picks = stats.where(F.col("total_revenue").isNotNull()).agg(
        _first_best(stats, "total_revenue", "customer_segment").alias("best_segment"),
        _first_best(stats, "customer_count", "customer_segment").alias("most_customers"))
    return picks.select(F.explode(F.array(
        F.struct(F.lit("best_segment").alias("metric"), F.col("best_segment").alias("r")),
        F.struct(F.lit("most_customers").alias("metric"), F.col("most_customers").alias("r")),
    )).alias("e")).where(F.col("e.r").isNotNull()).select("e.metric", "e.r.*")


# ------------------------------------------------------------- touchpoints ----

def touchpoint_ranking(analysis: DataFrame) -> DataFrame:
    """K2: touchpoints by revenue, highest first."""
    return (analysis.select("touchpoint", "total_revenue", "conversion_rate")
            .orderBy(F.desc("total_revenue"), "touchpoint"))


def top_touchpoints(analysis: DataFrame, n: int = 5) -> DataFrame:
    """K3: the ``n`` highest-revenue touchpoints (top-k, not a full sort)."""
    return (analysis.select("touchpoint", "total_interactions", "total_revenue", "conversion_rate")
            .orderBy(F.desc("total_revenue"), "touchpoint").limit(n))


def best_touchpoints(analysis: DataFrame) -> DataFrame:
    """Best touchpoint by revenue, by conversion rate, by interactions (whole rows)."""
    picks = analysis.agg(
        _first_best(analysis, "total_revenue", "touchpoint").alias("best_revenue"),
        _first_best(analysis, "conversion_rate", "touchpoint").alias("best_conversion"),
        _first_best(analysis, "total_interactions", "touchpoint").alias("most_interactions"))
    return picks.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("r"))
        for m in ("best_revenue", "best_conversion", "most_interactions")])).alias("e")
    ).where(F.col("e.r").isNotNull()).select("e.metric", "e.r.*")


# ------------------------------------------------------------- journeys -------

def journey_summary(journeys: DataFrame, n: int = config.JOURNEY_SUMMARY_ROWS) -> DataFrame:
    """Most common (first, last) touchpoint pairs with value and duration."""
    return (journeys.groupBy("first_touchpoint", "last_touchpoint")
            .agg(F.count("*").alias("journey_count"),
                 F.avg("total_revenue").alias("avg_revenue"),
                 F.avg("journey_duration_days").alias("avg_duration"))
            .orderBy(F.desc("journey_count"), "first_touchpoint", "last_touchpoint")
            .limit(n))


def journey_stats(journeys: DataFrame) -> DataFrame:
    """Mean length, mean duration, share of converted journeys (%)."""
    return journeys.agg(
        F.avg("total_interactions").alias("avg_length"),
        F.avg("journey_duration_days").alias("avg_duration"),
        (F.sum(F.col("conversion_occurred").cast("long")) * F.lit(100.0)
         / F.count("*")).alias("conversion_rate"))


def top_touchpoint_counts(journeys: DataFrame, column: str,
                          n: int = config.TOP_TOUCHPOINTS) -> DataFrame:
    """Most frequent first (or last) touchpoints; ties in table order."""
    return (journeys.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("touchpoint"))
            .agg(F.count("*").alias("customers"), F.min("customer_id").alias("seen"))
            .orderBy(F.desc("customers"), "seen").limit(n)
            .select("touchpoint", "customers"))


def high_value_journeys(journeys: DataFrame, q: float = config.HIGH_VALUE_QUANTILE,
                        accuracy: int = quantiles.DEFAULT_ACCURACY,
                        revenue: DataFrame | None = None) -> DataFrame:
    """P10: journeys whose revenue exceeds the exact ``q`` quantile of revenue.

    ``revenue`` (one total_revenue per journey) spares computing the journeys for the cut;
    it is written once, as the exact quantile reads it several times."""
    source = journeys.select("total_revenue") if revenue is None else written(revenue.select("total_revenue"), "revenue")
    cut = quantiles.quantile_scalars(source, ["total_revenue"], [q], accuracy)
    tmp = "__high_value_cut"
    return (journeys.withColumn(tmp, cut["total_revenue"]["q0"])
            .where(F.col("total_revenue") > F.col(tmp)).drop(tmp))


# ------------------------------------------------------------- daily series ---

def _array_mean(arr: Column) -> Column:
    acc = F.aggregate(arr, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                      lambda a, x: F.when(x.isNull(), a).otherwise(
                          F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))))
    return F.try_divide(acc["s"], acc["n"])


def revenue_trend(series: DataFrame, days: int = config.TREND_DAYS) -> DataFrame:
    """Total and mean daily revenue, peak day, trend direction.

    The daily table has one row per calendar day, so the ordered list of days
    gathered for the first/last ``days`` comparison is bounded by the calendar.
    """
    rev = nan_to_null("daily_revenue")
    agg = series.agg(
        F.coalesce(F.sum(rev), F.lit(0.0)).alias("total_revenue"),
        F.avg(rev).alias("avg_daily_revenue"),
        F.max_by(F.struct(F.col("date"), rev.alias("rev"), F.col("daily_interactions")),
                 F.struct(rev, -F.unix_date("date"))).alias("peak"),
        F.sort_array(F.collect_list(F.struct(F.col("date"), rev.alias("rev")))).alias("days"))
    revs = F.transform("days", lambda e: e["rev"])
    first = _array_mean(F.slice(revs, 1, days))
    last = _array_mean(F.slice(revs, -days, days))
    return agg.select(
        "total_revenue", "avg_daily_revenue",
        F.col("peak.date").alias("peak_date"),
        F.col("peak.rev").alias("peak_revenue"),
        F.col("peak.daily_interactions").alias("peak_interactions"),
        F.when(last > first, F.lit("increasing")).otherwise(F.lit("decreasing")).alias("trend"))


def table_counts(customers: DataFrame, interactions: DataFrame) -> DataFrame:
    """A10: row counts of the two base tables, as one row."""
    spark = customers.sparkSession
    return spark.range(1).select(
        customers.select(F.count("*")).scalar().alias("customer_count"),
        interactions.select(F.count("*")).scalar().alias("interaction_count"))
