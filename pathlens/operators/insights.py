"""Question routing and insight answers (X13, X14), as DataFrame jobs.

A table of questions is routed to topics with keyword tests on the whole text
(first matching topic wins). Each topic's answer is text rendered from a one-row
summary of a derived table; answers join the questions through a broadcast of
the six-row answer table (bounded by the number of topics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import grouped_int, money, one_decimal, render, two_decimals
from ..session import written
from . import reports


def route(question: Column, topics=config.QUESTION_TOPICS) -> Column:
    """Topic of a question by ``topics`` (topic, words), first match wins; default
    ``comprehensive``."""
    low = F.lower(question)
    expr = None
    for topic, words in topics:
        hit = None
        for w in words:
            c = F.contains(low, F.lit(w))
            hit = c if hit is None else (hit | c)
        expr = F.when(hit, F.lit(topic)) if expr is None else expr.when(hit, F.lit(topic))
    return expr.otherwise(F.lit(config.DEFAULT_TOPIC))


def route_questions(questions: DataFrame, column: str = "question",
                    topics=config.QUESTION_TOPICS) -> DataFrame:
    return questions.withColumn("topic", route(F.col(column), topics))


def _one_row(df: DataFrame, text: Column, topic: str) -> DataFrame:
    """One row: the rendered text, or the no-data message for an empty input."""
    rendered = df.agg(F.max(text).alias("answer"))
    return rendered.select(
        F.lit(topic).alias("topic"),
        F.coalesce("answer", F.lit(config.NO_DATA[topic])).alias("answer"))


def insight_touchpoints(analysis: DataFrame) -> DataFrame:
    best = reports.best_touchpoints(analysis)
    r = best.groupBy().pivot("metric", ["best_revenue", "best_conversion"]).agg(
        F.first(F.struct(*[c for c in best.columns if c != "metric"])))
    text = render(config.INSIGHT_TOUCHPOINTS,
                  best_touchpoint=F.col("best_revenue.touchpoint"),
                  best_revenue=money(F.col("best_revenue.total_revenue")),
                  best_interactions=grouped_int(F.col("best_revenue.total_interactions")),
                  best_rate=one_decimal(F.col("best_revenue.conversion_rate")),
                  conv_touchpoint=F.col("best_conversion.touchpoint"),
                  conv_rate=one_decimal(F.col("best_conversion.conversion_rate")),
                  conv_avg_revenue=two_decimals(F.coalesce(
                      F.col("best_conversion.avg_revenue_per_interaction"), F.lit(0.0))))
    return _one_row(r.where(F.col("best_revenue").isNotNull()), text, "touchpoint_performance")


def insight_segments(segment_stats: DataFrame) -> DataFrame:
    best = reports.best_segments(segment_stats).where(F.col("metric") == "best_segment")
    text = render(config.INSIGHT_SEGMENTS,
                  segment=F.col("customer_segment"),
                  total_revenue=money(F.col("total_revenue")),
                  customer_count=grouped_int(F.col("customer_count")),
                  avg_revenue=money(F.col("avg_revenue")),
                  avg_interactions=F.format_number(F.col("avg_interactions"), 1))
    return _one_row(best, text, "customer_segments")


def insight_journeys(journeys: DataFrame) -> DataFrame:
    stats = reports.journey_stats(journeys)
    first = reports.top_touchpoint_counts(journeys, "first_touchpoint", 1)
    last = reports.top_touchpoint_counts(journeys, "last_touchpoint", 1)
    f = first.select(F.struct("touchpoint", "customers").alias("s")).scalar()
    l_ = last.select(F.struct("touchpoint", "customers").alias("s")).scalar()
    s = stats.withColumn("__f", f).withColumn("__l", l_).where(F.col("avg_length").isNotNull())
    text = render(config.INSIGHT_JOURNEYS,
                  avg_length=one_decimal(F.col("avg_length")),
                  avg_duration=one_decimal(F.col("avg_duration")),
                  conversion_rate=one_decimal(F.col("conversion_rate")),
                  top_first=F.coalesce(F.col("__f.touchpoint"), F.lit("Unknown")),
                  top_first_count=F.coalesce(F.col("__f.customers").cast("string"), F.lit("0")),
                  top_last=F.coalesce(F.col("__l.touchpoint"), F.lit("Unknown")),
                  top_last_count=F.coalesce(F.col("__l.customers").cast("string"), F.lit("0")))
    return _one_row(s, text, "journey_patterns")


def insight_trends(series: DataFrame) -> DataFrame:
    t = reports.revenue_trend(series).where(F.col("peak_date").isNotNull())
    text = render(config.INSIGHT_TRENDS,
                  total_revenue=money(F.col("total_revenue")),
                  avg_daily_revenue=money(F.col("avg_daily_revenue")),
                  trend_title=F.initcap("trend"), trend=F.col("trend"),
                  peak_date=F.date_format("peak_date", "yyyy-MM-dd"),
                  peak_revenue=money(F.col("peak_revenue")),
                  peak_interactions=grouped_int(F.col("peak_interactions")))
    return _one_row(t, text, "revenue_trends")


def insight_table(analysis: DataFrame, segment_stats: DataFrame, journeys: DataFrame,
                  series: DataFrame) -> DataFrame:
    """Six rows (topic, answer): four rendered, the constant one, the combined default.

    The journeys (their narrow columns), which three summaries read, are written once, as are
    the five answers, which the combined one reads again."""
    spark = analysis.sparkSession
    journeys = written(journeys.select("customer_id", "total_interactions", "journey_duration_days", "first_touchpoint",
                                       "last_touchpoint", "conversion_occurred"), "journeys")
    parts = (insight_touchpoints(analysis).unionByName(insight_segments(segment_stats))
             .unionByName(insight_journeys(journeys)).unionByName(insight_trends(series))
             .unionByName(spark.range(1).select(
                 F.lit("recommendations").alias("topic"),
                 F.lit(config.INSIGHT_RECOMMENDATIONS).alias("answer"))))
    parts = written(parts, "answers")
    order = F.array(*[F.lit(t) for t in config.COMPREHENSIVE_TOPICS])
    combined = (parts.where(F.col("topic").isin(*config.COMPREHENSIVE_TOPICS))
                .agg(F.array_sort(F.collect_list(F.struct(
                    F.array_position(order, F.col("topic")).alias("i"), "answer"))).alias("a"))
                .select(F.lit(config.DEFAULT_TOPIC).alias("topic"),
                        F.array_join(F.transform("a", lambda e: e["answer"]),
                                     config.COMPREHENSIVE_SEPARATOR).alias("answer")))
    return parts.unionByName(combined)


def answer_questions(questions: DataFrame, answers: DataFrame, column: str = "question",
                     topics=config.QUESTION_TOPICS) -> DataFrame:
    """Route every question and attach its topic's answer (broadcast of <= 6 rows)."""
    return (route_questions(questions, column, topics).join(F.broadcast(answers), "topic", "left")
            .withColumn("success", F.lit(True)))


def insights_summary(answers: DataFrame) -> DataFrame:
    """All five answers under one header, each followed by a blank line (one row)."""
    order = F.array(*[F.lit(t) for t in config.SUMMARY_TOPICS])
    parts = (answers.where(F.col("topic").isin(*config.SUMMARY_TOPICS))
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.array_position(order, F.col("topic")).alias("i"), "answer"))).alias("a")))
    return parts.select(F.concat(F.lit(config.SUMMARY_HEADER), F.array_join(
        F.transform("a", lambda e: F.concat(e["answer"], F.lit("\n\n"))), "")).alias("summary"))
