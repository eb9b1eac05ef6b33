import datetime as dt

import pytest

from frames import interactions
from pathlens.operators import derive, realtime as rt, reports


def test_best_touchpoints_ties_take_first_in_name_order(spark):
    df = spark.createDataFrame([
        ("website", 10, 100.0, 10.0, 5.0, 3, 20.0),
        ("email", 10, 100.0, 10.0, 5.0, 3, 30.0),
        ("social_media", 12, 50.0, 4.0, 5.0, 3, 30.0),
    ], "touchpoint string, total_interactions long, total_revenue double, "
       "avg_revenue_per_interaction double, avg_session_duration double, unique_customers long, "
       "conversion_rate double")
    got = {r.metric: r.touchpoint for r in reports.best_touchpoints(df).collect()}
    assert got == {"best_revenue": "email", "best_conversion": "email",
                   "most_interactions": "social_media"}
    top = [r.touchpoint for r in reports.top_touchpoints(df, 2).collect()]
    assert top == ["email", "website"]


def test_revenue_trend_peak_and_direction(spark):
    days = [(dt.date(2024, 1, d), float(v), d * 10) for d, v in
            [(1, 5), (2, 9), (3, 1), (4, 1), (5, 1), (6, 1), (7, 9), (8, 8), (9, 8), (10, 8)]]
    df = spark.createDataFrame(days, "date date, daily_revenue double, daily_interactions long")
    r = reports.revenue_trend(df).first()
    assert r.total_revenue == 51.0 and r.avg_daily_revenue == 5.1
    assert (str(r.peak_date), r.peak_revenue, r.peak_interactions) == ("2024-01-02", 9.0, 20)
    assert r.trend == "increasing"          # last five mean 8.2 > first five 3.4


def test_top_touchpoint_counts_ties_first_seen(spark):
    j = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")],
                              "customer_id long, first_touchpoint string")
    got = [(r.touchpoint, r.customers) for r in
           reports.top_touchpoint_counts(j, "first_touchpoint", 2).collect()]
    assert got == [("b", 2), ("a", 2)]      # b appears first in customer order


def test_high_value_journeys_strictly_above_q80(spark):
    j = spark.createDataFrame([(i, float(i)) for i in range(1, 11)],
                              "customer_id long, total_revenue double")
    got = sorted(r.customer_id for r in reports.high_value_journeys(j).collect())
    assert got == [9, 10]                   # q80 = 8.2


def test_segment_reports_skip_inactive(spark):
    seg = spark.createDataFrame([(1, "A", 10.0, 2), (2, "A", None, None), (3, "B", 4.0, 1)],
                                "customer_id long, customer_segment string, total_revenue double, "
                                "total_interactions long").withColumn("unique_touchpoints_used",
                                                                      __import__("pyspark.sql.functions",
                                                                                 fromlist=["lit"]).lit(1))
    s = {r.customer_segment: r for r in reports.segment_summary(seg).collect()}
    assert s["A"].customer_count == 2 and s["A"].avg_revenue == 10.0
    st = {r.customer_segment: r for r in reports.segment_stats(seg).collect()}
    assert st["A"].customer_count == 1
    o = reports.overview_metrics(seg).first()
    assert (o.total_customers, o.total_revenue, o.total_interactions) == (3, 14.0, 3)


def test_realtime_bounds(spark):
    df = interactions(spark, [("1", 1, "email", "2024-01-30 23:00:00", 1.0),      # exactly 1 h
                              ("2", 1, "email", "2024-01-30 22:59:59", 1.0),
                              ("3", 2, "web", "2024-01-31 05:00:00", 2.0),        # after as_of
                              ("4", 2, "web", "2024-01-30 23:30:00", 0.0)])       # exactly 30 min
    r = rt.to_realtime(df, processed_at=__import__("pyspark.sql.functions", fromlist=["col"]).col("timestamp"))
    s = rt.last_hour_summary(r, "2024-01-31 00:00:00").first()
    assert s.interactions == 2 and s.unique_customers == 2      # the row after as_of is not "last hour"
    tp = {x.touchpoint: x.interactions for x in rt.recent_touchpoints(r, "2024-01-31 00:00:00").collect()}
    assert tp == {}                         # strict: 30 min old row excluded, and the later row
    assert [x.interaction_id for x in rt.latest_interactions(r, 2).collect()] == ["3", "4"]
    assert r.first().customer_segment == ""


def test_snapshot_parts_and_empty_input(spark):
    from pathlens.plans.snapshot import snapshot
    from pyspark.sql import functions as F
    df = interactions(spark, [("1", 1, "email", "2024-01-30 23:50:00", 1.0),
                              ("2", 2, "web", "2024-01-30 22:00:00", 0.0)])
    buf = df.withColumn("processed_timestamp", F.col("timestamp"))
    enr = buf.withColumn("weather_condition", F.lit("Rain")).withColumn(
        "news_sentiment", F.lit(None).cast("string")).withColumn("market_sentiment", F.lit("positive"))
    snap = snapshot(buf, enr, "2024-01-31 00:00:00")
    assert snap["minute_trends"].count() == 1 and snap["recent_interactions"].count() == 1
    assert snap["market_score"].first().matches == 1
    assert snap["enriched_interactions"].columns == ["interaction_id", "touchpoint", "revenue",
                                                     "weather_condition", "market_sentiment",
                                                     "news_sentiment"]
    empty = snapshot(buf.limit(0), enr.limit(0), "2024-01-31 00:00:00")
    assert empty["minute_trends"].count() == 0
    assert empty["best_weather"].first().best_condition == "Unknown"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_without_paths_shuffle_no_rows(spark):
    from pathlens.plans.registry import QUERIES
    for name in ("journey_summary", "journey_stats", "top_first_touchpoints", "top_last_touchpoints"):
        assert "collect_list" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_recent_enriched_takes_the_latest_rows_first(spark):
    df = interactions(spark, [(str(i), 1, "email", f"2024-01-30 23:{i:02d}:00", 1.0) for i in range(30)])
    seen = []

    def enrich(events):
        seen.append(events.count())
        return events

    got = [r.interaction_id for r in rt.recent_enriched(df, enrich).collect()]
    assert got == [str(i) for i in range(29, 19, -1)] and seen == [10]
