import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import interactions, t
from pathlens.functions import text as TX
from pathlens.operators import enrich as EN
from pathlens.operators import impact
from pathlens.operators.asof import asof_join
from pathlens.sources import factors as FA


def _readings(spark, rows):
    return spark.createDataFrame([(c, t(w), v) for c, w, v in rows],
                                 "city string, factor_time timestamp, v double")


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_asof_tolerance_and_candidates(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
    ev = spark.createDataFrame([
        ("exact", "X", t("2024-01-01 00:05:00")),     # reading 300 s old -> match
        ("late", "X", t("2024-01-01 00:05:01")),      # 301 s old -> none
        ("two", "X", t("2024-01-01 01:00:30")),       # two earlier readings -> latest
        ("none", "X", t("2023-12-31 23:00:00")),      # before any reading
        ("other", "Y", t("2024-01-01 00:00:10")),     # different key
        ("nullkey", None, t("2024-01-01 00:00:10")),
    ], "id string, city string, timestamp timestamp")
    rd = _readings(spark, [("X", "2024-01-01 00:00:00", 1.0), ("X", "2024-01-01 00:59:00", 2.0),
                           ("X", "2024-01-01 01:00:00", 3.0), ("Y", "2024-01-01 00:00:00", 9.0)])
    out = {r.id: r.v for r in asof_join(ev, rd, by=[("city", "city")], values=[("v", "v")],
                                        tolerance_seconds=300).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert out == {"exact": 1.0, "late": None, "two": 3.0, "none": None, "other": 9.0,
                   "nullkey": None}


def test_asof_global_series_and_duplicate_times(spark):
    ev = spark.createDataFrame([("a", t("2024-01-01 00:01:00"))], "id string, timestamp timestamp")
    rd = spark.createDataFrame([(t("2024-01-01 00:00:00"), 1.0), (t("2024-01-01 00:00:00"), 5.0)],
                               "factor_time timestamp, v double")
    rows = asof_join(ev, rd, values=[("v", "v")]).collect()
    assert len(rows) == 1 and rows[0].v == 5.0     # no duplicated events


def test_geo_and_city_defaults(spark):
    ev = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "interaction_id string, customer_id long")
    cust = spark.createDataFrame([(1, "Chicago"), (2, "Paris"), (3, None)],
                                 "customer_id long, city string")
    out = {r.interaction_id: r for r in
           EN.enrich_geo(EN.with_city(ev, cust), FA.city_facts(spark)).collect()}
    assert (out["1"].city_population, out["1"].city_median_income) == (2700000, 58000)
    assert (out["2"].city_population, out["2"].city_median_income) == (1000000, 60000)
    assert out["3"].city == "New York" and out["3"].city_population == 8400000


def test_news_sentiment_keywords_and_label(spark):
    docs = spark.createDataFrame([
        ("q", "Strong GROWTH and profit"),          # +1
        ("q", "a loss, a drop and a fall; gain"),   # -1
        ("q", "growth growth decline"),             # distinct keywords: 1 vs 1 -> 0
        ("r", "nothing here"),
    ], "query string, text string")
    rows = {r.query: r for r in FA.news_sentiment(docs).collect()}
    assert rows["q"].sentiment_score == 0.0 and rows["q"].sentiment_label == "neutral"
    assert rows["q"].articles_analyzed == 3
    one = FA.news_sentiment(docs.where("text like 'Strong%' or text like 'nothing%'")).collect()
    assert {r.query: r.sentiment_label for r in one} == {"q": "positive", "r": "neutral"}
    third = spark.createDataFrame([("q", "growth"), ("q", "x"), ("q", "y")], "query string, text string")
    r = FA.news_sentiment(third).first()
    assert r.sentiment_score == 0.33 and r.sentiment_label == "positive"


@pytest.mark.parametrize("matches,label", [(20, "Weak correlation"), (21, "Moderate correlation"),
                                           (50, "Moderate correlation"),
                                           (51, "Strong positive correlation")])
def test_market_score_thresholds(spark, matches, label):
    rows = [("positive", 1.0)] * matches + [("positive", 0.0), ("negative", 5.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "market_sentiment string, revenue double")
    r = impact.market_score(df).first()
    assert r.matches == matches and r.interpretation == label
    assert r.correlation_score == pytest.approx(matches * 0.1)


def test_weather_impact_and_best(spark):
    df = interactions(spark, [("1", 1, "email", "2024-01-01 00:00:00", 10.0),
                              ("2", 1, "email", "2024-01-01 00:01:00", 0.0),
                              ("3", 1, "email", "2024-01-01 00:02:00", 5.0),
                              ("4", 1, "email", "2024-01-01 00:03:00", 3.0)])
    df = df.withColumn("weather_condition", F.expr(
        "case interaction_id when '1' then 'Rain' when '2' then 'Rain' when '3' then 'Clear' end"))
    rows = {r.weather_condition: r for r in impact.weather_impact(df).collect()}
    assert rows["Rain"].avg_revenue == 5.0 and rows["Unknown"].interaction_count == 1
    best = impact.best_weather(df).first()
    assert (best.best_condition, best.best_avg_revenue) == ("Rain", 5.0)   # tie: first seen
    empty = impact.best_weather(df.limit(0)).first()
    assert (empty.best_condition, empty.best_avg_revenue) == ("Unknown", 0.0)


def test_sentiment_conversion_is_true_rate(spark):
    df = spark.createDataFrame([("neutral", 0.0)] * 3 + [("neutral", 2.0), (None, 1.0)],
                               "news_sentiment string, revenue double")
    r = {x.sentiment: x for x in impact.sentiment_impact(df).collect()}
    assert r["neutral"]["count"] == 5 and r["neutral"].conversion_rate == pytest.approx(40.0)


def test_payload_parsing_defaults(spark):
    df = spark.createDataFrame([
        ('{"main": {"temp": 21.5, "humidity": 60, "pressure": 1012}, '
         '"weather": [{"main": "Rain", "description": "light rain"}], "wind": {"speed": 3.1}, '
         '"visibility": 8000}',),
        ('{"main": {"temp": 1.0, "humidity": 9, "pressure": 999}, "weather": [], "wind": {}}',),
    ], "payload string")
    rows = df.select(TX.parse_weather(F.col("payload")).alias("w")).select("w.*").collect()
    assert rows[0].visibility == 8.0 and rows[0].weather_condition == "Rain"
    assert rows[1].visibility == 0.0 and rows[1].weather_condition is None
    q = spark.createDataFrame([
        ('{"Global Quote": {"05. price": "420.5", "06. volume": "77", "09. change": "-1.25", '
         '"10. change percent": "-0.30%"}}',), ('{}',)], "payload string")
    rows = q.select(TX.parse_quote(F.col("payload")).alias("q")).select("q.*").collect()
    assert (rows[0].price, rows[0].change, rows[0].change_percent, rows[0].volume) == \
        (420.5, -1.25, -0.30, 77)
    assert rows[0].market_sentiment == "negative"
    assert (rows[1].price, rows[1].change_percent, rows[1].volume) == (0.0, 0.0, 0)


def _sequential_rate(flags):
    r, k = 0.0, 0
    for f in flags:
        k += 1
        if f:
            r = (r * (k - 1) + 1) / k
    return r


@pytest.mark.parametrize("chunks", [1, 4, 50])
def test_running_rate_matches_sequential_rule(spark, chunks):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        lab = rnd.choice(["positive", "negative", None])
        rows.append((str(i), lab, t("2024-01-01 00:00:00") + __import__("datetime").timedelta(seconds=37 * i),
                     rnd.choice([0.0, 0.0, 0.0, 5.0])))
    rows[0] = ("0", "positive", rows[0][2], 9.0)        # first row converts (k = 1)
    df = spark.createDataFrame(rows, "interaction_id string, news_sentiment string, "
                                     "timestamp timestamp, revenue double")
    got = {r.sentiment: r for r in impact.running_conversion_rate(df, chunks=chunks).collect()}
    for lab in ["positive", "negative", None]:
        flags = [rv > 0 for _, l_, _, rv in sorted(rows, key=lambda x: (x[2], x[0])) if l_ == lab]
        g = got[lab or "neutral"]
        assert g["count"] == len(flags) and g.conversions == sum(flags)
        assert g.running_rate == pytest.approx(_sequential_rate(flags), rel=1e-9)
        assert g.running_rate > sum(flags) / len(flags)     # biased upward (H5)


def test_running_rate_of_one_hot_label_and_hour_is_linear(spark):
    import time
    df = spark.range(200_000).select(
        F.col("id").cast("string").alias("interaction_id"), F.lit("positive").alias("news_sentiment"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1000).alias("timestamp"),
        F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("revenue"))
    began = time.time()
    r = impact.running_conversion_rate(df).first()
    assert time.time() - began < 60
    assert (r["count"], r.conversions) == (200_000, 40_000)
    ids = sorted(range(200_000), key=lambda i: (i, str(i)))
    assert r.running_rate == pytest.approx(_sequential_rate(i % 5 == 0 for i in ids), rel=1e-9)


def test_asof_across_days_and_gap_days(spark):
    rd = spark.createDataFrame([(t("2024-01-01 23:59:00"), 1.0), (t("2024-01-02 00:00:30"), 2.0),
                                (t("2024-01-02 23:58:00"), 3.0), (t("2024-01-04 00:01:00"), 4.0)],
                               "factor_time timestamp, v double")
    ev = spark.createDataFrame([
        ("a", t("2024-01-02 00:00:10")),   # previous day's reading, next one not yet valid
        ("b", t("2024-01-02 00:01:00")),   # the 00:00:30 reading
        ("c", t("2024-01-02 23:59:59")),   # 23:58 reading, 119 s old
        ("d", t("2024-01-03 00:02:59")),   # 23:58 reading is 299 s old: still valid
        ("e", t("2024-01-03 00:03:01")),   # 301 s old, next reading two days later: none
        ("f", t("2024-01-04 00:05:00")),
    ], "id string, timestamp timestamp")
    got = {r.id: r.v for r in asof_join(ev, rd, values=[("v", "v")]).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 3.0, "e": None, "f": 4.0}


def test_weather_reports_as_dense_as_events_are_not_paired(spark):
    """As many reports as events in one bucket: sorted together, not each event joined with each report of the bucket."""
    first, n = t("2024-01-01 00:00:00"), 2000
    at = lambda ms: first + dt.timedelta(milliseconds=ms)
    ev = spark.createDataFrame([(str(i), "X" if i % 9 else None, at(i * 140 - 5000)) for i in range(n)], "interaction_id string, city string, timestamp timestamp")
    rd = spark.createDataFrame([("X" if i % 7 else "Y", at(i * 130), float(i), "Clear", i) for i in range(n)],
                               "city string, factor_time timestamp, temperature double, weather_condition string, humidity long")
    got = EN.enrich_weather(ev, rd)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    known = [(i * 130, float(i)) for i in range(n) if i % 7]
    want = {}
    for i in range(n):
        before = [v for ms, v in known if ms <= i * 140 - 5000]
        want[str(i)] = before[-1] if i % 9 and before and i * 140 - 5000 - before[-1] * 130 <= 300_000 else None
    assert {r.interaction_id: r.weather_temperature for r in got.collect()} == want
    prepared = EN.enrich_weather(ev, EN.weather_intervals(rd))
    assert {r.interaction_id: r.weather_temperature for r in prepared.collect()} == want
