"""Live tables: late events kept, replays single, minutes current after every batch, one cut."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pathlens.operators import enrich as EN
from pathlens.sources import factors as FA
from pathlens.streaming import jobs as ST
from pathlens.streaming import live
from test_io_streaming import _write_events

T0 = dt.datetime(2024, 1, 1, 10)


def _file(folder, n, rows):
    """rows: (id, minutes after T0, customer, value)"""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"events_{n:03d}.parquet")
    _write_events(path, [(i, (T0 + dt.timedelta(minutes=m)).isoformat(), c, "purchase" if v else "view", float(v), i % 7) for i, m, c, v in rows])
    os.utime(path, (1_700_000_000 + n * 100,) * 2)


def _stream(spark, src, watermark=None):
    return ST.read_interactions_stream(spark, src, file_glob="events_*.parquet", watermark=watermark, max_files_per_trigger=1)


def test_late_events_of_a_restarted_sink_are_kept(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("events", "realtime", "ck"))
    _file(src, 0, [(i, 2000 + i % 50, 1, 1) for i in range(900)])

    def run():
        ST.finish(ST.write_realtime(_stream(spark, src), out, ck, available_now=True))
        return live.realtime_table(spark, out)

    assert run().count() == 900
    _file(src, 1, [(1000 + i, i, 1, 1) for i in range(100)])           # more than a day older
    rows = run()
    assert rows.count() == 1000 and rows.select("interaction_id").distinct().count() == 1000
    assert rows.where("is_late").count() == 100
    _file(src, 2, [(1000 + i, i, 1, 1) for i in range(100)] + [(5, 2005, 1, 1), (2000, 2060, 2, 0)])     # replays, and one new event
    assert run().count() == 1001
    days = {str(r.date) for r in rows.select("date").distinct().collect()}
    assert days == {"2024-01-01", "2024-01-02"}


def test_customers_are_joined_as_they_are_in_each_batch(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "events"), os.path.join(tmp_dir, "realtime")
    _file(src, 0, [(1, 0, 7, 1)])
    _file(src, 1, [(2, 1, 8, 1)])
    known = [(7, "GOLD")]

    def customers():
        frame = spark.createDataFrame(known, "customer_id long, customer_segment string")
        known.append((8, "NEW"))
        return frame

    ST.finish(ST.write_realtime(_stream(spark, src), out, os.path.join(tmp_dir, "ck"), customers, available_now=True))
    assert {r.interaction_id: r.customer_segment for r in spark.read.parquet(out).collect()} == {"1": "GOLD", "2": "NEW"}


def _random_files(src, seed, files=6, rows=60):
    rng = random.Random(seed)
    every = []
    for n in range(files):
        own = [(n * 1000 + k, n * 40 + rng.randrange(45) - (600 if rng.random() < 0.1 else 0), rng.choice([1, 2, 3, None]), rng.choice([0, 0, 5]))
               for k in range(rows)]
        own += rng.sample(every, min(len(every), 10)) + own[:3]         # replays of this and earlier files
        _file(src, n, own)
        every += own[:rows]
    return every


def _expected(spark, rows):
    """The views over the events at once, from a batch aggregate."""
    frame = spark.createDataFrame([(str(i), c, ("app", "web", None)[i % 3], T0 + dt.timedelta(minutes=m), float(v), i % 7) for i, m, c, v in rows],
                                  "interaction_id string, customer_id long, touchpoint string, timestamp timestamp, revenue double, session_duration_minutes long")
    return frame, ST.stream_minutes(frame)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_minutes_and_views_are_current_after_every_batch(spark, tmp_dir):
    src, base, ck = (os.path.join(tmp_dir, x) for x in ("events", "live", "ck"))
    files = os.path.join(tmp_dir, "all")
    every = _random_files(files, 3)
    os.makedirs(src)
    for n in range(6):
        os.link(os.path.join(files, f"events_{n:03d}.parquet"), os.path.join(src, f"events_{n:03d}.parquet"))
        live.start_live(_stream(spark, src), base, ck, available_now=True).awaitTermination()      # a restart per batch
        so_far = spark.read.parquet(src).dropDuplicates(["event_id"])
        want = ST.stream_minutes(ST.interactions_from_events(so_far))
        assert _rows(live.minutes(spark, base)) == _rows(want.select(*live.MINUTES))
    views = live.live_views(spark, base)
    assert _rows(views["daily_totals"]) == _rows(ST.daily_totals(want))
    assert _rows(views["touchpoint_windows"]) == _rows(ST.touchpoint_windows(want))
    assert live.events(spark, base).count() == len(every) and live.late_events(spark, base).count() > 0
    early = live.minutes(spark, base, upto=1)
    assert early.agg(F.sum("interactions")).first()[0] == 120


def test_a_failed_batch_is_retried_whole(spark, tmp_dir, monkeypatch):
    src, base, ck = (os.path.join(tmp_dir, x) for x in ("events", "live", "ck"))
    every = _random_files(src, 4, files=3)
    real, failures = live._advance, [1]

    def fails_once(*a, **k):
        if a[2] == 1 and failures:
            failures.pop()
            raise RuntimeError("lost before the commit")
        return real(*a, **k)

    monkeypatch.setattr(live, "_advance", fails_once)
    with pytest.raises(Exception, match="lost before the commit"):
        live.start_live(_stream(spark, src), base, ck, available_now=True).awaitTermination()
    assert live.committed(spark, base).batch == 0
    assert live.events(spark, base).count() == 60                      # what batch 1 stored is not seen yet
    assert live.minutes(spark, base).agg(F.sum("interactions")).first()[0] == 60
    live.start_live(_stream(spark, src), base, ck, available_now=True).awaitTermination()
    assert live.events(spark, base).count() == len(every) == live.events(spark, base).select("interaction_id").distinct().count()
    assert live.minutes(spark, base).agg(F.sum("interactions")).first()[0] == len(every)


def test_rejected_records_of_a_topic(spark, tmp_dir):
    """Records as Kafka gives them (a value column), here from text files."""
    src, base = os.path.join(tmp_dir, "topic"), os.path.join(tmp_dir, "live")
    os.makedirs(src)
    event = {"interaction_id": "A", "customer_id": "C", "touchpoint": "email", "timestamp": "2024-01-01T10:00:00", "revenue": 2.0}
    lines = [json.dumps(event), "not json", json.dumps(event | {"interaction_id": ""}), json.dumps(event | {"interaction_id": "B", "timestamp": "never"}), json.dumps(event)]
    with open(os.path.join(src, "one.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")
    records = ST.parse_live_events(spark.readStream.text(src))
    live.start_live(records, base, os.path.join(tmp_dir, "ck"), available_now=True).awaitTermination()
    assert [r.interaction_id for r in live.events(spark, base).collect()] == ["A"]
    assert sorted(r.reason for r in live.rejects(spark, base).collect()) == ["no interaction_id", "no valid timestamp", "not a live event"]
    assert "not json" in {r.record for r in live.rejects(spark, base).collect()}
    commit = spark.read.parquet(os.path.join(base, "commits")).first()
    assert (commit.stored, commit.late, commit.rejected) == (1, 0, 3)


def _factors(spark):
    return {"customers": None, "weather": spark.createDataFrame([("New York", T0, 20.0, "Clear", 50)],
                                                                "city string, factor_time timestamp, temperature double, weather_condition string, humidity long"),
            "market": spark.createDataFrame([(T0, "positive", 1.0)], "factor_time timestamp, market_sentiment string, change_percent double"),
            "news": spark.createDataFrame([], "factor_time timestamp, sentiment_label string, sentiment_score double"),
            "economic": spark.createDataFrame([], "factor_time timestamp, inflation_rate double, consumer_confidence double"),
            "facts": FA.city_facts(spark)}


def test_snapshot_is_one_cut_while_a_batch_lands(spark, tmp_dir):
    src, base, ck = (os.path.join(tmp_dir, x) for x in ("events", "live", "ck"))
    as_of = T0 + dt.timedelta(minutes=29)

    def run():
        live.start_live(_stream(spark, src), base, ck, factors=lambda: _factors(spark), available_now=True).awaitTermination()

    _file(src, 0, [(i, i, i % 3, 5) for i in range(20)])
    run()
    parts = live.live_snapshot(spark, base, as_of)
    before = {n: parts[n].count() for n in ("recent_interactions", "enriched_interactions")}
    first = _rows(parts["touchpoint_performance"])
    _file(src, 1, [(100 + i, 20 + i % 9, i % 3, 5) for i in range(30)])
    run()                                                               # lands between two parts
    assert set(parts) == {"minute_trends", "touchpoint_performance", "recent_interactions", "conversion_window", "weather_impact", "best_weather",
                          "market_score", "sentiment_impact", "sentiment_running_rate", "enriched_interactions", "cut"}
    assert parts["cut"].first().batch == 0
    assert sum(r[1] for r in _rows(parts["touchpoint_performance"])) == sum(r[1] for r in first) == 20
    assert parts["weather_impact"].agg(F.sum("interaction_count")).first()[0] == 20
    assert before["recent_interactions"] == parts["recent_interactions"].count()
    now = live.live_snapshot(spark, base, as_of)
    assert now["cut"].first().batch == 1 and now["weather_impact"].agg(F.sum("interaction_count")).first()[0] == 50
    assert sum(r[1] for r in _rows(now["touchpoint_performance"])) == 50


def test_vacuum_keeps_the_last_versions(spark, tmp_dir):
    src, base, ck = (os.path.join(tmp_dir, x) for x in ("events", "live", "ck"))
    for n in range(4):
        _file(src, n, [(n * 10 + k, k, 1, 0) for k in range(5)])
    live.start_live(_stream(spark, src), base, ck, available_now=True).awaitTermination()
    want = _rows(live.minutes(spark, base))
    assert live.vacuum(spark, base, keep=0) == 3 and live.vacuum(spark, base, keep=0) == 0
    assert _rows(live.minutes(spark, base)) == want


def test_factors_of_a_batch_are_pruned_at_the_scan(spark, tmp_dir):
    """Readings by date: the batch's days alone are read, whatever the history."""
    folder = os.path.join(tmp_dir, "market")
    (spark.range(400).select((F.lit(T0) - F.make_dt_interval(days=F.col("id").cast("int"))).alias("factor_time"),
                             F.lit("positive").alias("market_sentiment"), F.lit(1.0).alias("change_percent"))
     .withColumn("date", F.to_date("factor_time")).write.partitionBy("date").parquet(folder))
    batch = spark.createDataFrame([("1", T0 + dt.timedelta(minutes=1), "New York")], "interaction_id string, timestamp timestamp, city string")
    tables = EN.pruned(_factors(spark) | {"market": spark.read.parquet(folder)}, batch)
    plan = tables["market"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(factor_time), GreaterThanOrEqual(factor_time" in plan
    assert tables["market"].count() == 1 and len(tables["market"].inputFiles()) == 400
    assert EN.enrich_market(batch, tables["market"]).first().market_sentiment == "positive"
    assert EN.pruned({}, batch) == {}
    assert EN.pruned(_factors(spark), batch.limit(0))["weather"].count() == 0


def test_a_batch_writes_a_file_per_folder(spark, tmp_dir):
    """Not one per task and folder: the number of files does not grow with the shuffle partitions."""
    src, base, ck = (os.path.join(tmp_dir, x) for x in ("events", "live", "ck"))
    _file(src, 0, [(i, i * 7, i % 9, i % 3) for i in range(400)])
    options = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        live.start_live(_stream(spark, src), base, ck, available_now=True).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(spark.read.parquet(os.path.join(base, "events")).inputFiles()) == 3                  # days
    assert len(spark.read.parquet(os.path.join(base, "minutes")).inputFiles()) == 47                # hours
    assert live.minutes(spark, base).agg(F.sum("interactions")).first()[0] == live.events(spark, base).count() == 400


def test_a_stream_runs_once_per_enriched_batch(spark, tmp_dir):
    """The times that prune the factors are taken from the batch's rows as written, not from another run of the stream."""
    src, out = os.path.join(tmp_dir, "events"), os.path.join(tmp_dir, "enriched")
    _file(src, 0, [(i, i, i % 3, 5) for i in range(50)])
    seen = spark.sparkContext.accumulator(0)

    def counted(_):
        seen.add(1)
        return True

    stream = _stream(spark, src).where(F.udf(counted, "boolean")("interaction_id"))
    ST.start_enriched(stream, lambda: _factors(spark), out, os.path.join(tmp_dir, "ck"), available_now=True).awaitTermination()
    assert ST.enriched_table(spark, out).count() == 50 and seen.value == 50


def test_readings_are_derived_once_for_all_batches(spark, monkeypatch):
    from pathlens.plans import registry

    calls, real = [], registry._tables

    def counted(*a):
        calls.append(a)
        return real(*a)

    sf = "/root/testdata/sf0.001"
    want = {r.weather_condition: r.interaction_count for r in registry.QUERIES["weather_impact"](spark, sf).collect()}
    monkeypatch.setattr(registry, "_tables", counted)
    got = registry.QUERIES["live_weather_impact"](spark, sf)
    assert len(calls) == 1 and {r.weather_condition: r.interaction_count for r in got.collect()} == want
