import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathlens.operators import derive
from pathlens.plans import registry
from pathlens.sources import io
from pathlens.streaming import jobs as ST


def _write_raw(folder, customers=True):
    os.makedirs(folder, exist_ok=True)
    if customers:
        pd.DataFrame({"customer_id": ["C1", "C2"], "age": ["31", "x"], "city": ["Chicago", None],
                      "registration_date": ["2023-01-02", "2023-02-03"],
                      "lifetime_value": ["10.5", ""]}).to_csv(f"{folder}/customers.csv", index=False)
    pd.DataFrame({"interaction_id": ["I1", "I2", "I3"], "customer_id": ["C1", "C1", "C2"],
                  "touchpoint": ["email", "website", "email"],
                  "timestamp": ["2024-01-01 10:00:00", "2024-01-02 11:00:00", "2024-01-03 09:00:00"],
                  "session_duration_minutes": ["3", "4.7", ""], "revenue": ["0", "12.5", "bad"]}
                 ).to_csv(f"{folder}/interactions.csv", index=False)


def test_read_raw_and_build_all(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    _write_raw(raw)
    c, i = io.read_raw(spark, raw)
    assert dict(i.dtypes)["timestamp"] == "timestamp" and dict(c.dtypes)["age"] == "bigint"
    out = io.build_all(spark, c, i, "2024-01-31 00:00:00", os.path.join(tmp_dir, "processed"))
    j = {r.customer_id: r for r in out["customer_journeys"].collect()}
    assert j["C1"].journey_path == "email -> website" and j["C1"].total_revenue == 12.5
    assert out["time_series_data"].count() == 3


def test_read_raw_missing_file_raises(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    _write_raw(raw, customers=False)
    with pytest.raises(FileNotFoundError):
        io.read_raw(spark, raw)


def test_write_modes_and_missing_derived(spark, tmp_dir):
    df = spark.createDataFrame([("email", 3, 1.0, 0.5, 2.0, 1, 10.0, "extra")],
                               "touchpoint string, total_interactions long, total_revenue double, "
                               "avg_revenue_per_interaction double, avg_session_duration double, "
                               "unique_customers long, conversion_rate double, junk string")
    p = os.path.join(tmp_dir, "tpa")
    io.write_table(df, "touchpoint_analysis", "WRITE_TRUNCATE", path=p)
    io.write_table(df, "touchpoint_analysis", "WRITE_APPEND", path=p)
    back = spark.read.parquet(p)
    assert back.count() == 2 and "junk" not in back.columns
    with pytest.raises(ValueError):
        io.write_table(df, "touchpoint_analysis", "WRITE_EMPTY", path=p)
    empty = io.read_derived(spark, tmp_dir, "customer_journeys")
    assert empty.count() == 0 and "journey_path" in empty.columns


def test_catalog_tables_and_load_all(spark, tmp_dir):
    made = io.create_tables(spark, "pl_test", ["touchpoint_analysis"])
    assert made == ["touchpoint_analysis"]
    raw = os.path.join(tmp_dir, "raw")
    _write_raw(raw)
    pd.DataFrame({"customer_id": ["C9"], "age": ["50"]}).to_csv(f"{raw}/customers_clean.csv", index=False)
    loaded = io.load_all(spark, raw, os.path.join(tmp_dir, "none"), target=os.path.join(tmp_dir, "wh"))
    assert loaded == ["customers", "interactions"]
    assert [r.customer_id for r in spark.read.parquet(os.path.join(tmp_dir, "wh", "customers")).collect()] == ["C9"]
    r = io.run_sql(spark, "select count(*) n from v", {"v": spark.range(3)}).first()
    assert r.n == 3


def _write_events(path, rows):
    import pyarrow as pa
    import pyarrow.parquet as pq
    cols = list(zip(*rows))
    table = pa.table({
        "event_id": pa.array(cols[0], pa.int64()),
        "ts": pa.array([dt.datetime.fromisoformat(x) for x in cols[1]], pa.timestamp("us")),
        "user_id": pa.array(cols[2], pa.int64()),
        "event_type": pa.array(cols[3], pa.string()),
        "value": pa.array(cols[4], pa.float64()),
        "props": pa.array(['{"k": %d}' % k for k in cols[5]], pa.string()),
    })
    pq.write_table(table, path)


def test_stream_dedup_watermark_and_batch_equality(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    os.makedirs(src)
    _write_events(os.path.join(src, "events_1.parquet"), [
        (1, "2024-01-01 10:00:00", 1, "purchase", 5.0, 0),
        (2, "2024-01-01 10:30:00", 2, "view", 1.0, 1),
        (3, "2024-01-02 09:00:00", 1, "purchase", 2.0, 2)])
    stream = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet")
    minutes = ST.stream_minutes(stream)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")

    def run():
        q = (minutes.writeStream.outputMode("update").option("checkpointLocation", ckpt)
             .foreachBatch(lambda b, i: b.withColumn("__batch", F.lit(i)).write.mode("append").parquet(out))
             .trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    # a second file arrives: a replayed duplicate, a late row inside the 1 h watermark,
    # and a row far behind the watermark
    _write_events(os.path.join(src, "events_2.parquet"), [
        (1, "2024-01-01 10:00:00", 1, "purchase", 5.0, 0),
        (4, "2024-01-02 08:30:00", 3, "view", 1.0, 3),
        (5, "2024-01-01 12:00:00", 3, "purchase", 9.0, 4)])
    run()
    rows = spark.read.parquet(out)
    values = [c for c in minutes.columns if c not in ST.MINUTE_KEYS]
    kept = rows.groupBy(*ST.MINUTE_KEYS).agg(F.max_by(F.struct(*values), "__batch").alias("v")).select(*ST.MINUTE_KEYS, "v.*")
    latest = {r.window_start.date().isoformat(): r for r in ST.daily_totals(kept).collect()}
    assert latest["2024-01-01"].interactions == 2 and latest["2024-01-01"].revenue == 5.0
    assert latest["2024-01-02"].interactions == 2          # late row inside watermark counted
    assert latest["2024-01-01"].active_customers == 2 and latest["2024-01-02"].active_customers == 2


def test_replay_raises_when_rows_come_too_late(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    os.makedirs(src)
    for n, when in enumerate(["2024-01-02 09:00:00", "2024-01-03 09:00:00", "2024-01-01 09:00:00"]):
        _write_events(os.path.join(src, f"events_{n}.parquet"), [(n, when, 1, "view", 1.0, 0)])
        os.utime(os.path.join(src, f"events_{n}.parquet"), (1_700_000_000 + n * 100,) * 2)
    stream = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet", max_files_per_trigger=1)
    with pytest.raises(RuntimeError, match="behind the watermark"):
        ST.run_minutes(stream)
    longer = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet", watermark="10 days", max_files_per_trigger=1)
    assert ST.run_minutes(longer).count() == 3


def test_replays_of_sink_and_enrichment_raise_with_few_reports_kept(spark, tmp_dir):
    sf = os.path.join(tmp_dir, "sf")
    src = os.path.join(sf, "events.parquet")
    os.makedirs(src)
    for n, when in enumerate(["2024-01-02 09:00:00", "2024-01-03 09:00:00", "2024-01-01 09:00:00", *["2024-01-03 10:00:00"] * 3]):
        _write_events(os.path.join(src, f"events_{n}.parquet"), [(n, when, 1, "view", 1.0, 0)])
        os.utime(os.path.join(src, f"events_{n}.parquet"), (1_700_000_000 + n * 100,) * 2)
    kept = spark.conf.get(ST.PROGRESS)
    stream = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet", max_files_per_trigger=1)
    try:
        spark.conf.set(ST.PROGRESS, "2")                   # the late row is in the third of six batches
        with pytest.raises(RuntimeError, match="behind the watermark"):
            ST.finish(ST.write_realtime(stream, os.path.join(tmp_dir, "rt"), os.path.join(tmp_dir, "ckpt"), available_now=True))
        spark.conf.set(ST.PROGRESS, "2")
        with pytest.MonkeyPatch.context() as m, pytest.raises(RuntimeError, match="behind the watermark"):
            m.setattr(ST.EN, "enrich", lambda batch: batch)
            m.setattr(ST.impact, "partial_impact", lambda rows: rows)
            ST.run_enriched(stream, dict)
        with pytest.MonkeyPatch.context() as m, pytest.raises(RuntimeError, match="behind the watermark"):
            m.setattr(registry, "_stream", lambda spark, sf: stream)
            m.setattr(registry.fx, "customers", lambda spark, sf: None)
            registry._sink(spark, sf)
    finally:
        spark.conf.set(ST.PROGRESS, kept)


def test_touchpoint_windows_count_customers_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), tp, c, 1, 2.0, 1, 5, 1) for m, tp, c in
            [(0, "web", 1), (2, "web", 1), (2, "web", 2), (40, "web", 1), (41, "app", 1), (41, None, 3), (41, "app", None)]]
    df = spark.createDataFrame(rows, "minute timestamp, touchpoint string, customer_id long, interactions long, revenue double, "
                                     "conversions long, session_sum long, session_n long")
    got = {(r.window_start, r.touchpoint): (r.interactions, r.revenue, r.unique_customers)
           for r in ST.touchpoint_windows(df, 30).collect()}
    want = {}
    for start in range(-40, 60):
        for tp in ("web", "app", None):
            inside = [r for r in rows if r[1] == tp and 0 <= (r[0] - t0).total_seconds() / 60 - start < 30]
            if inside:
                want[t0 + dt.timedelta(minutes=start), tp] = (len(inside), 2.0 * len(inside), len({r[2] for r in inside} - {None}))
    assert got == want


def test_streaming_equals_batch_on_sample(spark):
    sf = "/root/testdata/sf0.001"
    s = ST.read_interactions_stream(spark, sf, file_glob="events.parquet")
    got = ST.conversion_windows(ST.run_minutes(s))
    from pathlens.sources import fixtures
    i = fixtures.interactions(spark, sf)
    batch = ST.conversion_windows(ST.stream_minutes(i))     # same expression, batch execution
    a = sorted((r.window_start, r.interactions, round(r.conversion_rate, 9)) for r in got.collect())
    b = sorted((r.window_start, r.interactions, round(r.conversion_rate, 9)) for r in batch.collect())
    assert a == b and len(a) > 0


def test_write_realtime_sink(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    os.makedirs(src)
    _write_events(os.path.join(src, "events_1.parquet"), [
        (1, "2024-01-01 10:00:00", 1, "purchase", 5.0, 0),
        (2, "2024-01-02 10:30:00", 2, "view", 1.0, 1)])
    customers = spark.createDataFrame([(1, "GOLD")], "customer_id long, customer_segment string")
    stream = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet")
    out = os.path.join(tmp_dir, "realtime")
    q = ST.write_realtime(stream, out, os.path.join(tmp_dir, "ck"), customers=customers,
                          available_now=True)
    q.awaitTermination()
    rows = {r.interaction_id: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].customer_segment == "GOLD" and rows["2"].customer_segment == ""
    assert rows["1"].processed_timestamp is not None and str(rows["2"].date) == "2024-01-02"


def test_bucketed_tables_join_without_shuffle(spark):
    from pathlens.session import cluster_conf
    conf = cluster_conf(100 * 1024 ** 4, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    i = spark.createDataFrame([(f"I{n}", n % 50, "email") for n in range(500)],
                              "interaction_id string, customer_id long, touchpoint string")
    c = spark.createDataFrame([(n, f"city{n}") for n in range(50)], "customer_id long, city string")
    spark.sql("DROP TABLE IF EXISTS b_interactions")
    spark.sql("DROP TABLE IF EXISTS b_customers")
    io.write_table(i, "b_interactions", bucket_by=(4, ["customer_id"]))
    io.write_table(c, "b_customers", bucket_by=(4, ["customer_id"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("b_interactions").join(spark.table("b_customers"), "customer_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 500
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_build_warehouse_end_to_end(spark, tmp_dir):
    from pathlens.plans.batch import build_warehouse
    raw = os.path.join(tmp_dir, "raw")
    _write_raw(raw)
    tables = build_warehouse(spark, raw, os.path.join(tmp_dir, "wh"), "2024-01-31 00:00:00",
                             database="pl_build")
    assert set(tables) == {"customers", "interactions", "customer_journeys", "touchpoint_analysis",
                           "customer_segments", "time_series_data"}
    assert spark.table("pl_build.customer_segments").count() == 2
    i = spark.table("pl_build.interactions")
    assert dict(i.dtypes)["revenue"] == "double" and i.where("revenue = 0").count() == 2


def test_live_event_json_stream(spark, tmp_dir):
    import json as _json
    src = os.path.join(tmp_dir, "live")
    os.makedirs(src)
    stream = ST.read_live_events_stream(spark, src)          # starts on an empty folder
    events = [
        {"interaction_id": "A1", "customer_id": "CUST_1", "touchpoint": "website",
         "timestamp": "2024-01-05T10:00:00", "session_duration_minutes": 3, "pages_viewed": 2,
         "action_taken": "purchase", "product_category": "Books", "revenue": 25.0,
         "device_type": "mobile", "campaign_id": None, "customer_segment": "Premium", "customer_age": 30},
        {"interaction_id": "A2", "customer_id": "CUST_2", "touchpoint": "email",
         "timestamp": "2024-01-05T11:00:00", "session_duration_minutes": 1, "pages_viewed": None,
         "action_taken": "view", "product_category": "Books", "revenue": 0.0,
         "device_type": None, "campaign_id": "CAMP_1", "customer_segment": "Basic", "customer_age": 41},
    ]
    with open(os.path.join(src, "batch1.json"), "w") as f:
        for e in events + events[:1]:                          # includes a replayed duplicate
            f.write(_json.dumps(e) + "\n")
    got = ST.conversion_windows(ST.run_minutes(stream)).collect()
    by_start = {(r.window_start.hour, r.window_start.minute): r for r in got}
    assert by_start[10, 0].interactions == 1 and by_start[10, 0].conversion_rate == 100.0
    assert by_start[11, 0].interactions == 1 and by_start[11, 0].conversion_rate == 0.0


def _live(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _event(n, when):
    return ('{"interaction_id": "%s", "customer_id": "C1", "touchpoint": "email", "timestamp": "%s", "revenue": 1.0}'
            % (n, when))


def test_bad_events_go_to_the_reject_table_and_the_stream_goes_on(spark, tmp_dir):
    src, ck = os.path.join(tmp_dir, "live"), os.path.join(tmp_dir, "ck")
    good, bad = os.path.join(tmp_dir, "good"), os.path.join(tmp_dir, "bad")

    def run():
        ST.write_realtime(ST.read_live_events_stream(spark, src), good, ck + "-good", available_now=True).awaitTermination()
        ST.write_rejected(ST.read_live_records(spark, src), bad, ck + "-bad", available_now=True).awaitTermination()

    _live(src, "one.json", [_event("A", "2024-01-05T10:00:00"), _event("B", "bad"), "not json", _event("", "2024-01-05T10:00:00"),
                            '{"timestamp": "2024-01-05T10:00:00"}', "{}"])
    run()
    _live(src, "two.json", [_event("D", "2024-01-05T10:30:00")])
    run()
    assert sorted(r.interaction_id for r in spark.read.parquet(good).collect()) == ["A", "D"]
    rejects = spark.read.parquet(bad).collect()
    assert len(rejects) == 5 and {r.reason for r in rejects} == {"not a live event", "no valid timestamp", "no interaction_id"}
    assert "not json" in {r.record for r in rejects}


def test_restarted_sink_loses_nothing(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("events", "realtime", "ck"))
    os.makedirs(src)
    for run in range(2):
        _write_events(os.path.join(src, f"events_{run}.parquet"),
                      [(run * 500 + i, "2024-01-01 10:00:00", 1, "view", 1.0, 0) for i in range(500)])
        stream = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet")
        ST.write_realtime(stream, out, ck, available_now=True).awaitTermination()
    assert spark.read.parquet(out).select("interaction_id").distinct().count() == 1000
    with pytest.raises(TypeError):
        ST.write_realtime(stream, out)                      # a sink without its checkpoint is no sink


def test_readings_that_arrive_while_the_stream_runs(spark, tmp_dir):
    from pathlens.sources import factors as FA
    src, out, sums, ck = (os.path.join(tmp_dir, x) for x in ("events", "enriched", "impact", "ck"))
    os.makedirs(src)
    market, customers = [], []

    def tables():
        reading = "factor_time timestamp, market_sentiment string, change_percent double"
        return {"customers": spark.createDataFrame(customers, "customer_id long, city string"),
                "weather": spark.createDataFrame([], "city string, factor_time timestamp, temperature double, "
                                                     "weather_condition string, humidity long"),
                "market": spark.createDataFrame(market, reading),
                "news": spark.createDataFrame([], "factor_time timestamp, sentiment_label string, sentiment_score double"),
                "economic": spark.createDataFrame([], "factor_time timestamp, inflation_rate double, consumer_confidence double"),
                "facts": FA.city_facts(spark)}

    def step(n, minute):
        _write_events(os.path.join(src, f"events_{n}.parquet"), [(n, f"2024-01-01 10:{minute:02d}:00", 7, "purchase", 3.0, 0)])
        stream = ST.read_interactions_stream(spark, src, file_glob="events_*.parquet")
        ST.start_enriched(stream, tables, out, ck, sums, available_now=True).awaitTermination()

    step(1, 0)
    market.append((dt.datetime(2024, 1, 1, 10, 4), "positive", 1.0))
    customers.append((7, "Chicago"))
    step(2, 5)
    rows = {r.interaction_id: r for r in ST.enriched_table(spark, out).collect()}
    assert (rows["1"].market_sentiment, rows["1"].city) == (None, "New York")
    assert (rows["2"].market_sentiment, rows["2"].city) == ("positive", "Chicago")
    assert ST.factor_impact(spark, sums)["market_score"].first().matches == 1


def test_parse_live_events_from_record_values(spark):
    recs = spark.createDataFrame([
        ('{"interaction_id": "A1", "customer_id": "C1", "touchpoint": "email", '
         '"timestamp": "2024-01-05T10:00:00", "revenue": 2.5, "customer_age": 30}',),
        ('not json',)], "value string")
    rows = ST.parse_live_events(recs).collect()
    assert rows[0].interaction_id == "A1" and str(rows[0].timestamp) == "2024-01-05 10:00:00"
    assert rows[0].revenue == 2.5 and rows[0].pages_viewed is None
    assert rows[1].interaction_id is None


AWKWARD = ['say "hi"', "a,b;c", "two\nlines", "tab\there", " padded ", "", None, '"', '""', "\\", 'end\\"', "é 漢字 🙂", "NULL", "#x", "a\r\nb", '{"a": 1, "b": {"c": "d"}}',
           "'single'", ",", "\n"]


def _awkward_table(schema):
    """A row per awkward text, in every text column; the other columns plain, some null."""
    import datetime
    from pyspark.sql import types as T
    plain = {T.LongType(): lambda i: i * 7, T.DoubleType(): lambda i: i + 0.25, T.BooleanType(): lambda i: i % 2 == 0,
             T.DateType(): lambda i: datetime.date(2024, 1, 1 + i), T.TimestampType(): lambda i: dt.datetime(2024, 1, 1 + i, 2, 3, 4)}
    rows = []
    for i in range(len(AWKWARD)):
        rows.append(tuple(AWKWARD[(i + k) % len(AWKWARD)] if isinstance(f.dataType, T.StringType)
                          else None if f.nullable and (i + k) % 5 == 0 else plain[f.dataType](i) for k, f in enumerate(schema.fields)))
    return rows


def _key(rows):
    return sorted(map(repr, rows))


def test_all_six_tables_come_back_from_pandas_and_spark_csv(spark, tmp_dir):
    from pathlens.schemas import SCHEMAS
    from pyspark.sql import types as T
    names = [n for n in SCHEMAS if n != "realtime_interactions"]
    for writer in ("pandas", "spark"):
        raw, processed, target, bad = (os.path.join(tmp_dir, writer, x) for x in ("raw", "processed", "out", "rejects"))
        os.makedirs(raw), os.makedirs(processed)
        want = {}
        for name in names:
            rows = want[name] = _awkward_table(SCHEMAS[name])
            folder = raw if name in ("customers", "interactions") else processed
            if writer == "pandas":
                frame = pd.DataFrame(rows, columns=SCHEMAS[name].names, dtype=object)
                frame.to_csv(f"{folder}/{name}.csv", index=False)
                # pandas writes null and empty text alike
                want[name] = [tuple(None if x == "" else x for x in r) for r in rows]
            else:
                schema = T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMAS[name].fields])
                io.write_csv(spark.createDataFrame(rows, schema), f"{folder}/{name}.csv")
        assert io.load_all(spark, raw, processed, target, rejects=bad) == names
        assert io.rejected_counts(spark, bad).count() == 0
        for name in names:
            got = io.read_derived(spark, target, name)
            assert got.columns == SCHEMAS[name].names
            assert _key(map(tuple, got.collect())) == _key(want[name]), (writer, name)


def test_pandas_default_csv(spark, tmp_dir):
    """The reference's way: ``to_csv(index=False)``; null and empty text both read as null."""
    frame = pd.DataFrame({"customer_id": ["C1", "C2", "C3"], "journey_path": ["a -> b", 'q "x", y', "l1\nl2"],
                          "touchpoint_counts": ['{"a": 1, "b": 2}', "", None], "total_revenue": [1.5, None, 3.0]})
    os.makedirs(os.path.join(tmp_dir, "p"))
    frame.to_csv(os.path.join(tmp_dir, "p", "customer_journeys.csv"), index=False)
    io.load_all(spark, os.path.join(tmp_dir, "none"), os.path.join(tmp_dir, "p"), target=os.path.join(tmp_dir, "t"))
    got = {r.customer_id: r for r in io.read_derived(spark, os.path.join(tmp_dir, "t"), "customer_journeys").collect()}
    assert got["C1"].touchpoint_counts == '{"a": 1, "b": 2}' and got["C2"].journey_path == 'q "x", y'
    assert got["C3"].journey_path == "l1\nl2" and got["C2"].touchpoint_counts is None and got["C3"].total_revenue == 3.0


def test_crlf_files_and_folders_of_files(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "interactions.csv")
    os.makedirs(folder)
    for n in range(3):
        with open(os.path.join(folder, f"part-{n}.csv"), "w", newline="") as f:
            f.write(f'interaction_id,customer_id,action_taken\r\nI{n},C1,"x, ""y"""\r\nJ{n},C2,"two\nlines"\r\n')
    rows = io.read_csv_text(spark, folder).collect()
    assert sorted((r.interaction_id, r.action_taken) for r in rows) == sorted(
        [(f"I{n}", 'x, "y"') for n in range(3)] + [(f"J{n}", "two\nlines") for n in range(3)])


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    with open(f"{raw}/customers.csv", "w") as f:
        f.write("customer_id,city\nC1,Paris\n")
    with open(f"{raw}/interactions.csv", "w") as f:
        f.write('interaction_id,customer_id,action_taken\nI1,C1,"a\nb"\nI2,C1\nI3,C1,x,y\n"I4","C2","z"\n')
    bad = os.path.join(tmp_dir, "bad")
    c, i = io.read_raw(spark, raw, rejects=bad)
    assert sorted(r.interaction_id for r in i.collect()) == ["I1", "I4"] and c.count() == 1
    [counts] = io.rejected_counts(spark, bad).collect()
    assert (counts["name"], counts["records"]) == ("interactions", 2) and counts["file"].endswith("interactions.csv")
    assert sorted(r.record for r in spark.read.parquet(f"{bad}/interactions").collect()) == ["I2,C1", "I3,C1,x,y"]
    with pytest.raises(Exception, match="does not fit the header"):
        io.read_raw(spark, raw)[1].collect()
