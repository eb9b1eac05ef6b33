"""Incremental build against a full one; published versions switch as a whole."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pathlens.operators import derive
from pathlens.plans import incremental as inc
from pathlens.sources import versions as V

DDL = ("interaction_id string, customer_id long, touchpoint string, timestamp timestamp, session_duration_minutes long, revenue double")
AS_OF = "2024-02-01 00:00:00"


def _interactions(spark, days=4, n=120):
    rng = random.Random(9)
    rows = [(f"I{d}-{k}" if rng.random() > 0.02 else None, rng.choice([None, *range(12)]), rng.choice(["email", "website", "store", None]),
             dt.datetime(2024, 1, 1 + d, rng.randrange(24), rng.randrange(60)), rng.choice([None, 3, 8]), rng.choice([0.0, 0.0, 4.5, None, float("nan")]))
            for d in range(days) for k in range(n)]
    return spark.createDataFrame(rows, DDL)


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def _full(customers, i):
    return {"customer_journeys": derive.customer_journeys(i), "touchpoint_analysis": derive.touchpoint_analysis(i, None),
            "customer_segments": derive.customer_segments(customers, i, AS_OF, None), "time_series_data": derive.time_series(i, round_to=None)}


def test_day_by_day_equals_a_full_build(spark, tmp_dir):
    source, base = os.path.join(tmp_dir, "interactions"), os.path.join(tmp_dir, "wh")
    _interactions(spark).withColumn("date", F.to_date("timestamp")).write.partitionBy("date").parquet(source)
    customers = spark.createDataFrame([(c, f"city{c}") for c in range(14)], "customer_id long, city string")
    table = spark.read.parquet(source)
    for d in range(1, 5):
        day = table.where(F.col("date") == F.lit(dt.date(2024, 1, d)))
        plan = day._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(date" in plan and f"2024-01-0{d}" in plan     # one day is read
        inc.build(spark, base, customers, day.drop("date"), AS_OF, None)
        full = _full(customers, table.where(F.col("date") <= F.lit(dt.date(2024, 1, d))).drop("date"))
        for name, want in full.items():
            got = V.read_current(spark, base, name)
            assert got.columns == want.columns
            assert repr(_rows(got)) == repr(_rows(want)), (name, d)
    before = _rows(V.read_current(spark, base, "customer_journeys"))
    inc.build(spark, base, customers, table.where("date = '2024-01-02'").drop("date"), AS_OF, None)      # a day again
    assert repr(_rows(V.read_current(spark, base, "customer_journeys"))) == repr(before)


def test_old_days_keep_their_files(spark, tmp_dir):
    base = os.path.join(tmp_dir, "wh")
    i = _interactions(spark, 2).persist()
    inc.add_days(spark, base, i.where("to_date(timestamp) = '2024-01-01'"))
    files = set(spark.read.parquet(f"{base}/partials/pieces").inputFiles())
    inc.add_days(spark, base, i.where("to_date(timestamp) = '2024-01-02'"))
    assert files < set(spark.read.parquet(f"{base}/partials/pieces").inputFiles())


def test_a_reader_and_a_killed_job_see_the_old_version_whole(spark, tmp_dir):
    base = os.path.join(tmp_dir, "t")
    V.publish(spark, base, {"a": spark.range(10), "b": spark.range(3)}, database="pl_versions")
    reader = V.read_current(spark, base, "a")
    catalog = spark.table("pl_versions.a")
    planned = catalog.selectExpr("sum(id) s")
    planned._jdf.queryExecution().executedPlan()

    def killed():
        raise RuntimeError("killed while writing")

    with pytest.raises(RuntimeError, match="killed"):
        V.publish(spark, base, {"a": spark.range(99), "b": killed}, database="pl_versions")
    assert V.read_current(spark, base, "a").count() == 10 and spark.table("pl_versions.a").count() == 10
    V.publish(spark, base, {"a": spark.range(5), "b": spark.range(4)}, database="pl_versions")
    assert reader.count() == 10 and planned.first().s == 45                # those that began before
    assert V.read_current(spark, base, "a").count() == 5 and spark.table("pl_versions.a").count() == 5
    assert spark.table("pl_versions.b").count() == 4
    assert V.drop_old_versions(spark, base) == 2 and V.read_current(spark, base, "a").count() == 5


def test_partitioned_tables_and_nothing_published(spark, tmp_dir):
    base = os.path.join(tmp_dir, "t")
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, base, "a")
    for n in (4, 6):
        V.publish(spark, base, {"p": spark.range(n).withColumn("part", F.col("id") % 2)}, "pl_versions", {"p": ["part"]})
        assert spark.table("pl_versions.p").count() == n and spark.table("pl_versions.p").where("part = 1").count() == n // 2
    with pytest.raises(ValueError):
        V.switch(spark, base, "/elsewhere/v-1")
