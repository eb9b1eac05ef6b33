import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import interactions
from pathlens.functions import quantiles
from pathlens.operators import derive


def test_journeys_order_duration_and_counts(spark):
    df = interactions(spark, [
        ("1", 1, "email", "2024-01-01 23:59:00", 0.0),
        ("2", 1, "website", "2024-01-02 00:01:00", 5.0),       # 2 minutes later: 0 days
        ("3", 2, "store_visit", "2024-01-05 10:00:00", 0.0),   # one-row customer
        ("b", 3, "website", "2024-01-01 00:00:00", 0.0),       # equal times: id order
        ("a", 3, "email", "2024-01-01 00:00:00", 0.0),
        ("c", 3, "website", "2024-01-02 00:00:00", 0.0),       # exactly 24 h after
        ("d", 3, "email", "2024-01-02 00:00:00", 0.0),
        ("e", 4, "email", "2024-01-01 00:00:00", float("nan")),  # NaN revenue
        ("f", 4, "email", "2024-01-01 01:00:00", 3.0),
    ])
    rows = {r.customer_id: r for r in derive.customer_journeys(df).collect()}
    assert rows[1].journey_path == "email -> website"
    assert rows[1].journey_duration_days == 0
    assert rows[1].conversion_occurred is True
    assert rows[2].journey_path == "store_visit" and rows[2].journey_duration_days == 0
    assert rows[2].first_touchpoint == rows[2].last_touchpoint == "store_visit"
    assert rows[3].journey_path == "email -> website -> website -> email"
    assert rows[3].journey_duration_days == 1
    assert (rows[3].first_touchpoint, rows[3].last_touchpoint) == ("email", "email")
    # tie 2-2: first seen (email at id 'a') comes first, python json.dumps layout
    assert rows[3].touchpoint_counts == '{"email": 2, "website": 2}'
    assert json.loads(rows[3].touchpoint_counts) == {"email": 2, "website": 2}
    assert rows[3].unique_touchpoints == 2
    assert math.isnan(rows[4].total_revenue) and rows[4].conversion_occurred is False


def test_journeys_chunking_does_not_change_paths(spark):
    rows = [(str(i), i % 3, ["a", "b", "c", "d"][i % 4],
             f"2024-01-{1 + i % 5:02d} {i % 24:02d}:{i % 60:02d}:00", float(i % 2)) for i in range(200)]
    df = interactions(spark, rows)
    fine = {r.customer_id: r.journey_path for r in derive.customer_journeys(df, 60).collect()}
    coarse = {r.customer_id: r.journey_path
              for r in derive.customer_journeys(df, 10 ** 9).collect()}
    assert fine == coarse
    pdf = pd.DataFrame(rows, columns=["id", "c", "tp", "t", "r"]).sort_values(["c", "t", "id"])
    for c, g in pdf.groupby("c"):
        assert fine[c] == " -> ".join(g.tp)


def test_touchpoint_analysis_nan_and_rounding(spark):
    df = interactions(spark, [
        ("1", 1, "email", "2024-01-01 00:00:00", 1.005),
        ("2", 2, "email", "2024-01-01 00:00:00", float("nan")),
        ("3", 2, "email", "2024-01-01 00:00:00", 0.0),
        ("4", 3, "website", "2024-01-01 00:00:00", 0.0),
    ])
    rows = {r.touchpoint: r for r in derive.touchpoint_analysis(df, round_to=None).collect()}
    e = rows["email"]
    assert e.total_interactions == 3 and e.unique_customers == 2
    assert e.total_revenue == pytest.approx(1.005)              # NaN skipped (H9)
    assert e.avg_revenue_per_interaction == pytest.approx(1.005 / 2)
    assert e.conversion_rate == pytest.approx(100 / 3)
    assert rows["website"].conversion_rate == 0.0
    r2 = {r.touchpoint: r for r in derive.touchpoint_analysis(df).collect()}
    assert r2["email"].conversion_rate == 33.33


def test_time_series_zero_fill(spark):
    df = interactions(spark, [("1", 1, "email", "2024-01-01 10:00:00", 2.0),
                              ("2", 1, "website", "2024-01-02 10:00:00", 0.0)])
    rows = {str(r.date): r for r in derive.time_series(df).collect()}
    assert rows["2024-01-01"].daily_email_interactions == 1
    assert rows["2024-01-01"].daily_website_interactions == 0
    assert rows["2024-01-02"].daily_store_visit_interactions == 0
    long = derive.time_series_long(derive.time_series(df))
    assert {r.touchpoint for r in long.collect()} >= {"email", "website", "interactions"}


def _numpy_q(values, qs):
    v = np.array([x for x in values if x is not None and not math.isnan(x)], dtype=float)
    return [float(np.quantile(v, q)) for q in qs]


@pytest.mark.parametrize("accuracy", [quantiles.DEFAULT_ACCURACY, 50])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(7)
    vals = list(np.round(rng.gamma(2.0, 30.0, 3000), 1)) + [5.0] * 400 + [None, float("nan")]
    df = spark.createDataFrame([(float(x) if x is not None else None,) for x in vals], "x double")
    qs = [0.0, 1 / 3, 0.5, 2 / 3, 0.8, 1.0]
    row = quantiles.quantile_row(df, ["x"], qs, accuracy=accuracy).first()
    got = [row["x"][f"q{i}"] for i in range(len(qs))]
    assert got == pytest.approx(_numpy_q(vals, qs), rel=1e-12)


def test_tertiles_match_qcut_and_survive_ties(spark):
    vals = [float(x) for x in [3, 9, 1, 7, 5, 11, 2, 8, 4, 10, 6, 12]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)] + [(99, None)], "id long, x double")
    out = quantiles.with_tertiles(df, {"s": ("x", ("Low", "Medium", "High"))})
    got = {r.id: r.s for r in out.collect()}
    expect = pd.qcut(pd.Series(vals), 3, labels=["Low", "Medium", "High"])
    assert [got[i] for i in range(len(vals))] == list(expect.astype(str))
    assert got[99] is None
    ties = spark.createDataFrame([(i, 1.0 if i < 8 else 2.0) for i in range(10)], "id long, x double")
    labels = {r.s for r in quantiles.with_tertiles(
        ties, {"s": ("x", ("Low", "Medium", "High"))}).collect()}
    assert labels <= {"Low", "Medium", "High"}   # pandas would raise here (H4)


def test_segments_keep_inactive_customers(spark):
    customers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")],
                                      "customer_id long, customer_segment string")
    df = interactions(spark, [("1", 1, "email", "2024-01-30 23:59:00", 1.0),
                              ("2", 2, "email", "2024-01-29 00:00:01", 0.0)])
    rows = {r.customer_id: r for r in derive.customer_segments(
        customers, df, "2024-01-31 00:00:00").collect()}
    assert rows[3].total_interactions is None and rows[3].frequency_score is None
    assert rows[1].recency_days == 0        # 1 minute ago: 0 whole days (H3)
    assert rows[2].recency_days == 1


def test_journey_path_is_concatenated_segments(spark):
    rows = [(str(i), i % 4, ["a", "b", "c"][i % 3],
             f"2024-01-{1 + i % 3:02d} {(7 * i) % 24:02d}:{i % 60:02d}:00", float(i % 2)) for i in range(120)]
    df = interactions(spark, rows)
    segs = {}
    for r in derive.journey_segments(df).collect():
        segs.setdefault(r.customer_id, []).append((r.segment_start, r.segment_path))
    paths = {r.customer_id: r.journey_path for r in derive.customer_journeys(df).collect()}
    for c, parts in segs.items():
        assert paths[c] == " -> ".join(p for _, p in sorted(parts))
