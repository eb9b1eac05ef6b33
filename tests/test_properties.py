"""Property tests: distributed operators against brute force on random small inputs."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pathlens.functions import quantiles
from pathlens.operators import derive
from pathlens.operators.asof import asof_join

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = dt.datetime(2024, 1, 1)


@SETTINGS
@given(values=st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e3, 1e3)),
                       min_size=1, max_size=400),
       q=st.sampled_from([0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.8, 1.0]),
       accuracy=st.sampled_from([2, 10, 10_000]))       # a poor sketch changes no result
def test_quantile_row_equals_numpy(spark, values, q, accuracy):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.quantile_row(df, ["x"], [q], accuracy=accuracy).first()["x"]["q0"]
    assert got == pytest.approx(float(np.quantile(np.array(values), q)), rel=1e-9, abs=1e-9)


@SETTINGS
@given(readings=st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(0, 4000)),
                         min_size=1, max_size=25),
       events=st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 4500)),
                       min_size=1, max_size=40),
       tol=st.sampled_from([60, 300, 1000]))
def test_asof_join_equals_brute_force(spark, readings, events, tol):
    # one value per (key, time): the greatest wins, as in the operator
    best = {}
    for i, (k, s) in enumerate(readings):
        best[(k, s)] = max(best.get((k, s), -1), i)
    rd = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), float(v)) for (k, s), v in best.items()],
                               "city string, factor_time timestamp, v double")
    ev = spark.createDataFrame([(str(i), k, T0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(events)],
                               "id string, city string, timestamp timestamp")
    got = {r.id: r.v for r in asof_join(ev, rd, by=[("city", "city")], values=[("v", "v")],
                                        tolerance_seconds=tol).collect()}
    for i, (k, s) in enumerate(events):
        cands = [(rs, v) for (rk, rs), v in best.items() if rk == k and rs <= s]
        expect = None
        if cands:
            rs, v = max(cands)
            expect = float(v) if s - rs <= tol else None
        assert got[str(i)] == expect


def _journeys_brute_force(rows):
    pdf = pd.DataFrame(rows, columns=["interaction_id", "customer_id", "touchpoint", "timestamp",
                                      "revenue"]).sort_values(["customer_id", "timestamp", "interaction_id"])
    out = {}
    for cust, g in pdf.groupby("customer_id"):
        tps, ts = list(g.touchpoint), list(g.timestamp)
        counts = {}
        for tp in tps:
            counts[tp] = counts.get(tp, 0) + 1
        order = sorted(counts, key=lambda tp: (-counts[tp], tps.index(tp)))
        out[cust] = (" -> ".join(tps), len(tps), float(sum(g.revenue)),
                     (ts[-1] - ts[0]).days if len(ts) > 1 else 0, tps[0], tps[-1],
                     len(set(tps)), json.dumps({tp: counts[tp] for tp in order}))
    return out


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["web", "app", "mail", "shop"]),
                               st.integers(0, 5 * 86400), st.sampled_from([0.0, 1.5, 20.0])),
                     min_size=1, max_size=60),
       chunk=st.sampled_from([60, 3600, 86400]))
def test_journeys_equal_brute_force(spark, rows, chunk):
    data = [(f"{i:04d}", c, tp, T0 + dt.timedelta(seconds=s), r) for i, (c, tp, s, r) in enumerate(rows)]
    df = spark.createDataFrame(data, "interaction_id string, customer_id long, touchpoint string, "
                                     "timestamp timestamp, revenue double")
    got = {r.customer_id: (r.journey_path, r.total_interactions, r.total_revenue,
                           r.journey_duration_days, r.first_touchpoint, r.last_touchpoint,
                           r.unique_touchpoints, r.touchpoint_counts)
           for r in derive.customer_journeys(df, chunk).collect()}
    expect = _journeys_brute_force(data)
    assert set(got) == set(expect)
    for c in expect:
        g, e = got[c], expect[c]
        assert g[:2] == e[:2] and math.isclose(g[2], e[2]) and g[3:] == e[3:]


def test_hot_customer_holding_a_third_of_rows(spark):
    """One customer with a third of all rows: journeys, segments' behaviour and
    the running rate still equal brute force (the hot key spans many chunks)."""
    import random
    rnd = random.Random(11)
    data = []
    for i in range(3000):
        cust = 0 if i % 3 == 0 else rnd.randint(1, 200)
        data.append((f"{i:05d}", cust, rnd.choice(["web", "app", "mail"]),
                     T0 + dt.timedelta(seconds=rnd.randint(0, 3 * 86400)), rnd.choice([0.0, 0.0, 4.0])))
    df = spark.createDataFrame(data, "interaction_id string, customer_id long, touchpoint string, "
                                     "timestamp timestamp, revenue double")
    expect = _journeys_brute_force(data)
    got = {r.customer_id: r for r in derive.customer_journeys(df).collect()}
    assert got[0].total_interactions == 1000
    assert got[0].journey_path == expect[0][0] and got[0].touchpoint_counts == expect[0][7]
    segs = derive.journey_segments(df).where("customer_id = 0").count()
    assert segs > 50                                        # the hot path is spread over rows
    from pyspark.sql import functions as F
    beh = {r.customer_id: r for r in derive.customer_behavior(
        df.withColumn("session_duration_minutes", F.lit(5)), round_to=None).collect()}
    assert beh[0].total_interactions == 1000
    assert beh[0].total_revenue == pytest.approx(sum(r[4] for r in data if r[1] == 0))
