import math

from pathlens.functions.columns import coerce_numeric, conform
from pathlens.operators import clean
from pathlens.schemas import SCHEMAS


def test_clean_interactions_dirty_values(spark):
    df = spark.createDataFrame([
        ("1", "abc", "3", "1.5", "2024-01-01 10:00:00", None, None),
        ("2", "", "1.9", "nan", "2024-01-01 11:00:00", "mobile", "CAMP_1"),
        ("3", None, "7", None, None, None, None),
        ("4", "1.9", "x", "NaN", "2024-01-01 12:00:00", None, None),
    ], "interaction_id string, session_duration_minutes string, pages_viewed string, "
       "revenue string, timestamp string, device_type string, campaign_id string")
    rows = {r.interaction_id: r for r in clean.clean_interactions(df).collect()}
    assert [rows[k].session_duration_minutes for k in "1234"] == [0, 0, 0, 1]
    assert [rows[k].pages_viewed for k in "1234"] == [3, 1, 7, 0]
    assert [rows[k].revenue for k in "1234"] == [1.5, 0.0, 0.0, 0.0]
    assert rows["1"].device_type == "" and rows["2"].device_type == "mobile"
    assert rows["3"].campaign_id == "" and rows["3"].timestamp is None
    assert str(rows["1"].timestamp) == "2024-01-01 10:00:00"


def test_clean_customers(spark):
    df = spark.createDataFrame([("1", "forty", "12.5", "2023-05-06", None, None),
                                ("2", "33", "bad", "2023-05-07 10:00:00", "Chicago", "555")],
                               "customer_id string, age string, lifetime_value string, "
                               "registration_date string, city string, phone string")
    rows = {r.customer_id: r for r in clean.clean_customers(df).collect()}
    assert (rows["1"].age, rows["1"].lifetime_value, rows["1"].city, rows["1"].phone) == (0, 12.5, "", "")
    assert (rows["2"].age, rows["2"].lifetime_value) == (33, 0.0)
    assert str(rows["2"].registration_date) == "2023-05-07"


def test_coerce_numeric_threshold_and_whole(spark):
    n = 100
    rows = []
    for i in range(n):
        a = str(i) if i < 81 else "x"          # 81 % numeric -> converts
        b = str(i) if i < 80 else "x"          # exactly 80 % -> stays text
        c = f"{i}.5" if i < 90 else "oops"     # numeric, not whole -> double
        rows.append((a, b, c, "2024-01-02"))
    df = spark.createDataFrame(rows, "a string, b string, c string, date string")
    out = coerce_numeric(df)
    types = dict(out.dtypes)
    assert types["a"] == "bigint" and types["b"] == "string" and types["c"] == "double"
    assert types["date"] == "date"
    got = out.collect()
    assert got[90].a == 0 and got[95].c == 0.0 and got[3].c == 3.5
    assert not any(isinstance(r.c, float) and math.isnan(r.c) for r in got)


def test_conform_orders_and_casts(spark):
    df = spark.createDataFrame([("x", "7", "a1")], "touchpoint string, total_interactions string, junk string")
    out = conform(df, SCHEMAS["touchpoint_analysis"])
    assert out.columns == ["touchpoint", "total_interactions"]
    assert dict(out.dtypes)["total_interactions"] == "bigint"
