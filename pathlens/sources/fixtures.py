"""Map the supplied parquet tables onto the application's two base tables.

``interactions`` comes from ``events`` (one row per event) and ``customers`` from
``customer`` + ``nation`` + first order date. Both are pure projections / one
aggregate, so Catalyst prunes columns and pushes filters into the parquet scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CITY_FACTS, TOUCHPOINTS
from ..functions.scalars import market_label


_TABLES: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; the relation (file listing, footer schema) is reused per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if "://" not in path:
        path = os.path.abspath(path)
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def _touchpoint_of(k):
    expr = None
    for i, tp in enumerate(TOUCHPOINTS[:-1]):
        expr = (F.when(k % 6 == i, F.lit(tp)) if expr is None
                else expr.when(k % 6 == i, F.lit(tp)))
    return expr.otherwise(F.lit(TOUCHPOINTS[-1]))


def interactions_from_events(events: DataFrame) -> DataFrame:
    """Events -> interactions (works on batch and streaming frames alike)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("interaction_id"),
        F.col("user_id").alias("customer_id"),
        _touchpoint_of(k).alias("touchpoint"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.lit(1) + k).cast("long").alias("session_duration_minutes"),
        F.when(k % 6 < 2, (F.lit(1) + k % 15).cast("long")).alias("pages_viewed"),
        F.col("event_type").alias("action_taken"),
        F.when(F.col("event_type") == "purchase", F.col("value"))
         .otherwise(F.lit(0.0)).alias("revenue"),
        F.when(F.col("event_id") % 5 < 2,
               F.concat(F.lit("CAMP_"), (F.col("event_id") % 50).cast("string")))
         .alias("campaign_id"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return interactions_from_events(table(spark, sf_dir, "events"))


def _city_of(nation: DataFrame):
    """The first nations stand for the cities with known facts, the others for unknown ones."""
    city = None
    for key, (name, *_) in enumerate(CITY_FACTS):
        hit = nation["n_nationkey"] == key
        city = F.when(hit, F.lit(name)) if city is None else city.when(hit, F.lit(name))
    return city.otherwise(nation["n_name"])


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + city by nation."""
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    # nation is a fixed 25-row dimension: broadcasting it is size-safe
    return (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey)
            .select(*[cust[c] for c in cust.columns], _city_of(nation).alias("city")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + city by nation + first order date as registration date."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cust = _cities(spark, sf_dir)
    first_order = (table(spark, sf_dir, "orders")
                   .groupBy("o_custkey")
                   .agg(F.min("o_orderdate").cast("date").alias("registration_date")))
    return (cust.join(first_order, cust.c_custkey == first_order.o_custkey, "left")
            .select(F.col("c_custkey").alias("customer_id"), "c_name", "city",
                    F.col("c_mktsegment").alias("customer_segment"),
                    F.col("c_acctbal").alias("lifetime_value"),
                    "registration_date"))


def english_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News articles: English documents, ``source`` as the query they answer."""
    return (table(spark, sf_dir, "documents").where(F.col("lang") == "en")
            .select("doc_id", F.col("source").alias("query"), "text"))


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: the user turns of ``conversations``."""
    return (table(spark, sf_dir, "conversations").where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("question")))


# ------------------------------------------------------------------ factors ----
# Readings taken from the supplied tables: values of the tables reach every column.

FACTOR_START = "2024-01-01 00:00:00"
WEATHER_CONDITIONS = ("Clear", "Clouds", "Rain", "Snow")


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station reports: every event, at its customer's city, up to 300 seconds before or after
    it (so an event need not meet a report of its own); some lack visibility."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k = F.get_json_object("props", "$.k").cast("int")
    condition = F.element_at(F.array(*[F.lit(c) for c in WEATHER_CONDITIONS]), k % 4 + 1)
    reports = table(spark, sf_dir, "events")
    cities = _cities(spark, sf_dir).select(F.col("c_custkey").alias("customer_id"), "city")
    return (reports.join(cities, reports["user_id"] == cities["customer_id"])
            .select("city", (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 7 - 3) * 100)).alias("factor_time"),
                    F.col("value").alias("temperature"), (F.lit(40) + k % 41).cast("long").alias("humidity"),
                    condition.alias("weather_condition"), F.lower(condition).alias("weather_description"),
                    ((k % 5) * F.lit(1.5)).alias("wind_speed"), (F.lit(1000) + k % 21).cast("long").alias("pressure"),
                    F.when(F.col("event_id") % 7 != 0, (F.lit(8) + k % 3).cast("double")).alias("visibility")))


def _laid_over_events(days: DataFrame, minutes: int):
    """The n-th day of a table as the n-th step of the events' time (a row per calendar day)."""
    n = F.row_number().over(Window.orderBy("day")) - 1
    return F.lit(FACTOR_START).cast("timestamp") + F.make_dt_interval(mins=n * minutes)


def market_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes: daily order totals, their day-on-day change, 15 minutes apart."""
    days = (table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"))
            .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("volume")))
    before = F.lag("cents").over(Window.orderBy("day"))
    quotes = days.withColumn("factor_time", _laid_over_events(days, 15)).withColumn("before", before)
    change = F.coalesce((F.col("cents") - F.col("before")) / 100.0, F.lit(0.0))
    percent = F.coalesce((F.col("cents") - F.col("before")) * 100.0 / F.col("before"), F.lit(0.0))
    return quotes.select(F.lit("ORDERS").alias("symbol"), "factor_time", (F.col("cents") / 100.0).alias("price"),
                         change.alias("change"), percent.alias("change_percent"), "volume",
                         market_label(change).alias("market_sentiment"))


def economic_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators: daily means and shares over line items by ship date, 20 minutes apart."""
    percent = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    days = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
            .agg(F.count("*").alias("n"), percent("l_tax").alias("tax"), percent("l_discount").alias("discount"),
                 F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
                 F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
                 F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("finished")))
    return days.withColumn("factor_time", _laid_over_events(days, 20)).select(
        "factor_time", (F.col("tax") / F.col("n")).alias("inflation_rate"),
        (F.col("discount") / F.col("n")).alias("unemployment_rate"),
        (F.col("quantity") / F.col("n")).alias("consumer_confidence"),
        (F.col("returned") * 100.0 / F.col("n")).alias("gdp_growth"),
        (F.col("finished") * 100.0 / F.col("n")).alias("interest_rate"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents with a time of publication, spread over the events' days."""
    minutes = (F.col("doc_id") * 2609) % (30 * 24 * 60)
    return (table(spark, sf_dir, "documents").where(F.col("lang") == "en")
            .select((F.lit(FACTOR_START).cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))).alias("published"),
                    "text"))
