"""Enrichment of interactions with external factors.

Events first get a city (their own, else their customer's, else the default,
H16). Weather is joined as-of per city, market, news and economic readings as-of on
their single series, city facts by a lookup join.
Every step is a left join: no interaction is ever dropped (J9).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import asof


def with_city(events: DataFrame, customers: DataFrame | None = None,
              default: str = config.DEFAULT_CITY) -> DataFrame:
    """City of each event; taken from the customer when the event has none."""
    if "city" in events.columns:
        return events.withColumn("city", F.coalesce("city", F.lit(default)))
    if customers is None:
        return events.withColumn("city", F.lit(default))
    c = customers.select("customer_id", F.col("city").alias("__city"))
    return (events.join(c, "customer_id", "left")
            .withColumn("city", F.coalesce("__city", F.lit(default))).drop("__city")
            .select(*events.columns, "city"))


WEATHER_VALUES = (("temperature", "weather_temperature"), ("weather_condition", "weather_condition"),
                  ("humidity", "weather_humidity"))
MARKET_VALUES = (("market_sentiment", "market_sentiment"), ("change_percent", "market_change_percent"))
ECONOMIC_VALUES = (("inflation_rate", "inflation_rate"), ("consumer_confidence", "consumer_confidence"))
NEWS_VALUES = (("sentiment_label", "news_sentiment"), ("sentiment_score", "news_sentiment_score"))
ECONOMIC_TOLERANCE_SECONDS = 3600
NEWS_TOLERANCE_SECONDS = 86_400


def weather_intervals(weather: DataFrame,
                      tolerance_seconds: int = config.FACTOR_TOLERANCE_SECONDS) -> asof.Intervals:
    return asof.prepare(weather, by=["city"], values=WEATHER_VALUES,
                        tolerance_seconds=tolerance_seconds)


def market_intervals(market: DataFrame,
                     tolerance_seconds: int = config.FACTOR_TOLERANCE_SECONDS) -> asof.Intervals:
    return asof.prepare(market, values=MARKET_VALUES, tolerance_seconds=tolerance_seconds)


def economic_intervals(economic: DataFrame,
                       tolerance_seconds: int = ECONOMIC_TOLERANCE_SECONDS) -> asof.Intervals:
    return asof.prepare(economic, values=ECONOMIC_VALUES, tolerance_seconds=tolerance_seconds)


def news_intervals(news: DataFrame, tolerance_seconds: int = NEWS_TOLERANCE_SECONDS) -> asof.Intervals:
    return asof.prepare(news, values=NEWS_VALUES, tolerance_seconds=tolerance_seconds)


def _iv(x, make):
    return x if isinstance(x, asof.Intervals) else make(x)


def enrich_weather(events: DataFrame, weather) -> DataFrame:
    """Temperature, condition, humidity of the event's city, as of the event.

    ``weather``: readings (city, factor_time, ...) or prepared ``Intervals``. Stations report as
    often as there are events, so both are sorted together; the other series are sparse.
    """
    if isinstance(weather, asof.Intervals):
        return asof.sorted_join(events, weather, by=["city"])
    return asof.asof_join(events, weather, by=[("city", "city")], values=WEATHER_VALUES,
                          tolerance_seconds=config.FACTOR_TOLERANCE_SECONDS)


def enrich_market(events: DataFrame, market) -> DataFrame:
    """Market sentiment and change percent as of the event."""
    return asof.join(events, _iv(market, market_intervals))


def enrich_economic(events: DataFrame, economic) -> DataFrame:
    """Inflation and consumer confidence as of the event (hourly, 1 h life)."""
    return asof.join(events, _iv(economic, economic_intervals))


def enrich_news(events: DataFrame, news) -> DataFrame:
    """Label and score of the news reading as of the event (daily, 1 day life)."""
    return asof.join(events, _iv(news, news_intervals))


def enrich_geo(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Population and median income of the event's city, defaults otherwise.

    ``facts`` is the fixed four-city lookup, broadcast (bounded by construction).
    """
    f = facts.select(F.col("city").alias("__c"), F.col("population").alias("__p"),
                     F.col("median_income").alias("__m"))
    pop_default, income_default, _ = config.CITY_DEFAULT
    return (events.join(F.broadcast(f), events["city"] == f["__c"], "left")
            .withColumn("city_population", F.coalesce("__p", F.lit(pop_default)).cast("long"))
            .withColumn("city_median_income", F.coalesce("__m", F.lit(income_default)).cast("long"))
            .drop("__c", "__p", "__m"))


def enrich(events: DataFrame, *, customers: DataFrame | None, weather: DataFrame,
           market: DataFrame, news: DataFrame, economic: DataFrame,
           facts: DataFrame) -> DataFrame:
    """The whole chain. Output = events + city + the eleven factor columns."""
    e = with_city(events, customers)
    e = enrich_weather(e, weather)
    e = enrich_market(e, market)
    e = enrich_news(e, news)
    e = enrich_economic(e, economic)
    return enrich_geo(e, facts)


TOLERANCES = {"weather": config.FACTOR_TOLERANCE_SECONDS, "market": config.FACTOR_TOLERANCE_SECONDS,
              "news": NEWS_TOLERANCE_SECONDS, "economic": ECONOMIC_TOLERANCE_SECONDS}


def pruned(tables: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """The arguments of ``enrich`` with only the readings that can match ``events``: those from the
    tolerance before the first event up to the last. The bounds are literals, so they reach the
    scan, and with a ``date`` column (a date-partitioned table) only those days are read: a
    micro-batch costs the same however long the history of readings is."""
    if not set(tables) & set(TOLERANCES):
        return tables
    ends = events.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    if ends["last"] is None:
        return {name: t.limit(0) if name in TOLERANCES and isinstance(t, DataFrame) else t for name, t in tables.items()}
    out = dict(tables)
    for name, seconds in TOLERANCES.items():
        readings = tables.get(name)
        if not isinstance(readings, DataFrame):
            continue                    # prepared intervals
        first, last = ends["first"] - dt.timedelta(seconds=seconds), ends["last"]
        kept = readings.where((F.col("factor_time") >= F.lit(first)) & (F.col("factor_time") <= F.lit(last)))
        if "date" in readings.columns:
            kept = kept.where(F.col("date").between(F.lit(first.date()), F.lit(last.date())))
        out[name] = kept
    return out
