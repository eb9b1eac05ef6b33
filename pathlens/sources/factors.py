"""External-factor tables (weather, market, economic, news, city facts).

The original fetched "current" readings over HTTP. Here each factor is a table of
timestamped readings that the enrichment joins as-of; ``sources.fixtures`` takes such
readings from the supplied tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import article_score, sentiment_label


def city_facts(spark: SparkSession) -> DataFrame:
    """J8 lookup: the four known cities (fixed values in ``config``)."""
    return spark.createDataFrame(
        [tuple(r) for r in config.CITY_FACTS],
        "city string, population long, median_income long, timezone string")


def news_sentiment(articles: DataFrame,
                   positive=config.POSITIVE_KEYWORDS, negative=config.NEGATIVE_KEYWORDS,
                   round_to: int | None = 2) -> DataFrame:
    """Per query, mean article score (+1/-1/0 by keyword counts) and its label.

    ``articles``: (query, text). Each whole text is scanned once per keyword with
    the built-in ``contains``; scores are partial-aggregated per query.
    """
    scored = articles.select("query", article_score("text", positive, negative).alias("s"))
    agg = scored.groupBy("query").agg(F.avg("s").alias("mean"), F.count("*").alias("n"))
    score = F.col("mean") if round_to is None else F.bround("mean", round_to)
    return agg.select("query", score.alias("sentiment_score"),
                      sentiment_label("mean").alias("sentiment_label"),
                      F.col("n").alias("articles_analyzed"))


def news_readings(articles: DataFrame, positive=config.POSITIVE_KEYWORDS,
                  negative=config.NEGATIVE_KEYWORDS, round_to: int | None = 2) -> DataFrame:
    """News sentiment as timestamped readings, one per day with articles.

    ``articles``: (published, text). The reading of a day covers that day's articles and is
    known, and so holds, from the next midnight (for a day at most, see ``enrich_news``).
    """
    daily = news_sentiment(articles.where(F.col("published").isNotNull())
                           .select(F.to_date("published").alias("query"), "text"), positive, negative, round_to)
    return daily.select(F.date_add("query", 1).cast("timestamp").alias("factor_time"),
                        "sentiment_score", "sentiment_label", "articles_analyzed")


def weather_payloads(weather: DataFrame) -> DataFrame:
    """Weather readings as provider-style JSON documents (city, factor_time, payload)."""
    doc = F.struct(
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.array(F.struct(F.col("weather_condition").alias("main"),
                         F.col("weather_description").alias("description"))).alias("weather"),
        F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
        (F.col("visibility") * 1000).alias("visibility"))
    return weather.select("city", "factor_time", F.to_json(doc).alias("payload"))


def quote_payloads(market: DataFrame) -> DataFrame:
    """Market readings as provider-style quote JSON (numbers as text, percent with '%')."""
    quote = F.struct(
        F.col("price").cast("string").alias("05. price"),
        F.col("volume").cast("string").alias("06. volume"),
        F.col("change").cast("string").alias("09. change"),
        F.concat(F.col("change_percent").cast("string"), F.lit("%")).alias("10. change percent"))
    return market.select("symbol", "factor_time",
                         F.to_json(F.struct(quote.alias("Global Quote"))).alias("payload"))
