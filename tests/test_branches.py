"""The registered inputs reach every branch: no query is green on its default branch alone."""

import pytest

from pathlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,column,least", [
    ("enrich_weather", "weather_condition", 5), ("enrich_market", "market_sentiment", 3), ("enrich_news", "news_sentiment", 2),
    ("enrich_economic", "inflation_rate", 3), ("enrich_geo", "city_population", 2), ("sentiment_impact", "sentiment", 2),
    ("weather_impact", "weather_condition", 5), ("conversion_by_market", "market_sentiment", 2),
    ("clean_interactions", "device_type", 2), ("clean_interactions", "timestamp", 100), ("clean_customers", "phone", 2),
    ("clean_customers", "city", 5), ("parse_weather", "visibility", 3), ("parse_quote", "market_sentiment", 2),
    ("market_advice", "market_advice", 3), ("market_advice", "market_direction", 2), ("route_questions_corpus", "topic", 5),
    ("news_sentiment_pieces", "sentiment_label", 2), ("sentiment_running_rate", "sentiment", 2), ("answer_questions", "topic", 5),
])
def test_branches(spark, name, column, least):
    assert QUERIES[name](spark, SF).select(column).distinct().count() >= least


def test_cleaning_meets_bad_numbers(spark):
    rows = QUERIES["clean_interactions"](spark, SF).where("interaction_id % 11 = 0").select("revenue").distinct().collect()
    assert [r.revenue for r in rows] == [0.0]
