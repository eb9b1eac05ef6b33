"""Fixed values that must match the behaviour being reproduced.

Everything in this module is a constant; the code that uses it lives elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (kept exactly as the original application defines them)
# ---------------------------------------------------------------------------

# Interaction channels, in configured order.
TOUCHPOINTS = (
    "website",
    "mobile_app",
    "email",
    "social_media",
    "store_visit",
    "customer_service",
)

# Tertile labels used by the recency/frequency/monetary scores.
FREQUENCY_LABELS = ("Low", "Medium", "High")
MONETARY_LABELS = ("Low", "Medium", "High")
RECENCY_LABELS = ("Recent", "Moderate", "Distant")

# Journey path separator.
PATH_SEPARATOR = " -> "

# City used when an interaction has no city.
DEFAULT_CITY = "New York"

# Lookup life of an external reading, in seconds (as-of tolerance).
FACTOR_TOLERANCE_SECONDS = 300

# City facts: city, population, median income, timezone.
CITY_FACTS = (
    ("New York", 8400000, 65000, "EST"),
    ("Los Angeles", 4000000, 62000, "PST"),
    ("Chicago", 2700000, 58000, "CST"),
    ("Houston", 2300000, 55000, "CST"),
)
# Values for any other city: population, median income, timezone.
CITY_DEFAULT = (1000000, 60000, "EST")

# News sentiment keywords.
POSITIVE_KEYWORDS = ("growth", "increase", "positive", "success", "profit", "gain")
NEGATIVE_KEYWORDS = ("decline", "decrease", "negative", "loss", "drop", "fall")

# Market correlation score: step per matching interaction and label thresholds.
MARKET_SCORE_STEP = 0.1
MARKET_STRONG_ABOVE = 5
MARKET_MODERATE_ABOVE = 2
MARKET_LABEL_STRONG = "Strong positive correlation"
MARKET_LABEL_MODERATE = "Moderate correlation"
MARKET_LABEL_WEAK = "Weak correlation"

# Market advice thresholds on change percent.
ADVICE_PREMIUM_ABOVE = 2
ADVICE_VALUE_BELOW = -2
# Question routing: topic and its keywords, checked in this order; first match wins.
QUESTION_TOPICS = (
    ("touchpoint_performance", ("touchpoint", "channel", "performance")),
    ("customer_segments", ("segment", "customer", "valuable")),
    ("journey_patterns", ("journey", "path", "conversion")),
    ("revenue_trends", ("trend", "revenue", "time")),
    ("recommendations", ("recommend", "improve", "strategy")),
)
# Topic of a question that matches none of the keywords.
DEFAULT_TOPIC = "comprehensive"

# Number of days averaged at each end of the daily series for the trend label.
TREND_DAYS = 5
# Share of journeys above which a journey counts as high value.
HIGH_VALUE_QUANTILE = 0.8
# Number of entries in the first/last touchpoint frequency lists.
TOP_TOUCHPOINTS = 3
# Number of rows in the journey summary report.
JOURNEY_SUMMARY_ROWS = 10
# Windows of the in-memory real-time views, in minutes.
RECENT_TREND_MINUTES = 60
RECENT_TOUCHPOINT_MINUTES = 30
CONVERSION_WINDOW_MINUTES = 5
# Warehouse real-time queries look back this many hours.
LAST_HOUR_HOURS = 1
# Latest interactions shown.
LATEST_INTERACTIONS = 20
# Micro-batch sink defaults: rows per batch and seconds between batches.
STREAM_INTERVAL_SECONDS = 30

# ---------------------------------------------------------------------------
# OWN WORDING: advice and answers. The numbers that fill the slots follow the original's
# rules; the sentences around them are this library's.
# ---------------------------------------------------------------------------

ADVICE_PREMIUM = "The market has risen clearly: put premium offers forward."
ADVICE_VALUE = "The market has fallen clearly: put discounts and value offers forward."
ADVICE_UP = "The market is rising; conversions may follow."
ADVICE_DOWN = "The market is not rising; buyers may hold back."

# {name} placeholders; numbers arrive formatted.
INSIGHT_TOUCHPOINTS = """Touchpoints

Most revenue: {best_touchpoint} (${best_revenue} from {best_interactions} interactions, {best_rate}% of them conversions).
Highest conversion rate: {conv_touchpoint} ({conv_rate}%, ${conv_avg_revenue} per interaction).

{best_touchpoint} carries the revenue and {conv_touchpoint} converts best; changes to these two have the largest effect."""

INSIGHT_SEGMENTS = """Segments

Most revenue: {segment} (${total_revenue} from {customer_count} customers).
Per customer in {segment}: ${avg_revenue} and {avg_interactions} interactions on average.

Keep the customers of {segment}, and look for customers elsewhere who behave like them."""

INSIGHT_JOURNEYS = """Journeys

A journey has {avg_length} interactions over {avg_duration} days on average; {conversion_rate}% of journeys convert.
They most often begin at {top_first} ({top_first_count} customers) and end at {top_last} ({top_last_count} customers).

The way from {top_first} to {top_last} deserves the first look; {conversion_rate}% is the rate to raise."""

INSIGHT_TRENDS = """Revenue

Total: ${total_revenue}, or ${avg_daily_revenue} a day. Direction: {trend_title}.
Best day: {peak_date}, with ${peak_revenue} from {peak_interactions} interactions.

Daily revenue is {trend}; find out what happened on {peak_date}."""

INSIGHT_RECOMMENDATIONS = """Recommendations

Now: give the touchpoints that earn most more room, and mend those with many visits and few sales.
Next: shorten journeys that take long, and treat every channel as one visit.
Later: measure what a customer is worth over time, and offer what fits that customer."""

NO_DATA = {
    "touchpoint_performance": "There are no touchpoints to report on.",
    "customer_segments": "There are no segments to report on.",
    "journey_patterns": "There are no journeys to report on.",
    "revenue_trends": "There are no days to report on.",
}
SUMMARY_HEADER = "# What the interactions show\n\n"
# Order of the full summary (all five answers).
SUMMARY_TOPICS = ("touchpoint_performance", "customer_segments", "journey_patterns",
                  "revenue_trends", "recommendations")
# The three answers joined for a question that matches no topic.
COMPREHENSIVE_TOPICS = ("touchpoint_performance", "customer_segments", "journey_patterns")
COMPREHENSIVE_SEPARATOR = "\n\n"
