"""Fixed table schemas of the warehouse (S7) and the helpers that enforce them."""

from __future__ import annotations

from pyspark.sql import types as T

from .config import TOUCHPOINTS

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS, DT = T.TimestampType(), T.DateType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


def _f(name, dtype, required=False):
    return (name, dtype, not required)


CUSTOMERS = _struct(
    _f("customer_id", S, True), _f("first_name", S), _f("last_name", S), _f("email", S),
    _f("phone", S), _f("age", L), _f("gender", S), _f("city", S), _f("state", S),
    _f("country", S), _f("registration_date", DT), _f("customer_segment", S),
    _f("preferred_channel", S), _f("lifetime_value", D),
)

INTERACTIONS = _struct(
    _f("interaction_id", S, True), _f("customer_id", S, True), _f("touchpoint", S),
    _f("timestamp", TS), _f("session_duration_minutes", L), _f("pages_viewed", L),
    _f("action_taken", S), _f("product_category", S), _f("revenue", D),
    _f("device_type", S), _f("referrer_source", S), _f("campaign_id", S),
)

CUSTOMER_JOURNEYS = _struct(
    _f("customer_id", S, True), _f("journey_path", S), _f("total_interactions", L),
    _f("total_revenue", D), _f("journey_duration_days", L), _f("first_touchpoint", S),
    _f("last_touchpoint", S), _f("unique_touchpoints", L), _f("conversion_occurred", B),
    _f("touchpoint_counts", S),
)

TOUCHPOINT_ANALYSIS = _struct(
    _f("touchpoint", S, True), _f("total_interactions", L), _f("total_revenue", D),
    _f("avg_revenue_per_interaction", D), _f("avg_session_duration", D),
    _f("unique_customers", L), _f("conversion_rate", D),
)

CUSTOMER_SEGMENTS = T.StructType(list(CUSTOMERS.fields) + list(_struct(
    _f("total_interactions", L), _f("total_revenue", D), _f("unique_touchpoints_used", L),
    _f("avg_session_duration", D), _f("first_interaction", TS), _f("last_interaction", TS),
    _f("recency_days", L), _f("frequency_score", S), _f("monetary_score", S),
    _f("recency_score", S),
).fields))

TIME_SERIES_DATA = _struct(
    _f("date", DT, True), _f("daily_interactions", L), _f("daily_unique_customers", L),
    _f("daily_revenue", D), _f("avg_session_duration", D),
    *[_f(f"daily_{tp}_interactions", L) for tp in TOUCHPOINTS],
)

REALTIME_INTERACTIONS = _struct(
    _f("interaction_id", S, True), _f("customer_id", S, True), _f("touchpoint", S),
    _f("timestamp", TS), _f("revenue", D), _f("action_taken", S),
    _f("customer_segment", S), _f("processed_timestamp", TS),
)

# A live event as produced upstream (timestamp as ISO text).
LIVE_EVENT = _struct(
    _f("interaction_id", S), _f("customer_id", S), _f("touchpoint", S), _f("timestamp", S),
    _f("session_duration_minutes", L), _f("pages_viewed", L), _f("action_taken", S),
    _f("product_category", S), _f("revenue", D), _f("device_type", S), _f("campaign_id", S),
    _f("customer_segment", S), _f("customer_age", L),
)

SCHEMAS: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "interactions": INTERACTIONS,
    "customer_journeys": CUSTOMER_JOURNEYS,
    "touchpoint_analysis": TOUCHPOINT_ANALYSIS,
    "customer_segments": CUSTOMER_SEGMENTS,
    "time_series_data": TIME_SERIES_DATA,
    "realtime_interactions": REALTIME_INTERACTIONS,
}


def get_table_schema(name: str) -> T.StructType:
    """Named schema; an unknown name gives an empty schema."""
    return SCHEMAS.get(name, T.StructType([]))
