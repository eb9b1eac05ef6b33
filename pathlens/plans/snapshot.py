"""The live dashboard's data as a named set of batch DataFrames at ``as_of``.

``buffer``: interactions with ``processed_timestamp``; ``enriched``: the enriched
interactions (``operators.enrich.enrich``). The entries are lazy DataFrames, but for the
running rate, which writes its narrow rows when it is built; an empty input gives empty
frames (and the documented defaults for one-row ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import config
from ..operators import impact, realtime


def snapshot(buffer: DataFrame, enriched: DataFrame | None, as_of) -> dict[str, DataFrame]:
    out = {
        "minute_trends": realtime.recent_minute_trends(buffer, as_of, config.RECENT_TREND_MINUTES),
        "touchpoint_performance": realtime.recent_touchpoints(buffer, as_of,
                                                              config.RECENT_TOUCHPOINT_MINUTES),
        "recent_interactions": realtime.latest_interactions(
            realtime.recent(buffer, as_of, config.RECENT_TREND_MINUTES), config.LATEST_INTERACTIONS),
        "conversion_window": realtime.conversion_window(buffer, as_of),
    }
    if enriched is not None:
        out.update({
            "weather_impact": impact.weather_impact(enriched),
            "best_weather": impact.best_weather(enriched),
            "market_score": impact.market_score(enriched),
            "sentiment_impact": impact.sentiment_impact(enriched),
            "sentiment_running_rate": impact.running_conversion_rate(enriched),
            "enriched_interactions": realtime.enriched_recent(enriched, config.LATEST_INTERACTIONS),
        })
    return out
