"""Scalar column expressions (X1-X12, P6). All built-in Spark functions, no UDFs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

MICROS_PER_DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> null, so that sums and means skip it as pandas does (H9)."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def is_conversion(revenue: str | Column = "revenue") -> Column:
    """Revenue > 0; NaN and null are not conversions."""
    return F.coalesce(nan_to_null(revenue) > 0, F.lit(False))


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Floor of elapsed days between two timestamps (not calendar days, H3)."""
    delta = F.unix_micros(col(end)) - F.unix_micros(col(start))
    return F.floor(delta / F.lit(MICROS_PER_DAY)).cast("long")


def event_order(ts: str | Column = "timestamp", key: str | Column = "interaction_id") -> Column:
    """Total order of interactions: time, then id."""
    return F.struct(col(ts).alias("t"), col(key).cast("string").alias("k"))


def path_text(items: Column, sep: str = config.PATH_SEPARATOR) -> Column:
    """Join an ordered array of names into a path."""
    return F.array_join(items, sep)


def _json_string(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_counts(entries: Column, key: str = "touchpoint", count: str = "n") -> Column:
    """An ordered array of (key, count) structs as JSON object text.

    Output layout follows Python's ``json.dumps``: ``{"a": 3, "b": 1}``.
    """
    body = F.array_join(
        F.transform(entries, lambda e: F.concat(_json_string(e[key]), F.lit(": "),
                                                e[count].cast("string"))),
        ", ")
    return F.concat(F.lit("{"), body, F.lit("}"))


def market_label(change: str | Column) -> Column:
    """Positive when the change is above zero, else negative."""
    return F.when(col(change) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def sentiment_label(score: str | Column) -> Column:
    """Label by the sign of an (unrounded) score."""
    s = col(score)
    return (F.when(s > 0, F.lit("positive"))
            .when(s < 0, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def keyword_hits(text_lower: Column, keywords: Iterable[str]) -> Column:
    """Number of distinct keywords that occur as substrings of the text."""
    hits = [F.contains(text_lower, F.lit(k)).cast("int") for k in dict.fromkeys(keywords)]
    if not hits:
        return F.lit(0)
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def article_score(text: str | Column,
                  positive: Iterable[str] = config.POSITIVE_KEYWORDS,
                  negative: Iterable[str] = config.NEGATIVE_KEYWORDS) -> Column:
    """X8 per article: +1 more positive keywords, -1 more negative, else 0."""
    low = F.lower(col(text))
    return F.signum(keyword_hits(low, positive) - keyword_hits(low, negative)).cast("int")


def market_advice(change_percent: str | Column) -> Column:
    """Recommendation from the market change percent (null when none applies)."""
    c = col(change_percent)
    return (F.when(c > config.ADVICE_PREMIUM_ABOVE, F.lit(config.ADVICE_PREMIUM))
            .when(c < config.ADVICE_VALUE_BELOW, F.lit(config.ADVICE_VALUE)))


def market_direction(change_percent: str | Column) -> Column:
    """up/down message."""
    return F.when(col(change_percent) > 0, F.lit(config.ADVICE_UP)).otherwise(F.lit(config.ADVICE_DOWN))


def lenient_double(c: str | Column) -> Column:
    """Text -> double; bad text -> null instead of an error."""
    return col(c).cast("string").try_cast("double")


def lenient_long(c: str | Column) -> Column:
    """Text -> whole number, truncating decimals ('1.9' -> 1); bad text -> null."""
    return lenient_double(c).try_cast("long")
