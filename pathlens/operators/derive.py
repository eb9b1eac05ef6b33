"""The four derived tables: journeys, touchpoint analysis, segments, daily series.

All are partial (map-side combined) aggregations keyed by a column of the
interactions, so a shuffle moves one row per group per map task. Only the journey's
path text and channel tally need the rows of a chunk; reports that do not read these
columns do not shuffle them either (column pruning drops the lists).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import quantiles
from ..functions.scalars import (is_conversion, json_counts, nan_to_null, path_text,
                                 whole_days_between)


def rounded(c: Column, round_to: int | None) -> Column:
    """Half-even rounding as pandas does (H2); ``None`` keeps full precision."""
    return c if round_to is None else F.bround(c, round_to)


def _sum0(c: Column) -> Column:
    """pandas group sum: NaN/null skipped, an all-missing group sums to 0."""
    return F.coalesce(F.sum(nan_to_null(c)), F.lit(0.0))


# ---------------------------------------------------------------- A1 ----------

def touchpoint_analysis(interactions: DataFrame, round_to: int | None = 2) -> DataFrame:
    """A1: per touchpoint volume, revenue, session length, reach and conversion %."""
    agg = (interactions.where(F.col("touchpoint").isNotNull())
           .groupBy("touchpoint")
           .agg(F.count("interaction_id").alias("total_interactions"),
                _sum0(F.col("revenue")).alias("total_revenue"),
                F.avg(nan_to_null("revenue")).alias("avg_revenue_per_interaction"),
                F.avg("session_duration_minutes").alias("avg_session_duration"),
                F.countDistinct("customer_id").alias("unique_customers"),
                F.count(F.when(is_conversion("revenue"), F.col("interaction_id")))
                 .alias("conversions")))
    rate = F.coalesce(F.try_divide(F.col("conversions") * F.lit(100.0),
                                   F.col("total_interactions")), F.lit(0.0))
    return agg.select(
        "touchpoint", "total_interactions",
        rounded(F.col("total_revenue"), round_to).alias("total_revenue"),
        rounded(F.col("avg_revenue_per_interaction"), round_to).alias("avg_revenue_per_interaction"),
        rounded(F.col("avg_session_duration"), round_to).alias("avg_session_duration"),
        "unique_customers",
        rounded(rate, round_to).alias("conversion_rate"))


# ---------------------------------------------------------------- A2 ----------

def customer_journeys(interactions: DataFrame, chunk_seconds: int = 3600,
                      with_path: bool = True) -> DataFrame:
    """A2: one row per customer with the ordered path and journey facts.

    ``with_path=False`` leaves ``journey_path`` out: one text per customer cannot hold a
    customer with a huge share of all rows; ``journey_segments`` has such paths in pieces.

    One scan, two partially aggregated shuffles, no join:

    1. (customer, time chunk) groups sort their rows and produce the chunk's path
       text, count, revenue, first/last row and a small channel tally (count and
       first-seen row per channel, computed with array functions on the sorted
       chunk), so no task ever sorts a whole customer;
    2. per customer, chunk texts are concatenated in time order and the chunk
       tallies merged. That step holds one short text and a few tally entries per
       chunk; the final path text is the output itself.
    """
    return journeys_of(journey_pieces(interactions, chunk_seconds), with_path)


def journey_pieces(interactions: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Step 1 of ``customer_journeys``: a row per (customer, time chunk). Pieces of different times
    can be stored and put together later; with chunks that divide a day none spans two days."""
    i = interactions.where(F.col("customer_id").isNotNull())
    order = F.struct(F.col("timestamp").alias("t"),
                     F.col("interaction_id").cast("string").alias("k"),
                     F.col("touchpoint").alias("tp"))
    chunk = F.floor(F.unix_micros("timestamp") / F.lit(chunk_seconds * 1_000_000))
    # Python sum over the path: a missing revenue makes the journey total NaN
    rev_nan = F.coalesce(F.col("revenue"), F.lit(float("nan")))
    seq = F.col("seq")
    channels = F.filter(F.array_distinct(F.transform(seq, lambda e: e["tp"])),
                        lambda tp: tp.isNotNull())
    chunk_tally = F.transform(channels, lambda tp: F.struct(
        tp.alias("tp"),
        F.size(F.filter(seq, lambda e: e["tp"] == tp)).alias("n"),
        F.get(F.filter(seq, lambda e: e["tp"] == tp), 0).dropFields("tp").alias("seen")))
    return (i.groupBy("customer_id", chunk.alias("chunk"))
              .agg(F.count("*").alias("n"), F.sum(rev_nan).alias("rev"),
                   F.min(order).alias("first"), F.max(order).alias("last"),
                   F.array_sort(F.collect_list(order)).alias("seq"))
              .select("customer_id", "n", "rev", "first", "last",
                      path_text(F.transform(seq, lambda e: e["tp"])).alias("part"),
                      chunk_tally.alias("tally")))


def journeys_of(pieces: DataFrame, with_path: bool = True) -> DataFrame:
    """Step 2 of ``customer_journeys``: the journeys of all pieces."""
    per_customer = (pieces.groupBy("customer_id")
                    .agg(F.sum("n").alias("total_interactions"),
                         F.sum("rev").alias("total_revenue"),
                         F.min("first").alias("first"), F.max("last").alias("last"),
                         F.sort_array(F.collect_list(F.struct(F.col("first").alias("o"),
                                                              F.col("part").alias("p"))))
                          .alias("parts"),
                         F.flatten(F.collect_list("tally")).alias("tallies")))
    tallies = F.col("tallies")
    merged = F.transform(
        F.array_distinct(F.transform(tallies, lambda e: e["tp"])),
        lambda tp: F.struct(
            F.aggregate(F.filter(tallies, lambda e: e["tp"] == tp), F.lit(0),
                        lambda acc, e: acc + e["n"]).alias("n"),
            F.array_min(F.transform(F.filter(tallies, lambda e: e["tp"] == tp),
                                    lambda e: e["seen"])).alias("seen"),
            tp.alias("touchpoint")))
    entries = F.array_sort(F.transform(merged, lambda m: F.struct(
        (-m["n"]).alias("neg"), m["seen"].alias("seen"), m["touchpoint"].alias("touchpoint"),
        m["n"].alias("n"))))
    parts = F.filter("parts", lambda e: F.length(e["p"]) > 0)
    total = F.col("total_revenue")
    path = [path_text(F.transform(parts, lambda e: e["p"])).alias("journey_path")] if with_path else []
    return (per_customer.withColumn("entries", entries)
            .select("customer_id", *path,
                    "total_interactions",
                    total.alias("total_revenue"),
                    F.when(F.col("total_interactions") > 1,
                           whole_days_between(F.col("first.t"), F.col("last.t")))
                     .otherwise(F.lit(0)).cast("long").alias("journey_duration_days"),
                    F.col("first.tp").alias("first_touchpoint"),
                    F.col("last.tp").alias("last_touchpoint"),
                    F.size("entries").cast("long").alias("unique_touchpoints"),
                    F.when(F.isnan(total), F.lit(False)).otherwise(total > 0)
                     .alias("conversion_occurred"),
                    json_counts(F.col("entries"), "touchpoint", "n").alias("touchpoint_counts")))


def customer_revenue(interactions: DataFrame) -> DataFrame:
    """(customer_id, total_revenue) as ``customer_journeys`` has it, without the journey."""
    return (interactions.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.sum(F.coalesce(F.col("revenue"), F.lit(float("nan")))).alias("total_revenue")))


def journey_segments(interactions: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """The journeys' skew-safe form: one row per (customer, time chunk) with the
    ordered path piece, its size, revenue and first/last touchpoint.

    ``customer_journeys.journey_path`` is these pieces joined in ``segment_start``
    order. A customer with a huge share of all rows spreads over many rows here
    instead of forming one giant row.
    """
    i = interactions.where(F.col("customer_id").isNotNull())
    order = F.struct(F.col("timestamp").alias("t"),
                     F.col("interaction_id").cast("string").alias("k"),
                     F.col("touchpoint").alias("tp"))
    width = chunk_seconds * 1_000_000
    chunk = F.floor(F.unix_micros("timestamp") / F.lit(width))
    seq = F.col("seq")
    return (i.groupBy("customer_id", chunk.alias("chunk"))
            .agg(F.count("*").alias("interactions"), F.sum("revenue").alias("revenue"),
                 F.array_sort(F.collect_list(order)).alias("seq"))
            .select("customer_id",
                    F.timestamp_micros(F.col("chunk") * F.lit(width)).alias("segment_start"),
                    path_text(F.transform(seq, lambda e: e["tp"])).alias("segment_path"),
                    "interactions", "revenue",
                    seq[0]["tp"].alias("first_touchpoint"),
                    F.element_at(seq, -1)["tp"].alias("last_touchpoint")))


# ---------------------------------------------------------------- A3/A4 -------

def customer_behavior(interactions: DataFrame, round_to: int | None = 2) -> DataFrame:
    """A3: per customer activity."""
    agg = (interactions.where(F.col("customer_id").isNotNull())
           .groupBy("customer_id")
           .agg(F.count("interaction_id").alias("total_interactions"),
                _sum0(F.col("revenue")).alias("total_revenue"),
                F.countDistinct("touchpoint").alias("unique_touchpoints_used"),
                F.avg("session_duration_minutes").alias("avg_session_duration"),
                F.min("timestamp").alias("first_interaction"),
                F.max("timestamp").alias("last_interaction")))
    return agg.select("customer_id", "total_interactions",
                      rounded(F.col("total_revenue"), round_to).alias("total_revenue"),
                      "unique_touchpoints_used",
                      rounded(F.col("avg_session_duration"), round_to).alias("avg_session_duration"),
                      "first_interaction", "last_interaction")


def customer_segments(customers: DataFrame, interactions: DataFrame, as_of,
                      round_to: int | None = 2,
                      accuracy: int = quantiles.DEFAULT_ACCURACY,
                      checkpoint: bool = True) -> DataFrame:
    """A4: customers + behaviour + recency + three tertile scores (W1), left join.

    ``as_of`` replaces the wall clock (H1). Tertile cut points are exact
    quantiles attached as scalar subqueries. With ``checkpoint=True`` the
    behaviour table is checkpointed once (shared checkpoint folder) so the cut
    point passes read it instead of re-aggregating the interactions.
    """
    beh = customer_behavior(interactions, round_to).withColumn(
        "recency_days", whole_days_between(F.col("last_interaction"), F.lit(as_of).cast("timestamp")))
    if checkpoint:
        from ..session import checkpoint_dir
        checkpoint_dir(beh.sparkSession)
        beh = beh.checkpoint(eager=True)
    scored = quantiles.with_tertiles(beh, {
        "frequency_score": ("total_interactions", config.FREQUENCY_LABELS),
        "monetary_score": ("total_revenue", config.MONETARY_LABELS),
        "recency_score": ("recency_days", config.RECENCY_LABELS)}, accuracy)
    return customers.join(scored, "customer_id", "left")


# ---------------------------------------------------------------- A5/A6 -------

def time_series(interactions: DataFrame, touchpoints: Sequence[str] = config.TOUCHPOINTS,
                round_to: int | None = 2) -> DataFrame:
    """Daily totals plus one count column per touchpoint (zero-filled).

    The wide part is conditional counts in the same aggregate (no pivot pass,
    and it also works on streams, H7). ``touchpoints`` fixes the columns.
    """
    tp_cols = [F.count(F.when(F.col("touchpoint") == tp, F.col("interaction_id")))
               .alias(f"daily_{tp}_interactions") for tp in touchpoints]
    agg = (interactions.where(F.col("timestamp").isNotNull())
           .groupBy(F.to_date("timestamp").alias("date"))
           .agg(F.count("interaction_id").alias("daily_interactions"),
                F.countDistinct("customer_id").alias("daily_unique_customers"),
                _sum0(F.col("revenue")).alias("daily_revenue"),
                F.avg("session_duration_minutes").alias("avg_session_duration"),
                *tp_cols))
    return agg.select("date", "daily_interactions", "daily_unique_customers",
                      rounded(F.col("daily_revenue"), round_to).alias("daily_revenue"),
                      rounded(F.col("avg_session_duration"), round_to).alias("avg_session_duration"),
                      *[f"daily_{tp}_interactions" for tp in touchpoints])


def time_series_long(series: DataFrame) -> DataFrame:
    """Wide daily counts -> (date, touchpoint, interactions).

    Selects columns named ``daily_*_interactions`` like the chart code does; the
    total column ``daily_interactions`` also matches that pattern and appears
    as touchpoint ``interactions``.
    """
    cols = [c for c in series.columns if c.startswith("daily_") and c.endswith("_interactions")]
    long = series.unpivot(["date"], cols, "column", "interactions")
    name = F.regexp_replace(F.regexp_replace("column", "^daily_", ""), "_interactions$", "")
    return long.select("date", name.alias("touchpoint"), F.col("interactions").cast("long"))
