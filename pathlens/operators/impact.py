"""Effect of external factors on interactions (A19-A23, W6) over enriched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import event_order, is_conversion
from ..session import written


def weather_impact(enriched: DataFrame) -> DataFrame:
    """Revenue sum, count and mean per weather condition (missing -> Unknown)."""
    cond = F.coalesce(F.col("weather_condition"), F.lit("Unknown"))
    return (enriched.groupBy(cond.alias("weather_condition"))
            .agg(F.sum("revenue").alias("total_revenue"),
                 F.count("*").alias("interaction_count"))
            .withColumn("avg_revenue", F.col("total_revenue") / F.col("interaction_count")))


def best_weather(enriched: DataFrame) -> DataFrame:
    """Condition with the highest mean revenue (2 dp, ties: first seen); Unknown if none."""
    cond = F.coalesce(F.col("weather_condition"), F.lit("Unknown"))
    per = (enriched.groupBy(cond.alias("c"))
           .agg((F.sum("revenue") / F.count("*")).alias("avg"),
                F.min(event_order()).alias("seen")))
    best = per.agg(F.min_by(F.struct("c", F.bround("avg", 2).alias("a")),
                            F.struct((-F.bround("avg", 2)).alias("k"), F.col("seen"))).alias("b"))
    return best.select(F.coalesce(F.col("b.c"), F.lit("Unknown")).alias("best_condition"),
                       F.coalesce(F.col("b.a"), F.lit(0.0)).alias("best_avg_revenue"))


def market_score(enriched: DataFrame) -> DataFrame:
    """0.1 per interaction where sentiment agrees with the outcome, and its label.

    The label uses exact integer thresholds (count > 50 / > 20); the original added
    0.1 repeatedly, whose rounding error can flip the label exactly at 5.0 / 2.0.
    """
    return _scored(enriched.agg(F.count(F.when(_agrees(), 1)).alias("matches")))


def _scored(matches: DataFrame) -> DataFrame:
    step = config.MARKET_SCORE_STEP
    strong = int(round(config.MARKET_STRONG_ABOVE / step))
    moderate = int(round(config.MARKET_MODERATE_ABOVE / step))
    return matches.select(
        "matches",
        (F.col("matches") * F.lit(step)).alias("correlation_score"),
        F.when(F.col("matches") > strong, F.lit(config.MARKET_LABEL_STRONG))
         .when(F.col("matches") > moderate, F.lit(config.MARKET_LABEL_MODERATE))
         .otherwise(F.lit(config.MARKET_LABEL_WEAK)).alias("interpretation"))


def sentiment_impact(enriched: DataFrame) -> DataFrame:
    """Per news label (missing -> neutral): count, mean revenue, conversion %."""
    label = F.coalesce(F.col("news_sentiment"), F.lit("neutral"))
    return (enriched.groupBy(label.alias("sentiment"))
            .agg(F.count("*").alias("count"),
                 F.avg("revenue").alias("avg_revenue"),
                 (F.count(F.when(is_conversion("revenue"), 1)) * F.lit(100.0) / F.count("*"))
                 .alias("conversion_rate")))


def _agrees():
    s = F.col("market_sentiment")
    return ((s == "positive") & is_conversion("revenue")) | ((s == "negative") & (F.col("revenue") == 0))


def partial_impact(enriched: DataFrame) -> DataFrame:
    """Sums for A19-A21 per (weather condition, news label): they add up over batches."""
    return (enriched.groupBy(F.coalesce("weather_condition", F.lit("Unknown")).alias("weather_condition"),
                             F.coalesce("news_sentiment", F.lit("neutral")).alias("sentiment"))
            .agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"),
                 F.count("revenue").alias("revenue_n"),
                 F.count(F.when(is_conversion("revenue"), 1)).alias("conversions"),
                 F.count(F.when(_agrees(), 1)).alias("matches")))


def combined_impact(sums: DataFrame) -> dict[str, DataFrame]:
    """A19-A21 from the sums of ``partial_impact``."""
    weather = (sums.groupBy("weather_condition")
               .agg(F.sum("revenue").alias("total_revenue"), F.sum("n").alias("interaction_count"))
               .withColumn("avg_revenue", F.col("total_revenue") / F.col("interaction_count")))
    sentiment = (sums.groupBy("sentiment")
                 .agg(F.sum("n").alias("count"),
                      (F.sum("revenue") / F.sum("revenue_n")).alias("avg_revenue"),
                      (F.sum("conversions") * F.lit(100.0) / F.sum("n")).alias("conversion_rate")))
    score = _scored(sums.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches")))
    return {"weather_impact": weather, "sentiment_impact": sentiment, "market_score": score}


def conversion_by_market(enriched: DataFrame) -> DataFrame:
    """Conversion % per market sentiment."""
    return (enriched.where(F.col("market_sentiment").isNotNull())
            .groupBy("market_sentiment")
            .agg((F.avg((F.col("revenue") > 0).cast("double")) * F.lit(100.0))
                 .alias("conversion_rate")))


def revenue_temperature_ols(enriched: DataFrame) -> DataFrame:
    """Least-squares line of revenue on temperature, one per weather condition."""
    y, x = F.col("revenue"), F.col("weather_temperature")
    return (enriched.where(F.col("weather_condition").isNotNull() & x.isNotNull() & y.isNotNull())
            .groupBy("weather_condition")
            .agg(F.count("*").alias("n"),
                 F.regr_slope(y, x).alias("slope"),
                 F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2")))


def running_conversion_rate(enriched: DataFrame, label: str = "news_sentiment",
                            default: str = "neutral", chunks: int | None = None) -> DataFrame:
    """H5: the original's order-dependent "conversion rate" per label, reproduced exactly.

    Rows of a label are taken in (time, id) order; at the k-th row the rate becomes
    ``((k-1) r + 1) / k`` if it converts, else stays. With ``r0 = 0`` the end value
    is ``sum_j (1/k_j) * prod_{i>j} (k_i - 1)/k_i`` over converting rows j, i. It is
    computed without gathering a label's rows anywhere:

    * rows are cut into balanced ranges of (label, time, id), so one label or one busy
      hour spreads over as many chunks as its rows need; the narrow rows with their
      chunk are written once;
    * positions k: row numbers inside a chunk plus the rows of the label's earlier
      chunks (running count over the small per-chunk table);
    * the products: exp of suffix sums of ``log((k-1)/k)``, as running sums over the
      reversed order, inside the chunk and over the per-chunk table.

    The true rate (conversions / count) is ``sentiment_impact``'s ``conversion_rate``.
    """
    lab = F.coalesce(F.col(label), F.lit(default)).alias("label")
    rows = enriched.select(lab, "timestamp", F.col("interaction_id").cast("string").alias("id"),
                           is_conversion("revenue").alias("conv"))
    parts = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, "label", "timestamp", "id")
                   .withColumn("chunk", F.spark_partition_id()), "running-rate")
    sizes = rows.groupBy("label", "chunk").agg(F.count("*").alias("n"))
    by_chunk = Window.partitionBy("label").orderBy("chunk")
    offsets = sizes.select("label", "chunk", (F.sum("n").over(by_chunk) - F.col("n")).alias("offset"))
    in_chunk = Window.partitionBy("label", "chunk").orderBy("timestamp", "id")
    later = (Window.partitionBy("label", "chunk").orderBy(F.desc("k"))
             .rowsBetween(Window.unboundedPreceding, -1))
    k = (rows.join(offsets, ["label", "chunk"])
         .withColumn("k", F.col("offset") + F.row_number().over(in_chunk)))
    log_a = F.when(F.col("conv") & (F.col("k") > 1), F.log((F.col("k") - 1) / F.col("k"))) \
        .otherwise(F.lit(0.0))
    k = k.withColumn("la", log_a)
    k = k.withColumn("after", F.coalesce(F.sum("la").over(later), F.lit(0.0)))
    partial = (k.groupBy("label", "chunk")
               .agg(F.sum(F.when(F.col("conv"), F.exp("after") / F.col("k"))
                          .otherwise(F.lit(0.0))).alias("p"),
                    F.sum("la").alias("chunk_log"), F.count("*").alias("n"),
                    F.count(F.when(F.col("conv"), 1)).alias("conversions")))
    later_chunks = (Window.partitionBy("label").orderBy(F.desc("chunk"))
                    .rowsBetween(Window.unboundedPreceding, -1))
    combined = partial.withColumn("later_log", F.coalesce(F.sum("chunk_log").over(later_chunks), F.lit(0.0)))
    return (combined.groupBy("label")
            .agg(F.sum("n").alias("count"), F.sum("conversions").alias("conversions"),
                 F.sum(F.col("p") * F.exp("later_log")).alias("running_rate"))
            .withColumnRenamed("label", "sentiment"))
