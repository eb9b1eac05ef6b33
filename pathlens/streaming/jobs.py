"""Structured Streaming versions of the real-time path.

Event time drives every window (the original used processing time on a bounded
buffer; a watermark is the time bound here). Replayed rows are dropped by id
within the watermark. Aggregations are incremental in the state store; windows
leave state once the watermark passes them.

Exact distinct counts are not allowed in streaming aggregates (H6). The live views
therefore share one streaming aggregate, ``stream_minutes``: a row per minute, touchpoint
and customer, maintained in state. The views over it (days, minutes, sliding windows) are
batch reductions of these rows, with exact distinct customers and no raw row copied per
window.

Factor tables are read per micro-batch (``start_enriched``), so readings and customers
that arrive while a stream runs take effect in the next batch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..functions.scalars import is_conversion
from ..operators import enrich as EN
from ..operators import impact
from ..session import checkpoint_dir
from ..sources.fixtures import interactions_from_events
from ..sources.io import path_exists
from . import live

DEFAULT_WATERMARK = "1 hour"


def read_events_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """S10 source: new event files in ``folder`` (schema taken from the files present)."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def _stamp(s: DataFrame, stamp: bool) -> DataFrame:
    # processing time of the micro-batch that receives the row
    return s.withColumn("processed_timestamp", F.current_timestamp()) if stamp else s


def read_interactions_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                             watermark: str | None = DEFAULT_WATERMARK,
                             max_files_per_trigger: int | None = None,
                             stamp_processing_time: bool = False) -> DataFrame:
    """Interactions stream with event-time watermark, replays dropped by id (H8). Without a
    watermark every row comes through, as the sinks of ``live`` need it."""
    s = interactions_from_events(read_events_stream(spark, folder, file_glob, max_files_per_trigger))
    if watermark:
        s = s.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["interaction_id"])
    return _stamp(s, stamp_processing_time)


def read_live_records(spark: SparkSession, folder: str, fmt: str = "json",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Live-event records as they arrive: ``record`` (the text) and the parsed columns.

    JSON lines or header CSV with the live-event schema. The schema is declared, so the
    stream can start on an empty folder. Nothing raises here: a value that does not parse
    is null, and ``accepted`` / ``rejected`` tell the records apart.
    """
    from ..schemas import LIVE_EVENT
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        return parse_live_events(r.text(folder))
    events = r.schema(LIVE_EVENT).option("header", True).format(fmt).load(folder)
    text = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    return events.select(text.alias("record"), *events.columns).withColumn(
        "timestamp", F.try_to_timestamp("timestamp"))


def parse_live_events(records: DataFrame, column: str = "value") -> DataFrame:
    """Live-event JSON text (e.g. a Kafka record value) -> record and typed columns."""
    from ..schemas import LIVE_EVENT
    text = F.col(column).cast("string")
    e = F.from_json(text, LIVE_EVENT)
    return (records.select(text.alias("record"), e.alias("e")).select("record", "e.*")
            .withColumn("timestamp", F.try_to_timestamp("timestamp")))


def accepted(records: DataFrame, watermark: str | None = DEFAULT_WATERMARK) -> DataFrame:
    """The events with id and time, replays dropped by id within the watermark."""
    events = records.where(live.valid()).drop("record")
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["interaction_id"]) if watermark else events


def rejected(records: DataFrame) -> DataFrame:
    """The records without id or time: (record, reason, rejected_at)."""
    return live.rejected_records(records)


def write_rejected(records: DataFrame, path: str, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Rejected records to their own Parquet table, so that none is lost silently."""
    w = (rejected(records).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start(path)


def read_live_events_stream(spark: SparkSession, folder: str, fmt: str = "json",
                            watermark: str | None = DEFAULT_WATERMARK,
                            max_files_per_trigger: int | None = None,
                            stamp_processing_time: bool = False) -> DataFrame:
    """S10 for upstream live events: the accepted ones. Run ``write_rejected`` over
    ``read_live_records`` beside it to keep the others."""
    records = read_live_records(spark, folder, fmt, max_files_per_trigger)
    return _stamp(accepted(records, watermark), stamp_processing_time)


def read_live_records_kafka(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "latest") -> DataFrame:
    """Live-event records of a Kafka topic (needs the Spark Kafka connector): ``record`` and the
    parsed columns, as ``read_live_records`` gives them. ``live.start_live`` over them stores the
    events, the late ones and those that are rejected."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", starting_offsets).load())
    return parse_live_events(raw)


def read_live_events_kafka(spark: SparkSession, servers: str, topic: str,
                           watermark: str | None = DEFAULT_WATERMARK,
                           starting_offsets: str = "latest") -> DataFrame:
    """S10 from a Kafka topic of live-event JSON: the accepted events.

    Offsets are tracked in the query checkpoint, so a restarted or failed query
    resumes without loss; replays are dropped by id within the watermark.
    """
    return accepted(read_live_records_kafka(spark, servers, topic, starting_offsets), watermark)


MINUTE_KEYS = ("minute", "touchpoint", "customer_id")


def stream_minutes(stream: DataFrame) -> DataFrame:
    """The aggregate behind T1-T4: a row per event-time minute, touchpoint and customer."""
    return (stream.groupBy(F.window("timestamp", "1 minute").alias("window"), "touchpoint", "customer_id")
            .agg(F.count("*").alias("interactions"), F.sum("revenue").alias("revenue"),
                 F.count(F.when(is_conversion("revenue"), 1)).alias("conversions"),
                 F.sum("session_duration_minutes").alias("session_sum"),
                 F.count("session_duration_minutes").alias("session_n"))
            .select(F.col("window.start").alias("minute"), "touchpoint", "customer_id", "interactions",
                    "revenue", "conversions", "session_sum", "session_n"))


def _spans(start, length) -> list:
    return [start.alias("window_start"), (start + length).alias("window_end")]


def daily_totals(minutes: DataFrame, touchpoints: Sequence[str] = config.TOUCHPOINTS) -> DataFrame:
    """Per day: interactions, revenue, active customers, per-touchpoint counts.

    Days are counted per customer first, so that no row is copied per distinct count."""
    day = F.date_trunc("day", "minute")
    per_customer = minutes.groupBy(day.alias("day"), "customer_id").agg(
        F.sum("interactions").alias("n"), F.sum("revenue").alias("r"),
        *[F.sum(F.when(F.col("touchpoint") == tp, F.col("interactions")).otherwise(0)).alias(f"{tp}_interactions")
          for tp in touchpoints])
    return (per_customer.groupBy("day").agg(
        F.sum("n").alias("interactions"), F.sum("r").alias("revenue"),
        F.count("customer_id").alias("active_customers"),
        *[F.sum(f"{tp}_interactions").alias(f"{tp}_interactions") for tp in touchpoints])
        .select(*_spans(F.col("day"), F.expr("interval 1 day")), "interactions", "revenue", "active_customers",
                *[f"{tp}_interactions" for tp in touchpoints]))


def minute_totals(minutes: DataFrame) -> DataFrame:
    """Per minute: interactions, revenue, distinct customers."""
    per_customer = minutes.groupBy("minute", "customer_id").agg(
        F.sum("interactions").alias("n"), F.sum("revenue").alias("r"))
    return (per_customer.groupBy("minute").agg(
        F.sum("n").alias("interactions"), F.sum("r").alias("revenue"), F.count("customer_id").alias("unique_customers"))
        .select(*_spans(F.col("minute"), F.expr("interval 1 minute")), "interactions", "revenue", "unique_customers"))


def _sliding(rows: DataFrame, minutes: int, oldest) -> DataFrame:
    """``rows`` once per window of ``minutes`` (sliding by one) from the one that begins at
    ``oldest`` to the one that begins at the row's own minute."""
    return rows.withColumn("start", F.explode(F.sequence(oldest, F.col("minute"), F.expr("interval 1 minute"))))


def _back(minutes: int):
    return F.col("minute") - F.make_dt_interval(mins=F.lit(minutes - 1))


def conversion_windows(minutes: DataFrame, length: int = config.CONVERSION_WINDOW_MINUTES) -> DataFrame:
    """Windows of ``length`` minutes, one per minute: conversion %, mean session.
    Rows are reduced per minute before they go to their windows."""
    per_minute = minutes.groupBy("minute").agg(*[F.sum(c).alias(c) for c in (
        "interactions", "conversions", "session_sum", "session_n")])
    return (_sliding(per_minute, length, _back(length)).groupBy("start").agg(
        F.sum("interactions").alias("interactions"),
        (F.sum("conversions") * F.lit(100.0) / F.sum("interactions")).alias("conversion_rate"),
        F.try_divide(F.sum("session_sum").cast("double"), F.sum("session_n")).alias("avg_session_duration"))
        .select(*_spans(F.col("start"), F.make_dt_interval(mins=F.lit(length))), "interactions", "conversion_rate",
                "avg_session_duration"))


def touchpoint_windows(minutes: DataFrame, length: int = config.RECENT_TOUCHPOINT_MINUTES) -> DataFrame:
    """T4: per touchpoint over sliding windows: interactions, revenue, distinct customers.

    A customer's minute goes only to the windows that the customer's previous minute does not
    cover already, so each customer counts once per window without a distinct count."""
    per_minute = minutes.groupBy("touchpoint", "minute").agg(
        F.sum("interactions").alias("interactions"), F.sum("revenue").alias("revenue"))
    sums = _sliding(per_minute, length, _back(length)).groupBy("touchpoint", "start").agg(
        F.sum("interactions").alias("interactions"), F.sum("revenue").alias("revenue"))
    seen = minutes.where(F.col("customer_id").isNotNull())
    before = F.lag("minute").over(Window.partitionBy("touchpoint", "customer_id").orderBy("minute"))
    oldest = F.greatest(_back(length), F.coalesce(before + F.expr("interval 1 minute"), _back(length)))
    customers = _sliding(seen.select("touchpoint", "minute", oldest.alias("oldest")), length, F.col("oldest")) \
        .groupBy("touchpoint", "start").agg(F.count("*").alias("unique_customers"))
    joined = sums.join(customers.withColumnRenamed("touchpoint", "tp"),
                       F.col("touchpoint").eqNullSafe(F.col("tp")) & (sums["start"] == customers["start"]), "left")
    return joined.select(*_spans(sums["start"], F.make_dt_interval(mins=F.lit(length))), "touchpoint", "interactions",
                         "revenue", F.coalesce("unique_customers", F.lit(0)).cast("long").alias("unique_customers"))


def active_customers(minutes: DataFrame) -> DataFrame:
    """Exact distinct customers and interactions per day."""
    return daily_totals(minutes, ()).select("window_start", "window_end", "active_customers", "interactions")


FactorTables = Callable[[], dict[str, DataFrame]]


def _folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/__batch={batch_id}"


def start_enriched(stream: DataFrame, tables: FactorTables, path: str, checkpoint: str,
                   impact_path: str | None = None, interval_seconds: int = config.STREAM_INTERVAL_SECONDS,
                   available_now: bool = False) -> StreamingQuery:
    """Enriches every micro-batch with the tables as they are then.

    ``tables`` is called per micro-batch and returns the arguments of ``enrich`` (customers,
    weather, market, news, economic, facts). A batch is written to a folder of its own, which
    a retry overwrites, so each event is in the table once. With ``impact_path`` the batch's
    sums for the factor metrics are kept beside it (``factor_impact``).

    A batch's rows are first written below ``checkpoint``, in a folder that the next batch
    overwrites: the stream's operators and their state run once per batch, and the joins are
    planned in the session of ``stream``, adaptively, which a query with state is not.
    """
    spark, own = stream.sparkSession, live._below(checkpoint, "batch")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(own)
        rows, out = spark.read.schema(batch.schema).parquet(own), _folder(path, batch_id)
        EN.enrich(rows, **EN.pruned(tables(), rows)).write.mode("overwrite").parquet(out)
        if impact_path:
            impact.partial_impact(spark.read.parquet(out)).write.mode("overwrite").parquet(_folder(impact_path, batch_id))

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{interval_seconds} seconds")
    return w.start()


def enriched_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("__batch")


def factor_impact(spark: SparkSession, impact_path: str) -> dict[str, DataFrame]:
    """The factor metrics over all batches so far, from their sums."""
    return impact.combined_impact(spark.read.parquet(impact_path))


PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
ALL_BATCHES = "100000"                                 # progress reports kept: of all batches of a replay


def run_enriched(stream: DataFrame, tables: FactorTables, name: str = "enriched") -> tuple[str, str]:
    """Enriches everything available; returns the paths of the table and of its sums."""
    spark = stream.sparkSession
    out, sums = _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-impact")
    spark.conf.set(PROGRESS, ALL_BATCHES)
    q = start_enriched(stream, tables, out, _scratch(spark, f"{name}-ckpt"), sums, available_now=True)
    finish(q)
    return out, sums


def write_realtime(stream: DataFrame, path: str, checkpoint: str, customers: live.Customers = None,
                   interval_seconds: int = config.STREAM_INTERVAL_SECONDS, available_now: bool = False,
                   late_path: str | None = None) -> StreamingQuery:
    """Real-time records to a Parquet table by date every ``interval_seconds``; see
    ``live.write_realtime``, which keeps late events in a table of their own."""
    if available_now:
        stream.sparkSession.conf.set(PROGRESS, ALL_BATCHES)
    return live.write_realtime(stream, path, checkpoint, customers, interval_seconds, available_now, late_path)


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def finish(q: StreamingQuery) -> None:
    """Waits for a replay and raises if rows came too late for the watermark."""
    q.awaitTermination()
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    if late:
        raise RuntimeError(f"{late} rows arrived behind the watermark; replay them with a longer one")




def run_available(agg: DataFrame, keys: Sequence[str], output_mode: str = "update",
                  name: str = "stream") -> DataFrame:
    """Run a streaming aggregate over everything available and return its final table.

    Each micro-batch's updated rows are appended (with the batch id) to a Parquet
    table in the shared checkpoint folder by the executors; the result keeps,
    per key, the row of the latest batch. Nothing passes through the driver. Rows
    behind the watermark raise instead of being lost.
    """
    spark = agg.sparkSession
    out, ckpt = _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(out, batch_id))

    spark.conf.set(PROGRESS, ALL_BATCHES)
    q = (agg.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink).trigger(availableNow=True).start())
    finish(q)
    if not path_exists(spark, out):
        return spark.createDataFrame([], agg.schema)
    rows = spark.read.parquet(out)
    value_cols = [c for c in agg.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), "__batch").alias("__v"))
    return latest.select(*keys, "__v.*")


def run_minutes(stream: DataFrame) -> DataFrame:
    """The rows of ``stream_minutes`` over everything available."""
    return run_available(stream_minutes(stream), MINUTE_KEYS, name="minutes")
