"""Live tables that lose nothing: events, late events, rejected records, minutes, one commit per batch.

``start_live`` runs one query over the records as they arrive. Nothing is dropped by state: each
micro-batch is split here.

* Records without id or valid time go to ``rejects``.
* Replays are dropped by id, against the batch and against the stored events whose time is within
  the ``delay`` of the batch's (a pruned read of the date partitions that the batch touches).
* Events behind the watermark of the last committed batch go to ``late``, the others to ``events``;
  both are partitioned by date, and a replayed late id stays single, too.
* The minutes that the batch touches are counted anew from the stored events of their hours and
  written as a new version of those hours in ``minutes``; other hours are left as they are.
* With factor tables the batch's events are also enriched (``enriched``) and their sums kept
  (``impact``), a folder per batch.
* Last, a commit row is written: batch, watermark, latest event time and row counts.

Readers follow the last commit: rows carry their batch, so a batch that is being written, or one
whose writer was lost, is not seen. A retried batch finds what its first attempt stored, drops it as
replayed and stores the rest; folders per batch are overwritten. So every event is stored once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..operators import enrich as EN
from ..operators import impact
from ..operators.realtime import to_realtime
from ..sources.io import path_exists

DELAY = "1 hour"

Tables = Callable[[], dict[str, DataFrame]]
Customers = DataFrame | Callable[[], DataFrame] | None


class Commit(NamedTuple):
    batch: int
    watermark: object           # events before it are late; None before the first event
    latest: object              # the latest event time so far


def _below(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def batch_folder(path: str, batch_id: int) -> str:
    return _below(path, f"__batch={batch_id}")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


# --- commits ---------------------------------------------------------------------------------------

def _write_commit(spark: SparkSession, commits: str, batch_id: int, latest, delay: str, counts: dict[str, int]) -> None:
    newest = F.lit(latest).cast("timestamp")
    row = spark.range(1).select(newest.alias("latest"), (newest - F.expr(f"interval {delay}")).alias("watermark"),
                                *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])
    row.coalesce(1).write.mode("overwrite").parquet(batch_folder(commits, batch_id))


def committed(spark: SparkSession, base: str, before: int | None = None) -> Commit | None:
    """The last commit (before batch ``before``): one row."""
    rows = _stored(spark, _below(base, "commits"))
    if rows is None:
        return None
    if before is not None:
        rows = rows.where(F.col("__batch") < before)
    last = rows.groupBy().agg(F.max(F.struct(F.col("__batch").cast("long").alias("batch"), "watermark", "latest")).alias("c")).first()["c"]
    return Commit(*last) if last is not None else None


# --- storing a batch ----------------------------------------------------------------------------------

def valid() -> Column:
    return F.col("interaction_id").isNotNull() & (F.col("interaction_id") != "") & F.col("timestamp").isNotNull()


def rejected_records(records: DataFrame) -> DataFrame:
    """The records without id or time: (record, reason, rejected_at)."""
    record = F.col("record") if "record" in records.columns else F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    no_id = F.col("interaction_id").isNull() | (F.col("interaction_id") == "")
    reason = (F.when(F.col("interaction_id").isNull() & F.col("timestamp").isNull(), F.lit("not a live event"))
              .when(no_id, F.lit("no interaction_id")).otherwise(F.lit("no valid timestamp")))
    return records.where(~valid()).select(record.alias("record"), reason.alias("reason"), F.current_timestamp().alias("rejected_at"))


def _days(rows: DataFrame, delay: str) -> list:
    """The days within ``delay`` of the rows' times: one row per day that a batch touches."""
    around = F.expr(f"interval {delay}")
    days = F.sequence(F.to_date(F.col("timestamp") - around), F.to_date(F.col("timestamp") + around))
    return [r["day"] for r in rows.select(F.explode(days).alias("day")).distinct().collect()]


def by_folder(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` dealt by their partition folder, so that a write makes a file per folder (more where a
    folder's rows are many: adaptive execution splits them) and not one per task and folder."""
    return rows.hint("rebalance", *[F.col(c) for c in columns])


def unseen(batch: DataFrame, paths: list[str], days: list) -> DataFrame:
    """``batch`` without ids that occur twice in it or in the tables at ``paths`` on ``days``, their
    date partitions."""
    rows = batch.repartition("interaction_id").dropDuplicates(["interaction_id"])       # one sort by id, not one on each side of a shuffle
    for path in paths:
        table = _stored(batch.sparkSession, path)
        if table is not None:
            rows = rows.join(table.where(F.col("date").isin(days)).select("interaction_id"), "interaction_id", "left_anti")
    return rows


def store_events(batch: DataFrame, batch_id: int, events: str, late: str, watermark, delay: str = DELAY) -> tuple[object, dict[str, int]]:
    """Appends the batch's new events to ``events``, those before ``watermark`` to ``late``; returns
    the latest event time of the batch and how many rows went where. The new events are first
    written beside ``late``, in a folder that the next batch overwrites."""
    days = _days(batch, delay)
    if not days:
        return None, {"stored": 0, "late": 0}
    rows = unseen(batch, [events, late], days).withColumns({"date": F.to_date("timestamp"), "batch_id": F.lit(batch_id).cast("long")})
    own = f"{late.rstrip('/')}-batch"                   # cached rows would be computed anew once a table they were checked against is written
    rows.write.mode("overwrite").parquet(own)
    rows = batch.sparkSession.read.schema(rows.schema).parquet(own)
    is_late = F.coalesce(F.col("timestamp") < F.lit(watermark).cast("timestamp"), F.lit(False))
    counts = rows.agg(F.count(F.when(~is_late, 1)).alias("stored"), F.count(F.when(is_late, 1)).alias("late")).first().asDict()
    for path, part, n in ((events, rows.where(~is_late), counts["stored"]), (late, rows.where(is_late), counts["late"])):
        if n:
            by_folder(part, "date").write.mode("append").partitionBy("date").parquet(path)
    return batch.agg(F.max("timestamp")).first()[0], counts


def _advance(spark: SparkSession, commits: str, batch_id: int, before: Commit | None, latest, delay: str, counts: dict[str, int]) -> None:
    ends = [t for t in (latest, before.latest if before else None) if t is not None]
    newest = max(ends) if ends else None
    _write_commit(spark, commits, batch_id, newest, delay, counts)


# --- the sink alone -------------------------------------------------------------------------------------

def write_realtime(stream: DataFrame, path: str, checkpoint: str, customers: Customers = None,
                   interval_seconds: int = config.STREAM_INTERVAL_SECONDS, available_now: bool = False,
                   late_path: str | None = None, delay: str = DELAY) -> StreamingQuery:
    """Real-time records to Parquet by date, late ones to ``late_path`` (default ``path-late``).

    ``checkpoint`` is the sink's own folder and must stay the same over restarts. Give it the stream
    without a watermark, as a stream that drops replays by state drops late events before they come
    here. ``customers`` is joined per micro-batch; as a function it is asked anew for each."""
    late = late_path or f"{path.rstrip('/')}-late"
    commits = _below(checkpoint, "live")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = committed(spark, commits, batch_id)
        rows = to_realtime(batch, customers() if callable(customers) else customers)
        latest, counts = store_events(rows, batch_id, path, late, before.watermark if before else None, delay)
        _advance(spark, _below(commits, "commits"), batch_id, before, latest, delay, counts)

    return _started(stream, checkpoint, sink, interval_seconds, available_now)


def _started(stream: DataFrame, checkpoint: str, sink, interval_seconds: int, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{interval_seconds} seconds")
    return w.start()


def realtime_table(spark: SparkSession, path: str, late_path: str | None = None) -> DataFrame:
    """All stored real-time records, ``is_late`` telling the two tables apart."""
    late = _stored(spark, late_path or f"{path.rstrip('/')}-late")
    rows = spark.read.parquet(path).withColumn("is_late", F.lit(False))
    return rows if late is None else rows.unionByName(late.withColumn("is_late", F.lit(True)))


# --- the live job ---------------------------------------------------------------------------------------

MINUTES = ("minute", "touchpoint", "customer_id", "interactions", "revenue", "conversions", "session_sum", "session_n")


def _hour(c: str = "timestamp") -> Column:
    return F.date_trunc("hour", c)


def _all_events(spark: SparkSession, base: str, upto: int) -> DataFrame | None:
    parts = [t.where(F.col("batch_id") <= upto) for t in (_stored(spark, _below(base, n)) for n in ("events", "late")) if t is not None]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None


def update_minutes(spark: SparkSession, base: str, batch_id: int) -> None:
    """Counts the hours that hold events of ``batch_id`` anew, as this batch's version of them."""
    from .jobs import stream_minutes

    rows = _all_events(spark, base, batch_id)
    if rows is None:
        return
    hours = rows.where(F.col("batch_id") == batch_id).select("date", _hour().alias("hour")).distinct()
    days = [r["date"] for r in hours.select("date").distinct().collect()]       # one row per day of the batch
    if not days:
        return
    near = rows.where(F.col("date").isin(days)).withColumn("hour", _hour())
    minutes = stream_minutes(near.join(hours.select("hour"), "hour", "left_semi"))
    minutes = minutes.withColumns({"date": F.to_date("minute"), "hour": F.hour("minute")})
    by_folder(minutes, "date", "hour").write.mode("overwrite").partitionBy("date", "hour").parquet(batch_folder(_below(base, "minutes"), batch_id))


def start_live(records: DataFrame, base: str, checkpoint: str, *, factors: Tables | None = None, delay: str = DELAY,
               interval_seconds: int = config.STREAM_INTERVAL_SECONDS, available_now: bool = False) -> StreamingQuery:
    """The live job over ``records`` (interactions, or live records with their text in ``record``,
    from files or Kafka), without a watermark. ``factors``: as ``tables`` of ``start_enriched``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = committed(spark, base, batch_id)
        batch = batch.persist()
        try:
            rejected = rejected_records(batch)
            rejected.write.mode("overwrite").parquet(batch_folder(_below(base, "rejects"), batch_id))
            good = batch.where(valid()).drop("record")
            latest, counts = store_events(good, batch_id, _below(base, "events"), _below(base, "late"), before.watermark if before else None, delay)
            update_minutes(spark, base, batch_id)
            if factors is not None:
                _enrich_batch(spark, base, batch_id, factors())
            _advance(spark, _below(base, "commits"), batch_id, before, latest, delay,
                     counts | {"rejected": spark.read.parquet(batch_folder(_below(base, "rejects"), batch_id)).count()})
        finally:
            batch.unpersist()

    return _started(records, checkpoint, sink, interval_seconds, available_now)


def _enrich_batch(spark: SparkSession, base: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    rows = _all_events(spark, base, batch_id)
    if rows is None:
        return
    rows = rows.where(F.col("batch_id") == batch_id)
    out = batch_folder(_below(base, "enriched"), batch_id)
    rows = rows.drop("date", "batch_id")
    EN.enrich(rows, **EN.pruned(tables, rows)).write.mode("overwrite").parquet(out)
    impact.partial_impact(spark.read.parquet(out)).write.mode("overwrite").parquet(batch_folder(_below(base, "impact"), batch_id))


# --- readers --------------------------------------------------------------------------------------------

def events(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """All events, late ones included, up to the last commit (or batch ``upto``)."""
    upto = _upto(spark, base, upto)
    return _all_events(spark, base, upto).drop("date", "batch_id")


def late_events(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame | None:
    rows = _stored(spark, _below(base, "late"))
    return None if rows is None else rows.where(F.col("batch_id") <= _upto(spark, base, upto))


def rejects(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(_below(base, "rejects")).drop("__batch")


def _upto(spark: SparkSession, base: str, upto: int | None) -> int:
    if upto is not None:
        return upto
    last = committed(spark, base)
    return -1 if last is None else last.batch


def minutes(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """The minute rows of ``stream_minutes``: of each hour the latest committed version. What tells
    the versions apart are partition values; no column is read for it."""
    rows = spark.read.parquet(_below(base, "minutes")).where(F.col("__batch") <= _upto(spark, base, upto))
    latest = rows.select("date", "hour", "__batch").groupBy("date", "hour").agg(F.max("__batch").alias("__batch"))
    return rows.join(latest, ["date", "hour", "__batch"], "left_semi").select(*MINUTES)


def live_views(spark: SparkSession, base: str, upto: int | None = None) -> dict[str, DataFrame]:
    """T1-T4 over the minutes as of the last commit."""
    from . import jobs

    rows = minutes(spark, base, upto)
    return {"daily_totals": jobs.daily_totals(rows), "conversion_windows": jobs.conversion_windows(rows),
            "minute_totals": jobs.minute_totals(rows), "touchpoint_windows": jobs.touchpoint_windows(rows),
            "active_customers": jobs.active_customers(rows)}


def enriched(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    return spark.read.parquet(_below(base, "enriched")).where(F.col("__batch") <= _upto(spark, base, upto)).drop("__batch")


def live_snapshot(spark: SparkSession, base: str, as_of) -> dict[str, DataFrame]:
    """Every part of the snapshot as of one commit, which is read once; ``cut`` names it. A batch
    that is committed while the parts are computed is in none of them."""
    from ..plans.snapshot import snapshot

    last = committed(spark, base)
    if last is None:
        raise ValueError("nothing is committed yet")
    rows = events(spark, base, last.batch).withColumn("processed_timestamp", F.col("timestamp"))
    factors = enriched(spark, base, last.batch) if path_exists(spark, _below(base, "enriched")) else None
    parts = snapshot(rows, factors, as_of)
    return parts | {"cut": spark.range(1).select(F.lit(last.batch).cast("long").alias("batch"), F.lit(last.watermark).cast("timestamp").alias("watermark"),
                                                 F.lit(last.latest).cast("timestamp").alias("latest"))}


def vacuum(spark: SparkSession, base: str, keep: int = 10) -> int:
    """Deletes the versions of hours that a version at least ``keep`` batches old has replaced;
    returns how many folders went. A closed hour keeps its last version for ever."""
    root = _below(base, "minutes")
    if not path_exists(spark, root):
        return 0
    versions = spark.read.parquet(root).select("__batch", "date", "hour").distinct()
    newer = versions.groupBy("date", "hour").agg(F.max(F.when(F.col("__batch") <= _upto(spark, base, None) - keep, F.col("__batch"))).alias("replaced_by"))
    old = versions.join(newer, ["date", "hour"]).where("__batch < replaced_by").collect()      # one row per stale folder
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in old:
        folder = jvm.org.apache.hadoop.fs.Path(f"{batch_folder(root, r['__batch'])}/date={r['date']}/hour={r['hour']}")
        folder.getFileSystem(conf).delete(folder, True)
    return len(old)
