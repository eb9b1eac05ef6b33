"""As-of left join: for each event, the latest reading at or before it, within a tolerance.

Spark has no as-of join; this builds two from public operators. ``asof_join`` is for series
whose readings grow with the events (station reports): events and readings are sorted
together by time within (key, bucket) and each event takes the last reading before it, so
the cost grows with the rows and not with the pairs of a bucket. ``prepare`` and ``join``
are for sparse series (a few readings per tolerance, however many events): each event
matches at most one reading through a plain equi-join (no per-event aggregation) and
neither side is sorted when the readings are broadcast:

* each reading is valid from its time until the next reading of the same key,
  and at most ``tolerance`` after its time: a set of disjoint intervals per key;
* time is cut into buckets of width ``tolerance``; an interval covers at most two
  buckets, so each reading is copied into those (the factor side grows by 2x). What ends
  an interval for the events of a bucket is in that bucket, too, so the readings of a
  (key, bucket) find their ends among themselves: one aggregation, whose partitioning
  the join needs anyway;
* events join on (key, bucket) plus the interval bounds. Unmatched events stay.

``prepare`` builds the interval table (``Intervals``); it can be written to the
shared checkpoint folder (``materialize``) so that repeated joins, e.g. every
micro-batch of a stream, only read it. The join carries no hint: adaptive execution
broadcasts the interval side when its measured bytes allow, else both sides shuffle
on (key, bucket), which spreads even a single global key over all buckets, and
skewed buckets are split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Intervals:
    """Validity intervals of readings, keyed by (key columns, time bucket)."""
    df: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...]
    tolerance_seconds: int

    def materialize(self) -> "Intervals":
        """Write the interval table to the shared checkpoint folder (cuts lineage)."""
        from ..session import checkpoint_dir
        checkpoint_dir(self.df.sparkSession)
        return replace(self, df=self.df.checkpoint(eager=True))


def prepare(readings: DataFrame, *, reading_time: str = "factor_time",
            by: Sequence[str] = (), values: Sequence[tuple[str, str]] = (),
            tolerance_seconds: int = 300) -> Intervals:
    """Readings -> validity intervals. ``by``: key columns of the readings;
    ``values``: (reading column, output name) pairs."""
    width = tolerance_seconds * 1_000_000
    keys = tuple(f"__k{i}" for i in range(len(by)))
    r = readings.select(*[F.col(c).alias(k) for c, k in zip(by, keys)],
                        F.col(reading_time).alias("__rt"),
                        F.struct(*[F.col(v).alias(o) for v, o in values]).alias("__v"))
    bucket = F.floor(F.unix_micros("__rt") / width)
    r = r.where(F.col("__rt").isNotNull()).withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
    # equal readings are dropped map-side; of several at one time the greatest value counts, as
    # the others end where they begin
    r = r.groupBy(*keys, "__bucket").agg(F.array_sort(F.collect_set(F.struct("__rt", "__v"))).alias("__readings"))
    ends = F.transform("__readings", lambda x, i: F.struct(
        x["__rt"].alias("__rt"), x["__v"].alias("__v"), F.get("__readings", i + 1)["__rt"].alias("__next")))
    r = r.select(*keys, "__bucket", F.inline(ends))
    return Intervals(r, keys, tuple(o for _, o in values), tolerance_seconds)


def join(events: DataFrame, intervals: Intervals, *, event_time: str = "timestamp",
         by: Sequence[str] = ()) -> DataFrame:
    """Left-join prepared intervals; ``by``: event key columns matching the reading keys."""
    width = intervals.tolerance_seconds * 1_000_000
    r = intervals.df
    ev_t = F.col(event_time)
    cond: list[Column] = [events[ec] == r[k] for ec, k in zip(by, intervals.keys)]
    cond += [F.floor(F.unix_micros(ev_t) / width) == r["__bucket"], ev_t >= r["__rt"],
             ev_t <= r["__rt"] + F.make_dt_interval(secs=F.lit(intervals.tolerance_seconds)),
             r["__next"].isNull() | (ev_t < r["__next"])]
    cond_all = cond[0]
    for c in cond[1:]:
        cond_all = cond_all & c
    joined = events.join(r, cond_all, "left")
    return joined.select(*[events[c] for c in events.columns],
                         *[F.col(f"__v.{o}").alias(o) for o in intervals.values])


# a bucket of the sorted form is so many tolerances wide: a reading that holds into the next one is
# copied there, so a quarter of the readings at most if they are spread evenly
BUCKET_TOLERANCES = 4


def asof_join(events: DataFrame, readings: DataFrame, *, event_time: str = "timestamp",
              reading_time: str = "factor_time", by: Sequence[tuple[str, str]] = (),
              values: Sequence[tuple[str, str]] = (), tolerance_seconds: int = 300) -> DataFrame:
    """Left as-of join of events and readings sorted together, linear in both at any density.

    ``by``: (event column, reading column) key pairs (empty: one global series).
    ``values``: (reading column, output name) pairs added to the events.
    A reading exactly ``tolerance_seconds`` old still matches; of several readings at one time
    the greatest value counts.
    """
    tolerance = tolerance_seconds * 1_000_000
    bucket = lambda micros: F.floor(micros / (BUCKET_TOLERANCES * tolerance))
    keys = [f"__k{i}" for i in range(len(by))]
    at = F.unix_micros(F.col(reading_time))
    reading = F.struct(F.col(reading_time).alias("__rt"), *[F.col(v).alias(o) for v, o in values])
    known = F.col(reading_time).isNotNull()
    for _, rc in by:
        known = known & F.col(rc).isNotNull()
    r = readings.where(known).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields],
        *[F.col(rc).alias(k) for (_, rc), k in zip(by, keys)], F.col(reading_time).alias("__at"), reading.alias("__r"),
        F.lit(False).alias("__event"), F.explode(F.sequence(bucket(at), bucket(at + F.lit(tolerance)))).alias("__bucket"))
    e = events.select(
        *[F.col(c) for c in events.columns],
        *[F.col(ec).alias(k) for (ec, _), k in zip(by, keys)], F.col(event_time).alias("__at"),
        F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(True).alias("__event"),
        bucket(F.unix_micros(F.col(event_time))).alias("__bucket"))
    so_far = (Window.partitionBy(*keys, "__bucket").orderBy("__at", "__event", "__r")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = e.union(r).withColumn("__last", F.last("__r", ignorenulls=True).over(so_far)).where("__event")
    holds = F.col("__at") <= F.col("__last.__rt") + F.make_dt_interval(secs=F.lit(tolerance_seconds))
    return rows.select(*events.columns, *[F.when(holds, F.col(f"__last.{o}")).alias(o) for _, o in values])


def sorted_join(events: DataFrame, intervals: Intervals, *, event_time: str = "timestamp",
                by: Sequence[str] = ()) -> DataFrame:
    """``join`` by the sorted form: each prepared reading is taken from the bucket of its own time."""
    width = intervals.tolerance_seconds * 1_000_000
    own = intervals.df.where(F.floor(F.unix_micros("__rt") / width) == F.col("__bucket"))
    return asof_join(events, own.select(*intervals.keys, "__rt", "__v.*"), event_time=event_time, reading_time="__rt",
                     by=list(zip(by, intervals.keys)), values=[(o, o) for o in intervals.values],
                     tolerance_seconds=intervals.tolerance_seconds)
