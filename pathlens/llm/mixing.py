"""Mixing sources to target weights [native].

Word totals per source give each source a target and a repetition rate; a document is emitted
floor(rate) times, and once more when its hash-seeded uniform draw falls below the fraction.

Defined cases: a null or empty text has size 0, very long texts count whole; a null source is a source of its own, ranked last; a
null doc_id draws like an empty one; rows equal in doc_id and text draw alike; an empty table
gives an empty result. Columns beside doc_id, text and source pass through ``mix`` unchanged; what
the plan adds is kept in one struct, and only a column named like ``copy_column`` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

# fixed values
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sizes`` (one row per source) plus ``weight``: the weights repeating over the sources by
    code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(int(w)) for w in weights])
    return sizes.withColumn("weight", F.get(values, rank % len(weights)))


def source_targets(sizes: DataFrame, cap: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight) plus ``target``.

    Targets share the total by weight, and none exceeds ``cap`` times its source; the excess goes
    to the others by weight. Sources are filled in the order of size per weight: a source is
    capped when its cap is below its share of what the ones before it leave. One row per source
    is all that these windows see.
    """
    everything = Window.partitionBy()
    before = (Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    most = F.col("source_size") * cap
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    tagged = sizes.withColumn("capped", most * weight_left <= left * F.col("weight"))
    capped_size = F.sum(F.when(F.col("capped"), most).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    share = ((F.sum("source_size").over(everything) - capped_size).cast("double")
             * F.col("weight") / F.when(open_weight > 0, open_weight))
    return tagged.select("source", "source_size", "weight",
                         F.when(F.col("capped"), most.cast("double")).otherwise(share).alias("target"))


def draw(seed: str) -> Column:
    """A uniform number in [0, 1) that depends on the seed, doc_id and text only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS,
             seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` plus a struct ``mix`` (size, source_size, target, copies).

    The per-source table is aggregated map-side and written; joined by source, the planner
    broadcasts it if its measured size allows, else splits a hot source's partition.
    """
    sizes = (docs.select("source", text_size(F.col("text")).alias("size"))
             .groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = written(source_targets(cycled_weights(sizes, weights), cap), "mix-sources")
    sources = sources.select(F.struct("*").alias("per_source"))
    rows = docs.select(F.struct("*").alias("doc"), text_size(F.col("text")).alias("size"), draw(seed).alias("u"))
    joined = rows.join(sources, F.col("doc.source").eqNullSafe(F.col("per_source.source")), "left")
    rate = F.when(F.col("per_source.source_size") > 0,
                  F.least(F.col("per_source.target") / F.col("per_source.source_size"), F.lit(float(cap)))).otherwise(0.0)
    copies = (F.floor(rate) + F.when(F.col("u") < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.select("doc", F.struct("size", "per_source.source_size", "per_source.target",
                                         copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS, seed: str = SEED,
        copy_column: str = "copy") -> DataFrame:
    """The mixed rows: each document ``copies`` times, numbered from 1 in ``copy_column``."""
    plan = mix_plan(docs, weights, cap, seed).where(F.col("mix.copies") > 0)
    return (plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("n"))
            .select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != copy_column],
                    F.col("n").alias(copy_column)))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select(
        "doc.doc_id", "doc.source", "mix.size", "mix.source_size", "mix.target",
        F.col("mix.copies").cast("long").alias("copies"),
        (F.col("mix.copies") * F.col("mix.size")).cast("long").alias("taken"))


# Independent statement: of all prefixes of sources (by size per weight) that could be capped,
# take the first whose share leaves every capped source above its cap and no other.
OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from s),
t as (select sum(source_size) as total, sum(weight) as weights from w),
limits as (select distinct source_size / weight as ratio from w union select -1.0),
tried as (
  select l.ratio, coalesce(sum(w.source_size) filter (w.source_size / w.weight <= l.ratio), 0) as held,
         coalesce(sum(w.weight) filter (w.source_size / w.weight <= l.ratio), 0) as held_weight
  from limits l cross join w group by l.ratio),
shares as (
  select ratio, held, held_weight, (total - 3 * held) / nullif(weights - held_weight, 0) as share, total, weights
  from tried cross join t),
fits as (
  select x.ratio, x.held, x.held_weight, x.total, x.weights
  from shares x cross join w
  group by all
  having bool_and(case when w.source_size / w.weight <= x.ratio then x.share is null or 3 * w.source_size <= x.share * w.weight + 1e-6
                       else 3 * w.source_size >= x.share * w.weight - 1e-6 end)
  order by x.ratio limit 1),
targets as (
  select w.source, w.source_size,
         case when w.source_size / w.weight <= f.ratio then cast(3 * w.source_size as double)
              else cast(f.total - 3 * f.held as double) * w.weight / (f.weights - f.held_weight) end as target
  from w cross join fits f),
rates as (
  select d.doc_id, d.source, d.size, g.source_size, g.target,
         case when g.source_size > 0 then least(g.target / g.source_size, 3.0) else 0.0 end as rate,
         cast(cast('0x' || substr(md5('mix-1:' || coalesce(cast(d.doc_id as varchar), '') || ':' || md5(d.text)), 1, 13) as bigint) as double)
           / 4503599627370496.0 as u
  from d join targets g on d.source is not distinct from g.source)
select doc_id, source, size, source_size, target,
       cast(floor(rate) + (case when u < rate - floor(rate) then 1 else 0 end) as bigint) as copies,
       cast((floor(rate) + (case when u < rate - floor(rate) then 1 else 0 end)) * size as bigint) as taken
from rates
"""
