"""Exact, distributed quantiles and tertile labels.

``pd.qcut`` and ``Series.quantile`` use linear interpolation between order
statistics. Spark's exact ``percentile`` merges every distinct value into a single
aggregation buffer, which does not scale; ``percentile_approx`` is bounded but
approximate. ``quantile_row`` gets the exact answer with bounded single-task work,
the same way at every size:

1. ``count`` and ``percentile_approx`` at a few points around each ``q`` (partial
   aggregation, bounded memory) give split values, close together near ``q``;
2. rows are counted exactly per interval between split values; running counts over
   that small table tell which interval holds each order statistic that is needed.
   Nothing is assumed of the sketch: a poor one only makes intervals larger;
3. the values of those intervals are counted (map-side combine), and a running count
   inside each picks the order statistics. With a sketch of accuracy ``a`` an
   interval holds about ``6 n / a`` rows.

Several columns are handled in the same passes (rows are unpivoted to
``(column, value)``). Results are one-row DataFrames; callers attach them as
scalar subqueries (``DataFrame.scalar()``), so no join touches the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000


def _clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def quantile_row(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
                 accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One row with a struct per column holding ``q0 .. q{k-1}``.

    Exact linear-interpolated quantiles; nulls and NaN are skipped (pandas
    semantics); an all-null column gives nulls.
    """
    names = list(columns)
    probes = sorted({_clamp(q + sign * step * 3.0 / accuracy)
                     for q in qs for sign in (-1, 1) for step in (1, 16, 256, 4096)})
    long = (df.select(F.explode(F.array(*[
                F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("x"))
                for j, c in enumerate(names)])).alias("e"))
            .select("e.j", "e.x")
            .where(F.col("x").isNotNull() & ~F.isnan("x")))

    # pass 1: size and split values per column -> one small row (scalar subquery), bound
    # once as a column; every later use reads the column
    sketch = long.groupBy("j").agg(
        F.count("*").alias("n"),
        F.array_sort(F.array_distinct(F.percentile_approx("x", probes, accuracy))).alias("splits"))
    per_col = sketch.agg(F.map_from_entries(F.collect_list(
        F.struct("j", F.struct("n", "splits")))).alias("m"))
    long = long.withColumn("s", per_col.select("m").scalar()[F.col("j")])
    interval = F.size(F.filter("s.splits", lambda v: v < F.col("x")))

    # pass 2: exact counts per interval (a few dozen rows per column)
    counts = (long.groupBy("j", F.col("s.n").alias("n"), interval.alias("i"))
              .agg(F.count("*").alias("c")))
    before = F.sum("c").over(Window.partitionBy("j").orderBy("i")) - F.col("c")
    held = counts.select("j", "n", F.struct("i", before.alias("before"), "c").alias("v"))
    ranks = [(n_, F.floor((F.col("n") - 1) * F.lit(float(q))) + up)
             for k, q in enumerate(qs) for n_, up in ((f"a{k}", 0), (f"b{k}", 1))]
    picked = held.groupBy("j", "n").agg(F.collect_list("v").alias("vs"))

    def holding(rank: Column) -> Column:
        return F.get(F.filter("vs", lambda v: (v["before"] <= rank) & (rank < v["before"] + v["c"])), 0)

    picked = picked.select("j", "n", *[holding(F.least(r, F.col("n") - 1)).alias(n_) for n_, r in ranks])
    per_col = picked.agg(F.map_from_entries(F.collect_list(
        F.struct("j", F.struct("n", *[n_ for n_, _ in ranks])))).alias("m"))

    # pass 3: the values of the intervals that hold a needed order statistic
    close = (long.select("j", "x", interval.alias("i"))
             .withColumn("t", per_col.select("m").scalar()[F.col("j")]))
    needed = F.array(*[F.col(f"t.{n_}.i") for n_, _ in ranks])
    hist = (close.where(F.array_contains(needed, F.col("i")))
            .groupBy("j", "i", "x").agg(F.count("*").alias("c"), F.first("t").alias("t")))
    upto = F.sum("c").over(Window.partitionBy("j", "i").orderBy("x"))
    ranked = hist.select("j", "i", "x", "c", "t", upto.alias("upto"))
    values, parts = {}, []
    for n_, r in ranks:
        q = float(qs[int(n_[1:])])
        rank = F.least(F.floor((F.col("t.n") - 1) * F.lit(q)) + (1 if n_[0] == "b" else 0), F.col("t.n") - 1)
        at = rank - F.col(f"t.{n_}.before")
        values[n_] = F.max(F.when((F.col("i") == F.col(f"t.{n_}.i")) & (F.col("upto") > at)
                                  & (F.col("upto") - F.col("c") <= at), F.col("x")))
    for k, q in enumerate(qs):
        pos = (F.first("t.n") - 1).cast("double") * F.lit(float(q))
        parts.append(_lerp(values[f"a{k}"], values[f"b{k}"], pos - F.floor(pos)).alias(f"q{k}"))
    per_j = ranked.groupBy("j").agg(*parts)
    packed = per_j.agg(F.map_from_entries(F.collect_list(
        F.struct("j", F.struct(*[f"q{k}" for k in range(len(qs))])))).alias("m"))
    return packed.select(*[F.col("m")[j].alias(c) for j, c in enumerate(names)])


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (exact at both ends)."""
    diff = b - a
    return F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)


def quantile_scalars(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
                     accuracy: int = DEFAULT_ACCURACY) -> Column:
    """Exact quantiles as one scalar-subquery struct ``{column: {q0.., }}``.

    Bind it to a column once (``withColumn``) before referencing its fields:
    each reference to the subquery expression itself carries its whole plan.
    """
    row = quantile_row(df, columns, qs, accuracy)
    return row.select(F.struct(*columns).alias("s")).scalar()


def tertile_label(x: Column, cuts: Sequence[Column], labels: Sequence[str]) -> Column:
    """``x <= q1`` -> first, ``x <= q2`` -> second, else third; null stays null.

    Unlike ``pd.qcut`` this never raises on equal cut points (H4): heavy ties
    fall into the lowest matching label.
    """
    q1, q2 = cuts
    return (F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None).cast("string"))
            .when(x <= q1, F.lit(labels[0]))
            .when(x <= q2, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def with_tertiles(df: DataFrame, spec: dict[str, tuple[str, Sequence[str]]],
                  accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Add tertile label columns: ``{output: (column, labels)}``, cuts over ``df``."""
    cols = list(dict.fromkeys(c for c, _ in spec.values()))
    cuts = quantile_scalars(df, cols, (1 / 3, 2 / 3), accuracy)
    tmp = "__tertile_cuts"
    out = df.withColumn(tmp, cuts)
    out = out.withColumns({
        name: tertile_label(F.col(c), [F.col(tmp)[c]["q0"], F.col(tmp)[c]["q1"]], labels)
        for name, (c, labels) in spec.items()})
    return out.drop(tmp)
