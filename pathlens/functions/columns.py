"""Schema conformance and lenient numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import lenient_double, nan_to_null


def _to_type(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    if src == dst:
        return c
    if isinstance(src, T.StringType):
        if isinstance(dst, (T.LongType, T.IntegerType)):
            return nan_to_null(lenient_double(c)).try_cast(dst)
        return c.try_cast(dst)
    return c.try_cast(dst)


def conform(df: DataFrame, schema: T.StructType, cast: bool = True) -> DataFrame:
    """Keep the schema's columns that exist, in schema order (cast by name)."""
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name in present:
            c = F.col(f"`{f.name}`")
            cols.append(_to_type(c, present[f.name], f.dataType).alias(f.name) if cast else c)
    return df.select(*cols)


def coerce_numeric(df: DataFrame, threshold: float = 0.8,
                   date_column: str | None = "date") -> DataFrame:
    """Text columns that are mostly numbers become numbers.

    A text column converts when more than ``threshold`` of all rows parse as a
    number; unparsable values become 0; the column is whole-number typed when
    every value is whole. The decision needs one small aggregate (three numbers
    per text column) before the output schema is known; that single row is the
    only thing fetched to the driver.
    """
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df
    probes = []
    for i, c in enumerate(text_cols):
        x = nan_to_null(lenient_double(F.col(f"`{c}`")))
        filled = F.coalesce(x, F.lit(0.0))
        probes += [F.count(x).alias(f"p{i}"),
                   F.count(F.when(filled != F.floor(filled), 1)).alias(f"f{i}")]
    stats = df.agg(F.count("*").alias("n"), *probes).first()
    n = stats["n"]
    out = {}
    for i, c in enumerate(text_cols):
        parsed, fractional = stats[f"p{i}"], stats[f"f{i}"]
        if parsed > 0 and parsed > n * threshold:
            x = F.coalesce(nan_to_null(lenient_double(F.col(f"`{c}`"))), F.lit(0.0))
            out[c] = x.cast("long") if fractional == 0 else x
    if date_column and date_column in df.columns and date_column not in out:
        out[date_column] = F.to_date(F.col(date_column))
    return df.withColumns(out) if out else df
