"""The batch job end to end: raw CSV -> cleaned -> four derived tables -> warehouse.

Each table is written once as Parquet under ``out_path``: first the cleaned base tables
(interactions partitioned by date), then the derived tables from them. With ``database``
they are also registered there as external tables over the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean
from ..sources import io


def build_warehouse(spark: SparkSession, raw_path: str, out_path: str, as_of,
                    round_to: int | None = 2, database: str | None = None,
                    only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """``only``: the derived tables to build (default: all four)."""
    cleaned = clean.clean_all(*io.read_raw(spark, raw_path))
    io.write_table(cleaned["customers"], "customers", path=f"{out_path}/customers")
    io.write_table(cleaned["interactions"], "interactions", path=f"{out_path}/interactions", partition_by=["date"])
    tables = {name: spark.read.parquet(f"{out_path}/{name}") for name in ("customers", "interactions")}
    derived = io.derived_tables(tables["customers"], tables["interactions"].drop("date"), as_of, round_to, only)
    for name, df in derived.items():
        io.write_table(df, name, path=f"{out_path}/{name}")
        tables[name] = spark.read.parquet(f"{out_path}/{name}")
    if database:
        for name in tables:
            io.register_external(spark, database, name, f"{out_path}/{name}", partitioned=name == "interactions")
    return tables
