"""Reading and writing tables.

Raw CSV is RFC 4180: fields may be quoted, a quote inside is doubled, quoted fields may hold
commas and newlines. It is read as text with a header and converted by column name (no schema
inference pass over the data). A record whose number of fields differs from the header's is
rejected: it goes to a reject table, with its text and file, or raises where none is named. As
a quoted newline can be anywhere, a file is one task's work; give large tables as folders of
many files. Tables are written as Parquet, either to a path
or as catalog tables; the fixed schemas of ``pathlens.schemas`` are enforced on
write. Large tables can be partitioned by date for pruning.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conform
from ..operators import clean, derive
from ..schemas import SCHEMAS, get_table_schema

WRITE_MODES = {"WRITE_TRUNCATE": "overwrite", "WRITE_APPEND": "append", "WRITE_EMPTY": "empty"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
NULL_FIELD = "\0null\0"       # what the reader takes for an unquoted empty field, so that "" stays empty text
CORRUPT = "_corrupt_record"


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV file (of the first file of a folder)."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """All records as text columns, plus the raw text of those that do not fit the header and
    the file they are in."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*csv_columns(spark, path), CORRUPT]])
    # unpruned: fields are counted whichever columns a query takes
    rows = (spark.read.options(**CSV_OPTIONS).schema(schema).option("mode", "PERMISSIVE").option("columnPruning", "false").option("nullValue", NULL_FIELD)
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    # the reader refuses queries of the corrupt records alone, so a field is looked at, too
    read = F.length(F.coalesce(F.col(f"`{schema.names[0]}`"), F.lit(""))) >= 0
    return rows.where(read).withColumn("_file", F.input_file_name())


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text (the schema is applied by name afterwards); a record that
    does not fit the header raises when it is read."""
    rows = _csv_records(spark, path)
    refused = F.raise_error(F.concat(F.lit("record does not fit the header of "), F.col("_file"), F.lit(": "), F.col(CORRUPT)))
    checked = rows.where(F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(refused.cast("boolean")))
    return checked.drop(CORRUPT, "_file")


def read_csv_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records as text columns, rejected records): (record, file, reason, rejected_at)."""
    rows = _csv_records(spark, path)
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"), F.col("_file").alias("file"), F.lit("record does not fit the header").alias("reason"),
        F.current_timestamp().alias("rejected_at"))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"), bad


def read_raw(spark: SparkSession, raw_path: str, rejects: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Customers.csv and interactions.csv; a missing file raises FileNotFoundError.

    ``rejects``: folder of the reject tables (one sub-folder per table), written here; without
    it a record that does not fit its header raises when it is read."""
    out = []
    for name in ("customers", "interactions"):
        p = os.path.join(raw_path, f"{name}.csv")
        if not path_exists(spark, p):
            raise FileNotFoundError(f"{name} data not found at {p}")
        text = _accepted(spark, p, name, rejects)
        known = {f.name for f in SCHEMAS[name].fields}
        extra = [T.StructField(c, T.StringType()) for c in text.columns if c not in known]
        out.append(conform(text, T.StructType([*SCHEMAS[name].fields, *extra])))
    return out[0], out[1]


def _accepted(spark: SparkSession, path: str, name: str, rejects: str | None) -> DataFrame:
    """The records that fit; the others to ``rejects/name``."""
    if rejects is None:
        return read_csv_text(spark, path)
    good, bad = read_csv_split(spark, path)
    bad.write.mode("append").parquet(os.path.join(rejects, name))
    return good


def rejected_counts(spark: SparkSession, rejects: str) -> DataFrame:
    """(name, file, reason, records) of the reject tables below ``rejects``."""
    tables = [spark.read.parquet(p).withColumn("name", F.lit(n)) for n in SCHEMAS if path_exists(spark, p := os.path.join(rejects, n))]
    if not tables:
        return spark.createDataFrame([], "name string, file string, reason string, records bigint")
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("name", "file", "reason").agg(F.count("*").alias("records"))


def read_derived(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A derived table; a missing one reads as an empty table with its schema."""
    schema = get_table_schema(name)
    p = os.path.join(base, name)
    if not path_exists(spark, p):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        return conform(read_csv_text(spark, p), schema)
    return spark.read.format(fmt).load(p)


def _has_rows(spark: SparkSession, name: str, path: str | None) -> bool:
    if path is not None:
        return path_exists(spark, path) and spark.read.parquet(path).limit(1).count() > 0
    return spark.catalog.tableExists(name) and spark.table(name).limit(1).count() > 0


def write_table(df: DataFrame, name: str, write_disposition: str = "WRITE_TRUNCATE",
                path: str | None = None, partition_by: list[str] | None = None,
                bucket_by: tuple[int, list[str]] | None = None) -> None:
    """S3: conform to the table's schema and write it.

    WRITE_TRUNCATE replaces, WRITE_APPEND adds, WRITE_EMPTY fails only when the
    table already holds rows. ``bucket_by=(n, ["customer_id"])`` stores a catalog
    table bucketed (and sorted) on the key, so later joins and aggregations on it
    with another table bucketed the same way need no shuffle.
    """
    mode = WRITE_MODES.get(write_disposition, write_disposition)
    spark = df.sparkSession
    schema = get_table_schema(name.split(".")[-1].strip("`"))
    out = conform(df, schema) if schema.fields else df
    if "date" in (partition_by or []) and "date" not in out.columns:
        out = out.withColumn("date", F.to_date("timestamp"))
    if mode == "empty":
        if _has_rows(spark, name, path):
            raise ValueError(f"table {name} is not empty")
        mode = "overwrite"
    w = out.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        w = w.bucketBy(n, *cols).sortBy(*cols)
        if path is not None:
            w = w.option("path", path)
        w.saveAsTable(name)
    elif path is not None:
        w.save(path)
    else:
        w.saveAsTable(name)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV as ``read_csv_text`` reads it: every value survives, null and empty text apart."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.mode(mode).options(header="true", quote='"', escape='"', emptyValue='""', nullValue="",
                                  ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def load_csv(spark: SparkSession, csv_path: str, name: str, write_disposition: str = "WRITE_TRUNCATE",
             path: str | None = None, rejects: str | None = None) -> None:
    """Header CSV -> typed table (no inference); ``rejects`` as in ``read_raw``."""
    write_table(conform(_accepted(spark, csv_path, name, rejects), get_table_schema(name)), name, write_disposition, path)


def _pick(spark: SparkSession, base: str, stem: str) -> str | None:
    for candidate in (f"{stem}_clean.csv", f"{stem}.csv"):
        p = os.path.join(base, candidate)
        if path_exists(spark, p):
            return p
    return None


def load_all(spark: SparkSession, raw_path: str, processed_path: str,
             target: str | None = None, rejects: str | None = None) -> list[str]:
    """Load the six tables, preferring ``_clean`` files; returns the tables loaded.

    ``target``: folder for path-based tables (one sub-folder per table); default
    catalog tables. ``rejects`` as in ``read_raw``.
    """
    jobs = [("customers", raw_path, "customers"), ("interactions", raw_path, "interactions"),
            ("customer_journeys", processed_path, "customer_journeys"),
            ("touchpoint_analysis", processed_path, "touchpoint_analysis"),
            ("customer_segments", processed_path, "customer_segments"),
            ("time_series_data", processed_path, "time_series_data")]
    loaded = []
    for name, base, stem in jobs:
        src = _pick(spark, base, stem)
        if src is None:
            continue
        load_csv(spark, src, name, "WRITE_TRUNCATE", os.path.join(target, name) if target else None, rejects)
        loaded.append(name)
    return loaded


def derived_tables(customers: DataFrame, interactions: DataFrame, as_of, round_to: int | None = 2,
                   only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The four derived tables of cleaned base tables, or those named in ``only``."""
    makers = {
        "customer_journeys": lambda: derive.customer_journeys(interactions),
        "touchpoint_analysis": lambda: derive.touchpoint_analysis(interactions, round_to),
        "customer_segments": lambda: derive.customer_segments(customers, interactions, as_of, round_to),
        "time_series_data": lambda: derive.time_series(interactions, round_to=round_to),
    }
    return {name: make() for name, make in makers.items() if only is None or name in only}


def build_all(spark: SparkSession, customers: DataFrame, interactions: DataFrame, as_of,
              out_path: str, round_to: int | None = 2) -> dict[str, DataFrame]:
    """Clean, derive the four tables and write each as Parquet; returns them re-read.

    The cleaned base tables are written first, the interactions by date, so the input is
    parsed once and every derivation prunes columns and dates; the written tables are the
    materialisation points for later reports.
    """
    write_table(clean.clean_customers(customers), "", path=f"{out_path}/customers")
    write_table(clean.clean_interactions(interactions), "", path=f"{out_path}/interactions", partition_by=["date"])
    c, i = (spark.read.parquet(f"{out_path}/{name}") for name in ("customers", "interactions"))
    out = {"customers": c, "interactions": i}
    for name, df in derived_tables(c, i.drop("date"), as_of, round_to).items():
        df.write.mode("overwrite").parquet(f"{out_path}/{name}")
        out[name] = spark.read.parquet(f"{out_path}/{name}")
    return out


def register_external(spark: SparkSession, database: str, name: str, path: str, partitioned: bool = False) -> None:
    """A catalog table over files that are written already: nothing is stored twice."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet")
    if partitioned:
        spark.catalog.recoverPartitions(f"{database}.{name}")


def create_tables(spark: SparkSession, database: str | None = None,
                  names: list[str] | None = None) -> list[str]:
    """Create the database and the fixed-schema tables when absent."""
    prefix = ""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        prefix = f"`{database}`."
    made = []
    for name in names or list(SCHEMAS):
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}`{name}` ({ddl}) USING parquet")
        made.append(name)
    return made


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL over the warehouse tables (plus any DataFrames registered as views)."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
