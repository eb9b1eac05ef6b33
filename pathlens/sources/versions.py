"""Tables that are replaced as a whole: a new version beside the old one, then one switch.

A version is a folder below ``base`` with one sub-folder per table; the file ``_CURRENT`` names the
one that counts and is replaced by an atomic rename. A reader that resolved the old version goes on
reading it whole, a job that is killed before the switch leaves the old version current, and tables
that are published together are switched together. Catalog tables follow by their location.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, p, p.getFileSystem(conf)


def current_version(spark: SparkSession, base: str) -> str | None:
    """The folder of the current version, None before the first."""
    jvm, _, pointer, fs = _hadoop(spark, f"{base.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{base.rstrip('/')}/{name}"


def new_version(base: str) -> str:
    """A folder for a version that is not current yet."""
    return f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"


def switch(spark: SparkSession, base: str, version: str) -> None:
    """Makes ``version`` current: the pointer is written beside and renamed over the old one."""
    base = base.rstrip("/")
    if not version.startswith(f"{base}/"):
        raise ValueError(f"{version} is not below {base}")
    jvm, conf, part, fs = _hadoop(spark, f"{base}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(part)
    try:
        out.write(bytearray(version[len(base) + 1:].encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), conf).rename(
        part, jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"), options)


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame | Callable[[], DataFrame]], database: str | None = None,
            partition_by: dict[str, list[str]] | None = None) -> str:
    """Writes ``tables`` as a new version and switches to it; with ``database`` the catalog's
    external tables move to it, too. Returns the version's folder."""
    version = new_version(base)
    for name, table in tables.items():
        w = (table() if callable(table) else table).write
        columns = (partition_by or {}).get(name)
        (w.partitionBy(*columns) if columns else w).parquet(f"{version}/{name}")
    switch(spark, base, version)
    if database:
        for name in tables:
            locate(spark, database, name, f"{version}/{name}", bool((partition_by or {}).get(name)))
    return version


def locate(spark: SparkSession, database: str, name: str, path: str, partitioned: bool = False) -> None:
    """The catalog table over ``path``: made if absent, else moved there without a moment without it.
    A partitioned table is made anew, as its partitions are in the catalog."""
    full = f"`{database}`.`{name}`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    if spark.catalog.tableExists(f"{database}.{name}") and not partitioned:
        spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
        spark.catalog.refreshTable(f"{database}.{name}")
        return
    spark.sql(f"DROP TABLE IF EXISTS {full}")
    spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet")
    if partitioned:
        spark.catalog.recoverPartitions(f"{database}.{name}")


def read_current(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the current version."""
    version = current_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"nothing is published below {base}")
    return spark.read.parquet(f"{version}/{name}")


def drop_old_versions(spark: SparkSession, base: str) -> int:
    """Deletes every version but the current one, those that killed jobs left included; returns how
    many. Run it when no reader of an old version is left and no job writes."""
    current = current_version(spark, base)
    _, _, root, fs = _hadoop(spark, base)
    gone = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v-") and (current is None or name != current.rsplit("/", 1)[1]):
            gone += bool(fs.delete(status.getPath(), True))
    return gone
