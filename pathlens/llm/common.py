"""Shared helpers: reading supplied tables, written intermediate tables, UTF-8 batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors,
    and its measured size lets the planner choose join strategies itself."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as the path by which every machine that
    mounts it reaches it; any other store raises, as its files cannot be memory-mapped."""
    where = urlparse(scratch(spark, name))
    path = unquote(where.path) if where.scheme else where.geturl()
    if where.scheme not in ("", "file") or where.netloc not in ("", "localhost") or not os.path.isabs(path):
        raise ValueError("memory-mapping needs spark.checkpoint.dir to be an absolute path of a mounted folder")
    os.makedirs(path, exist_ok=True)
    return path


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` text bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last
