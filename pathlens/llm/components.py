"""Connected components of an edge table by large-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014) and a union-find inside each partition.

The union-find takes the place of the paper's small-star step: dealt by their larger node, all
edges of a node to smaller ones are in one partition, so they are joined up there, along with
whatever else the partition holds. That saves exchanges and rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood.

    The least neighbour is a partial aggregate that joins back, so a node with very many
    neighbours is never gathered."""
    around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join back has plain exchanges, which are split where a node is hot
    least = written(around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "least")
    return (around.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")))


def _keys(column: pa.Array) -> list:
    if pa.types.is_struct(column.type):
        return list(zip(*(c.to_pylist() for c in column.flatten()), strict=True))
    return column.to_pylist()


def _array(keys: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind):
        columns = [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(kind)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))
    return pa.array(keys, kind)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition to (node, least node that they connect it to)."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(_keys(batch.column("a")), _keys(batch.column("b")), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for n in range(0, len(nodes), 50_000):
        part = nodes[n:n + 50_000]
        yield pa.RecordBatch.from_arrays([_array(part, kind), _array([find(x) for x in part], kind)], names=["a", "b"])


def _joined_up(edges: DataFrame) -> DataFrame:
    return edges.repartition("a").mapInArrow(_union_find, edges.schema)


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and to a node that has none: stars."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        edges.select("b", F.lit(0), F.lit(1)))
    seen = nodes.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")


def partial_roots(edges: DataFrame, name: str = "partial", rounds: int = 1) -> DataFrame:
    """(node, root) after ``rounds`` steps: nodes of equal root are of one component, though a
    component may still have several roots."""
    edges = written(_joined_up(_downward(edges)), f"{name}-0")
    for n in range(1, rounds + 1):
        edges = written(_joined_up(_large_star(edges)), f"{name}-{n}")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a and b, of one orderable type): root is
    the least node of its component. Each round is written, so a lost executor costs one round;
    it ends when all that is left is stars, which another round would leave as they are."""
    edges, n = written(_joined_up(_downward(edges)), f"{name}-0"), 0
    while not _is_settled(edges):
        n += 1
        edges = written(_joined_up(_large_star(edges)), f"{name}-{n}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
