"""Document fingerprints by Order MinHash (Marcais et al., "Locality-sensitive hashing for the
edit distance", Bioinformatics 2019).

The k-mers of a text's UTF-8 bytes are numbered by occurrence, so that a repeated k-mer counts
each time. The hash of (k-mer, number) falls into one of ``SLOTS`` bins (one permutation,
partitioned); in each bin the ``TUPLE`` smallest are taken, put back into text order, and the
tuple of their k-mers is hashed to 16 bits. Moving a passage changes the order within tuples, so
the share of equal slots falls with edit distance, not only with changed content. A bin that
stays empty copies the first filled bin of a fixed random sequence of its own.

Defined cases: a null text counts as empty; very long texts are taken whole, k-mer by k-mer; an empty text has the fingerprint of 64 zero slots and
is alike to empty texts only; a text shorter than a k-mer is one k-mer; documents are ordered by
doc_id, null last, and text, and rows equal in both are interchangeable neighbours; a single
document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import BASE, BYTE_VALUES, mix

K = 6
TUPLE = 2
SLOTS = 64
LOW_BITS = 20
_rng = np.random.default_rng(17)
_DONORS = np.array([_rng.permutation(np.delete(np.arange(SLOTS), j)) for j in range(SLOTS)])
_EMPTY = np.zeros(SLOTS, np.uint16)
_BIN_STARTS = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS.bit_length() + 1)

SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` cut to their upper 44 bits at every length and sorted, equal ones by index; and
    the indexes, which are sorted along in the low bits if they fit: the same order, found faster."""
    low = np.uint64((1 << LOW_BITS) - 1)
    cut, n = values & ~low, len(values)
    if n > 1 << LOW_BITS:
        at = np.argsort(cut, kind="stable")
        return cut[at], at
    packed = cut | np.arange(n, dtype=np.uint64)
    packed.sort()
    return packed & ~low, (packed & low).astype(np.int64)


def order_minhash(text: bytes) -> np.ndarray:
    """The fingerprint: ``SLOTS`` 16-bit tuple hashes."""
    if not text:
        return _EMPTY
    values = BYTE_VALUES[np.frombuffer(text, np.uint8)]
    k = min(K, len(values))
    n = len(values) - k + 1
    kmers = np.zeros(n, np.uint64)
    for j in range(k):
        kmers += values[j:n + j] * np.uint64(pow(BASE, j, 2**64))
    kmers = mix(kmers)
    same, at = _ranked(kmers)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(same[1:], same[:-1], out=new[1:])
    run = np.flatnonzero(new)
    number = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    keys = np.empty(n, np.uint64)
    keys[at] = mix(same + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    smallest, at = _ranked(keys)
    begin = np.searchsorted(smallest, _BIN_STARTS)
    end = np.append(begin[1:], n)
    taken = begin[:, None] + np.arange(TUPLE)
    valid = taken < end[:, None]
    place = np.where(valid, at[np.minimum(taken, n - 1)], np.iinfo(np.int64).max)
    place.sort(axis=1)                                  # back into text order; missing ones last
    slots = np.zeros(SLOTS, np.uint64)
    for j in range(TUPLE):
        there = place[:, j] < n
        slots = np.where(there, mix(slots + kmers[np.where(there, place[:, j], 0)] + np.uint64(j + 1)), slots)
    filled = begin < end
    if not filled.all():
        donor = _DONORS[np.arange(SLOTS), filled[_DONORS].argmax(axis=1)]
        slots = np.where(filled, slots, slots[donor])
    return (slots >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as hex) of every row of ``docs``; a map, no shuffle."""
    def run(batches):
        for batch in batches:
            made = [order_minhash((t or "").encode()).tobytes().hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``other``."""
    n = len(text) // 4
    return text[:len(text) - n] + other[:n]


def _compare(last_bucket: int, last_next: str | None):
    """Rows sorted by bucket, own rows before the bucket's one successor from outside."""
    def row(doc_id, text, print_, next_text, next_print):
        changed = edited(text, next_text).encode()
        changed_print = order_minhash(changed)
        return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), print_.tobytes().hex(),
                changed_print.tobytes().hex(), likeness(print_, changed_print), likeness(print_, next_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []                            # held: bucket, doc_id, text, fingerprint
        for batch in batches:
            for bucket, outside, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if outside and held is None:
                    continue                            # a further row of the successor's key
                text = text or ""
                print_ = order_minhash(text.encode())
                if held is not None and held[0] == bucket:
                    out.append(row(*held[1:], text, print_))
                elif held is not None and last_next is not None and held[0] == last_bucket:
                    out.append(row(*held[1:], last_next, order_minhash(last_next.encode())))
                held = None if outside else (bucket, doc_id, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
                out = []
        if held is not None and last_next is not None and held[0] == last_bucket:
            out = [row(*held[1:], last_next, order_minhash(last_next.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see SCHEMA.

    Texts are dealt once, to buckets between quantiles of doc_id that are ids of the table. The
    documents of such an id also go to the bucket before, as the successor of its last document;
    so each bucket is read in order, a batch at a time, on its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("cuts"), F.min("doc_id").alias("least"),
                     F.count_if(F.col("doc_id").isNull()).alias("no_id"), F.count("*").alias("n")).first()
    if stats["n"] == 0:
        return spark.createDataFrame([], SCHEMA)
    bounds = np.unique([stats["least"], *(stats["cuts"] or [])]) if stats["least"] is not None else np.zeros(0, np.int64)
    last, no_id = len(bounds) - 1, bool(stats["no_id"])
    first_without = (rows.where("doc_id is null").agg(F.min(F.coalesce("text", F.lit(""))).alias("t")).first()["t"]
                     if no_id else None)

    @F.pandas_udf("array<struct<bucket:int,outside:boolean>>")
    def places(ids: pd.Series, missing: pd.Series) -> pd.Series:
        out = []
        for x, none in zip(ids.to_numpy(), missing.to_numpy(), strict=True):
            if none:
                out.append([(last + 1, False)] + [(last + 1, True)] * (last < 0))
                continue
            b = int(np.searchsorted(bounds, x, side="right")) - 1
            here = [(b, False)]
            if x == bounds[b]:
                here += [(b - 1, True)] if b else [(last + 1 if no_id else last, True)]
            out.append(here)
        return pd.Series(out)

    dealt = (rows.withColumn("place", F.explode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())))
             .select("place.bucket", "place.outside", "doc_id", "text")
             .repartition(max(1, n // 2), "bucket")
             .sortWithinPartitions("bucket", "outside", F.col("doc_id").asc_nulls_last(), "text"))
    return dealt.mapInArrow(_compare(last, first_without if last >= 0 else None), SCHEMA)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
