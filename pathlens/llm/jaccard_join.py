"""N-gram Jaccard join by MinHash banding.

Every text becomes the set of its ``n``-word shingles (lower-cased words). Texts with equal sets
form one class, and one row per class goes on. Band and row counts follow from the target recall
at the threshold; band hashes are shuffled, and each bucket links its classes to its least one,
which groups all candidates without emitting pairs. Groups are then verified on their full
shingle sets, in blocks of pairs of chunks: a block is one bounded task whatever the group's size,
and it returns a row per class (number of links, least linked class), never a row per pair.

Defined cases: a null text counts as empty; very long texts are taken whole, a set is one array; a text of fewer than ``n`` words is one shingle, a
text without words is one shingle of its whole self, so equal ones (the empty ones, too) are
copies; repeated rows are copies of each other; a class is named by its least doc_id (null last);
columns beside doc_id and text pass through ``drop_near_duplicates``; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8, written
from .components import components
from .words import LETTERS, Words, mix, ngrams, words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
CHUNK_CLASSES = 512             # classes in a chunk of a group, about
CHUNK_SHINGLES = 1_000_000      # shingles in a chunk, about

SKETCH_SCHEMA = "doc_id bigint, digest bigint, set1 bigint, set2 bigint, n_shingles int, bands array<bigint>"


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as ``most_hashes`` allow while a pair at ``threshold`` shares a
    band with probability ``recall`` at least; fewer false candidates come with more rows."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach the recall with so few hashes")
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of a slice, text by text, and where each text's begin; every
    text has one at least. Repeats are still in."""
    w: Words = words(data, offsets, LETTERS)
    counts = np.diff(w.first)
    per_text = np.maximum(1, counts - n + 1)
    begin = np.concatenate([[0], np.cumsum(per_text)])
    out = np.empty(begin[-1], np.uint64)
    grams = ngrams(w.hash, n)
    inside = np.arange(len(w.hash)) + n <= w.first[w.doc + 1]
    full = np.repeat(counts >= n, per_text)
    out[full] = grams[inside[:len(grams)]]
    for d in np.flatnonzero(counts < n):
        if counts[d]:
            short = w.hash[w.first[d]:w.first[d + 1]]
            out[begin[d]] = ngrams(short, len(short))[0] + np.uint64(len(short))
        else:
            own = data[offsets[d]:offsets[d + 1]].tobytes()
            out[begin[d]] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little")
    return out, begin


def _sketches(n: int, bands: int, rows: int):
    rng = np.random.default_rng(8)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                shingles, begin = shingle_sets(data, offsets[a:b + 1], n)
                least = np.stack([np.minimum.reduceat(shingles * f + t, begin[:-1]) for f, t in zip(factors, terms, strict=True)])
                banded = np.zeros((bands, b - a), np.uint64)
                for r in range(rows):
                    banded = mix(banded + least[r::rows] + np.uint64(r + 1))
                digests, sizes = [], []
                for d in range(b - a):
                    own = np.unique(shingles[begin[d]:begin[d + 1]])
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sizes.append(len(own))
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("digest").slice(a, b - a), pa.array(pair[:, 0]),
                     pa.array(pair[:, 1]), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()),
                                              pa.array(banded.T.reshape(-1).view(np.int64)))],
                    names=["doc_id", "digest", "set1", "set2", "n_shingles", "bands"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the text, text): what tells rows of ``docs`` apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), "text")


def sketches(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    return keyed(docs).mapInArrow(_sketches(n, *choose_bands(threshold, recall)), SKETCH_SCHEMA)


def _sets(n: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                shingles, begin = shingle_sets(data, offsets[a:b + 1], n)
                own = [np.unique(shingles[begin[d]:begin[d + 1]]).view(np.int64) for d in range(b - a)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("member").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(own)))],
                    names=["member", "shingles"])
    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``sets``, as a square matrix.

    Shingles of few sets are paired one by one along the sorted (shingle, set) list; those of
    many sets are columns of 0/1 matrices whose products are added up."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    run = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])]) if len(values) else np.zeros(0, np.int64)
    times = np.bincount(run)
    few = times[run] <= 16
    pairs = np.zeros(n * n, np.int64)
    v, o = run[few], owner[few]
    for d in range(1, 16):
        same = np.flatnonzero(v[d:] == v[:-d])
        if not len(same):
            break
        pairs += np.bincount(o[same] * n + o[same + d], minlength=n * n)
    counts = pairs.reshape(n, n)
    counts = counts + counts.T
    v, o = run[~few], owner[~few]
    if len(v):
        _, column = np.unique(v, return_inverse=True)
        total = np.zeros((n, n), np.float64)
        for c in range(0, int(column.max()) + 1, 4096):
            part = (column >= c) & (column < c + 4096)
            held = np.zeros((n, 4096), np.float32)
            held[o[part], column[part] - c] = 1
            total += held @ held.T
        counts = counts + total.astype(np.int64)
    np.fill_diagonal(counts, [len(s) for s in sets])
    return counts


def verify(sets: list[np.ndarray], weights: np.ndarray, chunk: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set: the weight of the sets that it is linked to, and the least index of its
    component. With two chunks in ``chunk``, only pairs across them are looked at."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    shared = shared_counts(sets)
    linked = shared >= threshold * (sizes[:, None] + sizes - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if chunk.min() != chunk.max():
        linked &= chunk[:, None] != chunk
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label, n).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return linked @ weights, label


def _verified(threshold: float):
    """Blocks of sorted rows to (node, links, root) of the classes with links."""
    def block(rows):
        seen, sets, info = set(), [], []
        for m, shingles in rows:
            if (m["set1"], m["set2"]) not in seen:      # a repeated row of the same document
                seen.add((m["set1"], m["set2"]))
                sets.append(shingles)
                info.append(m)
        if len(sets) < 2:
            return []
        order = sorted(range(len(sets)), key=lambda k: (info[k]["set1"], info[k]["set2"]))
        info = [info[k] for k in order]
        links, label = verify([sets[k] for k in order], np.array([m["size"] for m in info]),
                              np.array([m["chunk"] for m in info]), threshold)
        return [(m["set1"], m["set2"], int(x), info[r]["set1"], info[r]["set2"])
                for m, x, r in zip(info, links, label, strict=True) if x]

    def batch_of(rows):
        column = lambda i: pa.array([r[i] for r in rows], pa.int64())
        pair = lambda i: pa.StructArray.from_arrays([column(i), column(i + 1)], names=["set1", "set2"])
        return pa.RecordBatch.from_arrays([pair(0), column(2), pair(3)], names=["node", "links", "root"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            shingles, members = batch.column("shingles"), batch.column("member").to_pylist()
            for i, (k, m) in enumerate(zip(batch.column("block").to_pylist(), members, strict=True)):
                k = tuple(k.values())
                if k != key:
                    out += block(held) if held else []
                    key, held = k, []
                held.append((m, shingles[i].values.to_numpy().view(np.uint64)))
            held = [(m, s.copy()) for m, s in held]     # outlive the batch
            if out:
                yield batch_of(out)
        if held and (out := block(held)):
            yield batch_of(out)

    return run


def link_classes(docs: DataFrame, sketch: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, root) for the classes that have links to other classes."""
    bands = sketch.groupBy("node").agg(F.first("bands").alias("bands")).select(
        "node", F.posexplode("bands").alias("band", "hash"))
    # written, so that the joins back have plain exchanges, which may be split where a key is hot
    bucket = written(bands.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("n"))
                     .where("n > 1").drop("n"), "buckets")
    star = bands.join(bucket, ["band", "hash"]).where("node != least")
    groups = written(components(star.select(F.col("node").alias("a"), F.col("least").alias("b")), "candidates"), "groups")
    in_group = groups.join(classes, "node")
    chunks = written(in_group.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_CLASSES), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).alias("chunks")),
        "chunks")
    members = in_group.join(chunks, "root").select(
        F.struct("node.set1", "node.set2", "size", "root", "chunks",
                 F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")).alias("member"),
        F.col("rep.doc_id").alias("member_id"), F.col("rep.digest").alias("member_digest"))
    members = written(members, "members")
    texts = keyed(docs).join(members.hint("shuffle_hash"),
                             F.col("doc_id").eqNullSafe(F.col("member_id")) & (F.col("digest") == F.col("member_digest")))
    sets = texts.select("member", "text").mapInArrow(
        _sets(n), f"member {members.schema['member'].dataType.simpleString()}, shingles array<bigint>")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("member.chunks") - 1)).alias("other")
    blocks = sets.select("member", "shingles", other).select(
        F.struct("member.root.set1", "member.root.set2", F.least("other", "member.chunk").alias("i"),
                 F.greatest("other", "member.chunk").alias("j")).alias("block"), "member", "shingles")
    shuffled = blocks.repartition("block").sortWithinPartitions("block")
    return shuffled.mapInArrow(_verified(threshold), "node struct<set1:bigint,set2:bigint>, links bigint, "
                                                     "root struct<set1:bigint,set2:bigint>")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, class_id (the least doc_id among all that links
    connect), n_links (other rows within the threshold, copies included), n_copies (rows of equal
    sets, itself included), rep_id and rep_digest (the class's first row)."""
    sketch = written(sketches(docs, n, threshold, recall).withColumn("node", F.struct("set1", "set2")), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = written(sketch.groupBy("node").agg(F.min(place).alias("rep"), F.count("*").alias("size"),
                                                 F.first("n_shingles").alias("n_shingles")), "classes")
    linked = written(link_classes(docs, sketch, classes, n, threshold), "links")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), "linked")
    first = root.join(classes, "node").groupBy("root").agg(F.min("rep").alias("first"))
    named = root.join(first, "root").select("node", "first")
    per_class = (classes.join(named, "node", "left").join(links, "node", "left")
                 .select("node", "size", F.coalesce("first", "rep").alias("first"),
                         (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    return sketch.select("doc_id", "digest", "node").join(written(per_class, "classes-linked"), "node").select(
        "doc_id", "digest", F.col("first.doc_id").alias("class_id"), "n_links", F.col("size").alias("n_copies"),
        F.col("first.doc_id").alias("rep_id"), F.col("first.digest").alias("rep_digest"))


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: its first by doc_id."""
    found = near_duplicates(docs, n, threshold)
    first = written(found.where(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("digest") == F.col("rep_digest")))
                    .groupBy("doc_id", "digest").agg(F.count("*").alias("rows"))
                    .select(F.struct("doc_id", "digest", "rows").alias("kept")), "kept")
    rows = docs.select(F.struct("*").alias("doc"))
    same = (F.col("doc.doc_id").cast("bigint").eqNullSafe(F.col("kept.doc_id"))
            & (F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))) == F.col("kept.digest")))
    once = rows.join(first.where("kept.rows = 1").hint("shuffle_hash"), same, "left_semi").select("doc.*")
    many = (rows.join(first.where("kept.rows > 1").hint("shuffle_hash"), same)
            .groupBy("kept").agg(F.first("doc").alias("doc")).select("doc.*"))
    return once.unionAll(many)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")
