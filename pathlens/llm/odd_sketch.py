"""MinHash near-dedup with odd sketches.

Each text becomes its set of distinct two-word shingles; equal sets are one class. ``HASHES``
MinHash samples of a set are banded for candidates, and all of them are folded into a parity bitmap
of ``BITS`` bits, an odd sketch (Mitzenmacher, Pagh and Pham, "Efficient estimation for high
similarities using odd sketches", WWW 2014). The population count of the XOR of two sketches
estimates how many samples differ, so a candidate pair costs 256 bytes a side; only pairs whose
estimate is within ``SIGMAS`` standard deviations of the threshold are confirmed, always on their
full sets.

1. Every class is linked to the least class of the bucket that it shares most often; confirmed
   links join classes to components.
2. Buckets that still hold more than one component (or part of one) are searched across components,
   sketches only, in blocks of chunks; each component's best pair is confirmed, which joins most of
   what belongs together (``ROUNDS`` times).
3. Classes that still have a passing partner in another component are grouped, and their full sets
   compared in blocks, all pairs whose sketches pass: the exact way for what is left.

No step emits a row per pair: step 1 has one per class, step 2 one per component and block, step 3
one per class and block.

Defined cases: a null or blank text has no words, an empty set and no links, and is its own
component; a text of one word is one shingle; very long texts are taken whole, a set is one array;
repeated rows and equal sets are one class, so copies are linked; a component is named by its least
doc_id, null where no row has one; rows without doc_id are ``kept`` only in such a component (all
of them); of rows with the same doc_id each is kept if it names the component; other columns are
left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8, written
from .components import components, partial_roots
from .jaccard_join import choose_bands, keyed
from .words import NON_SPACE, Words, mix, ngrams, words

SHINGLE = 2
THRESHOLD = 80                  # per cent
RECALL = 0.99999
HASHES = 256
BITS = 2048
SIGMAS = 5
CHUNK = 1024                    # classes in a chunk of a bucket, sketches
CHUNK_SETS = 512                # classes in a chunk of a group, full sets
ROUNDS = 1

NODE = "struct<set1:bigint,set2:bigint>"
SKETCH_SCHEMA = f"doc_id bigint, digest bigint, node {NODE}, n_shingles bigint, buckets array<bigint>, odd binary"


def most_differing_bits(threshold: float = THRESHOLD / 100, hashes: int = HASHES, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """The largest XOR population count that a pair at ``threshold`` is let have: ``sigmas`` standard
    deviations below it in matching samples, and as many above the mean count of those samples."""
    similar = threshold - sigmas * math.sqrt(threshold * (1 - threshold) / hashes)
    tosses = 2 * hashes * (1 - max(0.0, similar))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** tosses))


def estimate(differing: np.ndarray, hashes: int = HASHES, bits: int = BITS) -> np.ndarray:
    """Similarity by the population count of two sketches' XOR."""
    left = np.maximum(1e-9, 1 - 2 * np.asarray(differing, np.float64) / bits)
    return np.clip(1 + bits / (4 * hashes) * np.log(left), 0, 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Per text of a slice its distinct shingle hashes, ascending."""
    w: Words = words(data, offsets, NON_SPACE)
    grams = ngrams(w.hash, n)
    sets = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            sets.append(ngrams(w.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minhashes(values: np.ndarray, begin: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(hashes, sets): the least value of each hash function over ``values[begin[i]:begin[i + 1]]``."""
    rng = np.random.default_rng(13)
    factors = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**64, hashes, dtype=np.uint64)
    return np.stack([np.minimum.reduceat(values * f + t, begin[:-1]) for f, t in zip(factors, terms, strict=True)])


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(sets, bits / 8) bytes: each sample, hashed with its number, flips one bit."""
    hashes, n = samples.shape
    numbered = mix(samples + np.arange(1, hashes + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
    bit = (numbered % np.uint64(bits)).astype(np.int64) + np.arange(n) * bits
    parity = np.bincount(bit.reshape(-1), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(parity.astype(np.uint8), axis=1)


def _sketched(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                sets = shingle_sets(data, offsets[a:b + 1])
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                buckets, odd = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), BITS // 8), np.uint8)
                if len(full):
                    samples = minhashes(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])]))
                    odd[full] = odd_sketches(samples)
                    banded = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[:, None], len(full), axis=1)
                    for r in range(rows):
                        banded = mix(banded + samples[r:bands * rows:rows])
                    buckets[full] = banded.T
                pair = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                node = pa.StructArray.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["set1", "set2"])
                taken = np.where(sizes > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("digest").slice(a, b - a), node, pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]), pa.int32()),
                                              pa.array(buckets[full].reshape(-1).view(np.int64))),
                     pa.array([x.tobytes() for x in odd], pa.binary())],
                    names=["doc_id", "digest", "node", "n_shingles", "buckets", "odd"])

    return run


def sketches(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its class, set size, band buckets and odd sketch."""
    return keyed(docs).mapInArrow(_sketched(*choose_bands(THRESHOLD / 100, RECALL, HASHES)), SKETCH_SCHEMA)


def _block_keys(column: pa.Array) -> np.ndarray:
    """The numbers of a block's key, nested or not, a row each."""
    flat = column.flatten()
    return np.concatenate([_block_keys(c) if pa.types.is_struct(c.type) else c.to_numpy(zero_copy_only=False)[:, None] for c in flat], axis=1)


def _runs(keys: np.ndarray) -> np.ndarray:
    """The number of the run of equal consecutive rows of ``keys`` that each row is in."""
    return np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.zeros(0, np.int64)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows again, cut between blocks only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = _block_keys(batch.column("block"))
        if held:
            last = _block_keys(held[-1].column("block").slice(len(held[-1]) - 1))[0]
            if (keys[0] == last).all() and (keys[-1] == last).all():
                held.append(batch)
                continue
        start = int(np.searchsorted(_runs(keys), _runs(keys)[-1]))
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _column(rows: pa.Table, name: str) -> pa.Array:
    found = rows.column(name).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _block_arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row its block's number, side and label, and its sketch as 64-bit words."""
    odd = np.frombuffer(b"".join(_column(rows, "odd").to_pylist()), np.uint64).reshape(len(rows), BITS // 64)
    return _runs(_block_keys(_column(rows, "block"))), _column(rows, "side").to_numpy(), _column(rows, "label").to_numpy(), odd


def passing(block: np.ndarray, side: np.ndarray, label: np.ndarray, odd: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(i, j, differing bits) of the pairs in a block, of different labels, whose sketches pass; in
    a block with two sides only pairs across them."""
    n = len(block)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    two = (np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first))[block - block[0]]
    found = []
    longest = int(np.diff(np.append(first, n)).max())
    at = np.arange(n)
    for d in range(1, longest):
        at = at[at + d < n]
        at = at[block[at + d] == block[at]]
        near = at[(label[at] != label[at + d]) & (~two[at] | (side[at] != side[at + d]))]
        for k in range(0, len(near), 50_000):
            i = near[k:k + 50_000]
            bits = np.bitwise_count(odd[i] ^ odd[i + d]).sum(axis=1, dtype=np.int64)
            ok = bits <= most
            found.append((i[ok], i[ok] + d, bits[ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (at[:0], at[:0], at[:0])


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that the pairs (i, j) connect each of ``n`` rows to."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        after = least.copy()
        np.minimum.at(after, least[i], low)
        np.minimum.at(after, least[j], low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def _best_pairs(most: int):
    """Blocks to (label, differing, a, b): each label's best pair of the block."""
    def run(batches):
        for rows in _whole_blocks(batches):
            block, side, label, odd = _block_arrays(rows)
            i, j, bits = passing(block, side, label, odd, most)
            if not len(i):
                continue
            i, j, bits = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([bits, bits])
            order = np.lexsort((j, i, bits, label[i]))
            i, j, bits = i[order], j[order], bits[order]
            best = np.flatnonzero(np.concatenate([[True], label[i[1:]] != label[i[:-1]]]))
            node = _column(rows, "node")
            yield pa.RecordBatch.from_arrays([pa.array(label[i[best]]), pa.array(bits[best]), node.take(pa.array(i[best])),
                                              node.take(pa.array(j[best]))], names=["label", "differing", "a", "b"])
    return run


def _passing_groups(most: int):
    """Blocks to edges (a, b) that connect all rows with a passing partner to one of their group."""
    def run(batches):
        for rows in _whole_blocks(batches):
            i, j, _ = passing(*_block_arrays(rows), most)
            least = joined(len(rows), i, j)
            other = np.flatnonzero(least != np.arange(len(rows)))
            if len(other):
                node = _column(rows, "node")
                yield pa.RecordBatch.from_arrays([node.take(pa.array(other)), node.take(pa.array(least[other]))], names=["a", "b"])
    return run


def _chunks(rows: Column, size: int) -> Column:
    return F.ceil(rows / size).cast("bigint")


def _in_blocks(members: DataFrame, group: Column, size: int) -> DataFrame:
    """``members`` (node, odd, label and their group's ``n`` rows, its most frequent label ``top``
    and that label's ``top_n`` rows) once per block: (block, side, label, node, odd). A block is a
    pair of chunks of about ``size`` rows, whatever the group's size.

    Rows of one label are not compared, so chunks of the most frequent label meet only those of the
    others: its rows are placed once per chunk of the others, however many they are themselves. A
    chunk of the others has its own pairs compared beside the first chunk of that label: there all
    rows have one side."""
    others, tops = _chunks(F.col("n") - F.col("top_n"), size), _chunks(F.col("top_n"), size)
    is_top = F.col("label") == F.col("top")
    chunk = F.when(is_top, F.col("others") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    partners = F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops"))
    other = F.explode(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("partners") - 1), F.col("chunk"))).alias("other")
    low, high = F.least("other", "chunk"), F.greatest("other", "chunk")
    return (members.withColumns({"others": others, "tops": tops, "_group": group}).where("others > 0")
            .withColumns({"chunk": chunk, "partners": partners}).select("*", other)
            .select(F.struct(F.col("_group").alias("group"), low.alias("i"), high.alias("j")).alias("block"),
                    F.when(high == F.col("others"), F.lit(0).cast("bigint")).otherwise(F.col("chunk")).alias("side"),
                    "label", "node", *[c for c in ("odd",) if c in members.columns]))


def _label_counts(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, top, top_n) and, of the group's nodes, ``sum`` and ``xor`` of their hashes; one
    row per group with rows of several labels."""
    per_label = rows.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
                                                 F.expr("bit_xor(xxhash64(node))").alias("xor"))
    return (per_label.groupBy(group).agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"),
                                         F.sum("sum").cast("decimal(38,0)").alias("sum"), F.bit_xor("xor").alias("xor"))
            .where("labels > 1").select(group, "n", F.col("most.label").alias("top"), F.col("most.n").alias("top_n"), "sum", "xor"))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, places, odd, text) to its set; of repeated rows of a document a task hands on one."""
    seen = set()
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.column("node").flatten()), strict=True))
        new = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                new.append(i)
        batch = batch.take(pa.array(new, pa.int32()))
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            own = shingle_sets(data, offsets[a:b + 1])
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            shingles = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("node", "places", "odd")], shingles],
                                             names=["node", "places", "odd", "shingles"])


def _confirmed(threshold: int, most: int):
    """Blocks with full sets to confirmed edges (a, b); a pair that others connect already in the
    block is left out."""
    def run(batches):
        for rows in _whole_blocks(batches):
            block, side, label, odd = _block_arrays(rows)
            node, lists = _column(rows, "node"), _column(rows, "shingles")
            values, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            i, j, bits = passing(block, side, label, odd, most)
            order = np.lexsort((j, i, bits))
            parent = list(range(len(rows)))

            def find(x, parent=parent):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            a, b = [], []
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                s, t = values[at[x]:at[x + 1]], values[at[y]:at[y + 1]]
                if 100 * min(len(s), len(t)) < threshold * max(len(s), len(t)) or find(x) == find(y):
                    continue
                shared = len(s) + len(t) - len(np.union1d(s, t))
                if 100 * shared >= threshold * (len(s) + len(t) - shared):
                    parent[find(x)] = find(y)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])
    return run


def _confirm(docs: DataFrame, classes: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) of ``placed`` (block, side, label, node) that hold on the full sets."""
    per_node = placed.groupBy("node").agg(F.collect_list(F.struct("block", "side", "label")).alias("places"))
    members = written(per_node.join(classes, "node").select(
        "node", "places", "odd", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest")), f"{name}-members")
    texts = keyed(docs).join(members.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("digest") == F.col("rep_digest")))
    places = members.schema["places"].dataType.simpleString()
    sets = texts.select("node", "places", "odd", "text").mapInArrow(_full_sets, f"node {NODE}, places {places}, odd binary, shingles array<bigint>")
    blocks = sets.select("node", "odd", "shingles", F.inline("places"))
    return written(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(
        _confirmed(THRESHOLD, most_differing_bits()), f"a {NODE}, b {NODE}"), f"{name}-confirmed")


def _star_places(pairs: DataFrame) -> DataFrame:
    """Pairs (a, hub) placed in blocks of a hub and at most about ``CHUNK_SETS`` others."""
    many = written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK_SETS).alias("salts")), "hubs")
    salted = pairs.join(many, "hub").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    block = lambda salt: F.struct(F.col("hub").alias("group"), salt.alias("i"), salt.alias("j")).alias("block")
    own = salted.select(block(F.col("salt")), F.lit(1).cast("bigint").alias("side"), F.xxhash64("a").alias("label"), F.col("a").alias("node"))
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    return own.unionAll(hubs.select(block(F.col("salt")), F.lit(0).cast("bigint").alias("side"), F.xxhash64("hub").alias("label"),
                                    F.col("hub").alias("node")))


def _open(star: DataFrame, classes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """(block, side, label, node, odd) of the buckets with classes of several components. Buckets
    of equal classes are taken once."""
    label = F.xxhash64(F.coalesce("root", "node"))
    labelled = star.join(roots, "node", "left").select("bucket", "node", label.alias("label"))
    mixed = written(_label_counts(labelled, "bucket").groupBy("n", "sum", "xor").agg(F.min(F.struct("bucket", "top", "top_n")).alias("b"))
                    .select("b.*", "n"), f"{name}-open")
    rows = labelled.join(mixed, "bucket").join(classes.select("node", "odd"), "node")
    return _in_blocks(rows, F.col("bucket"), CHUNK)


def _blocked(blocks: DataFrame, run, schema: str) -> DataFrame:
    return blocks.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, schema)


def linked_edges(docs: DataFrame, sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed edges (a, b) whose components are those of all pairs at the threshold."""
    most = most_differing_bits()
    bands = classes.select("node", F.explode("buckets").alias("bucket"))
    least = written(bands.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "odd-buckets")
    star = written(bands.join(least, "bucket"), "odd-star")
    often = star.where("node != least").groupBy("node", "least").agg(F.count("*").alias("times"))
    best = often.groupBy("node").agg(F.max(F.struct("times", "least")).alias("best"))
    edges = _confirm(docs, classes, _star_places(written(best.select(F.col("node").alias("a"), F.col("best.least").alias("hub")), "odd-pairs")), "odd-0")
    for n in range(1, ROUNDS + 1):
        roots = written(partial_roots(edges, f"odd-parts-{n}"), "odd-roots")
        found = _blocked(_open(star, classes, roots, f"odd-{n}"), _best_pairs(most), f"label bigint, differing bigint, a {NODE}, b {NODE}")
        pairs = written(found.groupBy("label").agg(F.min(F.struct("differing", "a", "b")).alias("best"))
                        .select(F.greatest("best.a", "best.b").alias("a"), F.least("best.a", "best.b").alias("hub")).distinct(), "odd-pairs")
        more = _confirm(docs, classes, _star_places(pairs), f"odd-{n}")
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(edges).unionAll(more)
    roots = written(partial_roots(edges, "odd-parts"), "odd-roots")
    left = written(_blocked(_open(star, classes, roots, "odd-left"), _passing_groups(most), f"a {NODE}, b {NODE}"), "odd-left")
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(edges)
    if left.isEmpty():
        return edges
    groups = written(components(left, "odd-groups").withColumnRenamed("root", "grp"), "odd-grouped")
    members = written(groups.join(roots, "node", "left").select("node", "grp", F.xxhash64(F.coalesce("root", "node")).alias("label")), "odd-members")
    sizes = written(_label_counts(members, "grp").drop("sum", "xor"), "odd-sizes")
    placed = _in_blocks(members.join(sizes, "grp"), F.col("grp"), CHUNK_SETS)
    return edges.unionAll(_confirm(docs, classes, placed, "odd-rest"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, digest, n_shingles and component_id."""
    sketch = written(sketches(docs), "odd-sketches")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = written(sketch.where("n_shingles > 0").groupBy("node").agg(
        F.min(place).alias("rep"), F.first("buckets").alias("buckets"), F.first("odd").alias("odd")), "odd-classes")
    roots = written(components(linked_edges(docs, sketch, classes), "odd-linked"), "odd-linked")
    reps = classes.select("node", "rep")
    first = written(roots.join(reps, "node").groupBy("root").agg(F.min("rep").alias("first")), "odd-first")
    named = written(roots.join(first, "root").select("node", "first"), "odd-named")
    per_class = written(reps.join(named, "node", "left").select("node", F.struct(F.coalesce("first", "rep").getField("doc_id").alias("id")).alias("component")),
                        "odd-per-class")
    rows = sketch.select("doc_id", "digest", "n_shingles", "node")
    full = rows.where("n_shingles > 0").join(per_class, "node").select("doc_id", "digest", "n_shingles", F.col("component.id").alias("component_id"))
    return full.unionAll(rows.where("n_shingles = 0").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
