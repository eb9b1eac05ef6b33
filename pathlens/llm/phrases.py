"""Phrase collocation mining by HAT-trie counting.

A task counts phrases in a shallow trie over the digits of word ids whose leaves are hash containers;
a container that grows too large bursts into one container per next digit (Askitis and Sinha, "HAT-trie:
a cache-conscious trie-based data structure for strings", 2007). When the trie is full, whole subtrees
are spilled as sorted runs, cut by prefix partition; the runs of a partition are merged in one task and
counts below ``least`` end there.

Counting goes level by level, so that only phrases whose parts are frequent are counted at all: no
part of a frequent phrase is rarer than the phrase, so nothing is lost. First the words; the frequent
ones get ids. Then pairs of frequent words; the frequent ones get ids. Then phrases of three and four
words all of whose pairs are frequent. Frequent words, pairs and triples are stored as sorted arrays in
the shared folder, which workers memory-map, so nothing that grows with the corpus is broadcast or sent
to the driver. A frequent first word's phrases are dealt over ``SPLIT`` prefix partitions.

Words are told apart by 64-bit hashes of their bytes and language while they are counted in pairs.

Defined cases: a null text counts as empty, a null lang as ``und``; an empty text or piece has no
words; very long texts are taken whole, in one slice; repeated rows count each; ties in the report go
by phrase, in UTF-8 byte order; an empty table, or one without frequent phrases, gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mounted, slices, table, utf8, written
from .words import LOWER, mix, words

LEAST = 30
MOST_CONTAINED = 80             # per cent
TOP = 2000
SPLIT = 16                      # prefix partitions of one first word (or pair)
DIGIT = 10                      # bits of a word id that one level of the trie takes
BURST = 1 << 15                 # phrases in a container before it bursts
MOST_PHRASES = 600_000          # phrases in a task's trie before it spills
MOST_WORDS = 400_000            # distinct words that a task holds before it hands them on
SLICE_BYTES = 2 << 20
MOST_IDS = 1 << 32
WIDE = 8                        # added to the kind of a run whose counts take 64 bits

# fixed values: pieces end at [.,;:!?\x0A-\x0D], words are [^\x20\x09]+
BETWEEN_PIECES = np.zeros(256, bool)
BETWEEN_PIECES[list(b".,;:!?\x0A\x0B\x0C\x0D")] = True
WORD = ~BETWEEN_PIECES
WORD[[0x20, 0x09]] = False

RUNS = "kind int, part int, keys binary, counts binary"


class Tokens(NamedTuple):
    """Words of a slice of texts."""
    hash: np.ndarray            # of word and language
    follows: np.ndarray         # whether the next word is in the same piece
    text: np.ndarray            # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    lang: list[str]             # per word's text
    doc: np.ndarray


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """Words of (lang, text) rows, in slices."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        of = {x: _lang_hash(x) for x in set(langs)}
        hashed = np.array([of[x] for x in langs], np.uint64)
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets, SLICE_BYTES):
            w = words(data, offsets[a:b + 1], WORD)
            text = LOWER[data[offsets[a]:offsets[b]]]
            piece = np.cumsum(BETWEEN_PIECES[text])[w.start]
            follows = np.zeros(len(w.hash), bool)
            follows[:-1] = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1])
            yield Tokens(mix(w.hash + hashed[a:b][w.doc]), follows, text, w.start, w.end, langs[a:b], w.doc)


# --- words -------------------------------------------------------------------------------------

def _strings(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    taken = text[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(taken)])


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their added counts; sorted runs are merged, not sorted anew."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's texts, and one row without word per lang for all its words."""
    held: list[tuple] = []
    totals: dict[str, int] = {}

    def handed_on():
        keys = np.concatenate([h[0] for h in held])
        own, at = np.unique(keys, return_index=True)
        _, n = _add_up(keys, np.concatenate([h[1] for h in held]))
        at = pa.array(at)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([h[2] for h in held]).take(at), pa.concat_arrays([h[3] for h in held]).take(at),
                                          pa.array(n)], names=["lang", "word", "n"])

    for t in tokens(batches):
        own, at, n = np.unique(t.hash, return_index=True, return_counts=True)
        for k, times in enumerate(np.bincount(t.doc, minlength=len(t.lang)).tolist()):
            totals[t.lang[k]] = totals.get(t.lang[k], 0) + times
        held.append((own, n, pa.array(t.lang, pa.string()).take(pa.array(t.doc[at])), _strings(t.text, t.start[at], t.end[at])))
        if sum(len(h[0]) for h in held) >= MOST_WORDS:
            yield from handed_on()
            held = []
    if held:
        yield from handed_on()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()),
                                      pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "n"])


# --- stored arrays ------------------------------------------------------------------------------

class Stored(NamedTuple):
    """A table of sorted keys in files, one per part; ids count through the parts."""
    folder: str
    name: str
    first: np.ndarray           # per part the id of its first key; one more entry at the end


def _path(folder: str, name: str, part: int) -> str:
    return f"{folder}/{name}-{part}.arrow"


def _save(folder: str, name: str, part: int, rows: pa.RecordBatch) -> None:
    """Whole or not at all, whichever attempt of the task ends first."""
    path = _path(folder, name, part)
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with pa.OSFile(own, "wb") as sink, pa.ipc.new_file(sink, rows.schema) as f:
        f.write_batch(rows)
    os.replace(own, path)


def _stored(folder: str, name: str, parts: int, sizes: list) -> Stored:
    n = np.zeros(parts + 1, np.int64)
    for r in sizes:
        n[r["part"] + 1] = r["n"]
    first = np.cumsum(n)
    if first[-1] >= MOST_IDS:
        raise ValueError(f"{first[-1]} {name} do not fit 32-bit ids")
    return Stored(folder, name, first)


_mapped: dict[str, pa.RecordBatch] = {}


def _part(stored: Stored, part: int) -> pa.RecordBatch:
    """A part's rows, mapped once per worker; a part that has keys must be there."""
    path = _path(stored.folder, stored.name, part)
    if path not in _mapped:
        _mapped[path] = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
    return _mapped[path]


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(parts):
        return
    order = np.argsort(parts, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(parts[order]) != 0]))
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        yield int(parts[order[a]]), order[a:b]


def look_up(stored: Stored, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Ids of ``keys``, -1 where a key is not stored."""
    out = np.full(len(keys), -1, np.int64)
    for part, own in _by_part(parts):
        if stored.first[part] == stored.first[part + 1]:
            continue
        there = _part(stored, part).column("key").to_numpy()
        at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
        out[own] = np.where(there[at] == keys[own], stored.first[part] + at, -1)
    return out


def values(stored: Stored, ids: np.ndarray, column: str) -> pa.Array:
    """A stored column at ``ids``."""
    order, taken = [], []
    for part, own in _by_part(np.searchsorted(stored.first, ids, side="right") - 1):
        order.append(own)
        taken.append(_part(stored, part).column(column).take(pa.array(ids[own] - stored.first[part])))
    if not taken:
        return pa.array([])
    back = np.empty(len(ids), np.int64)
    back[np.concatenate(order)] = np.arange(len(ids))
    return pa.concat_arrays(taken).take(pa.array(back))


def _word_part(hashed: np.ndarray, bits: int) -> np.ndarray:
    return (hashed >> np.uint64(64 - bits)).astype(np.int64)


def prefix_part(keys: np.ndarray, bits: int) -> np.ndarray:
    """The prefix partition of packed phrases: by the upper half, over ``SPLIT`` by the lower."""
    head, rest = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    return _word_part(mix(head * np.uint64(SPLIT) + rest % np.uint64(SPLIT) + np.uint64(1)), bits)


def _pack(head: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return head.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)


# --- the trie -----------------------------------------------------------------------------------

class HatTrie:
    """Counts of packed phrases. A node is a hash container (dict) or, once burst, an array of nodes
    by the next ``DIGIT`` bits of the first word's id, then of the rest's; the root is burst."""

    def __init__(self, burst: int = BURST):
        self.root: list = [{} for _ in range(1 << DIGIT)]
        self.size = np.zeros(1 << DIGIT, np.int64)
        self.burst = burst

    @staticmethod
    def _digit(keys: np.ndarray, depth: int) -> np.ndarray:
        """Digits of the upper half, the least first, then those of the lower half."""
        per_half = -(-32 // DIGIT)
        half = keys >> np.uint64(32) if depth < per_half else keys & np.uint64(0xFFFFFFFF)
        return (half >> np.uint64(DIGIT * (depth % per_half)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)

    def _add(self, node, depth: int, keys: np.ndarray, counts: np.ndarray):
        """The node with the counts added, and how many phrases are new in it."""
        if isinstance(node, list):
            new = 0
            for digit, own in _by_part(self._digit(keys, depth)):
                node[digit], more = self._add(node[digit] if node[digit] is not None else {}, depth + 1, keys[own], counts[own])
                new += more
            return node, new
        before, get = len(node), node.get
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            node[k] = get(k, 0) + n
        new = len(node) - before
        if len(node) > self.burst and depth < 2 * -(-32 // DIGIT):
            all_keys = np.fromiter(node.keys(), np.uint64, len(node))
            all_counts = np.fromiter(node.values(), np.int64, len(node))
            node = self._add([None] * (1 << DIGIT), depth, all_keys, all_counts)[0]
        return node, new

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        for digit, own in _by_part(self._digit(keys, 0)):
            self.root[digit], new = self._add(self.root[digit], 1, keys[own], counts[own])
            self.size[digit] += new

    def _phrases(self, node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if isinstance(node, list):
            for child in node:
                if child is not None:
                    yield from self._phrases(child)
        elif node:
            yield np.fromiter(node.keys(), np.uint64, len(node)), np.fromiter(node.values(), np.int64, len(node))

    def spill(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the largest subtrees below the root, whole, until ``left`` phrases are left."""
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for digit in np.argsort(-self.size, kind="stable").tolist():
            if self.size.sum() <= left or not self.size[digit]:
                break
            for k, n in self._phrases(self.root[digit]):
                keys.append(k)
                counts.append(n)
            self.root[digit], self.size[digit] = {}, 0
        return np.concatenate(keys), np.concatenate(counts)


def _runs(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of (keys, counts), a row per prefix partition."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    wide = len(counts) > 0 and counts.max() >= 1 << 32
    kind, counts = (kind + WIDE, counts) if wide else (kind, counts.astype(np.uint32))
    rows = [(kind, part, keys[own].tobytes(), counts[own].tobytes()) for part, own in _by_part(prefix_part(keys, bits))]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                         names=["kind", "part", "keys", "counts"])


def _count_phrases(keyed: Callable[[Tokens], dict[int, np.ndarray]], bits: int):
    """Tries of a task's phrases (by kind) to sorted runs."""
    def run(batches):
        tries: dict[int, HatTrie] = {}
        for t in tokens(batches):
            for kind, keys in keyed(t).items():
                trie = tries.setdefault(kind, HatTrie())
                trie.add(*np.unique(keys, return_counts=True))
            while sum(int(x.size.sum()) for x in tries.values()) > MOST_PHRASES:
                kind, largest = max(tries.items(), key=lambda x: int(x[1].size.sum()))
                yield from _runs(kind, *largest.spill(int(largest.size.sum()) // 2), bits)
        for kind, trie in tries.items():
            yield from _runs(kind, *trie.spill(0), bits)
    return run


def _merge_runs(folder: str, saved: dict[int, str], least: int):
    """The runs of a prefix partition to (kind, part, key, n) of its frequent phrases."""
    def merged(part: int, held: dict[int, list]):
        for kind, runs in sorted(held.items()):
            keys, counts = _add_up(np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs]))
            often = counts >= least
            keys, counts = keys[often], counts[often]
            if not len(keys):
                continue
            if kind in saved:
                _save(folder, saved[kind], part, pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"]))
            same = lambda x, k=len(keys): pa.array(np.full(k, x, np.int32))
            yield pa.RecordBatch.from_arrays([same(kind), same(part), pa.array(keys.view(np.int64)), pa.array(counts)],
                                             names=["kind", "part", "key", "n"])

    def run(batches):
        part, held = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if part is not None and r["part"] != part:
                    yield from merged(part, held)
                    held = {}
                part = r["part"]
                counts = np.frombuffer(r["counts"], np.int64 if r["kind"] >= WIDE else np.uint32).astype(np.int64)
                held.setdefault(r["kind"] % WIDE, []).append((np.frombuffer(r["keys"], np.uint64), counts))
        if part is not None:
            yield from merged(part, held)
    return run


# --- the levels -----------------------------------------------------------------------------------

def _store_words(folder: str, bits: int):
    """Words of a part, sorted by hash, to its file; (part, n)."""
    def run(batches):
        part, held = None, []

        def saved():
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column("key").to_numpy().view(np.uint64)
            order = pa.array(np.argsort(key, kind="stable"))
            columns = [pa.array(key), *[rows.column(c).combine_chunks() for c in ("n", "lang", "word")]]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            _save(folder, "words", part, pa.RecordBatch.from_arrays([c.take(order) for c in columns], names=["key", "n", "lang", "word"]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(rows)], pa.int64())], names=["part", "n"])

        for batch in batches:
            for own_part, own in _by_part(batch.column("part").to_numpy()):
                if part is not None and own_part != part:
                    yield saved()
                    held = []
                part = own_part
                held.append(batch.take(pa.array(own)))
        if held:
            yield saved()
    return run


def _hashed_words(bits: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("word"))
            langs = batch.column("lang").to_pylist()
            of = {x: _lang_hash(x) for x in set(langs)}
            w = words(data, offsets, WORD)          # every row is one word
            key = mix(w.hash + np.array([of[x] for x in langs], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_word_part(key, bits).astype(np.int32)), pa.array(key.view(np.int64)),
                                              *[batch.column(c) for c in ("n", "lang", "word")]], names=["part", "key", "n", "lang", "word"])
    return run


def _word_ids(t: Tokens, of_words: Stored, bits: int) -> np.ndarray:
    own, of = np.unique(t.hash, return_inverse=True)
    return look_up(of_words, own, _word_part(own, bits))[of]


def _pairs(t: Tokens, of_words: Stored, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, where a pair of frequent words begins, packed pairs there)."""
    ids = _word_ids(t, of_words, bits)
    at = np.flatnonzero(t.follows & (ids >= 0))
    at = at[ids[at + 1] >= 0]
    return ids, at, _pack(ids[at], ids[at + 1])


def _longer(t: Tokens, of_words: Stored, of_pairs: Stored, bits: int) -> dict[int, np.ndarray]:
    """Packed phrases of three words (pair, word) and four (pair, pair) all of whose pairs are frequent."""
    ids, at, packed = _pairs(t, of_words, bits)
    own, of = np.unique(packed, return_inverse=True)
    pair = np.full(len(ids) + 2, -1, np.int64)
    pair[at] = look_up(of_pairs, own, prefix_part(own, bits))[of]
    three = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0))
    four = three[pair[three + 2] >= 0]
    return {3: _pack(pair[three], ids[three + 2]), 4: _pack(pair[four], pair[four + 2])}


def _candidates(of_words: Stored, of_pairs: Stored, of_triples: Stored, bits: int):
    """(kind, key, n) to (lang, phrase, n_words, a, l, r, score)."""
    def pair_words(ids):
        key = values(of_pairs, ids, "key").to_numpy()
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def found(stored, key):
        return look_up(stored, key, prefix_part(key, bits))

    def count(stored, ids):
        return values(stored, ids, "n").to_numpy()

    def run(batches):
        for batch in batches:
            kinds, keys = batch.column("kind").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for kind, own in _by_part(kinds):
                key, a = keys[own], batch.column("n").to_numpy()[own]
                head, rest = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                if kind == 2:
                    ids = [head, rest]
                    cuts = [count(of_words, head) + count(of_words, rest)]
                    left = [count(of_words, head)]
                elif kind == 3:
                    ids = [*pair_words(head), rest]
                    left = [count(of_words, ids[0]), count(of_pairs, head)]
                    cuts = [left[0] + count(of_pairs, found(of_pairs, _pack(ids[1], ids[2]))), left[1] + count(of_words, rest)]
                else:
                    ids = [*pair_words(head), *pair_words(rest)]
                    middle = found(of_pairs, _pack(ids[1], ids[2]))
                    left = [count(of_words, ids[0]), count(of_pairs, head), count(of_triples, found(of_triples, _pack(head, ids[2])))]
                    cuts = [left[0] + count(of_triples, found(of_triples, _pack(middle, ids[3]))),
                            left[1] + count(of_pairs, rest), left[2] + count(of_words, ids[3])]
                # Python integers: the products may pass 64 bits
                scores = [2_000_000 * a.astype(object) // c.astype(object) for c in cuts]
                lowest = np.argmin(np.stack(scores).astype(np.int64), axis=0)        # the first of equal ones
                pick = lambda columns, k=lowest: np.stack(columns)[k, np.arange(len(k))].astype(np.int64)
                left, both = pick(left), pick(cuts)
                spelled = [values(of_words, x, "word").to_pylist() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [values(of_words, ids[0], "lang"), pa.array([" ".join(x) for x in zip(*spelled, strict=True)], pa.string()),
                     pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(left), pa.array(both - left), pa.array(pick(scores))],
                    names=["lang", "phrase", "n_words", "a", "l", "r", "score"])
    return run


def mine(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, phrase, n_words, a, l, r, score), and (lang, n) with all words counted.

    ``spark.checkpoint.dir`` has to be a mounted folder: workers map the stored arrays."""
    spark = docs.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    parts, folder = 1 << bits, mounted(spark, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = written(texts.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
                      .where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    frequent = counted.where("word is not null").mapInArrow(_hashed_words(bits), "part int, key bigint, n bigint, lang string, word string")
    of_words = _stored(folder, "words", parts, frequent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        _store_words(folder, bits), "part int, n bigint").collect())        # one row per part

    def level(keyed, saved: dict[int, str], name: str) -> DataFrame:
        runs = texts.mapInArrow(_count_phrases(keyed, bits), RUNS)
        return written(runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
            _merge_runs(folder, saved, least), "kind int, part int, key bigint, n bigint"), name)

    def stored(rows: DataFrame, kind: int, name: str) -> Stored:
        return _stored(folder, name, parts, rows.where(F.col("kind") == kind).groupBy("part").agg(F.count("*").alias("n")).collect())

    pairs = level(lambda t: {2: _pairs(t, of_words, bits)[2]}, {2: "pairs"}, "phrase-pairs")
    of_pairs = stored(pairs, 2, "pairs")
    longer = level(lambda t: _longer(t, of_words, of_pairs, bits), {3: "triples"}, "phrase-longer")
    of_triples = stored(longer, 3, "triples")
    found = pairs.unionAll(longer).select("kind", "key", "n").mapInArrow(
        _candidates(of_words, of_pairs, of_triples, bits),
        "lang string, phrase string, n_words int, a bigint, l bigint, r bigint, score bigint")
    return written(found, "phrase-candidates"), counted.where("word is null").select("lang", "n")


def not_contained(candidates: DataFrame, share: int = MOST_CONTAINED) -> DataFrame:
    """Candidates whose words lie in no longer candidate with ``share`` per cent of their count."""
    size = F.col("n_words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longest = written(candidates.where("n_words > 2").withColumn("words", F.split("phrase", " "))
                      .select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest")), "phrase-inner")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    joined = candidates.join(longest, ["lang", "phrase"], "left")
    return joined.where(F.col("longest").isNull() | (100 * wide("longest") < share * wide("a"))).drop("longest")


def top(candidates: DataFrame, by: list[Column], most: int, deals: int = 64) -> DataFrame:
    """The first ``most`` of each lang with their rank. A lang is dealt over ``deals`` tasks, of which
    each hands on ``most`` rows at most."""
    deal = F.pmod(F.xxhash64("phrase"), F.lit(deals))
    dealt = candidates.withColumn("deal", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*by)))
    few = dealt.where(F.col("rank") <= most).drop("deal", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, share: int = MOST_CONTAINED, most: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``most`` phrases."""
    candidates, totals = mine(docs, least)
    ranked = top(not_contained(candidates, share), [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents where text is not null),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from t),
q as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
w as (select lang, id, unnest(words) as w1, unnest(range(len(words))) as pos from q),
totals as (select lang, count(*) as n from w group by lang),
x as (
  select lang, w1, lead(w1, 1) over piece as w2, lead(w1, 2) over piece as w3, lead(w1, 3) over piece as w4
  from w window piece as (partition by id order by pos)),
g as (
  select lang, 1 as size, w1 as phrase from x
  union all select lang, 2, w1 || ' ' || w2 from x where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from x where w3 is not null
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from x where w4 is not null),
f as (select lang, size, phrase, count(*) as f from g group by all having count(*) >= 30),
c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as words from f where size > 1),
cuts as (
  select c.lang, c.phrase, c.size, c.a, k, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f + r.f) as score
  from c join (values (1), (2), (3)) as s(k) on k < c.size
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.words[k + 1:], ' ')),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, a, array_to_string(words[i:i + m - 1], ' ') as phrase
  from (select lang, a, words, m, unnest(range(1, size - m + 2)) as i from c join (values (2), (3)) as s(m) on m < size)),
longest as (select lang, phrase, max(a) as a from inside group by all),
kept as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
  from scored s left join longest x on x.lang = s.lang and x.phrase = s.phrase where x.a is null or 100::hugeint * x.a < 80::hugeint * s.a)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from kept join totals using (lang) where rank <= 2000
"""
