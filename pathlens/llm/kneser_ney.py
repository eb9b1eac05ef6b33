"""Language-model scoring by an interpolated modified Kneser-Ney model of order 2 (or 3).

Counting is one Spark job: tokens become 64-bit hashes, each task adds up the pairs (history,
word) of a few million tokens, and the sums are dealt to shards by history. A history so frequent
that it could fill a shard is dealt by pair instead. Each shard merges its pairs, derives the
history's totals, and hands on to the level below: at order 3 the pairs of the history's last word
with the number of words before them, then the number of histories and occurrences of each word. Every shard is stored as sorted hash arrays in the shared folder; scoring is a map over the
documents whose workers memory-map the arrays and look sorted queries up.

P(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) * P'(w), with three discounts from counts of counts,
g(h) the mass they free, P' the level below: the same over the number of distinct words before (at
a text's begin, where none is before, over occurrences), at last of w alone (Chen and Goodman, "An empirical study of smoothing techniques", 1999), down to a uniform share for an
unknown word. An unseen history leaves P1.

Defined cases: a null text counts as empty; an empty text is the end token alone; a null doc_id
is in the held-out fold like an empty string; repeated rows count and score each; without training
rows every token has probability 1; very long texts are counted and scored whole; other columns pass
through ``with_scores``. A model file that a worker cannot see raises.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mounted, slices, table, utf8
from .quality import fold
from .words import NON_SPACE, mix, words

BEGIN, END = np.uint64(0x5BD1E995A1B2C3D4), np.uint64(0xC2B2AE3D27D4EB4F)
GROUP_TOKENS = 2_000_000        # tokens whose pairs a task adds up before dealing them
SLICE_BYTES = 2 << 20
BASE_PRIOR = 0.1

PACKED = "kind string, shard int, keys binary, runs binary, words binary, counts binary, suffixes binary, times binary"
COLUMNS = ["kind", "shard", "keys", "runs", "words", "counts", "suffixes", "times"]


def pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(0x9FB21C651E98DF25) + word)


def sequences(data: np.ndarray, offsets: np.ndarray, order: int = 2) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Tokens of a slice's texts (each text's words, then the end), their histories of 1 to
    ``order`` - 1 words, and where each text's tokens begin."""
    w = words(data, offsets, NON_SPACE)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    token = np.empty(len(w.hash) + n, np.uint64)
    token[first[1:] - 1] = END
    body = np.ones(len(token), bool)
    body[first[1:] - 1] = False
    token[body] = w.hash
    history = np.empty(len(token), np.uint64)
    history[1:] = token[:-1]
    history[first[:-1]] = BEGIN
    histories = [history]
    if order == 3:
        before = np.empty(len(token), np.uint64)
        before[1:] = history[:-1]
        before[first[:-1]] = BEGIN
        histories.append(pair_key(before, history))
    return token, histories, first


def _add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values])


def _smallest(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if values.size else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def pair_shard(history: np.ndarray, key: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each pair: by history, by pair for the ``hot`` histories (sorted)."""
    return _shard_of(np.where(_is_in(history, hot), key, history), bits)


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _row(kind, shard, keys=b"", runs=b"", word=b"", counts=b"", suffixes=b"", times=b""):
    return kind, int(shard), *(x if isinstance(x, bytes) else x.tobytes() for x in (keys, runs, word, counts, suffixes, times))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)


def _token_groups(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    tokens, histories, held = [], [], 0
    together = lambda: (np.concatenate(tokens), [np.concatenate(h) for h in zip(*histories, strict=True)])
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for a, b in slices(offsets, SLICE_BYTES):
            token, history, _ = sequences(data, offsets[a:b + 1], order)
            tokens.append(token)
            histories.append(history)
            held += len(token)
            if held >= GROUP_TOKENS:
                yield together()
                tokens, histories, held = [], [], 0
    if held:
        yield together()


def frequent_histories(texts: DataFrame, shards: int, order: int = 2) -> list[np.ndarray]:
    """Per length, histories with at least 1/(4 shards) of all tokens in the groups where they have
    such a share; 4 * shards at most. Every history with twice that share overall is among them."""
    def run(batches):
        for _, histories in _token_groups(batches, order):
            for level, history in enumerate(histories):
                h, n = np.unique(history, return_counts=True)
                often = n >= len(history) / (4 * shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(often.sum() + 1, level, np.int32)), pa.array(np.append(h[often], np.uint64(0)).view(np.int64)),
                     pa.array(np.append(n[often], len(history)).astype(np.int64)),
                     pa.array(np.append(np.zeros(often.sum(), bool), True))], names=["level", "h", "n", "total"])

    got = (texts.mapInArrow(run, "level int, h bigint, n bigint, total boolean").groupBy("total", "level", "h").agg(F.sum("n").alias("n")))
    everything = got.where("total and level = 0").agg(F.sum("n")).scalar()
    rows = got.where(~F.col("total") & (F.col("n") * (4 * shards) >= everything)).select("level", "h").collect()
    return [np.sort(np.array([r["h"] for r in rows if r["level"] == k], np.int64).view(np.uint64)) for k in range(order - 1)]


def _dealt(level: int, h, w, n, times, suffix, hot: np.ndarray, bits: int) -> list[tuple]:
    """Rows of the distinct pairs (h, w), one per shard."""
    shard = pair_shard(h, pair_key(h, w), hot, bits)
    order = np.lexsort((h, shard))
    h, w, n, shard = h[order], w[order], n[order], shard[order]
    times = None if times is None else times[order]
    suffix = None if suffix is None else suffix[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
        own, at, runs = np.unique(h[a:b], return_index=True, return_counts=True)
        rows.append(_row(f"grams {level}", shard[a], own, runs.astype(np.uint32), w[a:b], n[a:b].astype(np.uint32),
                         b"" if suffix is None else suffix[a:b][at], b"" if times is None else times[a:b].astype(np.uint32)))
    return rows


def _count_pairs(bits: int, hot: list[np.ndarray], order: int):
    def run(batches):
        for word, histories in _token_groups(batches, order):
            _, at, n = np.unique(pair_key(histories[-1], word), return_index=True, return_counts=True)
            suffix = histories[-2][at] if order > 2 else None
            yield _batch(_dealt(order, histories[-1][at], word[at], n, None, suffix, hot[-1], bits))
    return run


def _by_shard(batches) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows of one shard, which come sorted."""
    shard, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != shard:
                yield shard, held
                held = []
            shard = row["shard"]
            held.append(row)
    if held:
        yield shard, held


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, whichever attempt of the task ends first."""
    path = f"{folder}/{name}.npy"
    part = f"{path}.{TaskContext.get().taskAttemptId()}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in range(1, 5)], np.int64)


def _merge_pairs(folder: str, bits: int, hot: list[np.ndarray], level: int):
    """A shard's pairs of histories of ``level`` - 1 words to its arrays; on to the level below, with
    the histories of hot ones. Rows of other kinds pass."""
    def merged(shard, rows):
        values = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
        runs = values("runs", np.uint32)
        spread = lambda c: np.concatenate([np.repeat(x, k) for x, k in zip(values(c, np.uint64), runs, strict=True)])
        h, w, n = spread("keys"), np.concatenate(values("words", np.uint64)), np.concatenate(values("counts", np.uint32)).astype(np.int64)
        lower = level > 2
        suffix = spread("suffixes") if lower else None
        times = np.concatenate(values("times", np.uint32)).astype(np.int64) if rows[0]["times"] else None
        key = pair_key(h, w)
        order = np.argsort(key, kind="stable")
        key, h, w, n = key[order], h[order], w[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, first)
        times = n if times is None else np.add.reduceat(times[order], first)
        suffix = suffix[order][first] if lower else None
        key, h, w = key[first], h[first], w[first]
        _save(folder, f"pairs{level}-{shard}", key)
        _save(folder, f"pairs{level}-n-{shard}", _smallest(n))
        own, total, n1, n2, n3 = _add_up(h, n, *[(n == k).astype(np.int64) for k in (1, 2)], (n > 2).astype(np.int64))
        stats = np.stack([total, n1, n2, n3])
        shared = _is_in(own, hot[level - 2])
        _save(folder, f"histories{level}-{shard}", own[~shared])
        _save(folder, f"histories{level}-n-{shard}", _smallest(stats[:, ~shared]))
        out = [_row(f"pair counts {level}", 0, counts=_counts_of_counts(n)), _row(f"stored {level}", 0, counts=np.array([shard]))]
        if shared.any():
            out.append(_row(f"hot {level}", 0, keys=own[shared], counts=np.ascontiguousarray(stats[:, shared])))
        if lower:
            below = pair_key(suffix, w)
            _, at = np.unique(below, return_index=True)
            _, before, occurrences = _add_up(below, np.ones(len(w), np.int64), times)
            seen = np.where(suffix[at] == BEGIN, occurrences, before)
            return out + _dealt(level - 1, suffix[at], w[at], seen, occurrences, None, hot[level - 3], bits)
        word, histories, occurrences = _add_up(w, np.ones(len(w), np.int64), times)
        to = _shard_of(word, bits)
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(to)), strict=True):
            out.append(_row("words", to[a], keys=word[a:b], runs=histories[a:b].astype(np.uint32), counts=occurrences[a:b]))
        return out

    def run(batches):
        for shard, rows in _by_shard(batches):
            out = [tuple(r[c] for c in COLUMNS) for r in rows if r["kind"] != f"grams {level}"]
            rows = [r for r in rows if r["kind"] == f"grams {level}"]
            yield _batch(out + (merged(shard, rows) if rows else []))
    return run


def _merge_words(folder: str):
    """A shard's words to its arrays; one small row for the model's totals."""
    def run(batches):
        for shard, rows in _by_shard(batches):
            out = [tuple(r[c] for c in COLUMNS) for r in rows if r["kind"] != "words"]
            rows = [r for r in rows if r["kind"] == "words"]
            if rows:
                word, histories, times = _add_up(
                    np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]),
                    np.concatenate([np.frombuffer(r["runs"], np.uint32) for r in rows]).astype(np.int64),
                    np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]))
                _save(folder, f"words-{shard}", word)
                _save(folder, f"words-n-{shard}", _smallest(np.stack([histories, times])))
                out.append(_row("stored words", 0, counts=np.array([shard])))
                out.append(_row("word counts", 0, counts=np.concatenate(
                    [_counts_of_counts(histories), [len(word), histories.sum(), times.sum(), (histories > 2).sum()]]).astype(np.int64)))
            yield _batch(out)
    return run


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more; 1/2, 1 and 3/2 where the counts of counts have gaps."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *[min(max(x, 0.0), k + 1.0) for k, x in enumerate(d)]])


class Level(NamedTuple):
    """Pairs with histories of one length."""
    hot: np.ndarray             # at most 4 * 2**bits histories and their totals
    hot_totals: np.ndarray
    discounts: np.ndarray


class Model(NamedTuple):
    """What the driver holds of the model; the arrays are files in ``folder``."""
    folder: str
    bits: int
    levels: list[Level]         # order 2 and up
    word_discounts: np.ndarray
    n_words: int                # V
    n_tokens: int               # N
    n_pairs: int                # distinct, of order 2
    unknown: float              # P1 of an unknown word
    shards: dict                # per table, the shards that have files

    @property
    def order(self) -> int:
        return len(self.levels) + 1

    @property
    def hot(self) -> np.ndarray:
        return self.levels[-1].hot


def train(docs: DataFrame, order: int = 2) -> Model:
    """Counts the texts of ``docs`` and stores the model below the shared checkpoint folder,
    which has to be a mounted one: workers map the files."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    folder = mounted(spark, "kneser-ney")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    hot = frequent_histories(texts, 1 << bits, order)
    rows = texts.mapInArrow(_count_pairs(bits, hot, order), PACKED)
    for level in range(order, 1, -1):
        rows = rows.repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(_merge_pairs(folder, bits, hot, level), PACKED)
    rows = (rows.repartition(1 << bits, "shard").sortWithinPartitions("shard")
            .mapInArrow(_merge_words(folder), PACKED).collect())    # a few numbers per shard
    numbers = lambda kind, size: np.sum([np.frombuffer(r["counts"], np.int64) for r in rows if r["kind"] == kind]
                                        or [np.zeros(size, np.int64)], axis=0)
    levels, stored = [], {}
    for level in range(2, order + 1):
        hot_rows = [r for r in rows if r["kind"] == f"hot {level}"]
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in hot_rows] or [np.zeros(0, np.uint64)])
        totals = np.concatenate([np.frombuffer(r["counts"], np.int64).reshape(4, -1) for r in hot_rows] or [np.zeros((4, 0), np.int64)], axis=1)
        added = _add_up(keys, *totals)
        levels.append(Level(added[0], np.stack(added[1:]), discounts(numbers(f"pair counts {level}", 4))))
        stored[f"pairs{level}"] = stored[f"histories{level}"] = _shards(rows, f"stored {level}")
    of_words = numbers("word counts", 8)
    n_words, n_pairs, n_tokens, more = (int(x) for x in of_words[4:])
    d = discounts(of_words[:4])
    freed = d[1] * of_words[0] + d[2] * of_words[1] + d[3] * more
    unknown = freed / n_pairs / (n_words + 1) if n_pairs else 1.0
    return Model(folder, bits, levels, d, n_words, n_tokens, n_pairs, unknown, stored | {"words": _shards(rows, "stored words")})


def _shards(rows: list, kind: str) -> frozenset:
    return frozenset(int(np.frombuffer(r["counts"], np.int64)[0]) for r in rows if r["kind"] == kind)


_mapped: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _arrays(model: Model, table_name: str, shard: int):
    """A shard's keys and values, mapped once per worker; a stored shard that is not there raises."""
    path = f"{model.folder}/{table_name}-{shard}.npy"
    if path not in _mapped:
        values = f"{model.folder}/{table_name}-n-{shard}.npy"
        _mapped[path] = np.load(path, mmap_mode="r"), np.load(values, mmap_mode="r")
    return _mapped[path]


def look_up(model: Model, table_name: str, keys: np.ndarray, shards: np.ndarray, width: int) -> np.ndarray:
    """Values of ``keys`` (``width`` rows), 0 where a key is not stored."""
    out = np.zeros((width, len(keys)), np.int64)
    order = np.lexsort((keys, shards))
    cut = np.flatnonzero(np.concatenate([[True], np.diff(shards[order]) != 0])) if len(keys) else []
    for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
        shard = int(shards[order[a]])
        if shard not in model.shards[table_name]:
            continue
        stored = _arrays(model, table_name, shard)
        if not len(stored[0]):
            continue
        own = order[a:b]
        at = np.minimum(np.searchsorted(stored[0], keys[own]), len(stored[0]) - 1)
        there = stored[0][at] == keys[own]
        out[:, own[there]] = np.atleast_2d(stored[1])[:, at[there]]
    return out


def score_slice(model: Model, token: np.ndarray, histories: list[np.ndarray], first: np.ndarray):
    """Per text: tokens, known tokens, base score and model score (log10)."""
    word, of = np.unique(token, return_inverse=True)
    befores, times = look_up(model, "words", word, _shard_of(word, model.bits), 2)
    base = np.log10((times + BASE_PRIOR) / (model.n_tokens + BASE_PRIOR * (model.n_words + 1)))
    lowest = np.maximum(0, befores - model.word_discounts[np.minimum(befores, 3)]) / max(1, model.n_pairs) + model.unknown
    p = lowest[of]
    for order, (level, history) in enumerate(zip(model.levels, histories, strict=True), 2):
        key, at, of_pair = np.unique(pair_key(history, token), return_index=True, return_inverse=True)
        h = history[at]
        count = look_up(model, f"pairs{order}", key, pair_shard(h, key, level.hot, model.bits), 1)[0]
        own, of_own = np.unique(h, return_inverse=True)
        stats = look_up(model, f"histories{order}", own, _shard_of(own, model.bits), 4)
        hot = _is_in(own, level.hot)
        stats[:, hot] = level.hot_totals[:, np.searchsorted(level.hot, own[hot])]
        d = level.discounts
        total = np.maximum(1, stats[0])
        freed = np.where(stats[0] > 0, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]) / total, 1.0)
        higher = np.maximum(0, count - d[np.minimum(count, 3)]) / total[of_own]
        p = (higher + freed[of_own] * p[at])[of_pair]
    score = np.log10(p)
    add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
    return np.diff(first), add((times[of] > 0).astype(np.int64)), add(base[of]), add(score)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, plus n_tokens, n_known, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in docs.columns if c not in ("text", *added)]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            parts = [score_slice(shared.value, *sequences(data, offsets[a:b + 1], shared.value.order)) for a, b in slices(offsets, SLICE_BYTES)]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(
                    columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]], names=[*kept, *added])

    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])
    return docs.select(*kept, "text").mapInArrow(run, schema)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    model = train(docs.where("not held_out"))
    return with_scores(docs, model).select("doc_id", "held_out", "n_tokens", "n_known",
                                           F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
