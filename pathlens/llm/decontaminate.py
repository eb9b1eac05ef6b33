"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of the training texts: one row per shard (about 1 MB of text)
with its documents, its sorted terms and, term by term, the ascending word positions. ``search``
looks benchmark windows up in each shard: starting from the window's rarest term there, the
position lists, each moved back by its term's offset, are intersected until none is left or all
terms agree (an exact phrase); a window is a proximity match where all its terms stand less than
``within`` words from an occurrence of its first. Terms are 64-bit word hashes, so a false phrase
needs all of its terms to collide.

Nothing is dealt by term, so a frequent word or passage costs each shard in proportion to its own
text. Windows travel in blocks of at most about ``BLOCK_WINDOWS``; each block is one pass over
the stored index.

Defined cases: null or wordless texts have no words and no hits; very long texts are indexed whole,
in a shard of their own; null or wordless items have no
window; items of equal id are one item and a null item_id counts as an empty string; repeated
document rows each give a row; an empty table on either side gives no match; other columns of the
documents pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8, written
from .words import LETTERS, words

WINDOW = 10                     # words of an item's window
WITHIN = 20                     # words of a proximity match
BLOCK_WINDOWS = 1 << 17         # windows broadcast at once (about 10 MB)

INDEX_SCHEMA = ("shard string, doc_id array<bigint>, digest array<bigint>, n_words array<int>, "
                "term array<bigint>, n_positions array<int>, position array<int>")
FOUND_SCHEMA = ("shard string, doc int, doc_id bigint, digest bigint, n_words int, "
                "hits array<struct<start:int,end:int>>, items array<string>, near array<string>")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            w = words(data, offsets[a:b + 1], LETTERS)
            order = np.argsort(w.hash, kind="stable")
            terms, counts = np.unique(w.hash, return_counts=True)
            ids = batch.column("doc_id").slice(a, b - a)
            digests = batch.column("digest").slice(a, b - a)
            one = pa.array([0, b - a], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{made}"]), pa.ListArray.from_arrays(one, ids),
                 pa.ListArray.from_arrays(one, digests), _lists(np.diff(w.first), pa.int32()),
                 _lists(terms.view(np.int64), pa.int64()), _lists(counts, pa.int32()), _lists(order, pa.int32())],
                names=["shard", "doc_id", "digest", "n_words", "term", "n_positions", "position"])
            made += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The stored positional index of ``docs`` (doc_id, text); one pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    return written(rows.mapInArrow(_index_batches, INDEX_SCHEMA), "positional-index")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, n, terms): every ``window`` consecutive words of an item; a shorter item is one."""
    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for a, b in slices(offsets):
                w = words(data, offsets[a:b + 1], LETTERS)
                hashed = w.hash.view(np.int64)
                for i in range(b - a):
                    item = batch.column("item")[a + i].as_py()
                    terms = hashed[w.first[i]:w.first[i + 1]]
                    if len(terms):
                        out += [(item, n, terms[n:n + window].tolist()) for n in range(max(1, len(terms) - window + 1))]
            for k in range(0, len(out), 10_000):
                part = out[k:k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int32()),
                     pa.array([x[2] for x in part], pa.list_(pa.int64()))], names=["item", "n", "terms"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(cut, "item string, n int, terms array<bigint>")


def _held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, keys)
    return among[np.minimum(at, len(among) - 1)] == keys


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, begin + count), one range after the other."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """The union of half-open ranges as disjoint ascending ranges."""
    out: list[dict] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _search_shard(row: dict, block: tuple, within: int) -> tuple[dict, dict, dict]:
    """Per document ordinal: hit word ranges, items with an exact window, items with a near one.

    A posting is the number ``list * span + position``, so that the lists of all terms are one
    sorted array, and one search intersects the lists of all windows with their candidates.
    Positions leave a gap between documents that no phrase or stretch bridges.
    """
    item_of, vocabulary, at, lengths = block
    terms = row["term"].view(np.uint64)
    place = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
    held = terms[place] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
    column = np.arange(at.shape[1])
    possible = (held[at] | (column >= lengths[:, None])).all(axis=1)
    hits, items, near = {}, {}, {}
    if not possible.any():
        return hits, items, near
    window, n_terms = at[possible], lengths[possible]
    owner = [item_of[w] for w in np.flatnonzero(possible)]
    used, window = np.unique(np.where(column < n_terms[:, None], window, window[:, :1]), return_inverse=True)
    window = window.reshape(len(n_terms), -1)
    sizes = row["n_positions"][place[used]].astype(np.int64)
    begin = (np.cumsum(row["n_positions"]) - row["n_positions"])[place[used]]
    position = row["position"][_ranges(begin, sizes)].astype(np.int64)
    n_docs, gap = len(row["n_words"]), 2 * max(within, at.shape[1])
    first = np.concatenate([[0], np.cumsum(row["n_words"])[:-1]]) + gap * np.arange(1, n_docs + 1)
    position = position + gap * (1 + np.repeat(np.arange(n_docs), row["n_words"])[position])
    span = int(row["n_words"].sum()) + gap * (n_docs + 2)
    begin = np.cumsum(sizes) - sizes
    posting = np.repeat(np.arange(len(used)), sizes) * span + position

    order = np.argsort(np.where(column < n_terms[:, None], sizes[window], np.iinfo(np.int64).max), axis=1, kind="stable")
    rarest = window[np.arange(len(window)), order[:, 0]]
    of = np.repeat(np.arange(len(window)), sizes[rarest])
    rare_at = position[_ranges(begin[rarest], sizes[rarest])]

    w, start = of, rare_at - order[of, 0]
    for r in range(1, at.shape[1]):
        offset = order[w, r]
        agrees = (r >= n_terms[w]) | _held(window[w, offset] * span + start + offset, posting)
        w, start = w[agrees], start[agrees]
    doc = np.searchsorted(first, start, side="right") - 1
    for k, d, s in zip(w.tolist(), doc.tolist(), (start - first[doc]).tolist(), strict=True):
        hits.setdefault(d, []).append((s, s + int(n_terms[k])))
        items.setdefault(d, set()).add(owner[k])

    def all_close(w, centre, reach):
        """Which centres have every term of their window at most ``reach`` words away."""
        kept = np.arange(len(w))
        for r in range(at.shape[1]):
            term = window[w[kept], order[w[kept], r]] * span
            at_least = np.searchsorted(posting, term + centre[kept] - reach)
            close = posting[np.minimum(at_least, len(posting) - 1)]
            kept = kept[(r >= n_terms[w[kept]]) | ((at_least < len(posting)) & (close <= term + centre[kept] + reach))]
        return kept

    if within:
        reach = within - 1
        kept = all_close(of, rare_at, 2 * reach)
        w, centre = of[kept], rare_at[kept]
        lead = window[w, 0] * span
        low = np.searchsorted(posting, lead + centre - reach)
        count = np.searchsorted(posting, lead + centre + reach, side="right") - low
        w, centre = np.repeat(w, count), position[_ranges(low, count)]
        kept = all_close(w, centre, reach)
        doc = np.searchsorted(first, centre[kept], side="right") - 1
        for k, d in set(zip(w[kept].tolist(), doc.tolist(), strict=True)):
            near.setdefault(d, set()).add(owner[k])
    return hits, items, near


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int = WITHIN,
           block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per indexed document: doc_id, digest, n_words, hits (disjoint ranges of words that
    lie in an occurrence of a window), items (with exact windows) and near (with proximity
    matches), both sorted. ``within`` = 0 leaves proximity out."""
    spark = index.sparkSession
    windows = written(item_windows(items, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    found = []
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("item", "n"), F.lit(blocks)) == k).collect()
        lengths = np.array([len(r["terms"]) for r in rows], np.int64)
        matrix = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            matrix[i, :len(r["terms"])] = r["terms"]
        vocabulary, at = np.unique(matrix.view(np.uint64), return_inverse=True)
        block = spark.sparkContext.broadcast(([r["item"] for r in rows], vocabulary, at.reshape(matrix.shape), lengths))

        def look_up(batches, block=block):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                           for c in ("n_words", "term", "n_positions", "position")}
                    ids, digests = batch.column("doc_id")[i].values, batch.column("digest")[i].values
                    hits, items, near = _search_shard(row, block.value, within)
                    n, shard = len(ids), batch.column("shard")[i].as_py()
                    ranges = [[] if d not in hits else _merged(*np.array(hits[d]).T) for d in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * n), pa.array(np.arange(n), pa.int32()), ids, digests,
                         pa.array(row["n_words"], pa.int32()),
                         pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                         pa.array([sorted(near.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                        names=["shard", "doc", "doc_id", "digest", "n_words", "hits", "items", "near"])

        found.append(index.mapInArrow(look_up, FOUND_SCHEMA))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    together = lambda c: F.array_sort(F.flatten(F.collect_list(c)))  # noqa: E731  one entry per block
    return (out.groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"),
        together("hits").alias("hits"), F.array_distinct(together("items")).alias("items"),
        F.array_distinct(together("near")).alias("near")).drop("shard", "doc"))


def n_hit_words():
    """Words covered by ``hits``, whose ranges may overlap across blocks."""
    return F.expr("""aggregate(hits, named_struct('n', 0L, 'until', 0),
        (a, r) -> named_struct('n', a.n + greatest(0, r.end - greatest(r.start, a.until)),
                               'until', greatest(a.until, r.end)), a -> a.n)""")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, within: int = WITHIN) -> DataFrame:
    return search(build_index(docs), items, window, within).withColumn("n_hit", n_hit_words())


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs."""
    hit = written(contamination(docs, items, window, within=0).where("n_hit > 0")
                  .select(F.struct("doc_id", "digest").alias("hit")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("doc"))
    same = (F.col("doc.doc_id").cast("bigint").eqNullSafe(F.col("hit.doc_id"))
            & (F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))) == F.col("hit.digest")))
    return rows.join(hit, same, "left_anti").select("doc.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select coalesce(cast(item_id as varchar), '') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (
  select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from bw where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as phrase from bi),
di as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw cross join (select distinct n from win) where len(w) >= n),
hit as (
  select distinct di.doc_id, di.i, di.n, win.item
  from di join win on di.n = win.n and array_to_string(di.w[di.i:di.i + di.n - 1], ' ') = win.phrase),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(p.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(t.n_items, 0) as bigint) as n_items, sha256(coalesce(t.items, '')) as items_sha256,
       coalesce(p.n_hit, 0) > 0 as contaminated
from dw d left join pos p using (doc_id) left join its t using (doc_id)
"""
