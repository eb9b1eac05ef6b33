"""Substring dedup by hashing units of lines.

Units are the clauses of lines: a text is cut after every newline and after sentence and clause marks
that white space follows, so a passage that begins or ends inside a line still consists of whole units
but for its ends. A unit is normalised (A-Z lower-cased, white space to single spaces, trimmed) and its
128-bit digest grouped over all texts; the occurrence that ranks first (by doc_id, null last, then
place) stays. Later occurrences go

* in stretches: consecutive later occurrences of ``min_words`` words or more together (parts without
  words do not break a stretch), so a passage goes with its short clauses, while a short clause that
  recurs by chance stays;
* as frequent lines: a shorter whole line goes wherever it occurs again if its count over all texts is
  ``FREQUENT`` or more and, where it has fewer than ``FREQUENT_WORDS`` words, also one per
  ``FREQUENT_TEXTS`` texts.

A removed unit takes the white space (and the newline) behind it along. Offsets are code points of the
original text.

Defined cases: a null text has no units and stays null; an empty or blank text stays as it is; very
long texts are taken whole; a text whose units all go becomes empty or blank; of rows equal in doc_id
and text any one ranks first, and all units of the others are later occurrences; columns beside doc_id
and text pass through ``drop_repeated``.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, utf8, written
from .words import NON_SPACE, mix, run_hashes, words

MIN_WORDS = 15
FREQUENT = 10
FREQUENT_WORDS = 3
FREQUENT_TEXTS = 1000
GROUP_UNITS = 400_000           # units whose first occurrences a task finds before it deals them
SLICE_BYTES = 2 << 20

# fixed values: a unit ends behind each of these, and is made of these words
CUT = re.compile(r"\n|[.!?,;:]+[ \t]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = np.zeros(256, bool)
MARKS[list(b".!?,;:")] = True

RUNS = "part int, docs binary, entries binary"
ENTRY = np.dtype([("hash1", np.uint64), ("hash2", np.uint64), ("doc", np.uint32), ("unit", np.uint32)])
DOC = np.dtype([("no_id", np.bool_), ("doc_id", np.int64), ("digest", np.int64)])


class Units(NamedTuple):
    """Units of a slice's texts, or their lines."""
    hash1: np.ndarray
    hash2: np.ndarray
    n_words: np.ndarray
    doc: np.ndarray
    number: np.ndarray          # among the units (lines) of its text


def _grouped(hashed: np.ndarray, doc: np.ndarray, group: np.ndarray) -> Units:
    """Consecutive words of one ``group`` and text as one unit; groups without words have none."""
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])])) if len(hashed) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(hashed)) if len(first) else first
    own = doc[first]
    begin = np.searchsorted(own, own)
    return Units(run_hashes(hashed, first, end), run_hashes(mix(hashed + np.uint64(1)), first, end), end - first, own, np.arange(len(first)) - begin)


def units_and_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Units, Units]:
    w = words(data, offsets, NON_SPACE)
    text = data[offsets[0]:offsets[-1]]
    newline = text == 0x0A
    blank = (text == 0x20) | (text == 0x09)
    # behind the last of the blanks that follow a mark; blanks of another text follow none
    after = np.zeros(len(text), bool)
    after[1:] = MARKS[text[:-1]]
    edges = offsets[1:-1] - offsets[0]
    after[edges[edges < len(text)]] = False
    run = np.maximum.accumulate(np.where(blank, -1, np.arange(len(text))))      # the last byte before a run of blanks
    cut = newline.copy()
    at = np.flatnonzero(blank & ~np.append(blank[1:], False))
    cut[at] = after[np.minimum(run[at] + 1, len(text) - 1)]
    before = lambda flags: np.concatenate([[0], np.cumsum(flags)])[w.start]
    return _grouped(w.hash, w.doc, before(cut)), _grouped(w.hash, w.doc, before(newline))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the text, text) of the rows with a text."""
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")


def _texts(batches: Iterator[pa.RecordBatch]):
    """(docs of a slice, data, offsets) of the batches."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        docs = np.zeros(len(batch), DOC)
        docs["no_id"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        docs["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy()
        docs["digest"] = batch.column("digest").to_numpy()
        for a, b in slices(offsets, SLICE_BYTES):
            yield docs[a:b], data, offsets[a:b + 1]


def _ranks(docs: np.ndarray) -> np.ndarray:
    """The rank of each of ``docs``; equal ones rank alike."""
    order = np.lexsort((docs["digest"], docs["doc_id"], docs["no_id"]))
    ordered = docs[order]
    new = np.zeros(len(docs), np.int64)
    for field in DOC.names:
        new[1:] |= ordered[field][1:] != ordered[field][:-1]
    ranks = np.empty(len(docs), np.uint64)
    ranks[order] = np.cumsum(new)
    return ranks


def _later(docs: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries have an equal one that ranks before; equal places rank alike."""
    later = np.zeros(len(entries), bool)
    order = np.argsort(entries["hash1"], kind="stable")
    h = entries["hash1"][order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    same[:-1] |= same[1:]
    many = order[same]
    if not len(many):
        return later
    place = _ranks(docs)[entries["doc"][many]] << np.uint64(32) | entries["unit"][many]
    order = np.lexsort((place, entries["hash2"][many], entries["hash1"][many]))
    many, place = many[order], place[order]
    new = np.concatenate([[True], (entries["hash1"][many][1:] != entries["hash1"][many][:-1])
                          | (entries["hash2"][many][1:] != entries["hash2"][many][:-1])])
    first = place[np.flatnonzero(new)][np.cumsum(new) - 1]
    later[many] = place != first
    return later


def _row(part: int, docs: np.ndarray, entries: np.ndarray) -> tuple[int, bytes, bytes]:
    """Entries with those of ``docs`` that they name."""
    named, of = np.unique(entries["doc"], return_inverse=True)
    entries = entries.copy()
    entries["doc"] = of
    return part, docs[named].tobytes(), entries.tobytes()


def _batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["part", "docs", "entries"])


def _first_runs(bits: int):
    """Texts to entries by part of the digest: the first of equal units that a task holds. The others
    are later occurrences for certain and go to part -1, so a frequent unit is never gathered."""
    def dealt(docs, held):
        entries = np.concatenate(held)
        docs = np.concatenate(docs)
        later = _later(docs, entries)
        rows = [_row(-1, docs, entries[later])] if later.any() else []
        entries = entries[~later]
        part = (entries["hash1"] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            rows.append(_row(int(part[order[a]]), docs, entries[order[a:b]]))
        return _batch(rows)

    def run(batches):
        docs, held, n, units = [], [], 0, 0
        for own, data, offsets in _texts(batches):
            found, _ = units_and_lines(data, offsets)
            entries = np.empty(len(found.doc), ENTRY)
            entries["hash1"], entries["hash2"], entries["doc"], entries["unit"] = found.hash1, found.hash2, found.doc + n, found.number
            docs.append(own)
            held.append(entries)
            n, units = n + len(own), units + len(entries)
            if units >= GROUP_UNITS:
                yield dealt(docs, held)
                docs, held, n, units = [], [], 0, 0
        if units:
            yield dealt(docs, held)
    return run


def _later_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to (doc_id, digest, units): later occurrences, a row per text and part."""
    def found(rows):
        docs = [np.frombuffer(r["docs"], DOC) for r in rows]
        entries = [np.frombuffer(r["entries"], ENTRY).copy() for r in rows]
        for e, n in zip(entries, np.cumsum([0, *[len(d) for d in docs[:-1]]]), strict=True):
            e["doc"] += np.uint32(n)
        docs, entries = np.concatenate(docs), np.concatenate(entries)
        if rows[0]["part"] >= 0:
            entries = entries[_later(docs, entries)]
        entries = entries[np.argsort(entries["doc"], kind="stable")]
        named, size = np.unique(entries["doc"], return_counts=True)
        ids = pa.array(docs["doc_id"][named], mask=docs["no_id"][named])
        at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array(docs["digest"][named]), pa.ListArray.from_arrays(at, pa.array(entries["unit"].astype(np.int32)))],
                                          names=["doc_id", "digest", "units"])

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["part"] != held[0]["part"] or r["part"] < 0):
                yield found(held)
                held = []
            held.append(r)
    if held:
        yield found(held)


def _short_lines(min_words: int):
    def run(batches):
        for own, data, offsets in _texts(batches):
            _, lines = units_and_lines(data, offsets)
            short = lines.n_words < min_words
            doc = own[lines.doc[short]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc["doc_id"], mask=doc["no_id"]), pa.array(doc["digest"]), pa.array(lines.number[short].astype(np.int32)),
                 pa.array(lines.n_words[short].astype(np.int32)), pa.array(lines.hash1[short].view(np.int64)), pa.array(lines.hash2[short].view(np.int64))],
                names=["doc_id", "digest", "line", "n_words", "hash1", "hash2"])
    return run


def frequent_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, lines): later occurrences of frequent lines of fewer than ``min_words`` words.

    A frequent line is reduced map-side to its first occurrence; the table of those is written, so
    that the join back has plain exchanges, which adaptive execution splits where a digest is hot."""
    rows = keyed(docs)
    lines = rows.mapInArrow(_short_lines(min_words), "doc_id bigint, digest bigint, line int, n_words int, hash1 bigint, hash2 bigint")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "line")
    texts = rows.agg(F.count("*")).scalar()
    often = (F.col("n") >= FREQUENT) & ((F.col("words") >= FREQUENT_WORDS) | (F.col("n") * FREQUENT_TEXTS >= texts))
    first = written(lines.groupBy("hash1", "hash2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("n_words").alias("words"))
                    .where(often).select("hash1", "hash2", "first"), "first-lines")
    later = lines.join(first, ["hash1", "hash2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "digest").agg(F.collect_set("line").alias("lines"))


def later_units(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, units): the units of each text that are later occurrences."""
    spark = docs.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    # rows of part -1 need no grouping and are dealt evenly
    dealt = keyed(docs).mapInArrow(_first_runs(bits), RUNS).withColumn(
        "deal", F.when(F.col("part") < 0, F.xxhash64("docs")).otherwise(F.col("part").cast("long")))
    merged = dealt.repartition(1 << bits, "deal").sortWithinPartitions("part").drop("deal").mapInArrow(
        _later_units, "doc_id bigint, digest bigint, units array<int>")
    return merged.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("units"))).alias("units"))


def pieces(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, words, line) of a text's units; ``line`` counts lines with words."""
    out, start, line, filled = [], 0, 0, False
    for end in [*(m.end() for m in CUT.finditer(text)), len(text)]:
        n = len(WORD.findall(text, start, end))
        if n:
            out.append((start, end, n, line))
            filled = True
        if filled and text[end - 1:end] == "\n":
            line, filled = line + 1, False
        start = end
    return out


def removed_spans(text: str, later: Container[int], lines: Container[int], min_words: int) -> list[tuple[int, int]]:
    """The units that go: those of long enough stretches of ``later`` ones and of ``lines``."""
    units, gone, stretch = pieces(text), set(), []
    for k in range(len(units) + 1):
        if k in later and k < len(units):
            stretch.append(k)
            continue
        if sum(units[i][2] for i in stretch) >= min_words:
            gone.update(stretch)
        stretch = []
    gone.update(k for k, u in enumerate(units) if u[3] in lines)
    return [units[k][:2] for k in sorted(gone)]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    at = [0, *[x for span in spans for x in span], len(text)]
    return "".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _cut(names: list[str], min_words: int):
    """Batches of (doc, again, units, lines) to the columns of doc, text without what goes, and ``removed``."""
    def run(batches):
        for batch in batches:
            fields = dict(zip(names, batch.column("doc").flatten(), strict=True))
            texts = fields["text"].to_pylist()
            spans = []
            for i, (again, units, lines) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("again", "units", "lines")], strict=True)):
                text = texts[i] or ""
                later = range(len(text)) if again else set(units or ())
                spans.append(removed_spans(text, later, set(lines or ()), min_words) if later or lines else [])
                if spans[-1]:
                    texts[i] = _without(text, spans[-1])
            fields["text"] = pa.array(texts, fields["text"].type)
            removed = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*fields.values(), removed], names=[*names, "removed"])
    return run


def _placed(docs: DataFrame) -> DataFrame:
    """(doc, id, digest, again): ``again`` if another row of equal doc_id and text ranks before it.
    Only rows with equals are written and numbered; the first number is taken map-side."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("bigint").alias("id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    equal = written(rows.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1")
                    .select(F.struct("id", "digest").alias("key")), "equal-rows")
    same = F.col("id").eqNullSafe(F.col("key.id")) & (F.col("digest") == F.col("key.digest"))
    many = written(rows.join(equal, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "rows-again")
    first = many.groupBy("id", "digest").agg(F.min("row").alias("row")).select("row", F.lit(False).alias("again"))
    numbered = many.join(first, "row", "left").select("doc", "id", "digest", F.coalesce("again", F.lit(True)).alias("again"))
    return rows.join(equal, same, "left_anti").withColumn("again", F.lit(False)).unionAll(numbered)


def without_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``removed``: the removed units' array<struct<start, end>>."""
    marks = later_units(docs).withColumn("lines", F.expr("cast(null as array<int>)")).unionAll(
        frequent_lines(docs, min_words).select("doc_id", "digest", F.expr("cast(null as array<int>)"), "lines"))
    gone = written(marks.groupBy("doc_id", "digest").agg(F.first("units", ignorenulls=True).alias("units"), F.first("lines", ignorenulls=True).alias("lines"))
                   .select(F.struct("doc_id", "digest").alias("key"), "units", "lines"), "later-units")
    kept = docs.drop("removed")
    # hashed, not sorted: the table of the marks is the small side and its keys are unique
    joined = _placed(kept).join(gone.hint("shuffle_hash"),
                                F.col("id").eqNullSafe(F.col("key.doc_id")) & (F.col("digest") == F.col("key.digest")), "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return joined.select("doc", "again", "units", "lines").mapInArrow(
        _cut(kept.columns, min_words), T.StructType([*kept.schema.fields, T.StructField("removed", span)]))


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``n_chars``, if there, counted anew."""
    cut = without_repeated(docs, min_words)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return cut.select("doc_id", "text", F.length("text").cast("long").alias("n_kept"),
                      F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"))


OP7_SQL = r"""
with raw as (
  select doc_id, text, string_split(regexp_replace(text, '(\n|[.!?,;:]+[ \t]+)', '\1' || chr(57344), 'g'), chr(57344)) as pieces
  from documents where text is not null),
l as (select doc_id, unnest(pieces) as piece, unnest(range(0, len(pieces))) as n from raw),
o as (
  select doc_id, n, piece,
         cast(coalesce(sum(length(piece)) over before, 0) as bigint) as s,
         coalesce(sum(case when right(piece, 1) = chr(10) then 1 else 0 end) over before, 0) as line,
         regexp_extract_all(piece, '[^\x20\x09-\x0D]+') as w
  from l window before as (partition by doc_id order by n rows between unbounded preceding and 1 preceding)),
u as (
  select doc_id, n, line, s, s + length(piece) as e, len(w) as words,
         translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm,
         row_number() over (partition by doc_id order by n) as unit from o where len(w) > 0),
r as (select *, row_number() over (partition by norm order by doc_id nulls last, n) as occurrence from u),
later as (select *, unit - row_number() over (partition by doc_id order by unit) as stretch from r where occurrence > 1),
lines as (
  select doc_id, line, sum(words) as words, string_agg(norm, ' ' order by n) as norm from u group by doc_id, line having sum(words) < 15),
often as (
  select *, count(*) over (partition by norm) as count, row_number() over (partition by norm order by doc_id nulls last, line) as occurrence
  from lines),
gone as (
  select doc_id, n from (select *, sum(words) over (partition by doc_id, stretch) as stretch_words from later) where stretch_words >= 15
  union
  select u.doc_id, u.n from u join often o on u.doc_id = o.doc_id and u.line = o.line
  where o.occurrence > 1 and o.count >= 10 and (o.words >= 3 or o.count * 1000 >= (select count(*) from raw))),
spans as (
  select doc_id, count(*) as n_removed, string_agg(s || '-' || e, ',' order by n) as removed from u join gone using (doc_id, n) group by doc_id),
kept as (
  select l.doc_id, string_agg(l.piece, '' order by l.n) as text
  from l left join gone g on l.doc_id = g.doc_id and l.n = g.n where g.n is null group by l.doc_id),
cut as (
  select d.doc_id, case when s.n_removed is null then d.text else coalesce(k.text, '') end as text,
         coalesce(s.n_removed, 0) as n_removed, coalesce(s.removed, '') as removed
  from documents d left join spans s using (doc_id) left join kept k using (doc_id))
select doc_id, text, cast(length(text) as bigint) as n_kept, cast(n_removed as bigint) as n_removed, removed from cut
"""
