"""Token counts as delta-maintained rollups.

A store keeps, per committed batch, a ledger (what each touched document now counts) and signed
deltas of documents and tokens by source, language and tokenizer version. An insert adds, a delete
subtracts what the ledger says, a revised count subtracts the old and adds the new; totals are the
sum of the deltas. A batch counts once its row is in the commit table, which is written last: a
batch that failed midway is written again in full, and a committed one is not applied again.

Tokens are counted by public byte-level BPE vocabularies, read by the workers from a folder that
is a parameter.

Defined cases: a null or empty text has 0 tokens; very long texts are counted whole; a null source or language is a group of its own; changes
without doc_id or version are ignored (``left_out`` tells their number and tokens); of several changes of one document and version in a batch
the one with the most tokens counts, and any upsert goes before a delete; a delete of an unknown
document changes nothing; an empty batch commits without deltas; columns that changes do not need
are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

# fixed values: versions are vocabulary files of TOKENIZER_DIR; the pattern splits their words
TOKENIZER_DIR = "/opt/tokenizers"
VERSION, NEXT_VERSION = "byte_bpe_50k", "byte_bpe_multi_50k"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHANGES = "doc_id bigint, source string, lang string, version string, tokens bigint, deleted boolean"
COMMITS = "batch string, number bigint"
LEDGER = "batch string, doc_id bigint, version string, source string, lang string, tokens bigint, deleted boolean"
DELTAS = "batch string, source string, lang string, version string, docs bigint, tokens bigint"

_encodings: dict[str, object] = {}


def encoding(version: str, folder: str = TOKENIZER_DIR):
    """The tokenizer of a version, built once per worker."""
    import tiktoken

    path = f"{folder}/{version}.tiktoken"
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def counted(docs: DataFrame, version: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Upserts: every row of ``docs`` with the tokens of its whole text under ``version``."""
    def run(batches):
        for batch in batches:
            own = encoding(version, folder)
            n = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([version] * size, pa.string()),
                 pa.array(n, pa.int64()), pa.array([False] * size, pa.bool_())],
                names=["doc_id", "source", "lang", "version", "tokens", "deleted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "text")
    return rows.mapInArrow(run, CHANGES)


def deletions(docs: DataFrame, version: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("source"),
                       F.lit(None).cast("string").alias("lang"), F.lit(version).alias("version"),
                       F.lit(None).cast("bigint").alias("tokens"), F.lit(True).alias("deleted"))


def create_store(spark: SparkSession, path: str) -> str:
    for name, schema in (("commits", COMMITS), ("ledger", LEDGER), ("deltas", DELTAS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")
    return path


def _committed(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """The rows of committed batches, with the batch's number. One attempt's rows can stand beside
    a failed one's, so rows carry the attempt in ``batch`` and commits name it."""
    commits = spark.read.schema(COMMITS).parquet(f"{store}/commits")
    return spark.read.schema(schema).parquet(f"{store}/{name}").join(commits, "batch")


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Applies ``changes`` (CHANGES) as ``batch``; False if it is committed already."""
    commits = spark.read.schema(COMMITS).parquet(f"{store}/commits")
    done = commits.agg(F.max("number").alias("n"), F.max(F.split("batch", "/")[0] == batch).alias("mine")).first()
    if done["mine"]:
        return False
    attempt = f"{batch}/{scratch(spark, 'x').rsplit('-', 1)[-1]}"
    rank = F.struct((~F.col("deleted")).alias("upsert"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang")
    new = written(changes.where("doc_id is not null and version is not null").groupBy("doc_id", "version")
                  .agg(F.max(rank).alias("new")), "changes")
    old = (_committed(spark, store, "ledger", LEDGER).join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
           .groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "deleted"), "number").alias("old")))
    both = new.join(old, ["doc_id", "version"], "left")
    ledger = new.select(F.lit(attempt).alias("batch"), "doc_id", "version", "new.source", "new.lang", "new.tokens",
                        (~F.col("new.upsert")).alias("deleted"))
    held = F.col("old").isNotNull() & ~F.col("old.deleted")
    signed = F.array(
        F.when(held, F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"),
                              F.lit(-1).cast("bigint").alias("docs"), (-F.col("old.tokens")).alias("tokens"))),
        F.when(F.col("new.upsert"), F.struct(F.col("new.source").alias("source"), F.col("new.lang").alias("lang"),
                                             F.lit(1).cast("bigint").alias("docs"), F.col("new.tokens").alias("tokens"))))
    deltas = (both.select("version", F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("d"))
              .groupBy("d.source", "d.lang", "version").agg(F.sum("d.docs").alias("docs"), F.sum("d.tokens").alias("tokens"))
              .select(F.lit(attempt).alias("batch"), "source", "lang", "version", "docs", "tokens"))
    deltas.write.mode("append").parquet(f"{store}/deltas")
    ledger.write.mode("append").parquet(f"{store}/ledger")
    spark.createDataFrame([(attempt, (done["n"] or 0) + 1)], COMMITS).coalesce(1).write.mode("append").parquet(f"{store}/commits")
    return True


def left_out(changes: DataFrame) -> DataFrame:
    """What a batch leaves out of the totals, one row: changes without doc_id or version, and those
    that a change of the same document and version with more tokens stands for; rows and tokens."""
    keyed = changes.where(~F.col("deleted"))
    known = F.col("doc_id").isNotNull() & F.col("version").isNotNull()
    best = keyed.where(known).groupBy("doc_id", "version").agg(F.count("*").alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("counted"))
    unknown = keyed.where(~known).agg(F.count("*").alias("unkeyed_rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("unkeyed_tokens"))
    repeated = best.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"),
                        F.coalesce(F.sum(F.col("all") - F.col("counted")), F.lit(0)).alias("repeated_tokens"))
    one = F.lit(1).alias("one")
    return unknown.select("*", one).join(repeated.select("*", one), "one").drop("one")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Documents and tokens by source, language and version: the sum of all committed deltas."""
    sums = (_committed(spark, store, "deltas", DELTAS).groupBy("source", "lang", "version")
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
    return sums.where("docs <> 0 or tokens <> 0")


def later_copies(docs: DataFrame) -> DataFrame:
    """Documents whose whole text an earlier doc_id has, too."""
    rows = docs.where("doc_id is not null").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    # written, so that the join back has plain exchanges, which are split where a text is hot
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-copies")
    return rows.join(first, "digest").where("doc_id <> first").select("doc_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over ``documents``: all are inserted; later copies are deleted; what is not
    English is revised to the next tokenizer version. The first batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    store = create_store(spark, scratch(spark, "token-counts"))
    inserts = counted(docs, VERSION)
    commit(spark, store, "insert", inserts)
    commit(spark, store, "insert", inserts)
    copies = written(later_copies(docs), "copies")
    commit(spark, store, "delete copies", deletions(copies, VERSION))
    moved = docs.where(F.coalesce(F.col("lang") != "en", F.lit(True))).join(copies.distinct(), "doc_id", "left_anti")
    commit(spark, store, "revise", counted(moved, NEXT_VERSION).unionAll(deletions(moved, VERSION)))
    return totals(spark, store)
