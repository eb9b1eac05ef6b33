"""Merkle manifest of a dataset over concatenated-level strings.

Every row is a leaf, the sha256 of its columns; the leaves of a group are ranked in parallel (range
partitions, then counts per partition) and 8 consecutive nodes hash to their parent until one is
left. A block of 512 consecutive nodes, aligned to the tree, keeps each of its three levels as one
hex string; fixed-width substrings of it are hashed to the next level, and the substrings to both
sides of a node within its run are its siblings. Block roots are the nodes of the next tier, so the
same step recurses, tier by tier, first per group and then over the groups' roots. Siblings go back
down from tier to tier, one row per block, and are folded with the leaves inside their block; a
proof is never a row of its own.

Defined cases: a null column hashes as ``-``, an empty text as ``0:``; very long texts are hashed
whole, as a stream of the hash, and only digests are shuffled; null ids rank last within their group;
rows equal in id rank by leaf, rows equal in all columns are leaves each, and any of them may have
any of their places; a group of one is its own root; an empty table has no rows and no root; other
columns are left alone (``with_proofs`` returns ids and digests alone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

FAN = 8
LEVELS = 3                      # levels that a block keeps
BLOCK = FAN**LEVELS
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` (with a column ``grp``, not null) plus ``pos``, the place in the group by ``by``.

    The range sort deals equal keys apart by a row number, so no group and no key is one task's;
    what is gathered is a count per group and partition."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = written(numbered.repartitionByRange("grp", *by, "row").sortWithinPartitions("grp", *by, "row").drop("row")
                      .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    counts = ordered.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # rows: partitions and groups
    before = written(counts.selectExpr("grp", "part", "first", "sum(n) over (partition by grp order by part) - n as before"), f"{name}-parts")
    return ordered.join(before, ["grp", "part"]).withColumn("pos", F.expr("before + at - first")).drop("at", "part", "first", "before")


def _up(level: Column) -> Column:
    """The parents of a level string: the hash of each run of ``FAN`` digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (FAN * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "")


def _blocks(nodes: DataFrame, kept: list[str], sizes: DataFrame, name: str) -> DataFrame:
    """A row per block of 512 nodes (grp, pos, node): level strings l0 to l2, the levels the block
    hashes, its own root, and its ``members`` in order with the columns ``kept``."""
    members = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", *kept))).alias("members"))
    sized = members.join(sizes, "grp")
    height = F.when(F.col("n") > FAN * FAN, 3).when(F.col("n") > FAN, 2).when(F.col("n") > 1, 1).otherwise(0)
    level = sized.withColumn("height", height).withColumn("l0", F.array_join("members.node", "").cast("binary"))
    for k in range(1, LEVELS + 1):
        level = level.withColumn(f"l{k}", F.when(F.col("height") >= k, _up(F.col(f"l{k - 1}"))).cast("binary"))
    root = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)]).cast("string")
    return written(level.withColumn("root", root).drop(f"l{LEVELS}"), name)


def _flanks(place: Column) -> Column:
    """(left, right) of each level that the block hashes: the digests on both sides of the node
    (or its ancestor) at ``place`` within its run."""
    steps = []
    for k in range(LEVELS):
        own = F.shiftright(place, 3 * k)
        run = F.shiftleft(F.shiftright(own, 3), 3)
        text = F.col(f"l{k}")
        left = F.substring(text, run * HEX + 1, (own - run) * HEX)
        right = F.substring(text, (own + 1) * HEX + 1, (run + FAN - 1 - own) * HEX)
        steps.append(F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))
    return F.slice(F.array(*steps), 1, F.col("height"))


def _tree(nodes: DataFrame, kept: list[str], name: str) -> DataFrame:
    """Block rows of the nodes (grp, pos, node) with ``root`` of the whole group and ``above``: the
    (left, right) siblings from the block's root up to the group's."""
    tiers, tier = [], 0
    sizes = written(nodes.groupBy("grp").agg(F.count("*").alias("n")), f"{name}-sizes-0")
    most = sizes.agg(F.max("n")).first()[0] or 0
    while True:
        tiers.append(_blocks(nodes, kept if tier == 0 else [], sizes, f"{name}-tier-{tier}"))
        most = -(-most // BLOCK)
        if most <= 1:
            break
        tier += 1
        nodes = tiers[-1].select("grp", F.col("block").alias("pos"), F.col("root").alias("node"))
        sizes = written(nodes.groupBy("grp").agg(F.count("*").alias("n")), f"{name}-sizes-{tier}")
    none = F.array().cast("array<struct<left:string,right:string>>")
    block = tiers[-1].withColumn("above", none).withColumnRenamed("root", "group_root")
    for lower in reversed(tiers[:-1]):
        place = lambda m: (m["pos"] % BLOCK).cast("int")
        down = block.select("grp", "group_root", F.inline(F.transform("members", lambda m: F.struct(
            m["pos"].alias("block"), F.concat(_flanks(place(m)), F.col("above")).alias("above")))))
        block = lower.join(written(down, f"{name}-down"), ["grp", "block"]).drop("root")
    return block


def _fold(node: Column, siblings: Column) -> Column:
    return F.aggregate(siblings, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def _proof(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def with_proofs(leaves: DataFrame, name: str = "merkle") -> DataFrame:
    """(id, leaf, presented, subroot, root, proof_sha256, folded_root, verified) of ``leaves``
    (grp string, id, leaf, presented): the digest that a holder presents is folded with the
    leaf's own siblings. A null ``grp`` is a group of its own, first in order."""
    keyed = leaves.select(F.concat(F.lit("="), "grp").alias("grp"), F.col("id").isNull().alias("no_id"), "id", "leaf", "presented")
    keyed = written(keyed.fillna("", ["grp"]), f"{name}-leaves")
    ranked = _ranked(keyed, ["no_id", "id", "leaf"], f"{name}-ranked").withColumnRenamed("leaf", "node")
    blocks = _tree(ranked, ["id", "presented"], name)
    subroots = blocks.where("block = 0").select("grp", F.col("group_root").alias("leaf"))
    groups = _ranked(subroots.select(F.lit("all").alias("grp"), F.col("grp").alias("own"), "leaf"), ["own"], f"{name}-groups")
    top = _tree(groups.withColumnRenamed("leaf", "node"), ["own"], f"{name}-top")
    down = top.select(F.col("group_root").alias("all_root"), F.inline(F.transform("members", lambda m: F.struct(
        m["own"].alias("grp"), F.concat(_flanks((m["pos"] % BLOCK).cast("int")), F.col("above")).alias("over")))))
    joined = blocks.join(written(down, f"{name}-over"), "grp")
    rows = joined.select("group_root", "all_root", F.inline(F.transform("members", lambda m: F.struct(
        m["id"].alias("id"), m["node"].alias("leaf"), m["presented"].alias("presented"),
        F.concat(_flanks((m["pos"] % BLOCK).cast("int")), F.col("above"), F.col("over")).alias("siblings")))))
    folded = rows.select("id", "leaf", "presented", F.col("group_root").alias("subroot"), F.col("all_root").alias("root"),
                         _proof(F.col("siblings")).alias("proof_sha256"), _fold(F.col("presented"), F.col("siblings")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` per lang; where 3 divides the unsigned crc32 of the decimal doc_id,
    ``presented`` is the leaf of the row with A-Z of its text lower-cased (a row without doc_id
    is never such a one)."""
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = leaf_hash(*before, F.col("text"))
    other = leaf_hash(*before, F.translate("text", UPPER, LOWER))
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), leaf.alias("leaf"),
                       F.when(tampered, other).otherwise(leaf).alias("presented"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_proofs(document_leaves(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _manifest_sql(levels: int = 7, top: int = 3) -> str:
    """The same rows by DuckDB: trees of at most 8**levels leaves and 8**top langs."""
    piece = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"
    columns = " || ".join(piece(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = ("xor(list_reduce([4294967295::ubigint] || list_transform(range(1, length(cast(doc_id as varchar)) + 1), "
           "lambda i: ord(substr(cast(doc_id as varchar), i, 1))::ubigint), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, y: xor(x >> 1, (x & 1::ubigint) * 3988292384::ubigint))), 4294967295::ubigint)")
    sql = [f"""with t as (select doc_id, lang, {columns} as head, text, {crc} % 3 = 0 as tampered from documents),
h as (select doc_id, coalesce('=' || lang, '') as grp, sha256(head || {piece('text')}) as leaf,
        case when tampered then sha256(head || {piece(f"translate(text, '{UPPER}', '{LOWER}')")})
             else sha256(head || {piece('text')}) end as presented from t),
a0 as (select *, leaf as node, row_number() over (partition by grp order by doc_id nulls last, leaf) - 1 as pos from h)"""]

    def tree(p: str, n: int) -> None:
        for k in range(n):
            sql.append(f"""{p}s{k} as (select grp, pos, node, count(*) over (partition by grp) as n,
        coalesce(string_agg(node, '') over (partition by grp, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
        coalesce(string_agg(node, '') over (partition by grp, pos // 8 order by pos rows between 1 following and unbounded following), '') as r from {p}{k}),
{p}{k + 1} as (select grp, pos // 8 as pos, case when any_value(n) > 1 then sha256(string_agg(node, '' order by pos)) else any_value(node) end as node
        from {p}s{k} group by grp, pos // 8)""")

    tree("a", levels)
    sql.append(f"b0 as (select 'all' as grp, grp as own, node, row_number() over (order by grp) - 1 as pos from a{levels})")
    tree("b", top)
    proof, folded, joins = [], "p.presented", []

    def walk(p: str, n: int, grp: str, pos: str) -> None:
        nonlocal folded
        for k in range(n):
            x = f"{p}x{k}"
            joins.append(f"join {p}s{k} {x} on {x}.grp = {grp} and {x}.pos = {pos} // {8**k}")
            proof.append(f"case when {x}.n > 1 then {x}.l || {x}.r else '' end")
            joins.append(f"cross join lateral (select case when {x}.n > 1 then sha256({x}.l || {folded} || {x}.r) else {folded} end as f) {x}f")
            folded = f"{x}f.f"

    walk("a", levels, "p.grp", "p.pos")
    joins.append("join b0 q on q.own = p.grp")
    walk("b", top, "'all'", "q.pos")
    sql = ",\n".join(sql)
    return f"""{sql}
select p.doc_id, p.leaf, q.node as subroot, z.node as root, sha256({' || '.join(proof)}) as proof_sha256, {folded} as folded_root,
  {folded} = z.node as verified
from a0 p {' '.join(joins)} cross join b{top} z"""


OP12_SQL = _manifest_sql()
