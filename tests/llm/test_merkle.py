"""Merkle manifest: leaves, trees, proofs and folding against a recursive version."""

import hashlib
import random
import zlib

from helpers import clashing, docs, rows
from pyspark.sql import functions as F

from pathlens.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """(root, per node its (left, right) siblings, bottom up)"""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
    root, above = tree([h(*r) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1:])), *up] for r, up in zip(runs, above, strict=True) for k in range(len(r))]


def brute(data):
    groups = {}
    for r in data:
        groups.setdefault(r[2], []).append((r[0] is None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, over = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, over, strict=True):
        for (no_id, _, own, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            steps = steps + top
            shown = own
            if not no_id and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                shown = leaf(r[0], lower(r[1]), *r[2:])
            for left, right in steps:
                shown = h(left, shown, right)
            out.append((r[0], own, trees[g][0], root, h(*[a + b for a, b in steps]), shown, shown == root))
    return out


def result(frame):
    found = merkle.with_proofs(merkle.document_leaves(frame))
    return sorted((tuple(r) for r in found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_groups_of_every_height_against_brute_force(spark):
    rng = random.Random(3)
    sizes = {None: 1, "": 8, "a": 9, "é": 64, "z": 65, "hot": 1100, **{f"l{i}": 1 + i % 3 for i in range(70)}}
    data = [(lang, rng.choice(["Text", "text", "", None])) for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(data)
    data = [(i * 7 - 50, text, lang, rng.choice(["s", None]), rng.choice([i, None])) for i, (lang, text) in enumerate(data)]
    got = result(docs(spark, data).repartition(5))
    assert got == sorted(brute(data), key=repr)
    assert len({r[3] for r in got}) == 1 and 0 < sum(r[6] for r in got) < len(got)


def test_small_blocks_recurse(spark, monkeypatch):
    """More groups than a block and more tiers: a block is 512, so 5,000 rows have two tiers."""
    data = [(i, f"T{i}", "en" if i % 5 else None, "s", i) for i in range(5000)]
    assert result(docs(spark, data)) == sorted(brute(data), key=repr)


def test_awkward_and_repeated_rows(spark):
    data = rows() * 3
    got = result(clashing(docs(spark, data)))
    assert got == sorted(brute(data), key=repr)
    untouched = [r for r in got if r[0] is None]
    assert untouched and all(r[6] for r in untouched)


def test_empty_table_and_other_presented(spark):
    assert result(docs(spark, [])) == []
    leaves = merkle.document_leaves(docs(spark)).withColumn("presented", F.sha2(F.lit("forged"), 256))
    assert not any(r["verified"] for r in merkle.with_proofs(leaves).collect())
