"""Odd sketches: estimates, components against all pairs, and the exact way behind the sketches."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, clashing, docs, rows

from pathlens.llm import odd_sketch as o
from pathlens.llm.common import table


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def brute(data):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    rank = lambda x: (x is None, x or 0)
    least = {}
    for i, r in enumerate(data):
        least[find(i)] = min(least.get(find(i), r[0]), r[0], key=rank)
    return sorted(((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(data)), key=repr)


def result(frame):
    found = o.near_duplicates(frame)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["doc_id"] == r["component_id"]) for r in found.collect()), key=repr)


def near_copies(rng, n, words, share):
    """``n`` texts that differ from one base in about ``share`` of their words."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base) for _ in range(n)]


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.6, 0.8, 0.9, 1.0):
        n = 3000
        shared = round(n * 2 * similarity / (1 + similarity))
        pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n:2 * n - shared]])
        odd = o.odd_sketches(o.minhashes(np.concatenate([a, b]), np.array([0, n, 2 * n])))
        differing = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        assert abs(float(o.estimate(differing)) - similarity) < 0.1
        assert similarity < 0.8 or differing <= o.most_differing_bits()
    assert 0.6 < float(o.estimate(o.most_differing_bits())) < 0.7


def test_components_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [t for share in (0.02, 0.05, 0.06, 0.1) for t in near_copies(rng, 40, 120, share)]
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):                                      # neighbours are linked, the ends are not
        texts.append(" ".join(chain))
        chain = [*chain[6:], *[f"n{step}x{k}" for k in range(6)]]
    texts += texts[:7] + ["", " \t", None, "one", "One", "two two", "two two two two"]
    rng.shuffle(texts)
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    want = brute(data)
    assert result(docs(spark, data).repartition(3)) == want
    assert 20 < len({w[2] for w in want}) < len(want) - 60


def test_links_at_exactly_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    data = []
    for k in range(12):                                         # 8 of 10 shingles shared, or one fewer
        part = words[30 * k:30 * k + 19]
        data += [(10 * k, " ".join(part), "en", "s", 0), (10 * k + 1, " ".join([*part[:17], "a", "b"]), "en", "s", 0),
                 (10 * k + 2, " ".join([*part, "c"]), "en", "s", 0), (10 * k + 3, " ".join([*part[:16], "d", "e", "f"]), "en", "s", 0)]
    want = brute(data)
    assert result(docs(spark, data)) == want
    assert any(w[0] != w[2] for w in want) and any(w[0] % 10 and w[3] for w in want)


def test_small_chunks_and_no_rounds(spark, monkeypatch):
    """The blocks of chunks alone, without the rounds before them."""
    monkeypatch.setattr(o, "CHUNK", 7)
    monkeypatch.setattr(o, "CHUNK_SETS", 5)
    monkeypatch.setattr(o, "ROUNDS", 0)
    rng = random.Random(6)
    data = [(i, t, "en", "s", 0) for i, t in enumerate([t for share in (0.04, 0.05) for t in near_copies(rng, 45, 90, share)])]
    assert result(docs(spark, data)) == brute(data)


def test_awkward_rows(spark):
    got = result(clashing(docs(spark)))
    assert got == brute(rows())
    assert result(docs(spark, [])) == []


def test_hot_group_of_copies(spark):
    rng = random.Random(7)
    text = near_copies(rng, 1, 60, 0)[0]
    data = [(i if i % 3 else None, text, "en", "s", 0) for i in range(900)] + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(near_copies(rng, 30, 60, 0.01))]
    assert result(docs(spark, data)) == brute(data)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_joined(n):
    i, j = np.arange(max(0, n - 1)), np.arange(1, max(1, n))
    assert (o.joined(n, i, j) == 0).all()


def test_registered_query(spark):
    data = [(r["doc_id"], r["text"], None, None, None) for r in table(spark, SF, "documents").collect()]
    got = sorted((tuple(r) for r in o.op13_odd_sketch(spark, SF).collect()), key=repr)
    assert got == brute(data)


def test_blocks_of_a_large_component_grow_with_its_rows(spark):
    """Every pair of different labels is compared in exactly one block; a group's large component is not
    copied to a block per pair of its own chunks (105 rows in 11 chunks of 10: 1,155 rows before)."""
    labels = [0] * 100 + [1, 1, 2, 3, 4]
    nodes = spark.createDataFrame([(i, label) for i, label in enumerate(labels)], "node long, label long").withColumn("grp", F.lit(1))
    members = nodes.join(o._label_counts(nodes, "grp").drop("sum", "xor"), "grp")
    rows = o._in_blocks(members, F.col("grp"), 10).collect()
    assert len(rows) <= 2 * len(labels)
    compared = []
    blocks = {r.block: [x for x in rows if x.block == r.block] for r in rows}
    for own in blocks.values():
        two = len({r.side for r in own}) > 1
        compared += [tuple(sorted((a.node, b.node))) for n, a in enumerate(own) for b in own[n + 1:] if a.label != b.label and (not two or a.side != b.side)]
    assert sorted(compared) == [(i, j) for i in range(105) for j in range(i + 1, 105) if labels[i] != labels[j]]
    many = nodes.withColumn("label", F.col("node") % 4)                  # and with several chunks of the others
    members = many.join(o._label_counts(many, "grp").drop("sum", "xor"), "grp")
    seen = [(r.block, r.node) for r in o._in_blocks(members, F.col("grp"), 10).collect()]
    assert len(seen) == len(set(seen))
