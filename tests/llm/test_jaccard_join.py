"""Jaccard join: classes and links against all pairs."""

import random
import re

import numpy as np
import pytest
from helpers import clashing, docs, rows

from pathlens.llm import jaccard_join as j
from pathlens.llm.components import components


def shingles(text, n=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    if not w:
        return {("", text or "")}
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute(data, threshold=0.8):
    """Per row: class (least id, null last) and links, by comparing all pairs."""
    sets = [shingles(r[1]) for r in data]
    n = len(data)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a + 1, n):
            shared = len(sets[a] & sets[b])
            if shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i in range(n):
        k = find(i)
        least[k] = min(least.get(k, (True, 0)), (data[i][0] is None, data[i][0] or 0))
    return sorted((repr(data[i][0]), repr(None if least[find(i)][0] else least[find(i)][1]), links[i]) for i in range(n))


def variants(rng, n, length=120, edits=4):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"w{rng.randrange(5000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [512, 7])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(j, "CHUNK_CLASSES", chunk)
    rng = random.Random(chunk)
    texts = [t for _ in range(6) for t in variants(rng, rng.choice([1, 2, 5, 40]))]
    texts += texts[:5] + ["one two", "One, two!", "", None, "??", "??"]
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rng.shuffle(data)
    got = j.near_duplicates(docs(spark, data)).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["n_links"]) for r in got) == brute(data)


def test_supplied_documents(spark):
    from helpers import SF

    from pathlens.llm.common import table

    data = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = j.op8_jaccard_join(spark, SF).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["n_links"]) for r in got) == brute(data)


def test_awkward_rows_and_one_of_each_group(spark):
    frame = clashing(docs(spark))
    got = j.near_duplicates(frame).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["n_links"]) for r in got) == brute(rows())
    kept = j.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 4, 6, 8, 9, 10, None]))
    assert j.drop_near_duplicates(frame.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows_ = j.choose_bands(threshold, 0.99)
        assert 1 - (1 - threshold**rows_) ** bands >= 0.99 and bands * rows_ <= j.MOST_HASHES
    with pytest.raises(ValueError):
        j.choose_bands(0.01, 0.9999, 16)


def test_shared_counts_of_frequent_and_rare_shingles():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (j.shared_counts(sets) == np.array(want)).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len(got) == len(roots) == 41 + 51
    assert all(roots[i] == 0 for i in range(41)) and all(roots[200 + i] == 100 for i in range(50))
