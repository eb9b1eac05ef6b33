"""Decontamination: exact and proximity matches against brute force."""

import random
import re

import pytest
from helpers import clashing, docs, rows

from pathlens.llm import decontaminate as d


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def windows(items, window):
    for item, text in items:
        w = terms(text)
        if w:
            for n in range(max(1, len(w) - window + 1)):
                yield "" if item is None else str(item), w[n:n + window]


def brute(text, items, window, within):
    w, hit, found, near = terms(text), set(), set(), set()
    for item, phrase in windows(items, window):
        for p in range(len(w) - len(phrase) + 1):
            if w[p:p + len(phrase)] == phrase:
                hit |= set(range(p, p + len(phrase)))
                found.add(item)
        for p in range(len(w)):
            if w[p] == phrase[0] and all(x in w[max(0, p - within + 1):p + within] for x in phrase):
                near.add(item)
    return len(w), len(hit), sorted(found), sorted(near)


def run(spark, texts, items, window, within, **more):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.search(d.build_index(frame), bench, window, within, **more).withColumn("n_hit", d.n_hit_words())
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["near"]) for r in found.collect()}


@pytest.mark.parametrize("block_windows", [1 << 17, 5])
def test_against_brute_force(spark, block_windows):
    rng = random.Random(5)
    words = ["a", "b", "C", "é", "x1", "the", "rare"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 20, 50]))) for _ in range(40)] + [None, "--", "a,b;c"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 7])))) for k in range(8)] + [(None, "b a"), (3, None), (3, "x1 x1")]
    got = run(spark, texts, items, 3, 4, block_windows=block_windows)
    assert got == {i: brute(t, items, 3, 4) for i, t in enumerate(texts)}


def test_production_window_finds_passages(spark):
    item = " ".join(f"q{i}" for i in range(30))
    inside = "before " + " ".join(f"Q{i}," for i in range(12, 27)) + " after"
    got = run(spark, [inside, "q1 q2 q3", item], [(9, item)], d.WINDOW, d.WITHIN)
    assert got[0][:3] == (17, 15, ["9"]) and got[1][:3] == (3, 0, []) and got[2][:3] == (30, 30, ["9"])


def test_drop_keeps_clean_rows_and_columns(spark):
    frame = clashing(docs(spark))
    bench = spark.createDataFrame([(1, "delta epsilon zeta eta theta iota kappa lambda mu extra"), (2, " ".join(f"passage{i}" for i in range(12)))],
                                  "item_id bigint, text string")
    out = d.drop_contaminated(frame, bench)
    assert out.columns == frame.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=repr) == sorted([r[0] for r in rows() if r[0] not in (4, 5)], key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.drop_contaminated(docs(spark), none).count() == len(rows())
    assert d.contamination(docs(spark, []), none).count() == 0
