"""Source mixing: targets against round-by-round resharing, draws, awkward rows."""

import re

import pytest
from helpers import clashing, docs, rows

from pathlens.llm import mixing


def reshared(sizes, weights, cap):
    """Targets by rounds: share by weight, hold what is above its cap, share the excess again."""
    total, held = sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in held]
        weight = sum(weights[i] for i in open_)
        left = total - sum(held.values())
        target = {i: left * weights[i] / weight for i in open_} if weight else {}
        above = [i for i in open_ if target[i] > cap * sizes[i] + 1e-9]
        if not above:
            return [held.get(i, target.get(i, 0.0)) for i in range(len(sizes))]
        held |= {i: cap * sizes[i] for i in above}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 3], [0, 10, 10], [7], [0, 0], [1, 2, 3, 4, 5, 600, 7]])
def test_targets_equal_resharing_by_rounds(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size bigint")
    got = {r["source"]: r for r in mixing.source_targets(mixing.cycled_weights(frame)).collect()}
    names = sorted((f"s{i}" for i in range(1, len(sizes))), key=str) + [None]
    by_name = {(f"s{i}" if i else None): n for i, n in enumerate(sizes)}
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    want = reshared([by_name[n] for n in names], weights, 3)
    for name, weight, target in zip(names, weights, want, strict=True):
        assert got[name]["weight"] == weight
        assert got[name]["target"] == pytest.approx(target)


def test_plan_takes_awkward_rows_and_reruns_agree(spark):
    frame = docs(spark)
    first = [tuple(r["doc"]) + tuple(r["mix"]) for r in mixing.mix_plan(frame).collect()]
    assert len(first) == len(rows())
    again = [tuple(r["doc"]) + tuple(r["mix"]) for r in mixing.mix_plan(frame.repartition(3)).collect()]
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    for row in first:
        text, size, copies = row[1], row[5], row[8]
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert 0 <= copies <= 3


def test_mix_emits_copies_and_keeps_columns(spark):
    frame = clashing(docs(spark))
    plan = {(r["doc"]["doc_id"], r["doc"]["text"]): r["mix"]["copies"] for r in mixing.mix_plan(frame).collect()}
    out = mixing.mix(frame)
    assert out.columns == [c for c in frame.columns if c != "copy"] + ["copy"]
    counts = {}
    for r in out.collect():
        counts[r["doc_id"], r["text"]] = max(counts.get((r["doc_id"], r["text"]), 0), r["copy"])
    assert counts == {k: n for k, n in plan.items() if n}


def test_totals_come_near_targets(spark):
    data = [(i, " ".join(["x"] * (1 + i % 17)), "en", f"s{i % 4}", 0) for i in range(8000)]
    taken = {}
    for r in mixing.mix_plan(docs(spark, data)).collect():
        key = r["doc"]["source"], r["mix"]["target"]
        taken[key] = taken.get(key, 0) + r["mix"]["size"] * r["mix"]["copies"]
    for (_, target), words in taken.items():
        assert words == pytest.approx(target, rel=0.1)


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
