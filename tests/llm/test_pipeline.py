"""Corpus pipeline: every stage against a plain version of its decision; contract queries."""

import os
import sys

import corpus_pipeline as p
import pytest
from helpers import SF, docs
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as near
from test_line_dedup import brute as repeated

import __spark_entry__ as entry
from pathlens.llm import line_dedup, quality, registry
from pathlens.llm.common import table, written

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check_oracles import duck, duck_types, rows_of, spark_types  # noqa: E402


def test_stages_against_plain_versions(spark):
    frame = table(spark, SF, "documents")
    kept = [written(frame, "in")]
    for _, stage in p.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "out"))
    tables = [[tuple(r) for r in k.collect()] for k in kept]
    assert all(k.columns == frame.columns for k in kept[:-1])
    scores = {r["doc_id"]: r["predicted"] for r in quality.op6_quality(spark, SF).collect()}
    assert {r[0] for r in tables[1]} == {i for i, good in scores.items() if good}
    assert {repr(r[0]) for r in tables[2]} == {c for _, c, _ in near(tables[1])}
    want = repeated(tables[2], line_dedup.MIN_WORDS)
    by_id = {r[0]: r for r in tables[2]}
    assert len(tables[3]) == len(tables[2])
    assert all(r[1] == want[r[0], by_id[r[0]][1]][0] and r[4] == len(r[1]) for r in tables[3])
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {r[0] for r in tables[3] if not contaminated(r[1], items, 10, 1)[1]}
    assert {r[0] for r in tables[4]} == clean and len(tables[4]) == len(clean)
    assert {r[0] for r in tables[5]} <= clean
    assert max(r[-1] for r in tables[5]) <= 3


def test_empty_documents(spark):
    frame = docs(spark, [])
    for _, stage in p.STAGES:
        frame = written(stage(spark, frame, SF), "empty")
        assert frame.count() == 0


def test_registered():
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == []


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duck(SF)
    frame = registry.QUERIES[name](spark, SF)
    sql = registry.ORACLES[name]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    a, ac = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    b, bc = rows_of(names, res.fetchall())
    assert ac == bc and a == b
    kinds, duck_kinds = spark_types(frame), duck_types(con, sql)
    assert all(kinds[c] == duck_kinds[c] for c in kinds)
