"""Driver contract: entry() and every registered query against its DuckDB oracle."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from pathlens.plans.registry import QUERIES  # noqa: E402
from check_oracles import duck, duck_types, rows_of, spark_types  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "conversion_rate" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    missing = set(QUERIES) - set(E.oracle_sql())
    assert not missing, missing


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    sql = E.oracle_sql()[name]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    a, ac = rows_of(sdf.columns, srows)
    b, bc = rows_of(dcols, drows)
    assert ac == bc
    st, dt = spark_types(sdf), duck_types(con, sql)
    assert {c: st[c] for c in st if not st[c].startswith("TIMESTAMP")} == \
        {c: dt[c] for c in dt if not dt[c].startswith("TIMESTAMP")}
    assert len(a) == len(b)
    assert a == b
