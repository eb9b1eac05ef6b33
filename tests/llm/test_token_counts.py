"""Token counts: rollups against recounting, idempotent and failed batches."""

from collections import Counter

from helpers import SF, clashing, docs, rows

from pathlens.llm import token_counts as t
from pathlens.llm.common import scratch, table


def as_dict(frame):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in frame.collect()}


def recounted(data):
    docs_, tokens = Counter(), Counter()
    for source, lang, version, text in data:
        docs_[source, lang, version] += 1
        tokens[source, lang, version] += len(t.encoding(version).encode_ordinary(text or ""))
    return {k: (docs_[k], tokens[k]) for k in docs_}


def test_query_against_recounting(spark):
    data = table(spark, SF, "documents").collect()
    first = {}
    for r in data:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    kept = [(r["source"], r["lang"], t.VERSION if r["lang"] == "en" else t.NEXT_VERSION, r["text"])
            for r in data if first[r["text"]] == r["doc_id"]]
    assert as_dict(t.op2_token_counts(spark, SF)) == recounted(kept)


def change(spark, *data):
    return spark.createDataFrame(data, t.CHANGES)


def test_signed_changes_and_idempotence(spark):
    store = t.create_store(spark, scratch(spark, "store"))
    insert = change(spark, (1, "a", "en", "v", 10, False), (2, "a", "en", "v", 5, False), (3, None, None, "v", 7, False))
    assert t.commit(spark, store, "b1", insert)
    assert not t.commit(spark, store, "b1", insert)
    assert as_dict(t.totals(spark, store)) == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 7)}
    revise = change(spark, (1, "b", "en", "v", 12, False), (2, None, None, "v", None, True), (99, None, None, "v", None, True))
    assert t.commit(spark, store, "b2", revise)
    assert as_dict(t.totals(spark, store)) == {("b", "en", "v"): (1, 12), (None, None, "v"): (1, 7)}
    assert t.commit(spark, store, "b3", change(spark, (2, "a", "en", "v", 6, False), (2, "a", "en", "v", 9, False),
                                               (2, None, None, "v", None, True), (None, "a", "en", "v", 1, False)))
    assert as_dict(t.totals(spark, store))["a", "en", "v"] == (1, 9)
    assert t.commit(spark, store, "b4", insert.limit(0))
    assert as_dict(t.totals(spark, store))["a", "en", "v"] == (1, 9)


def test_a_failed_batch_leaves_no_trace(spark, monkeypatch):
    store = t.create_store(spark, scratch(spark, "store"))
    insert = change(spark, (1, "a", "en", "v", 10, False))
    with monkeypatch.context() as m:
        m.setattr(t, "COMMITS", "batch string, broken int, number bigint")      # fails at the commit row
        try:
            t.commit(spark, store, "b1", insert)
        except Exception:
            pass
    assert as_dict(t.totals(spark, store)) == {}
    assert t.commit(spark, store, "b1", insert)
    assert as_dict(t.totals(spark, store)) == {("a", "en", "v"): (1, 10)}


def test_awkward_rows(spark):
    store = t.create_store(spark, scratch(spark, "store"))
    t.commit(spark, store, "all", t.counted(clashing(docs(spark)), t.VERSION))
    kept = {r[0]: (r[3], r[2], t.VERSION, r[1]) for r in rows() if r[0] is not None}
    assert as_dict(t.totals(spark, store)) == recounted(kept.values())
    assert t.counted(docs(spark, []), t.VERSION).count() == 0


def test_what_is_left_out_is_told(spark):
    data = change(spark, (1, "a", "en", "v", 10, False), (1, "a", "en", "v", 4, False), (1, "a", "en", "v", 4, False), (None, "a", "en", "v", 7, False),
                  (2, "a", "en", None, 5, False), (3, "a", "en", "v", None, True))
    assert tuple(t.left_out(data).first()) == (2, 12, 2, 8)
    assert tuple(t.left_out(data.limit(0)).first()) == (0, 0, 0, 0)
