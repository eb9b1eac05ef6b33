"""Quality classifier: held-out accuracy, exact voting, awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
from helpers import clashing, docs, rows

from pathlens.llm import quality as q
from pathlens.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    got = q.op6_quality(spark, SF).collect()
    assert len(got) == 1000
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    good = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 1])
    assert len(held) > 100 and right > 0.95 and good > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_votes_are_exact_nearest_neighbours():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc de!"), 80)) for _ in range(60)]
    block = np.concatenate([w for _, _, w in q.term_blocks(pa.array(texts))])
    labels = rng.integers(0, 2, 60).astype(float)
    model = q.fit(block[:50], labels[:50])
    latent = model.project(block)
    for i, score in enumerate(model.scores(block)):
        cosine = latent[i] @ latent[:50].T
        top = np.argsort(-cosine)[:q.NEIGHBOURS]
        weight = np.maximum(0, cosine[top]) ** q.POWER
        assert abs(score - (weight @ labels[top]) / weight.sum()) < 1e-4


def test_terms_depend_on_the_text_alone():
    texts = ["A b!! 12", "", "x", "long " * 300, "é é é"]
    together = np.concatenate([w for _, _, w in q.term_blocks(pa.array([*texts, None]))])
    for i, t in enumerate(texts):
        alone = np.concatenate([w for _, _, w in q.term_blocks(pa.array([t]))])
        assert np.allclose(alone[0], together[i])
    assert not together[1].any() and not together[5].any()


def test_awkward_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (9, None, 1), (10, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    frame = clashing(docs(spark))
    out = q.with_quality(frame, q.train(frame, labels))
    assert out.count() == len(rows())
    kept = q.drop_low_quality(frame, labels)
    assert kept.columns == frame.columns
    none = q.with_quality(frame, q.train(frame, labels.limit(0))).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert q.drop_low_quality(frame.limit(0), labels).count() == 0
