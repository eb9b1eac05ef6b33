"""Order MinHash: neighbours and edits against a plain version, properties of the likeness."""

import hashlib
import random

import numpy as np
import pytest
from helpers import clashing, docs, rows

from pathlens.llm import order_minhash as o


def plain(data):
    ordered = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, r in enumerate(ordered):
        text, other = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        changed = (text[:len(text) - n] + other[:n]).encode()
        own = o.order_minhash(text.encode())
        out.append((r[0], len(text), hashlib.sha256(changed).hexdigest(), own.tobytes().hex(), o.order_minhash(changed).tobytes().hex(),
                    o.likeness(own, o.order_minhash(changed)), o.likeness(own, o.order_minhash(other.encode()))))
    return sorted(map(repr, out))


def got(frame):
    return sorted(repr(tuple(r)) for r in o.compare_with_edits(frame).collect())


def test_awkward_rows_against_plain_version(spark):
    assert got(clashing(docs(spark))) == plain(rows())


@pytest.mark.parametrize("n", [0, 1, 2, 200])
def test_neighbours_across_buckets(spark, n):
    rng = random.Random(n)
    data = [(i * 7 % 1000, " ".join(rng.choices("abcdefg", k=rng.randrange(60))), "en", "s", 0) for i in range(n)]
    assert got(docs(spark, data).repartition(5)) == plain(data)


def test_only_null_ids(spark):
    data = [(None, t, "en", "s", 0) for t in ("b b b b b b b b", "a", "a")]
    assert got(docs(spark, data)) == plain(data)


def test_likeness_falls_with_edits_and_reordering():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)) for _ in range(600)]
    text = b" ".join(words)
    one = b" ".join([*words[:300], b"changed", *words[301:]])
    half = b" ".join([*words[:300], *[bytes(rng.integers(97, 123, 6, dtype=np.uint8)) for _ in range(300)]])
    moved = b" ".join([*words[300:], *words[:300]])
    print_ = o.order_minhash(text)
    like = [o.likeness(print_, o.order_minhash(t)) for t in (text, one, moved, half)]
    assert like[0] == 1.0 and like[1] > 0.85
    assert like[1] > like[2] > 0.2              # the same k-mers in another order are not the same
    assert like[3] < 0.5
    assert o.likeness(o.order_minhash(b""), print_) == 0.0 and o.likeness(o.order_minhash(b""), o.order_minhash(b"")) == 1.0
    assert len(o.order_minhash(b"a")) == o.SLOTS


def test_texts_on_either_side_of_a_power_of_two():
    text = np.random.default_rng(3).integers(97, 123, 2**20 + 500, dtype=np.uint8).tobytes()
    cut = text[:2**20 - 500]                    # 1,000 bytes less, and fewer than 2^20 k-mers
    assert o.likeness(o.order_minhash(text), o.order_minhash(cut)) > 0.9
    short = o.edited(text.decode(), "a short next document").encode()
    assert o.likeness(o.order_minhash(text), o.order_minhash(short)) > 0.4


def test_both_ways_of_sorting_give_the_same(monkeypatch):
    values = np.random.default_rng(4).integers(0, 2**64, 5000, dtype=np.uint64).repeat(3)
    whole = o._ranked(values)
    monkeypatch.setattr(np, "arange", None)     # the packed way needs it
    monkeypatch.setattr(o, "LOW_BITS", 8)
    assert all((a == b).all() for a, b in zip(o._ranked(values & ~np.uint64(2**20 - 1)), whole, strict=True))


def test_repeats_count():
    assert o.likeness(o.order_minhash(b"ab" * 50), o.order_minhash(b"ab" * 500)) < 0.5


def test_fingerprints_alone(spark):
    by_text = {}
    for r in o.fingerprints(docs(spark)).join(docs(spark), "doc_id").collect():
        by_text.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
