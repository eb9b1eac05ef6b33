"""Kneser-Ney: scores against a plain dictionary model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, clashing, docs, rows

from pathlens.llm import kneser_ney as k
from pathlens.llm.common import table


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), 0]


def d_of(counts):
    n = [sum(c == i for c in counts) for i in range(1, 5)]
    if not all(n):
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *[min(max(x, 0), i + 1) for i, x in enumerate(raw)]]


class Plain:
    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            s = tokens(t)
            self.words.update(s)
            self.pairs.update(zip([1, *s[:-1]], s, strict=True))
        self.after, before = defaultdict(dict), Counter()
        for (h, w), n in self.pairs.items():
            self.after[h][w] = n
            before[w] += 1
        self.before, self.n, self.v = before, sum(self.words.values()), len(self.words)
        self.d, self.d1 = d_of(self.pairs.values()), d_of(before.values())
        self.all = sum(before.values())
        self.free = sum(self.d1[min(c, 3)] for c in before.values()) / self.all if self.all else 1.0

    def p1(self, w):
        c = self.before[w]
        return (max(0, c - self.d1[min(c, 3)]) / self.all if self.all else 0) + self.free / (self.v + 1)

    def p(self, h, w):
        if h not in self.after:
            return self.p1(w)
        own = self.after[h]
        total, c = sum(own.values()), own.get(w, 0)
        return max(0, c - self.d[min(c, 3)]) / total + sum(self.d[min(x, 3)] for x in own.values()) / total * self.p1(w)

    def score(self, text):
        s = tokens(text)
        base = sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in s)
        return len(s), sum(self.words[w] > 0 for w in s), base, sum(math.log10(self.p(h, w)) for h, w in zip([1, *s[:-1]], s, strict=True))


def compare(got, plain, texts):
    for r in got:
        n, known, base, score = plain.score(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_supplied_documents_against_plain_model(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    plain = Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10])
    got = k.op9_kneser_ney(spark, SF).collect()
    assert len(got) == len(texts) and {r["train_tokens"] for r in got} == {plain.n}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in got)
    compare(got, plain, texts)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_frequent_history_is_dealt_by_pair(spark):
    data = [(i, "the " + " the ".join(f"w{i * 50 + n}" for n in range(50)), "en", "s", 0) for i in range(40)]
    frame = docs(spark, data)
    model = k.train(frame)
    assert len(model.hot) >= 1
    compare(k.with_scores(frame, model).collect(), Plain([r[1] for r in data]), {r[0]: r[1] for r in data})


def test_probabilities_add_up_to_one():
    plain = Plain(["a b c a b", "b c d", "a a a", ""])
    for h in [1, "a", "b", "never"]:
        assert sum(plain.p(h, w) for w in plain.words) + plain.p(h, "unknown") == pytest.approx(1)


def test_awkward_rows(spark):
    frame = clashing(docs(spark))
    out = k.with_scores(frame, k.train(frame))
    plain = Plain([r[1] for r in rows()])
    got = out.collect()
    assert len(got) == len(rows()) and "size" in out.columns
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    compare(by_id.values(), plain, {r[0]: r[1] for r in rows()})
    assert by_id[7]["n_tokens"] == by_id[6]["n_tokens"] == 1


def test_no_training_rows(spark):
    frame = docs(spark)
    got = k.with_scores(frame, k.train(frame.limit(0))).collect()
    assert all(r["score"] == pytest.approx(0) and r["n_known"] == 0 for r in got)
    assert k.with_scores(frame.limit(0), k.train(frame)).count() == 0


def test_discounts_stay_in_range():
    assert (k.discounts(np.array([10, 20, 1, 50])) <= [0, 1, 2, 3]).all() and (k.discounts(np.array([10, 20, 1, 50])) >= 0).all()


@pytest.mark.parametrize("partitions", [4, 200])
@pytest.mark.parametrize("texts", [["a b c", "b c"], [""], ["x x x x"] * 50, ["one line of text"] * 200, [None, "", "a"]],
                         ids=["two", "empty", "one word", "copies", "null"])
def test_small_and_repetitive_tables(spark, texts, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        frame = docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).coalesce(1)
        compare(k.with_scores(frame, k.train(frame)).collect(), Plain(texts), dict(enumerate(texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_missing_shard_raises(spark):
    frame = docs(spark, [(1, "a b c", "en", "s", 0)])
    model = k.train(frame)
    with pytest.raises(Exception, match="No such file"):
        k.with_scores(frame, model._replace(folder="/nowhere/at/all")).collect()


def test_model_folder_is_an_absolute_mounted_path(spark, monkeypatch, tmp_path):
    from pathlens.llm import common

    for where, want in ((f"file:{tmp_path}", str(tmp_path)), (f"file://{tmp_path}", str(tmp_path)), (str(tmp_path), str(tmp_path)),
                        (f"file://{tmp_path}/a%20b", f"{tmp_path}/a b")):
        monkeypatch.setattr(common, "scratch", lambda s, n, where=where: f"{where}/{n}")
        assert common.mounted(spark, "model") == f"{want}/model" and (tmp_path / "model").is_dir()
    for where in ("relative", "hdfs://host/x", "file:relative", "s3a://b/x"):
        monkeypatch.setattr(common, "scratch", lambda s, n, where=where: f"{where}/{n}")
        with pytest.raises(ValueError, match="mounted folder"):
            common.mounted(spark, "model")


class PlainThree(Plain):
    """Order 3: pairs count the words before them, or occurrences at a text's begin."""
    def __init__(self, texts):
        super().__init__(texts)
        self.triples, befores, raw = Counter(), defaultdict(set), Counter()
        for t in texts:
            s = tokens(t)
            for a, b, w in zip([1, 1, *s[:-2]], [1, *s[:-1]], s, strict=False):
                self.triples[a, b, w] += 1
                befores[b, w].add(a)
                raw[b, w] += 1
        self.pairs = Counter({(h, w): raw[h, w] if h == 1 else len(x) for (h, w), x in befores.items()})
        self.after = defaultdict(dict)
        for (h, w), n in self.pairs.items():
            self.after[h][w] = n
        self.d = d_of(self.pairs.values())
        self.after_two = defaultdict(dict)
        for (a, b, w), n in self.triples.items():
            self.after_two[a, b][w] = n
        self.d3 = d_of(self.triples.values())

    def p3(self, a, b, w):
        own = self.after_two.get((a, b))
        if not own:
            return self.p(b, w)
        total, c = sum(own.values()), own.get(w, 0)
        return max(0, c - self.d3[min(c, 3)]) / total + sum(self.d3[min(x, 3)] for x in own.values()) / total * self.p(b, w)

    def score(self, text):
        s = tokens(text)
        n, known, base, _ = super().score(text)
        return n, known, base, sum(math.log10(self.p3(a, b, w)) for a, b, w in zip([1, 1, *s[:-2]], [1, *s[:-1]], s, strict=False))


def test_order_3_against_plain_model(spark):
    frame = docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(
        ["a b c a b c d", "b c d a b", "a b x", "", "the a the b the c the d", "c", None, "a b c a b c d"])])
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    model = k.train(frame.where("doc_id < 5"), order=3)
    compare(k.with_scores(frame, model).collect(), PlainThree([texts[i] for i in range(5)]), texts)
    some = table(spark, SF, "documents").where("doc_id < 60")
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    got = k.with_scores(some, k.train(some.where("doc_id >= 6"), order=3)).collect()
    compare(got, PlainThree([t for i, t in texts.items() if i >= 6]), texts)
    with pytest.raises(ValueError):
        k.train(frame, order=4)


def test_order_3_with_frequent_histories(spark):
    data = [(i, "of the " + " of the ".join(f"w{i * 50 + n}" for n in range(50)), "en", "s", 0) for i in range(40)]
    frame = docs(spark, data)
    model = k.train(frame, order=3)
    assert all(len(x.hot) for x in model.levels)
    compare(k.with_scores(frame, model).collect(), PlainThree([r[1] for r in data]), {r[0]: r[1] for r in data})
