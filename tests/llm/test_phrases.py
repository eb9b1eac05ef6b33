"""Collocations against a dictionary version; the trie's bursts and spills."""

import random
import re
from collections import Counter

import numpy as np
from helpers import clashing, docs, rows

from pathlens.llm import phrases as m


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(data, least, share=80, most=2000):
    f, n = {}, Counter()
    for r in data:
        lang = "und" if r[2] is None else r[2]
        for w in pieces(r[1]):
            n[lang] += len(w)
            for size in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i:i + size]] = max(longest[p[i:i + size]], a)
        found = []
        for p, a in often.items():
            if 100 * longest[p] >= share * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(frame, **options):
    return sorted(tuple(r) for r in m.collocations(frame, **options).collect())


def texts(rng, n, words=30):
    pool = [f"w{i}" for i in range(words)] + ["The", "of,", "é", "漢字", "a.b", "x:\ty", "\x0b"]
    fixed = ["New York City hall", "as far as I", "ha ha ha ha ha"]
    return [" ".join(rng.choice(fixed) if rng.random() < 0.2 else rng.choices(pool, weights=range(len(pool), 0, -1))[0]
                     for _ in range(rng.randrange(40))) for _ in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    data = [(i, t, rng.choice(["en", "de", None, "und"]), "s", 0) for i, t in enumerate(texts(rng, 400))]
    want = brute(data, 5)
    assert result(docs(spark, data).repartition(3), least=5) == want
    assert {len(r[2].split()) for r in want} == {2, 3, 4} and len(want) > 100
    assert result(docs(spark, data), least=5, most=7) == brute(data, 5, most=7)


def test_spills_and_bursts(spark, monkeypatch):
    for name, value in (("MOST_PHRASES", 50), ("MOST_WORDS", 10), ("SLICE_BYTES", 300), ("BURST", 3)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(3)
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts(rng, 150, 200))]
    assert result(docs(spark, data), least=4) == brute(data, 4)


def test_trie_counts_and_spills_whole_subtrees():
    rng = np.random.default_rng(4)
    keys = (rng.integers(0, 3000, 40_000, dtype=np.uint64) << np.uint64(32)) | rng.integers(0, 50, 40_000, dtype=np.uint64)
    trie, want = m.HatTrie(burst=8), Counter(keys.tolist())
    for part in np.array_split(keys, 7):
        trie.add(*np.unique(part, return_counts=True))
    assert trie.size.sum() == len(want) and any(isinstance(x, list) for x in trie.root)
    first, n = trie.spill(len(want) // 2)
    digits = m.HatTrie._digit(first, 0)
    assert trie.size.sum() <= len(want) // 2 and not trie.size[np.unique(digits)].any()
    rest, more = trie.spill(0)
    assert Counter(dict(zip(np.concatenate([first, rest]).tolist(), np.concatenate([n, more]).tolist(), strict=True))) == want
    assert not trie.size.any()


def test_counts_beyond_32_bits():
    keys, counts = np.array([5, 7], np.uint64), np.array([3, 1 << 40], np.int64)
    [batch] = m._runs(2, keys, counts, 1)
    got = {}
    for merged in m._merge_runs("", {}, 1)([batch, batch]):
        got |= dict(zip(merged.column("key").to_pylist(), merged.column("n").to_pylist(), strict=True))
    assert got == {5: 6, 7: 1 << 41}


def test_hot_words_and_repeated_rows(spark):
    data = [(i % 5, "the cat the dog the cat, the", "en", "s", 0) for i in range(600)] + [(None, "the cat", None, "s", 0)] * 40
    assert result(docs(spark, data)) == brute(data, 30)


def test_awkward_rows(spark):
    frame = clashing(docs(spark)).selectExpr("*", "1 as n", "2 as word", "3 as phrase", "4 as part")
    assert result(frame, least=1) == brute(rows(), 1)
    assert result(docs(spark)) == brute(rows(), 30)
    assert result(docs(spark, [])) == []
    assert result(docs(spark, [(1, "", "en", "s", 0), (2, None, None, "s", 0), (3, ".,;", "en", "s", 0)]), least=1) == []
