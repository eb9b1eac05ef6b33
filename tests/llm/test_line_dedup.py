"""Line dedup against a brute-force version, with offsets."""

import random
import re
from collections import Counter

import numpy as np
from helpers import clashing, docs, rows

from pathlens.llm import line_dedup

CUT = re.compile(r"(\n|[.!?,;:]+[ \t]+)")


def normal(words):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(words))


def units_of(text):
    """(start, end, words, line) of the parts with words, cut behind newlines, and marks before a blank."""
    split = CUT.split(text)
    parts = ["".join(split[i:i + 2]) for i in range(0, len(split), 2)]
    at, line = 0, 0
    for part in parts:
        w = re.findall(r"[^\x20\x09-\x0D]+", part)
        if w:
            yield at, at + len(part), w, line
        at += len(part)
        line += part.endswith("\n")


def brute(data, min_words):
    """text per (doc_id, text) and the removed spans."""
    distinct = sorted({(r[0], r[1]) for r in data if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    units = {k: list(units_of(k[1])) for k in distinct}
    lines = {}
    for k, own in units.items():
        for u in own:
            lines.setdefault((k, u[3]), []).extend(u[2])
    copies = Counter((r[0], r[1]) for r in data)
    times = Counter()
    for (k, _), w in lines.items():
        times[normal(w)] += copies[k]
    texts = sum(r[1] is not None for r in data)
    seen, seen_lines, out = set(), set(), {}
    for k, own in units.items():
        later = [normal(u[2]) in seen or seen.add(normal(u[2])) for u in own]
        gone, i = set(), 0
        while i < len(own):
            j = i
            while j < len(own) and later[j]:
                j += 1
            if sum(len(u[2]) for u in own[i:j]) >= min_words:
                gone |= set(range(i, j))
            i = max(j, i + 1)
        for line in sorted({u[3] for u in own}):
            w = lines[k, line]
            if len(w) < min_words and normal(w) in seen_lines and times[normal(w)] >= 10 and (len(w) >= 3 or 1000 * times[normal(w)] >= texts):
                gone |= {i for i, u in enumerate(own) if u[3] == line}
            seen_lines.add(normal(w))
        spans = [own[i][:2] for i in sorted(gone)]
        text = k[1]
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        out[k] = text, spans
    return out


def check(spark, data, min_words, parts=3):
    want = brute(data, min_words)
    got = line_dedup.without_repeated(docs(spark, data).repartition(parts), min_words).collect()
    assert len(got) == len(data)
    original = {r[0]: r[1] for r in data}
    for r in got:
        text, removed = want[r["doc_id"], original[r["doc_id"]]]
        assert r["text"] == text
        assert [(x["start"], x["end"]) for x in r["removed"]] == removed
    return got


def test_against_brute_force(spark):
    rng = random.Random(11)
    pool = ["a b c", "Of.", "", "  A  b C ", "x y z, w v u. t", "é ß ñ q", "long " * 12, "\t", "one two", "v.w; x:y", "a ,  b", "c. \t", "!!! \v d"]
    data = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 9))), "en", "s", 0) for i in range(60)]
    data += [(100 + i, " ".join(rng.choices(pool, k=rng.randrange(0, 9))), "en", "s", 0) for i in range(60)]
    data.append((None, "a b c\nx y z w v u", None, None, None))
    for min_words in (1, 4, 30):
        assert any(r["removed"] for r in check(spark, data, min_words))


def test_small_groups_of_units(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_UNITS", 5)
    monkeypatch.setattr(line_dedup, "SLICE_BYTES", 40)
    rng = random.Random(12)
    data = [(i, ". ".join(rng.choices([f"w{k} v{k}" for k in range(30)], k=12)), "en", "s", 0) for i in range(80)]
    check(spark, data, 4)


def test_passages_inside_lines(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))
    passage = prose(60)
    data = [(i, f"{prose(30)} {passage} {prose(30)}", "en", "s", 0) for i in range(20)] + [(100 + i, prose(90), "en", "s", 0) for i in range(20)]
    got = {r["doc_id"]: r for r in check(spark, data, line_dedup.MIN_WORDS)}
    inner = " ".join(passage.split()[15:45])
    assert inner in got[0]["text"] and not any(inner in got[i]["text"] for i in range(1, 20))
    assert not any(got[100 + i]["removed"] for i in range(20))


def test_units_of_slices_are_those_of_texts():
    texts = ["a. b", "", " c,  d\n\ne;", ". f", " \t", "g h\r\ni, j", "k,\tl", ", m", "n,"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    units, lines = line_dedup.units_and_lines(data, np.cumsum([0, *[len(t) for t in texts]]))
    for d, text in enumerate(texts):
        own = line_dedup.pieces(text)
        assert units.n_words[units.doc == d].tolist() == [p[2] for p in own]
        assert units.number[units.doc == d].tolist() == list(range(len(own)))
        assert lines.number[lines.doc == d].tolist() == sorted({p[3] for p in own})


def test_awkward_rows(spark):
    frame = clashing(docs(spark))
    out = line_dedup.drop_repeated(frame)
    assert out.columns == frame.columns and out.count() == len(rows())
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[6] == (None, None) and texts[7][0] == ""
    assert "passage3 " in texts[4][0] and texts[5][0] == "another start here\nOf.\nquite another end"
    assert texts[5][1] == len(texts[5][0]) and texts[9][0] == rows()[8][1]


def test_hot_line_and_empty_table(spark):
    hot = "the same fifteen words in every one of these texts of which there are some"
    data = [(i, f"own{i} word\n{hot}", "en", "s", 0) for i in range(500)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(docs(spark, data)).collect()}
    assert got[0].endswith(hot) and all(got[i] == f"own{i} word\n" for i in range(1, 500))
    assert line_dedup.drop_repeated(docs(spark, [])).count() == 0


def test_min_words_1_removes_every_later_occurrence(spark):
    data = [(i, f"own{i}\nall rights reserved.\nOf.", "en", "s", 0) for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(docs(spark, data), 1).collect()}
    assert got == {i: f"own{i}\n" if i else data[0][1] for i in range(50)}


def test_frequent_short_lines_go_by_their_count(spark):
    line = lambda i: "all rights reserved." if i < 10 else "but nine times only" if i < 19 else "of all, this"
    data = [(i, f"own{i} text\n{line(i)}\nOf.", "en", "s", 0) for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in check(spark, data, line_dedup.MIN_WORDS)}
    assert "reserved" in got[0] and not any("reserved" in got[i] for i in range(1, 10))
    assert all("nine" in got[i] for i in range(10, 19)) and all(got[i].endswith("Of.") == (i == 0) for i in range(20))


def test_one_of_equal_rows_keeps_its_units(spark):
    ten = "the same fifteen words in every one of these texts of which there are some"
    data = [*[(None, f"{ten}\n\nand more", "en", f"s{i % 2}", i) for i in range(4)], *[(5, f"five\n{ten} {ten}", "en", "s", 0)] * 3,
            *[(6, "short line", "en", "s", 0)] * 2, (7, f"own\n{ten}", "en", "s", 0), *[(8, None, "en", "s", 0), (8, "", "en", "s", 0)] * 2]
    cut = line_dedup.without_repeated(docs(spark, data).repartition(3)).collect()
    got = sorted((repr(r["doc_id"]), r["text"] or "", len(r["removed"])) for r in cut)
    whole = f"five\n{ten} {ten}"
    assert got == sorted([*[("None", "\n", 2)] * 3, ("None", "\nand more", 1), *[("5", "", 2)] * 2, ("5", whole, 0), *[("6", "short line", 0)] * 2,
                          ("7", f"own\n{ten}", 0), *[("8", "", 0)] * 4])
    assert sorted(r["n_chars"] for r in cut if r["doc_id"] is None) == [0, 1, 2, 3]
