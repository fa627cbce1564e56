"""Repeated windows of words and bytes against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import clashing, frame, sample

from tidemark.llm import substring_dedup, suffix_array, suffix_dedup, windows
from tidemark.llm.windows import Parser


def brute_words(rows, length):
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = lambda i: -(2**63) if i is None else i
    for i, t in order:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            first[k] = min(first.get(k, (at(i), p)), (at(i), p))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < (at(i), p):
                gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def brute_bytes(rows, length, seed=None):
    count = defaultdict(int)
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for size in {length, seed or length}:
            for p in range(len(b) - size + 1):
                count[b[p : p + size]] += 1
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone, short = np.zeros(len(b) + 2, bool), np.zeros(len(b) + 2, bool)
        for size, marks in ((length, gone), (seed or length, short)):
            for p in range(len(b) - size + 1):
                if count[b[p : p + size]] > 1:
                    marks[p + 1 : p + 1 + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, int(short.sum()), bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)))
    return sorted(out, key=repr)


def found_bytes(got):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_repeated, bytes(r.kept)) for r in got), key=repr)


def edited(seed, n=40):
    """Documents made of shared passages with small changes, so phrases share triggers but not contents."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("aé") * rnd.randint(1, 3) + str(rnd.randint(0, 30))
    passages = [[word() for _ in range(rnd.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(0, 15))]
        for _ in range(rnd.randint(0, 4)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.6:
                p[rnd.randrange(len(p))] = word()
            w += p + [word() for _ in range(rnd.randint(0, 3))]
        rows.append((i * 7 % n, " ".join(w)))
    return rows


CASES = {"sample": sample(), "edited": edited(1), "edited2": edited(2), "runs": [(1, "a " * 300), (2, "a b " * 200), (3, "a" * 2000), (1, "a " * 300)], "empty": []}


@pytest.mark.parametrize(("case", "make"), [*((c, frame) for c in CASES), ("sample", clashing)])
def test_words(spark, case, make):
    got = substring_dedup.deduplicate(make(spark, CASES[case])).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(CASES[case], substring_dedup.LENGTH)


@pytest.mark.parametrize(("case", "length", "make"), [*((c, 60, frame) for c in CASES), ("runs", 400, frame), ("edited", 400, frame), ("sample", 400, clashing)])
def test_bytes(spark, case, length, make):
    got = suffix_dedup.deduplicate(make(spark, CASES[case]), length, length // 2, length // 10).collect()
    assert found_bytes(got) == brute_bytes(CASES[case], length, length // 2)


def brute_intervals(strings):
    """For each string and depth, the strings of its group that share so many bytes."""
    return {(g, s): [frozenset(t for h, t in strings if h == g and t[:k] == s[:k]) for k in range(len(s) + 1)] for g, s in strings}


@pytest.mark.parametrize(("partitions", "letters"), [(1, "ab"), (5, "ab"), (40, "abcdefgh"), (40, "ab")])
def test_intervals_over_partitions(spark, partitions, letters):
    rnd = random.Random(partitions)
    strings = sorted({(g, "".join(rnd.choices(letters, k=rnd.randint(0, 12))).encode()) for g in (1, 1, 1, 2, 3) for _ in range(60)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = suffix_array.intervals(spark.createDataFrame([(g, s, s, 1) for g, s in strings], "group long, key binary, s binary, uses long"), "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_intervals(strings)
    numbers = {}
    assert len(rows) == len(strings)
    for r in rows:
        s = bytes(r.key)
        assert r.hi[-1] == len(s) and list(r.hi) == sorted(set(r.hi))
        at = 0
        for k, members in enumerate(want[r.group, s]):
            while r.hi[at] < k:
                at += 1
            number = numbers.setdefault((r.group, members, r.hi[at]), r.node[at])
            assert number == r.node[at]
            assert (r.node[at] & suffix_array.LEAF == suffix_array.LEAF) == (len(members) == 1)
    assert len(set(numbers.values())) == len(numbers)


def test_split_triggers(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PASSAGES", 3)
    monkeypatch.setattr(substring_dedup, "STRETCHES", 3)
    rows = edited(4)
    got = substring_dedup.deduplicate(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, substring_dedup.LENGTH)


def test_long_texts_are_parsed_in_parts(monkeypatch):
    data = random.Random(1).randbytes(5000)
    parser = Parser(40, 10)
    whole = parser.phrases(suffix_dedup.byte_symbols(data))
    monkeypatch.setattr(windows, "PART", 700)
    parts = parser.phrases(suffix_dedup.byte_symbols(data))
    cover = lambda p: [(a, int(t)) for f, l, t in zip(p.first, p.last, p.at, strict=True) for a in range(f, l + 1)]  # noqa: E731, E741
    assert cover(whole) == cover(parts) and [a for a, _ in cover(whole)] == list(range(5000 - 39))


@pytest.mark.parametrize("part", [700, 701, 333])
@pytest.mark.parametrize("reach", [0, 90])
def test_phrases_stay_whole_across_parts(monkeypatch, part, reach):
    data = random.Random(2).randbytes(5000) + b"ab" * 900
    parser = Parser(40, 10, reach)
    whole = parser.phrases(suffix_dedup.byte_symbols(data))
    monkeypatch.setattr(windows, "PART", part)
    parts = parser.phrases(suffix_dedup.byte_symbols(data))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_bytes_of_texts_longer_than_a_part(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    long = text(2 * windows.PART + 3000)
    across = long[windows.PART - 300 : windows.PART + 300]  # a true repeat over a part's end
    for rows in ([(1, long), (2, text(900))], [(1, long), (2, text(50) + across + text(50))]):
        got = suffix_dedup.deduplicate(frame(spark, rows)).collect()
        assert found_bytes(got) == brute_bytes(rows, suffix_dedup.LENGTH, suffix_dedup.SEED)
