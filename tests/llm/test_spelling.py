"""Spelling variants against a comparison of all words, and counts of words against regular expressions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import spelling

LETTERS = "".join(map(chr, range(65, 91)))


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    """word -> (form, root, n, n_near, form_n)"""
    forms, close = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        close[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, close[w], words.get(forms[w]))
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def brute_counts(rows, drop, least):
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c in LETTERS else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= least:
                out[w] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 10**12)), st.lists(st.sampled_from(["Ab", "Éab", "ÿ", "÷x", "z", " ", "\n", "ß", "ĀĀ", "中", "-", "c" * 70, "Zz"]), max_size=20).map("".join)), max_size=6),
       st.sampled_from([None, 1, 2, 3]), st.integers(1, 4), st.sampled_from([3, 20]))
def test_counts_of_words(rows, drop, least, bits):
    old, spelling.BITS = spelling.BITS, bits
    try:
        counter, got = spelling.WordCounter(drop, least), Counter()
        for a in range(0, len(rows), 2):
            for w, n in counter.add([b"%s:" % ("" if i is None else str(i)).encode() for i, _ in rows[a : a + 2]], [t.encode() for _, t in rows[a : a + 2]]):
                got[w.decode()] += n
        for w, n in counter.finish():
            got[w.decode()] += n
    finally:
        spelling.BITS = old
    assert got == brute_counts(rows, drop, least)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abé", max_size=6), min_size=1, max_size=40), st.lists(st.text("abé", max_size=4), max_size=6))
def test_equal_numbers_are_equal_prefixes(words, bounds):
    found = spelling.Ranges(sorted(set(bounds)))
    trie, seen = spelling.Numbering(found), {}
    for w in sorted(words):
        numbers = trie.path(found.of(w), w)
        assert len(numbers) == len(w) + 1
        for d, x in enumerate(numbers.tolist()):
            assert seen.setdefault(w[:d], x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", range(20))
def test_groups_of_keys_give_every_near_word_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab" if seed % 2 else "abcd") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    n = {w: rng.choice([1, 2, 3]) for w in words}
    rows = []
    for i, w in enumerate(words):
        for k in range(len(w) + 1):
            rows.append((w[:k], w[k:], i, 0))
            if k < len(w):
                rows.append((w[:k], w[k + 1 :], i, 2 if w[k : k + 1] != w[k + 1 : k + 2] else 1))
    rows.sort()
    number = {x: k for k, x in enumerate(sorted({r[0] for r in rows} | {r[1] for r in rows}))}
    a = [np.array(x) for x in zip(*[(number[p], number[s], i, n[words[i]], kind) for p, s, i, kind in rows], strict=True)]
    total, best = Counter(), {}
    for i, c, m, v in zip(*(x.tolist() for x in spelling.near_in_groups(*a)), strict=True):
        total[words[i]] += c
        best[words[i]] = min(best.get(words[i], (0, "~")), (-m, words[v]))
    for w in words:
        found = [v for v in words if near(w, v)]
        assert total[w] == len(found) and (not found or best[w] == min((-n[v], v) for v in found))


def test_words_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SAMPLE", 200)
    monkeypatch.setattr(spelling, "BOUND", 3)
    rng = random.Random(6)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 1, 5, 12, 150, 2000]) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert len(spelling.ranges(df, F.col("word"), 16).bounds) > 8
        assert result(spelling.spelling_groups(df)) == brute(words)
        assert result(spelling.spelling_groups(df, ratio=3)) == brute(words, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_words(spark):
    long = "".join(chr(97 + i * i % 7) for i in range(100_000))
    rows = [("a", 1), ("a", 2), (None, 5), ("", 1), ("b", 40), ("🙂x", 1), ("🙃x", 10), ("x", 100), ("\0", 1), ("\0\0", 10), (long, 1), (long[:500] + long[501:], 20), (long[:-1] + "z", 3)]
    words = {"a": 3, "": 1, "b": 40, "🙂x": 1, "🙃x": 10, "x": 100, "\0": 1, "\0\0": 10}
    got = result(spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long").withColumn("part", F.lit(1)).withColumn("wid", F.lit("x"))))
    assert got.pop(long) == (long[:500] + long[501:], long[:500] + long[501:], 1, 2, 20)
    assert got.pop(long[:500] + long[501:]) == (None, long[:500] + long[501:], 20, 1, None)
    assert got.pop(long[:-1] + "z") == (None, long[:-1] + "z", 3, 1, None)
    assert got == brute(words)
    assert result(spelling.spelling_groups(spark.createDataFrame([], "word string, n long"))) == {}


def test_words_of_odd_documents(odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {r["word"]: r["n"] for r in spelling.word_counts(odd, drop=3, least=2).collect()}
    assert got == brute_counts(rows, 3, 2)
    assert spelling.word_counts(documents([])).collect() == []
