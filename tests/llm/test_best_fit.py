"""Packing planned on the histogram of lengths against best-fit, item by item, and the library's ids."""

from __future__ import annotations

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import best_fit

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"


def item_by_item(lengths, limit):
    """Contents of the sequences that best-fit decreasing makes."""
    held = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in held if sum(b) + n <= limit]
        if fits:
            max(fits, key=sum).append(n)
        else:
            held.append([n])
    return Counter(tuple(sorted(b)) for b in held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(20, 33))
def test_plan_is_best_fit(lengths, limit):
    patterns = best_fit.plan(np.bincount(lengths, minlength=limit + 1), limit)
    own = Counter()
    for bins, parts in patterns:
        own[tuple(sorted(itertools.chain(*[[n] * each for n, each in parts])))] += bins
    want = item_by_item(lengths, limit)
    assert sum(own.values()) == sum(want.values())
    assert Counter({n: k * c for b, c in own.items() for n, k in Counter(b).items()}).keys() == set(lengths)
    assert sorted(itertools.chain(*[list(b) * c for b, c in own.items()])) == sorted(lengths)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_slots_fill_sequences_without_gaps(lengths):
    limit = 20
    counts = np.bincount(lengths, minlength=limit + 1)
    table = best_fit.slots(best_fit.plan(counts, limit))
    taken = defaultdict(list)
    for n in np.flatnonzero(counts).tolist():
        sequence, offset = table.of(np.full(counts[n], n), np.arange(counts[n]))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken[s].append((o, n))
    for held in taken.values():
        ends = [o + n for o, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= limit
    assert sorted(taken) == list(range(len(taken)))


def test_plan_does_not_grow_with_items():
    counts = np.random.default_rng(1).integers(0, 10**9, 1025)
    patterns = best_fit.plan(counts, 1024)
    packed = np.zeros(1025, np.int64)
    for bins, parts in patterns:
        for length, each in parts:
            packed[length] += bins * each
    assert len(patterns) <= 2 * 1024 and packed[1:].tolist() == counts[1:].tolist()


def check(rows, texts, limit, end_id):
    """Every id in one piece, crc32 of the library's ids, no gaps, as many sequences as best-fit, item by item."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = Counter()
    for i, t in texts:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [end_id]
        first = len(ids) - (len(ids) - 1) // limit * limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    assert len(by_sequence) == sum(item_by_item([r["length"] for r in rows], limit).values())


@pytest.mark.parametrize("limit", [1024, 7])
def test_odd_rows(odd, limit):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    if limit == 7:
        odd, texts = odd.where("doc_id is null or doc_id <> 6"), [x for x in texts if x[0] != 6]
        odd = odd.where("doc_id is not null")
        texts = [x for x in texts if x[0] is not None]
    check(best_fit.best_fit_packing(odd, limit=limit).collect(), texts, limit, 2)


def test_one_length_holds_most_rows_and_ids_come_back(documents):
    rng = random.Random(4)
    texts = ["one two three"] * 300 + [" ".join(rng.choice(["alpha", "be", "gamma9"]) for _ in range(rng.randrange(60))) for _ in range(100)]
    rows = best_fit.best_fit_packing(documents(texts).repartition(7), limit=64, with_ids=True).collect()
    check(rows, list(enumerate(texts)), 64, 2)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_ids_of_any_type_and_empty_table(documents, spark):
    named = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"] for r in best_fit.best_fit_packing(named).collect()} == {"a", None}
    assert best_fit.best_fit_packing(documents([])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(best_fit.op11_best_fit(spark, SF).collect(), [tuple(r) for r in docs], 1024, 2)
