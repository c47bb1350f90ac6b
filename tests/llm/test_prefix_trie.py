"""The trie of conversation prefixes against one that is built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """conv_id -> (role, text) in the order of the operator."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found[c].append(((turn is not None, turn), key, role, text))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    number, up, text, depth = {}, [None], [""], [0]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        at = 0
        members[at].append(c)
        for role, said in turns:
            if (at, role, said) not in number:
                number[at, role, said] = len(up)
                up.append(at)
                text.append(said)
                depth.append(depth[at] + 1)
            at = number[at, role, said]
            members[at].append(c)
        ends[at].append(c)
    if not convs:
        return []
    kids, leaves, saved = [0] * len(up), [0] * len(up), [0] * len(up)
    for x in range(len(up) - 1, -1, -1):  # children have larger numbers
        leaves[x] += not kids[x]
        saved[x] += (len(members[x]) - 1) * len(text[x].encode())
        if x:
            kids[up[x]] += 1
            leaves[up[x]] += leaves[x]
            saved[up[x]] += saved[x]
    return sorted((min(members[x]), depth[x], min(members[up[x]]) if x else None, len(members[x]), kids[x], leaves[x], saved[x],
                   hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest()) for x in range(len(up)))


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(map(tuple, df.collect()))


def some(rng, convs, turns, words=("a", "bb", "ccc")):
    """Rows of conversations, many of which begin alike."""
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, turns + 1)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(words)))
    rng.shuffle(rows)
    return rows




def parts_in_memory(convs, task_rows):
    """The operator's numpy work without Spark: sorted rows, cut into tasks, their parts added up."""
    seg, rows = prefix_trie.SEGMENT, []
    sums = defaultdict(lambda: np.zeros(2, np.uint64))
    for c, turns in convs.items():
        h = b"".join(hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest() for r, t in turns)
        size = np.array([len(t.encode()) for _, t in turns], "<i4").tobytes()
        base = np.zeros(2, np.uint64)
        for k in range(len(turns) // seg + 1):
            own, s = h[16 * seg * k : 16 * seg * (k + 1)], size[4 * seg * k : 4 * seg * (k + 1)]
            rows.append((c, k.to_bytes(4, "big") + b"".join(int(x).to_bytes(8, "big") for x in base) + own, s))
            x = np.frombuffer(own, "<u8").reshape(-1, 2)
            if len(x):
                base = base ^ np.bitwise_xor.reduce(prefix_trie.lanes(x, seg * k + np.arange(len(x))), axis=0)
    rows.sort(key=lambda r: (r[1], r[0]))
    found = defaultdict(lambda: [None, None, 0, 0, 0, 0])
    tails = defaultdict(lambda: [0, 0])
    ends = defaultdict(list)

    def take(batch):
        for r in batch.to_pylist():
            if r["kind"] == 0:
                x = found[r["depth"], r["p1"], r["p2"]]
                x[0] = x[0] if r["q1"] is None else (r["q1"], r["q2"])
                x[1] = r["conv_id"] if x[1] is None else x[1] if r["conv_id"] is None else min(x[1], r["conv_id"])
                for k, n in enumerate(("n", "saved", "leaves", "children")):
                    x[2 + k] += r[n] or 0
            elif r["kind"] == 1:
                ends[r["depth"], r["p1"], r["p2"]].append(r["ids"])
            elif r["kind"] == 3:
                for k, n in enumerate(("saved", "leaves")):
                    tails[r["conv_id"], r["depth"]][k] += r[n]

    last = None
    for a in range(0, len(rows), task_rows):
        own = rows[a : a + task_rows]
        if last:
            for b in prefix_trie.seam_parts(*last, *own[0]):
                take(b)
        for b in prefix_trie.block_parts(np.array([r[0] for r in own]), [r[1] for r in own], [r[2] for r in own]):
            take(b)
        last = own[-1]
    for c, key, size in rows:
        k = int.from_bytes(key[:4], "big")
        later = [v for (i, s), v in tails.items() if i == c and s > k]
        one = prefix_trie.Rows([key], [size])
        for j in range(int(k > 0), int(one.length[0]) + 1) if later else ():
            p = one.path(np.array([0]), np.array([j]))[0]
            found[seg * k + j, int(p[0]), int(p[1])][3] += sum(v[0] for v in later)
            found[seg * k + j, int(p[0]), int(p[1])][4] += sum(v[1] for v in later)
    out = []
    for (d, p1, p2), (up, conv, n, saved, leaves, children) in found.items():
        mine = [i for chunk in sorted(ends[d, p1, p2]) for i in chunk]
        assert mine == sorted(mine)
        out.append((conv, d, found[d - 1, *up][1] if d else None, n, children, leaves, saved, hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_parts_add_up(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "SEGMENT", rng.choice([1, 2, 3, 512]))
    monkeypatch.setattr(prefix_trie, "CHUNK", rng.choice([1, 2, 4096]))
    convs = {c: [("u", rng.choice(["a", "bb"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))] for c in range(rng.choice([1, 2, 9, 40]))}
    assert parts_in_memory(convs, rng.choice([1, 2, 7, 100])) == brute(convs)


def test_rows_without_ids_null_turns_ties_and_repeated_rows(spark):
    rows = [(None, 0, "u", "x"), (1, None, "u", "a"), (1, 0, None, None), (1, 0, "", ""), (1, 5, "u", "b"), (1, 5, "u", "b"), (1, 5, "v", "b"),
            (2, None, "u", "a"), (3, 1, "u", "é" * 3), (-7, 0, "u", "a"), (2**62, 0, "u", "a"), (6, 3, "x" * 9000, "y" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'p' as part", "2 as pos", "3 as depth")
    assert result(prefix_trie.conversation_trie(df.repartition(3))) == brute(ordered(rows))
    assert result(prefix_trie.conversation_trie(df.where("false"))) == []
    assert result(prefix_trie.conversation_trie(df.where("conv_id is null"))) == []


def test_one_conversation_over_many_tasks_and_one_of_many_copies(spark):
    rng = random.Random(5)
    long = [(0, t, "u", rng.choice(["a", "bb"])) for t in range(3 * prefix_trie.SEGMENT)]
    almost = [(1, t, r, x) for _, t, r, x in long[: 2 * prefix_trie.SEGMENT]] + [(2, t, r, x) for _, t, r, x in long[: prefix_trie.SEGMENT + 5]] + [(2, 10**6, "u", "other")]
    copies = [(c, t, "u", x) for c in range(10, 400) for t, x in enumerate(["hot", "hot", "same"])]
    rows = long + almost + copies + [(c + 1000, t, r, x) for c, t, r, x in some(rng, 30, 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert result(prefix_trie.conversation_trie(df)) == brute(ordered(rows))
        assert result(prefix_trie.prefix_nodes(prefix_trie.with_borrowed_heads(prefix_trie.turn_runs(df)))) == brute(rebuilt(ordered(rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(2))
def test_rebuilt_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [r for r in some(rng, 60, 12) if r[0] not in (5, 20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("role", F.when(F.col("turn") != 3, F.col("role")))
    rows = [tuple(r) for r in df.collect()]
    assert result(prefix_trie.prefix_nodes(prefix_trie.with_borrowed_heads(prefix_trie.turn_runs(df)))) == brute(rebuilt(ordered(rows)))
