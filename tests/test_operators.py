"""Operators against plain Python on small, random and published cases."""

from __future__ import annotations

import datetime
import json
import math
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions.media import halves, max_distance
from tessella.operators import cosine as V
from tessella.operators import duplicates as D
from tessella.operators import faces as P
from tessella.operators import hamming as H
from tessella.operators import merge as G
from tessella.operators import places as N
from tessella.operators import relational as R
from tessella.operators import scan as Q
from tessella.operators import search as S
from tessella.operators import text_index as T
from tessella.operators import upserts as U
from tessella.operators.graph import connected_components, leader_groups
from tessella.operators.hamming import near_hashes
from tessella.operators.similarity import vector_search
from tessella.plans import search as plans_search
from tessella.sources import catalogue as C
from tessella.streaming import catalogue as K


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def components_of(nodes, edges):
    to = {n: n for n in nodes}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        to[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)] + [(200, 200)]
    nodes = {x for e in edges for x in e}
    df = spark.createDataFrame(edges, "a int, b int")
    assert dict(rows(connected_components(df))) == dict(rows(connected_components(df, small=1000))) == components_of(nodes, edges)


def test_components_of_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([(None, 1)], "a int, b int"))) == []


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    n = 40
    forced = {i for i in range(n) if rng.random() < 0.1}
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    leader = {}
    for i in range(n):
        earlier = sorted(j for j in near[i] if j < i and leader[j] == j)
        leader[i] = i if i in forced or not earlier else earlier[0]
    nodes = spark.createDataFrame([(i, i, i in forced) for i in range(n)], "node int, ordinal int, forced boolean")
    assert dict(rows(leader_groups(nodes, spark.createDataFrame(list(edges) or [(0, 0)], "a int, b int")))) == leader


@pytest.mark.parametrize(("blocks", "part", "similarity"), [(None, 8192, 0.9), (0, 20, 0.9), (1, 8192, 0.9), (2, 8192, 0.9), (3, 3, 0.9), (2, 2, 0.95), (1, 20, 0.70), (None, 8192, 1.0)])
def test_near_hashes_finds_every_pair(spark, monkeypatch, blocks, part, similarity):
    monkeypatch.setattr(H, "PART", part)
    rng = random.Random(5)
    base = [[rng.randrange(2) for _ in range(64)] for _ in range(12)]
    data = [(i, [b ^ (rng.random() < 0.06) for b in base[i % 12]]) for i in range(60)] + [(100, base[0]), (101, base[0]), (102, [1])]
    data = [(i, [int(x) for x in b]) for i, b in data]
    got = {(a, b): d for a, b, d in rows(near_hashes(spark.createDataFrame(data, "id int, bits array<int>"), "id", "bits", similarity, blocks))}
    first = {}
    for i, b in data:
        if len(b) == 64:
            first.setdefault(tuple(b), i)
    want = {}
    for x, i in first.items():
        for y, j in first.items():
            d = sum(p != q for p, q in zip(x, y, strict=True))
            if i < j and d <= max_distance(similarity):
                want[i, j] = d
    assert got == want and (want or similarity > 0.95)


def test_keys_follow_the_rows_and_the_distance():
    """Rows that a row meets at similarities of 0.90 and 0.70, with the keys that are chosen."""
    for n in (2_000, 1_000_000, 100_000_000):
        figures = {d: (H.scheme(n, d), H.candidates(n, d, H.scheme(n, d))) for d in (6, 19)}
        print(f"{n} rows: blocks of a key, rows met at 0.90 {figures[6]}, at 0.70 {figures[19]}")
        assert figures[6][1] <= max(2_000, n / 50) and figures[19][1] <= n
    assert H.scheme(2_000, 6) == 0 and H.scheme(100_000_000, 6) >= 2


@pytest.mark.parametrize(("part", "seconds"), [(8192, 60), (15, 60), (15, 5), (4, 300)])
def test_sweeps_link_what_chains_of_pairs_connect(spark, monkeypatch, part, seconds):
    monkeypatch.setattr(H, "PART", part)
    rng = random.Random(11)
    data = [(i, rng.randrange(2000) if i % 3 else 700, rng.randrange(16), rng.randrange(64)) for i in range(200)] + [(900, None, 1, 1), (901, 5, None, 1)]
    real = [x for x in data if None not in x]
    edges = [(a[0], b[0]) for k, a in enumerate(real) for b in real[k + 1 :] if abs(a[1] - b[1]) <= seconds and bin(a[2] ^ b[2]).count("1") + bin(a[3] ^ b[3]).count("1") <= 2]
    links = H.time_links(spark.createDataFrame(data, "id long, at long, hi long, lo long"), seconds, 2)
    assert dict(rows(connected_components(links, small=10**6))) == components_of({x for e in edges for x in e}, edges)


def clustered(rng, n, clusters, width=16, wide=0.05):
    """Vectors around a few directions, some of them copies, with odd rows."""
    import numpy as np

    to = rng.normal(size=(clusters, width))
    v = to[rng.integers(0, clusters, n)] / np.sqrt(width) + wide * rng.normal(size=(n, width))
    return [(i, int(i % 3), x.tolist()) for i, x in enumerate(v)] + [(n, 0, v[0].tolist()), (n + 1, 0, None), (n + 2, 0, [0.0] * width), (n + 3, 0, [1.0, 2.0]), (n + 4, 0, [1.0, 2.1]), (0, 0, v[1].tolist())]


@pytest.mark.parametrize(("threshold", "key"), [(0.9, None), (0.5, None), (0.95, "k"), (-1.0, None)])
def test_vectors_around_pivots_lose_no_pair(spark, monkeypatch, threshold, key):
    import numpy as np

    monkeypatch.setattr(V, "PART_ROWS", 40)
    given = clustered(np.random.default_rng(3), 300, 9)
    df = spark.createDataFrame(given, "id int, k int, v array<double>")
    unit = [(i, k, np.array(v) / np.linalg.norm(v)) for i, k, v in given if v and any(v)]
    want = sorted({(min(a, b), max(a, b)) for x, (a, k, u) in enumerate(unit) for b, l, w in unit[x + 1 :] if a != b and len(u) == len(w) and (not key or k == l) and u @ w >= threshold})
    got = V.near_vectors(df, "id", "v", threshold, key)
    assert sorted({(r["left_id"], r["right_id"]) for r in got.collect()}) == want
    assert dict(rows(connected_components(V.vector_links(df, "id", "v", threshold, key), small=10**6))) == components_of({x for e in want for x in e}, want)


@pytest.mark.parametrize(("cell", "most", "threshold"), [(1024, 1 << 14, 0.3), (20, 1 << 14, 0.3), (20, 7, -1.0), (10, 50, 0.99)])
def test_nearest_references_equal_the_full_comparison(spark, monkeypatch, cell, most, threshold):
    import numpy as np

    for name, value in (("CELL", cell), ("ROWS", most), ("REFERENCES", most)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    refs = [(i, v) for i, _, v in clustered(rng, 150, 8)[:-1]]
    refs += [(i + 500, v) for i, v in refs[:30]] + [(400, [1.0, 2.0])]
    asked = [(i, v) for i, _, v in clustered(rng, 120, 9, wide=0.2)[:-1]] + [(900, refs[3][1]), (901, [1.0, 2.0, 3.0])]
    known = [(j, np.array(v) / np.linalg.norm(v)) for j, v in refs if v and any(v)]
    want = {}
    for i, v in asked:
        if v and any(v):
            u = np.array(v) / np.linalg.norm(v)
            same = [(float((u * w).sum()), j) for j, w in known if len(w) == len(u)]
            if same and (top := max(s for s, _ in same)) >= threshold:
                want[i] = {j for s, j in same if s >= top - 1e-12}
    frame = lambda x, names: spark.createDataFrame(x, names)
    got = {r["id"]: r["ref_id"] for r in V.nearest_reference(frame(asked, "i int, v array<double>"), frame(refs, "j int, v array<double>"), "i", "v", "j", threshold).collect()}
    assert got.keys() == want.keys() and all(got[i] == min(want[i]) for i in got)
    none = frame([], "j int, v array<double>")
    assert V.nearest_reference(frame(asked, "i int, v array<double>"), none, "i", "v", "j", threshold).collect() == []


def test_clusters_compare_fewer_than_all_pairs(spark, monkeypatch):
    """The share of pairs that meet falls as clustered vectors grow; vectors without clusters meet all."""
    import numpy as np

    monkeypatch.setattr(V, "PART_ROWS", 50)
    shares = []
    for n in (500, 1000, 2000, 4000):
        df = spark.createDataFrame(clustered(np.random.default_rng(4), n, n // 50, 32, 0.03), "id int, k int, v array<double>")
        shares.append(V.compared(V.dealt(df, "id", "v", 0.9)) / (n * (n - 1) / 2))
    print("share of pairs compared:", [round(s, 3) for s in shares])
    assert shares[3] < shares[2] < shares[1] < 1 and shares[3] < 0.2


def test_near_vectors_blocks_lose_no_pair(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(90, [0.0] * 4), (91, None)]
    df = spark.createDataFrame(data, "id int, v array<double>")
    one, many = V.near_vectors(df, "id", "v", 0.8, blocks=1), V.near_vectors(df, "id", "v", 0.8, blocks=5)
    assert [r[:2] for r in rows(one)] == [r[:2] for r in rows(many)] and one.count() > 10


def files(n, seed):
    rng = random.Random(seed)
    base = [[rng.randrange(2) for _ in range(64)] for _ in range(3)]
    out, t = [], 1000.0
    for i in range(n):
        t += rng.choice([0.5, 1.0, 2.0, 8.0])
        bits = [int(b ^ (rng.random() < 0.03)) for b in base[rng.randrange(3)]]
        out.append((f"/{rng.choice('ab')}/{i:03d}.jpg", i, bits, t, rng.randrange(1, 5), rng.randrange(1, 5), rng.randrange(100), float(i)))
    return out


FILES = "file_path string, ordinal int, bits array<int>, at double, width int, height int, file_size long, mtime double"


@pytest.mark.parametrize("seed", range(2))
def test_visual_groups_equal_the_loop(spark, seed):
    data, far = files(40, seed), max_distance(0.90)
    taken, want = set(), {}
    for i, a in enumerate(data):
        if i in taken:
            continue
        group = [j for j in range(i + 1, len(data)) if j not in taken and sum(p != q for p, q in zip(a[2], data[j][2], strict=True)) <= far]
        if group:
            taken |= {i, *group}
            want[i] = sorted([a[0], *(data[j][0] for j in group)])
    got = D.visual_members(spark.createDataFrame(data, FILES), 0.90).groupBy("group_id").agg(F.sort_array(F.collect_list("file_path")).alias("m"))
    assert sorted(r["m"] for r in got.collect()) == sorted(want.values())


@pytest.mark.parametrize("seed", range(2))
def test_anchored_bursts_equal_the_loop(spark, seed):
    data, far = files(60, seed), max_distance(0.85)
    want = {}
    for folder in "ab":
        anchor = None
        for path, _, bits, t, *_ in sorted((x for x in data if x[0][1] == folder), key=lambda x: (x[3], x[0])):
            if anchor is None or t - anchor[1] > 3 or sum(p != q for p, q in zip(bits, anchor[2], strict=True)) > far:
                anchor = (path, t, bits)
            want[path] = anchor[0]
    df = spark.createDataFrame(data, FILES).withColumn("h", halves("bits")).select(F.substring("file_path", 2, 1).alias("folder"), "at", "file_path", "h.hi", "h.lo")
    assert dict(rows(Q.anchored_bursts(df, 3.0, 0.85))) == want


@pytest.mark.parametrize("seed", range(3))
def test_match_or_register_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    vec = lambda: [x + rng.gauss(0, 0.4) for x in centre[rng.randrange(4)]]
    registry = [(f"R{i}", i, vec(), i % 2 == 0) for i in range(4)]
    new = [(i, None if i == 7 else vec(), rng.choice([0.5, 0.9])) for i in range(30)]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    def best(v, pool):
        found = None
        for name, w in pool:
            if found is None or cos(v, w) > found[0]:
                found = (cos(v, w), name)
        return found

    refs, cands, want = [(r[0], r[2]) for r in registry if r[3]], [(r[0], r[2]) for r in registry if not r[3]], {}
    count = 0
    for i, v, c in new:
        name = None
        for pool in (refs, cands):
            b = best(v, pool) if v is not None else None
            if name is None and b and b[0] >= 0.7 and c >= 0.7:
                name = b[1]
        if name is None:
            count += 1
            name = f"FACE_ID_{count:02d}"
            if v is not None:
                cands = [*cands, (name, v)]
        want[i] = name
    f = spark.createDataFrame(new, "ordinal int, embedding array<double>, confidence double")
    g = spark.createDataFrame(registry, "face_id string, seq int, embedding array<double>, is_reference boolean")
    assert dict(rows(P.match_or_register(f, g))) == want


def test_face_groups_keep_faces_alone(spark):
    data = [(1, [1.0, 0.0], 10), (2, [0.99, 0.1], 20), (3, [0.0, 1.0], 5), (4, None, 1)]
    got = dict(rows(P.face_groups(spark.createDataFrame(data, "face_id int, embedding array<double>, created_at int"), 0.7)))
    assert got == {1: 2, 2: 2, 3: 3}


@pytest.mark.parametrize("most", [7, 1000])
def test_leader_rounds_equal_the_greedy_loop_and_make_no_pairs(spark, monkeypatch, most):
    """Neither groups of signatures nor of faces make a table of all close pairs."""
    import numpy as np
    from tessella.operators import leaders as L

    def pairs(*_, **__):
        raise AssertionError("all close pairs are made")

    for module, name in ((D, "near_hashes"), (P, "near_vectors"), (D, "leader_groups"), (P, "leader_groups")):
        monkeypatch.setattr(module, name, pairs)
    monkeypatch.setattr(L, "RANK_BITS", 2)
    monkeypatch.setattr(L, "BLOCK", 5)
    monkeypatch.setattr(L, "TILE", 8)
    monkeypatch.setattr(L, "LEADERS", 3)
    monkeypatch.setattr(H, "PASS_SIGNATURES", most)
    monkeypatch.setattr(V, "PASS_VECTORS", most)
    rng = np.random.default_rng(most)

    def greedy(items, near):
        lead: dict = {}
        for i, x in items:
            lead[i] = next((j for j, y in items if lead.get(j) == j and near(x, y)), i)
        return lead

    v = {i: rng.normal(size=3 + i % 5 // 4) for i in range(120)} | {500: np.zeros(3)}
    order = sorted(v, key=lambda i: (-(i % 40), i))
    want = greedy([(i, v[i]) for i in order], lambda a, b: len(a) == len(b) and a.any() and b.any() and a @ b >= 0.7 * np.linalg.norm(a) * np.linalg.norm(b))
    data = [(i, x.tolist(), i % 40) for i, x in v.items()] + [(900, None, 1)]
    assert dict(rows(P.face_groups(spark.createDataFrame(data, "face_id int, embedding array<double>, created_at int"), 0.7))) == want
    bits = {i: tuple(rng.integers(0, 2, 64).tolist()) for i in range(100)}
    bits |= {i: bits[i - 100] for i in range(100, 110)}
    lead = greedy(list(bits.items()), lambda a, b: sum(p != q for p, q in zip(a, b, strict=True)) <= max_distance(0.55))
    sizes = {k: list(lead.values()).count(k) for k in lead.values()}
    photos = [(f"p{i}", i, list(b)) for i, b in bits.items()]
    got = D.visual_members(spark.createDataFrame(photos, "file_path string, ordinal int, bits array<int>"), 0.55).select("ordinal", "group_id")
    assert dict(rows(got)) == {i: f"visual_{k}" for i, k in lead.items() if sizes[k] > 1}


def test_duplicate_sets(spark):
    data = [(1, 0, 0, 0), (2, 5, 0, 0), (3, 12, 0, 15), (4, 15, 2**32 - 1, 2**32 - 1), (5, 300, 0, 0), (6, None, 0, 0)]
    got = dict(rows(D.duplicate_sets(spark.createDataFrame(data, "id int, at long, hi long, lo long"), 15, 12)))
    assert got == {1: "dup_group_001", 2: "dup_group_001", 3: "dup_group_001"}


def test_chain_and_propagation(spark):
    data = [("f", 100, "a", 0, 0, "burst_1.jpg", "text"), ("f", 102, "b", 2**32 - 1, 0, "BURST_2.jpg", None), ("f", 104, "c", 0, 0, "other.jpg", "own"), ("g", 103, "d", 0, 0, "burst_9.jpg", None)]
    b = Q.chain_bursts(spark.createDataFrame(data, "folder string, at long, id string, hi long, lo long, name string, summary string"), 5, 0.8, "burst|series")
    got = {r["id"]: (r["summary"], r["burst_primary"], r["similar_files_count"]) for r in D.propagated(b).collect()}
    assert got == {"a": ("text", None, None), "b": ("text", "a", 2), "c": ("own", None, None), "d": (None, None, None)}


@pytest.mark.parametrize(("strategy", "first"), [("highest_resolution", "/2"), ("largest_file_size", "/1"), ("newest", "/2"), ("oldest", "/1"), ("?", "/2")])
def test_ranking(spark, strategy, first):
    data = [(1, "/1", 1000, 1000, 500, 10.0), (1, "/2", 2000, 2000, 400, 20.0)]
    df = spark.createDataFrame(data, "g int, file_path string, width int, height int, file_size long, mtime double")
    assert R.ranked(df, ["g"], strategy).where("rank = 1").first()["file_path"] == first


@pytest.mark.parametrize(("seconds", "want"), [([], []), ([5], [(5, 5)]), ([1, 3], [(1, 3)]), ([1, 2, 10, 11, 75, 75], [(1, 2), (10, 11), (75, 75)])])
def test_intervals(spark, seconds, want):
    df = spark.createDataFrame([("a", s) for s in seconds], "k string, s int")
    assert rows(R.intervals(df, ["k"], "s", 2).select("interval_start", "interval_end")) == want


def test_numbering_is_in_order(spark):
    df = spark.range(1500).select((F.col("id") * 7919 % 1500).alias("k"))
    got = R.numbered(df, ["k"], "g").orderBy("k").collect()
    assert [r["group_id"] for r in got] == [f"g{i + 1:03d}" for i in range(1500)]


def test_next_id(spark):
    assert R.next_id(spark.createDataFrame([], "i string"), "i", "FACE_ID_").first()[0] == "FACE_ID_01"
    assert R.next_id(spark.createDataFrame([("FACE_ID_01",), ("x",), ("FACE_ID_9",)], "i string"), "i", "FACE_ID_").first()[0] == "FACE_ID_10"


def test_need_processing(spark):
    f = spark.createDataFrame([("new", 1, 1.0, "photo", True), ("same", 5, 10.0, "photo", True), ("size", 6, 10.0, "photo", True), ("time", 5, 10.5, "photo", True), ("failed", 5, 10.0, "photo", True), ("bare", 5, 10.0, "photo", False), ("unknown", 0, 0.0, "video", True)],
                              "file_path string, file_size long, mtime double, media_type string, sidecar boolean").withColumn("modules", F.create_map(F.lit("faces"), F.lit(True)))
    h = spark.createDataFrame([(p, "FAILED" if p == "failed" else "PROCESSED", 5, 10.005) for p in ("same", "size", "time", "failed", "bare", "unknown")], "file_path string, status string, file_size long, mtime double")
    need = lambda *m, **k: {r["file_path"] for r in R.need_processing(f, h, m, **k).where("need").collect()}
    assert need("faces", "transcribe") == {"new", "size", "time", "failed", "bare", "unknown"}  # speech counts for videos
    assert need("faces") == {"new", "size", "time", "failed", "bare"} and len(need(force=True)) == 7


def catalogue(spark):
    t = datetime.datetime
    items = spark.createDataFrame([("1", "/a", "photo", "Canon X", t(2024, 1, 1), None, "PROCESSED"), ("2", "/b", "photo", "Nikon", t(2024, 1, 2), None, "PROCESSED"), ("3", "/c", "video", None, None, None, "PROCESSED"), ("4", "/d", "photo", "Canon", t(2024, 1, 3), None, "PENDING")],
                                  "media_id string, file_path string, media_type string, camera string, media_date timestamp, created_at timestamp, status string")
    faces = spark.createDataFrame([("1", "Ann"), ("1", "bob "), ("2", "ANN"), ("3", "Ann"), ("3", "Bob")], "media_id string, name string")
    tags = spark.createDataFrame([("1", "food", "general"), ("2", "Sea", "nature")], "media_id string, tag string, category string")
    texts = spark.createDataFrame([("1", "alps hiking alps"), ("2", "the beach"), ("3", "Hikers in the Alps and more words")], "media_id string, text string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.6, 0.8]), ("3", [0.0, 0.0])], "media_id string, embedding array<float>")
    return items, faces, tags, S.text_index(texts, "media_id", ["text"]), vectors


@pytest.mark.parametrize(("query", "want"), [
    ({}, ["2", "1", "3"]), ({"persons": ["Ann", " bob", "ANN"]}, ["1", "3"]), ({"persons": ["ann", "bob"], "media_type": "video"}, ["3"]), ({"wanted_tags": ["sea", "FOOD", ""]}, ["2", "1"]),
    ({"query_text": "alp hik"}, ["1", "3"]), ({"query_text": "a x"}, ["2", "1", "3"]), ({"query_text": "nothing"}, []), ({"camera": "canon"}, ["1"]),
    ({"date_from": "2024-01-02", "date_to": "2024-01-02"}, ["2"]), ({"limit": 1, "offset": 1}, ["1"]), ({"query_vector": [1.0, 0.0], "query_text": "beach"}, ["1", "2", "3"]), ({"media_type": "audio"}, ["2", "1", "3"]),
])
def test_hybrid_search(spark, query, want):
    page, total = S.hybrid_search(*catalogue(spark), **query)
    assert [r["media_id"] for r in page.collect()] == want
    assert total.first()["total"] == (3 if "limit" in query else len(want))


def test_better_matches_score_higher(spark):
    page, _ = S.hybrid_search(*catalogue(spark), query_text="alps", by_score=True)
    got = page.collect()
    assert [r["media_id"] for r in got] == ["1", "3"] and got[0]["score"] >= got[1]["score"] and len(got[0]["persons"]) == 2


def test_vector_of_another_length_is_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="length"):
        vector_search(df, "id", "v", [1.0], 1).collect()
    with pytest.raises(ValueError, match="no numbers"):
        vector_search(df, "id", "v", [], 1)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, o int")
    assert rows(U.upserted(old, new, ["k"], "o").select("k", "v")) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(U.upserted(old, new, ["k"], "o", keep_old=["v"]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(U.inserted(old, new, ["k"], [F.col("o")]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(U.children_replaced(old, new, "k", old.where("k = 1").select("k")).select("k", "v")) == [(2, "c"), (2, "d"), (3, "e")]


def test_last_change_of_a_face_counts(spark):
    f = spark.createDataFrame([("1", "a", True), ("2", "b", True), ("3", "c", False)], "face_id string, name string, is_reference boolean")
    c = spark.createDataFrame([("1", "delete", None, 1), ("1", "assign", "Z", 2), ("2", "assign", "Y", 1), ("2", "delete", None, 2)], "face_id string, op string, name string, seq int")
    assert rows(U.renamed(f, c)) == [("1", "Z", True), ("3", "c", False)]


def test_resets_by_file_name(spark):
    f = spark.createDataFrame([("1", "a", "a", True, "/p/IMG_1.jpg"), ("2", "b", "b", True, "/q/img_12.jpg"), ("3", "c", "c", False, None)], "face_id string, name string, person_id string, is_reference boolean, source_file string")
    assert rows(U.resets_by_file(f, ["/z/img_1.JPG ", "", "  "], 1).select("face_id")) == [("1",)]
    assert rows(U.resets_by_file(f, ["img_1"], 1).select("face_id")) == [("1",), ("2",)]
    assert U.resets_by_file(f, [], 1).count() == 0
    assert rows(U.renamed(f, U.resets_by_file(f, ["img_1."], 1)).select("face_id", "person_id", "is_reference")) == [("1", "1", False), ("2", "b", True), ("3", "c", False)]


def test_manual_faces_take_a_sample(spark):
    r = spark.createDataFrame([("f2", "Ann", "/b.jpg", [2.0]), ("f1", "Ann", "", [1.0]), ("f3", "Ann", "/c.jpg", [3.0]), ("f4", "Bob", None, [4.0])], "face_id string, name string, image_path string, embedding array<double>")
    links = spark.createDataFrame([("m1", " Ann "), ("m2", "Bob"), ("m3", " "), ("m4", None)], "media_id string, name string")
    got = U.manual_faces(links, r)
    assert rows(got.select("media_id", "name", "image_path", "confidence", "is_reference").fillna("")) == [("m1", "Ann", "/b.jpg", 1.0, True), ("m2", "Bob", "", 1.0, True)]
    assert got.where("name = 'Ann'").first()["embedding"] == [2.0] and got.where("name = 'Bob'").first()["embedding"] is None
    assert U.linked(got.select("media_id", "face_id", "name"), links, r).count() == 2  # linked already


def test_faces_of_files(spark):
    ask = spark.createDataFrame([("/x/A.jpg",), ("/x/b.jpg",), ("/x/none.jpg",), (None,)], "file string")
    items = spark.createDataFrame([("1", "/p/a.jpg"), ("2", "/q/a.JPG"), ("3", "/p/b.jpg")], "id string, file_path string")
    held = spark.createDataFrame([("1", "f", "n", 0.4), ("2", "f", "m", 0.8), ("2", "g", "k", None)], "media_id string, face_id string, name string, confidence double")
    known = spark.createDataFrame([("r", "z", 0.1, "/o/B.jpg"), ("s", "z", 0.2, "/o/a.jpg")], "face_id string, name string, confidence double, source_file string")
    assert sorted((tuple(r) for r in P.faces_of_files(ask, items, held, known).collect()), key=str) == sorted([("/x/A.jpg", "f", "m", 0.8, "items"), ("/x/A.jpg", "g", "k", None, "items"), ("/x/b.jpg", "r", "z", 0.1, "registry")], key=str)


def test_sources_as_first_seen(spark):
    f = spark.createDataFrame([(1, "a", "", None, "1", "s"), (2, "a", "/i", 0.5, "2", "t"), (3, "a", None, 0.7, "3", "s"), (4, "a", "/i", 0.5, "0", None), (5, "b", None, None, None, "")],
                              "face_id int, g string, image_path string, confidence double, created_at string, source_file string")
    assert rows(P.cluster_summary(f, "g")) == [("a", 2, 4, 0.567, "s,t"), ("b", 5, 1, 1.0, "")]


def test_snapshots_are_not_overwritten(spark, tmp_path):
    U.swap_snapshot(spark, spark.range(1), str(tmp_path), 1)
    with pytest.raises(Exception, match=r"(?i)exist"):
        U.swap_snapshot(spark, spark.range(1), str(tmp_path), 1)


def test_scan_and_sidecars(spark, tmp_path):
    for name in ("a/x.JPG", "a/vault/y.png", "b/z.mp4", "b/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = {r["path"].rsplit("/", 1)[1]: (r["file_size"], r["media_type"]) for r in C.scanned(spark, [str(tmp_path)]).collect()}
    assert got == {"x.JPG": (5, "photo"), "z.mp4": (5, "video")}
    assert C.scanned(spark, [str(tmp_path)], vault=True).count() == 3
    side = tmp_path / "side"
    side.mkdir()
    (side / "1.json").write_text(json.dumps({"file_path": "/p/a.jpg", "mtime": 5.0, "tags": [{"tag": "Sea", "category": "Nature", "confidence": 0.5}], "extra": 1, "faces": [{"face_id": "f1", "name": "", "confidence": 0.5}, {"face_id": "f2", "name": "Ann"}, {"name": "x"}], "gemini_analysis": {"weather": "rain", "summary_ru": "s", "lighting": ""}}, indent=1))
    (side / "2.json").write_text('{"file_path": "/p/b.jpg", ')
    docs = C.sidecars(spark, str(side))
    assert {(r["file_path"], r["_corrupt_record"] is None) for r in docs.collect()} == {("/p/a.jpg", True), (None, False)} or docs.where("_corrupt_record is not null").count() == 1
    t = C.ingested(docs)
    assert rows(t.faces.select("face_id", "name", "confidence")) == [("f1", "f1", 0.5), ("f2", "Ann", None)]
    m = t.metadata.where("raw_analysis is not null").first()
    assert (m["weather"], m["summary_ru"], m["lighting"], m["raw_exif"], json.loads(m["raw_analysis"])) == ("rain", "s", None, None, {"weather": "rain", "summary_ru": "s", "lighting": ""})
    assert rows(t.tags.select("tag", "category")) == [("sea", "nature")] and t.items.first()["media_type"] == "photo"
    C.write_sidecars(t.items, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == t.items.count()


def test_manifest_needs_a_path(spark):
    with pytest.raises(ValueError, match="no column"):
        C.manifest(spark.range(1))
    m = C.manifest(spark.createDataFrame([("", "/x/y.jpg", 1), (None, None, 2)], "file_path string, file string, n int"))
    assert rows(m) == [("/x/y.jpg", "y.jpg", 1)]


def test_streams(spark, tmp_path):
    schema = "k string, at timestamp, status string, n int"
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", t(0), "x", 1), ("a", t(5), "y", 2), ("b", t(100), "x", 3)], schema).coalesce(1).write.parquet(src)
    q = K.ingest(K.file_stream(spark, src, schema), str(tmp_path / "snap"), str(tmp_path / "c1"), ["k"], ["n"])
    q.awaitTermination()
    assert rows(G.rows_of(spark, str(tmp_path / "snap"), schema).select("k", "n")) == [("a", 2), ("b", 3)]
    spark.createDataFrame([("a", t(3000), "z", 9)], schema).coalesce(1).write.mode("append").parquet(src)
    q = K.ingest(K.file_stream(spark, src, schema), str(tmp_path / "snap"), str(tmp_path / "c1"), ["k"], ["n"])
    q.awaitTermination()
    assert rows(G.rows_of(spark, str(tmp_path / "snap"), schema).select("k", "n")) == [("a", 9), ("b", 3)]
    out = K.finished(K.bursts(K.file_stream(spark, src, schema), "at", "k", "60 seconds", "10 seconds"), str(tmp_path / "o"), str(tmp_path / "c2"))
    assert [r["n"] for r in out.orderBy("burst_start").collect()] == [2, 1]
    spark.createDataFrame([("a", t(1), "late", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    out = K.finished(K.bursts(K.file_stream(spark, src, schema), "at", "k", "60 seconds", "10 seconds"), str(tmp_path / "o"), str(tmp_path / "c2"))
    assert sum(r["n"] for r in out.where("burst_start < '2024-01-01 00:01:00'").collect()) == 2  # the late row is dropped


def test_bursts_of_equal_file_names_stay_apart(spark):
    bits = [0] * 64
    data = [(f"/{f}/IMG_{k}.jpg", bits, 100.0 + k + 8000 * (f == "b")) for f in "ab" for k in (1, 2)]
    files = spark.createDataFrame(data, "file_path string, bits array<int>, at double").selectExpr(
        "*", "1L as ordinal", "file_path as content_hash", "10 as width", "10 as height", "100L as file_size", "1.0D as mtime", "'photo' as media_type")
    got = sorted((r["group_id"], r["primary"], r["n_members"]) for r in D.group_rows(D.burst_members(files, 3.0, 0.9, "newest"), "newest").collect())
    assert [(g, n) for g, _, n in got] == [("burst_IMG_1", 2)] * 2 or len(got) == 2 and all(n == 2 for _, _, n in got)
    assert {p.split("/")[1] for _, p, _ in got} == {"a", "b"}
    report = D.duplicate_report(files, "burst", 0.9, 3.0, "newest").collect()
    assert sorted(r["n_members"] for r in report) == [2, 2]


@pytest.mark.parametrize("pass_edges", [200_000, 3])
def test_leaders_of_a_long_chain(spark, pass_edges):
    n = 1000 if pass_edges > 3 else 12
    nodes = spark.range(n).selectExpr("id as node", "id as ordinal")
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    assert dict(rows(leader_groups(nodes, edges, pass_edges))) == {i: i - i % 2 for i in range(n)}


def test_duplicate_sets_equal_the_loop(spark):
    rng = random.Random(5)
    base = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(6)]
    data = []
    for i in range(150):
        hi, lo = rng.choice(base)
        for _ in range(rng.randrange(4)):
            hi ^= 1 << rng.randrange(32)
        data.append((i, rng.randrange(0, 3000), hi, lo))
    near = lambda x, y: abs(x[1] - y[1]) <= 60 and bin(x[2] ^ y[2]).count("1") + bin(x[3] ^ y[3]).count("1") <= 3
    label = list(range(150))
    for _ in range(150):
        new = [min([label[j] for j in range(150) if j == i or near(data[i], data[j])]) for i in range(150)]
        if new == label:
            break
        label = new
    want = {frozenset(i for i in range(150) if label[i] == k) for k in set(label)}
    got: dict = {}
    for r in D.duplicate_sets(spark.createDataFrame(data, "id long, at long, hi long, lo long"), 60, 3).collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert {frozenset(x) for x in got.values()} == {x for x in want if len(x) > 1}


def test_duplicate_sets_link_cells_not_rows(spark, monkeypatch):
    """rows of one signature and one window are one node of the graph, however many they are."""
    seen = []
    real = D.connected_components
    monkeypatch.setattr(D, "connected_components", lambda edges, **k: (seen.append(edges.count()), real(edges, **k))[1])
    data = [(i, i // 100 - 15, 0, i % 2) for i in range(3000)] + [(5000 + i, 1000 + i, 0, 15 * i) for i in range(2)] + [(6000, 2000, 0, 0), (6001, 2060, 0, 0), (6002, 2122, 0, 0), (6003, 2122, 0, 0)]
    got = dict(rows(D.duplicate_sets(spark.createDataFrame(data, "id long, at long, hi long, lo long"), 60, 3)))
    assert seen[0] <= 10
    twice = [(1, 0, 0, 0), (2, 10, 0, 0), (2, 900, 0, 0), (3, 910, 0, 0), (0, 5000, 0, 0), (0, 5001, 0, 0)]
    assert sorted(rows(D.duplicate_sets(spark.createDataFrame(twice, "id long, at long, hi long, lo long"), 60, 3))) == [(i, "dup_group_001") for i in (1, 2, 3)]
    want = {i: "dup_group_001" for i in range(3000)} | {6000: "dup_group_002", 6001: "dup_group_002", 6002: "dup_group_003", 6003: "dup_group_003"}
    assert got == want


def test_a_batch_with_errors_is_given_as_one(spark):
    """rows of a batch that raises are tried one by one, but are no batches of their own."""
    import pandas as pd

    class Items:
        schema = spark.createDataFrame([], "id int, text string").schema

        def mapInPandas(self, run, whole):
            self.run = run
            return spark.createDataFrame([], whole)

    def analyse(rows):
        if (rows["id"] % 10 == 3).any():
            raise TimeoutError(f"timed out at {rows['id'].iloc[0]}" if len(rows) == 1 else "timed out")
        return pd.DataFrame({"size": rows["text"].str.len(), "upper": rows["text"].str.upper()})

    data = [(i, "a" * i if i else None) for i in range(40)]
    items = Items()
    C.enriched(items, analyse, "size bigint, upper string")
    (batch,) = items.run(iter([pd.DataFrame(data, columns=["id", "text"])]))
    assert batch["error"].tolist() == [f"timed out at {i}" if i % 10 == 3 else None for i in range(40)]
    got = C.enriched(spark.createDataFrame(data, "id int, text string").coalesce(1), analyse, "size bigint, upper string")
    want = [(i, None if i % 10 == 3 or not i else i, None if i % 10 == 3 or not i else "A" * i, "network" if i % 10 == 3 else None) for i in range(40)]
    assert sorted(rows(got.select("id", "size", "upper", "error_class"))) == want


def test_nearest_references_need_little_memory():
    """neither the angles to all pivots nor the cosines of all references are there for many rows at once."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    vectors = lambda n: V._matrix(pa.array((lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8))).tolist()), 8)
    refs, asked = vectors(8192), vectors(1024)
    table = lambda m, name: pa.table({name: pa.array(range(len(m))), "n": pa.array([8] * len(m)), "u": pa.array(m.tolist())})
    q, r = table(asked, "id"), table(refs, "ref_id")
    tracemalloc.start()
    got = V._best_in(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("ref_id").to_pylist() == (asked @ refs.T).argmax(axis=1).tolist()
    assert peak < 30e6


def test_sidecars_are_written_unsorted(spark, tmp_path):
    """a task that writes documents into folders holds no sorted run of them."""
    docs = spark.createDataFrame([(i, "photo" if i % 2 else None) for i in range(20)], "id int, media_type string").coalesce(1)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    C.write_sidecars(docs, str(tmp_path / "docs"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert "Sort" not in plans.last().physicalPlanDescription() and str(tmp_path / "docs") in plans.last().physicalPlanDescription()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "docs")).collect()) == list(range(20))


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return round(12742.0176 * math.asin(math.sqrt(min(1, h))), 6)


@pytest.mark.parametrize("cell", [1024, 2])
def test_nearest_place_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL", cell)
    rng = random.Random(8)
    spot = lambda: (rng.uniform(-89, 89), rng.uniform(-180, 180))
    points = [(i, *spot()) for i in range(60)] + [(100, 10.0, 179.9), (101, 89.9, 0.0), (102, None, 1.0), (103, float("nan"), 1.0), (104, 5.0, 5.0), (104, 10.0, 179.9)]
    places = [(*spot(), k) for k in range(15)] + [(10.0, -179.9, 50), (89.9, 179.0, 51), (10.0, -179.9, 49), (10.0, 180.1, 48), (None, 2.0, 1)]
    got = {r["i"]: r["place"] for r in N.nearest_place(spark.createDataFrame(points, "i int, lat double, lon double"), spark.createDataFrame(places, "lat double, lon double, place int"), "i").collect()}
    real = [p for p in places if p[0] is not None]
    want = {i: None if a is None or a != a else min((km(a, b, c, d), k) for c, d, k in real)[1] for i, a, b in points[:-2]}
    assert got == want | {104: min((km(a, b, c, d), k) for i, a, b in points[-2:] for c, d, k in real)[1]}
    none = spark.createDataFrame(places[:0], "lat double, lon double, place int")
    assert {r["place"] for r in N.nearest_place(spark.createDataFrame(points, "i int, lat double, lon double"), none, "i").collect()} == {None}


def test_far_points_and_dense_places(spark):
    """Many points far from all places: few cells are near enough to be asked, and none has all points and places."""
    rng = random.Random(9)
    points = [(i, 40 + rng.random(), 10 + rng.random()) for i in range(20_000)]
    places = [(-30 + rng.random(), 150 + rng.random(), k) for k in range(4000)]
    began = time.monotonic()
    got = {r["i"]: r["place"] for r in N.nearest_place(spark.createDataFrame(points, "i int, lat double, lon double"), spark.createDataFrame(places, "lat double, lon double, place int"), "i").collect()}
    assert time.monotonic() - began < 30
    assert all(got[i] == min((km(a, b, c, d), k) for c, d, k in places)[1] for i, a, b in points[::1000])




def texts(rng, ids):
    return [(i, " ".join(rng.choice(["alpha", "alps", "beta", "betas", "gamma", "x", "Älpen", "9"]) for _ in range(rng.randrange(0, 60)))) for i in ids]


def bm25(spark, given, text):
    df = spark.createDataFrame(given, "id int, text string")
    return {r["id"]: round(r["bm25"], 9) for r in S.text_matches(S.text_index(df, "id", ["text"]), text).collect()}


def test_a_stored_index_reads_the_files_of_its_words(spark, tmp_path):
    given = texts(random.Random(1), range(300)) + [(900, None), (901, "")]
    index = T.build_index(spark.createDataFrame(given, "id int, text string"), "id", ["text"], str(tmp_path / "i"))
    for text in ("alpha be", "a", "x9 ga älp zz"):
        assert {r["id"]: round(r["bm25"], 9) for r in index.matches(text).collect()} == bm25(spark, given, text)
    plan = index.matches("alpha be")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "lead" in plan.split("PartitionFilters")[1][:80] and "StringStartsWith(term,alpha)" in plan
    read = T.word_blocks(index, ["alpha", "be"]).inputFiles()
    assert set(f.split("lead=")[1][0] for f in T.word_blocks(index, ["alpha"]).where("lead = 'a'").inputFiles()) <= set("abgxÄä9") and read
    assert {r["term"]: r["df"] for r in index.table("terms").collect()} == {r["term"]: r["df"] for r in index.terms().collect()}
    with pytest.raises(ValueError, match="unique"):
        T.build_index(spark.createDataFrame([(1, "a"), (1, "b")], "id int, text string"), "id", ["text"], str(tmp_path / "j"))
    nothing = T.build_index(spark.createDataFrame([], "id int, text string"), "id", ["text"], str(tmp_path / "k"))
    assert nothing.matches("alpha").collect() == [] == T.top_matches(nothing, "alpha", 3).collect()


def test_appended_documents_are_found_and_replace_old_ones(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    old, new, third = texts(rng, range(120)), texts(rng, range(100, 160)), texts(rng, range(500, 510))
    frame = lambda x: spark.createDataFrame(x, "id int, text string")
    index = T.build_index(frame(old), "id", ["text"], str(tmp_path / "i"))
    two = T.append_documents(index, frame(new), "id", ["text"])
    three = T.append_documents(two, frame(third), "id", ["text"])
    one = T.merge_segments(three)
    now = list((dict(old) | dict(new) | dict(third)).items())
    for text in ("alpha be",):
        want = bm25(spark, now, text)
        for version in (three, one, T.open_index(spark, str(tmp_path / "i"))):
            assert {r["id"]: round(r["bm25"], 9) for r in version.matches(text).collect()} == want
        assert {r["id"]: round(r["bm25"], 9) for r in index.matches(text).collect()} == bm25(spark, old, text)  # as it was
    assert len(one.segments) == 1 and one.documents == len(now) and {tuple(r) for r in one.terms().collect()} == {tuple(r) for r in three.terms().collect()}
    # a segment that was written but never published is no part of the index, and in nobody's way
    with monkeypatch.context() as m:
        m.setattr(T, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            T.append_documents(one, frame(texts(rng, range(700, 710))), "id", ["text"])
    assert T.open_index(spark, str(tmp_path / "i")).version == one.version
    assert T.append_documents(one, frame([(800, "alpha")]), "id", ["text"]).documents == len(now) + 1


def test_top_matches_equal_all_matches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "FIRST", 2)
    given = texts(random.Random(3), range(250))
    index = T.append_documents(T.build_index(spark.createDataFrame(given[:200], "id int, text string"), "id", ["text"], str(tmp_path / "i")), spark.createDataFrame(given[150:], "id int, text string"), "id", ["text"])
    want = sorted(bm25(spark, given, "alpha be").items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 10, 1000):
        assert [(r["id"], round(r["bm25"], 9)) for r in T.top_matches(index, "alpha be", k).collect()] == want[:k]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def photos(rng, n, step, folders="aaab"):
    """Photos in order of time, nearly all in one folder; hashes change now and then."""
    at, hash_, out = 0.0, (0, 0), []
    for i in range(n):
        at += rng.choice(step)
        if rng.random() < 0.2:
            hash_ = (rng.getrandbits(32), rng.getrandbits(32))
        out.append((rng.choice(folders), at, f"p{i:05d}", hash_[0] ^ rng.getrandbits(2), hash_[1], rng.choice(["burst_1", "IMG"])))
    return out


@pytest.mark.parametrize(("step", "similarity", "pattern"), [([0, 1, 2], 0.9, None), ([0.5], None, None), ([1, 9], 0.8, "burst"), ([1], 0.0, None), ([1, 2], None, "burst"), ([0, 1, 6], 1.0, None)])
def test_chains_go_on_over_ranges(spark, many_ranges, step, similarity, pattern):
    data = photos(random.Random(13), 700, step) + [(None, 1.0, "n1", 0, 0, "x"), (None, 1.5, "n2", 0, 0, "burst"), ("a", None, "n3", None, None, None), ("a", None, "n4", 1, 1, None)]
    want, size = {}, {}
    for folder in ("a", "b", None):
        before, start = None, None
        for f, at, i, hi, lo, name in sorted((x for x in data if x[0] == folder), key=lambda x: (x[1] is not None, x[1], x[2])):
            on = before is not None and None not in (at, before[1]) and at - before[1] <= 5 and folder is not None
            if on and (similarity is not None or pattern):
                alike = similarity is not None and None not in (hi, before[3]) and (64 - bin(hi ^ before[3]).count("1") - bin(lo ^ before[4]).count("1")) / 64 >= similarity
                on = alike or bool(pattern and pattern in (name or "") and pattern in (before[5] or ""))
            start = start if on else i
            want[i], before = start, (f, at, i, hi, lo, name)
            size[start] = size.get(start, 0) + 1
    df = spark.createDataFrame(data, "folder string, at double, id string, hi long, lo long, name string").where("folder is not null")
    got = {r["id"]: (r["burst"], r["burst_size"]) for r in Q.chain_bursts(df, 5, similarity, pattern).collect()}
    assert got == {i: (b, size[b]) for i, b in want.items() if i not in ("n1", "n2")}


@pytest.mark.parametrize(("step", "window"), [([0, 1, 2], 3.0), ([0.5], 20.0), ([0.25, 1], 1000.0), ([5], 3.0)])
def test_series_go_on_over_ranges(spark, many_ranges, step, window):
    data = photos(random.Random(14), 700, step)
    want = {}
    for folder in "ab":
        anchor = None
        for _, at, path, hi, lo, _ in sorted((x for x in data if x[0] == folder), key=lambda x: (x[1], x[2])):
            if anchor is None or at - anchor[0] > window or bin(hi ^ anchor[1]).count("1") + bin(lo ^ anchor[2]).count("1") > 6:
                anchor = (at, hi, lo, path)
            want[path] = anchor[3]
    df = spark.createDataFrame([x[:5] for x in data], "folder string, at double, file_path string, hi long, lo long")
    assert dict(rows(Q.anchored_bursts(df, window, 0.9))) == want


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "t"), "k long, v long, x string"
    frame = lambda x: spark.createDataFrame(x, schema)
    now = lambda: {r["k"]: (r["v"], r["x"]) for r in G.rows_of(spark, folder, schema).collect()}
    assert now() == {}
    assert G.merge_into(frame([(i, 1, "a") for i in range(100)]), folder, 0, ["k"], ["v"], 16) == 16
    assert G.merge_into(frame([(3, 2, "b"), (3, 5, "c"), (200, 1, "n")]), folder, 1, ["k"], ["v"]) <= 2
    assert G.merge_into(frame([(3, 4, "late")]), folder, 2, ["k"], ["v"]) == 1
    want = {i: (1, "a") for i in range(100)} | {3: (5, "c"), 200: (1, "n")}
    assert now() == want
    written = [len(list((tmp_path / "t" / "data" / f"version={v}").glob("bucket=*"))) for v in (0, 1, 2)]
    assert written[0] == 16 and written[1] <= 2 and written[2] == 1
    # lost between the files and the manifest: nothing is seen; the same batch again makes it whole
    with monkeypatch.context() as m:
        m.setattr(G, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            G.merge_into(frame([(7, 9, "z")]), folder, 3, ["k"], ["v"])
    assert now() == want
    G.merge_into(frame([(7, 9, "z")]), folder, 3, ["k"], ["v"])
    assert now() == want | {7: (9, "z")} and G.merge_into(frame([(7, 99, "again")]), folder, 3, ["k"], ["v"]) == 0
    G.merge_into(frame([(i, 100, "new") for i in range(300)]), folder, 4, ["k"], ["v"])
    G.expire(spark, folder)
    assert now() == {i: (100, "new") for i in range(300)} and [p.name for p in (tmp_path / "t" / "data").iterdir()] == ["version=4"]


def test_pages_by_key_join_to_the_whole_order(spark):
    data = [(i, i % 7, f"n{i % 3}") for i in range(40)]
    df, order = spark.createDataFrame(data, "id int, a int, b string"), [("a", True), ("b", False), ("id", True)]
    got, last = [], None
    while page := R.page_after(df, order, last, 9).collect():
        got += [r["id"] for r in page]
        last = [page[-1][c] for c, _ in order]
    assert got == [i for i, _, _ in sorted(data, key=lambda x: (-x[1], x[2], -x[0]))]


def test_merged_sketches_count_distinct_values(spark):
    df = spark.range(30_000).selectExpr("id % 2 as g", "id % 9000 as v")
    parts = [R.distinct_sketches(df.where(f"v % 3 = {k}"), ["g"], "v") for k in range(3)]
    both = R.merged_sketches(R.merged_sketches(parts[0], parts[1], ["g"]), parts[2], ["g"])
    assert all(abs(r["n"] - 4500) < 0.03 * 4500 for r in both.select(F.hll_sketch_estimate("sketch").alias("n")).collect())


def test_suffixes_of_many_depths(spark):
    files = ["/a/b/C.jpg", "/z/b/c.JPG", "/a/b/", "x.jpg", None, "\\s\\b\\c.jpg"]
    asked = ["c.jpg", "b/c.jpg", "/A/B/c.jpg", "a\\b", "jpg", "q/x.jpg", "", None, "X.JPG"]
    got = dict(rows(R.by_suffix(spark.createDataFrame([(a,) for a in asked], "want string"), spark.createDataFrame([(f,) for f in files], "p string"), "want", "p")))
    plain = lambda t: t.lower().replace("\\", "/")
    want = {}
    for a in asked:
        if a is not None:
            hits = [f for f in files if f and ("/" + plain(f).rstrip("/")).endswith("/" + plain(a).strip("/"))]
            if hits and a:
                want[a] = min(hits)
    assert got == want


@pytest.mark.parametrize("width", [0, 3, 40])
def test_pairs_in_a_window_of_time_equal_all_pairs(spark, many_ranges, width):
    rng = random.Random(15)
    data = [(rng.choice("aaaab"), rng.randrange(9), rng.randrange(0, 400), i, f"x{i}") for i in range(250)] + [(None, 1, 5, 900, "n"), ("a", 1, None, 901, "n")]
    data = [(f, k if f == "b" else 1, t, i, x) for f, k, t, i, x in data]
    want = sorted((f, k, t, i, x, u, j, y) for f, k, t, i, x in data for g, l, u, j, y in data if f and f == g and k == l and t is not None and u is not None and 0 <= u - t <= width and (u > t or i < j))
    got = Q.window_pairs(spark.createDataFrame(data, "f string, k int, t long, i long, x string"), ["f", "k"], "t", "i", width, ["x"])
    assert got.columns == ["f", "k", "t1", "left_id", "l_x", "t2", "right_id", "r_x"] and rows(got) == want


def test_files_are_found_by_their_own_path_first(spark):
    files = ["http://a/en/7", "http://a/en/7/", "http://b/en/9/", "http://b/x/8"]
    asked = ["HTTP:\\\\A\\EN\\7", "HTTP:\\\\A\\EN\\7\\", "en/9", "EN\\7", "none"]
    found = R.found_files(spark.createDataFrame([(a,) for a in asked], "want string"), spark.createDataFrame([(f,) for f in files], "p string"), "want", "p")
    assert dict(rows(found)) == {asked[0]: files[0], asked[1]: files[1], asked[2]: files[2], asked[3]: files[0]}


def test_lookup_gives_every_row_of_a_path(spark):
    table = spark.createDataFrame([("/a/x", 4), ("/a/x", 2), ("/b/Y", 6), ("/c/y", 8), ("/b/Y", 7)], "url string, found int")
    asked = spark.createDataFrame([(1, "/a/x"), (2, "/z/y"), (3, "/z/q"), (4, None)], "request int, want string")
    got = R.lookup(asked, table, "want", "url", "found").select("request", "found", "matched_by")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [(1, 4, "path"), (1, 2, "path"), (2, 6, "name"), (3, None, None), (4, None, None)]))


def test_a_task_gives_one_row_a_term_for_the_documents_that_it_counts(spark, tmp_path):
    got = [r for b in T._counts(pa.array([7, 3, 5]), pa.array(["b a b", "", "a-c b"]), 9) for r in b.to_pylist()]
    assert got[0] == {"term": None, "batch": 9, "ids": [7, 3, 5], "tfs": [0, 0, 0], "ns": [3, 0, 3]}
    assert {r["term"]: list(zip(r["ids"], r["tfs"], r["ns"], strict=True)) for r in got[1:]} == {"a": [(7, 1, 3), (5, 1, 3)], "b": [(7, 2, 3), (5, 1, 3)], "c": [(5, 1, 3)]}
    cut = [r for b in T._cutter({2: 1})(iter([b for b in T._counts(pa.array([7, 5, 8]), pa.array(["b a b", "a-c b", "b"]), 9)][1:])) for r in b.to_pylist()]
    assert [(r["term"], r["docs"], r["max_tf"], r["min_n"]) for r in cut if r["term"] == "b"] == [("b", 1, 1, 1), ("b", 2, 2, 3)]


def test_a_search_by_vector_makes_no_text_index(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the test tables are not here")
    before = dict(plans_search._INDEXES)
    plans_search._INDEXES.clear()
    try:
        plans_search.hybrid_by_vector(spark, "/root/testdata/sf0.001")
        assert not plans_search._INDEXES
    finally:
        plans_search._INDEXES.update(before)
