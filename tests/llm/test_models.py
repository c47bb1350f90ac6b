"""Learned scores: held-out accuracy, gradients against differences, and exact parts against brute force."""

from __future__ import annotations

import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import gru_lm, quality_cnn, toxicity
from tessella.llm.common import crc_remainder

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].mean() - (n - 1) / 2) / (len(label) - n)


def labelled(n, seed=1):
    """Texts of invented words; label 1 has a few marked words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["tion", "er", "an", "the", "ou", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        y = int(i % 4 == 0)
        for _ in range(6 * y):
            w[rng.randrange(len(w))] = rng.choice(["zigquix", "vobblefump", "grakkle"])
        texts.append(" ".join(w))
        labels.append(y)
    return texts, labels


def tables(spark, documents, n=240):
    texts, labels = labelled(n)
    return documents(texts), spark.createDataFrame([(i, y, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int"), np.array(labels)


@pytest.mark.parametrize(("scores", "fold", "held"), [(toxicity.toxicity_scores, 3, 1), (quality_cnn.quality_scores, 5, 0)])
def test_scores_of_held_out_documents(spark, documents, scores, fold, held):
    docs, labels, y = tables(spark, documents)
    rows = sorted(scores(docs, labels).collect(), key=lambda r: r["doc_id"])
    assert [r["held_out"] for r in rows] == [crc_remainder(i, fold) == held for i in range(len(y))]
    out = np.array([r["held_out"] for r in rows])
    p = np.array([r["score"] for r in rows])
    assert ((p >= 0) & (p <= 1)).all() and auc(p[out], y[out]) > 0.9


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality_cnn.quality_scores])
def test_held_out_labels_change_nothing(spark, documents, scores):
    docs, labels, _ = tables(spark, documents, 90)
    fold, held = (3, 1) if scores is toxicity.toxicity_scores else (5, 0)
    flipped = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    get = lambda t: sorted((r["doc_id"], r["score"]) for r in scores(docs, t).collect())
    assert get(labels) == get(flipped)


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality_cnn.quality_scores])
def test_scores_of_odd_tables(spark, odd, documents, scores):
    docs, labels, _ = tables(spark, documents, 60)
    got = scores(odd.unionByName(docs, allowMissingColumns=True), labels).collect()
    assert len(got) == odd.count() + 60 and all(0 <= r["score"] <= 1 for r in got)
    assert scores(documents([]), labels).collect() == []
    assert len(scores(odd, labels.limit(0)).collect()) == odd.count()


def test_toxic_documents_go_and_others_stay(spark, documents):
    docs, labels, _ = tables(spark, documents)
    predicted = {r["doc_id"] for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(240)) - predicted and predicted


def test_chunks_cover_every_place():
    for n in (0, 1, 7, 8, 511, 512, 513, 1018, 1019, 5000):
        text = bytes(i % 251 + 1 for i in range(n))
        c = quality_cnn.chunks_of(text)
        assert b"".join(bytes(x[: quality_cnn._NEXT]) for x in c[:-1]) + bytes(c[-1]).rstrip(b"\0") == text
        for at in range(0, max(0, n - quality_cnn.WIDTH), quality_cnn.STRIDE):
            k = min(at // quality_cnn._NEXT, len(c) - 1)
            assert at - k * quality_cnn._NEXT + quality_cnn.WIDTH <= quality_cnn.CHUNK


def test_long_texts_score_as_one_batch_or_alone():
    texts, labels = labelled(60)
    net = quality_cnn.train([t.encode() for t in texts], np.array(labels, float))
    many = [t.encode() for t in texts[:9]] + [b"", b"x" * 700_000, " ".join(texts).encode()]
    together = quality_cnn.probabilities(net, many)
    assert np.allclose(together, [quality_cnn.probabilities(net, [t])[0] for t in many], atol=1e-5)


def small_vocabulary(texts):
    h, g, n = gru_lm.tokens(texts)
    u, first, k = np.unique(h, return_index=True, return_counts=True)
    order = np.lexsort((u, -k))
    return gru_lm.Vocabulary(u[order], k[order], np.zeros((gru_lm.GROUPS, 2), np.int64), len(h) + len(texts), len(u) + 1, len(texts)), h, n


def one_step(net, given, state):
    n, u, kind = len(given), gru_lm.UNITS, net.gates.dtype
    own, gate, new, out = np.empty((n, 3 * u), kind), np.empty((n, 2 * u), kind), np.empty((n, u), kind), np.empty((n, u), kind)
    gru_lm._step(net, gru_lm.table_of(net)[given], state, own, gate, new, out)
    return out


def test_slots_and_classes():
    assert len(set(gru_lm.LIVE.tolist())) == len(gru_lm.LIVE) == gru_lm.SIZES.sum() == gru_lm.WORDS + gru_lm.GROUPS + 1
    assert gru_lm.SLOTS < 1 << 15 and (gru_lm.LIVE % gru_lm.SIZE < gru_lm.SIZES[gru_lm.LIVE // gru_lm.SIZE]).all()
    assert (gru_lm.GROUP_SLOT >= gru_lm.FIRST_GROUP).all() and (gru_lm.WORD_SLOT < gru_lm.FIRST_GROUP).all() and gru_lm.END < gru_lm.FIRST_GROUP


def test_state_runs_through_the_whole_document(monkeypatch):
    texts = [t.encode() for t in labelled(12)[0]]
    v, h, n = small_vocabulary(texts)
    slot = gru_lm.Lookup(v).slots(h, np.zeros(len(h), np.int64))[0]
    docs = [np.append(x, np.int32(gru_lm.END)) for x in np.split(slot, np.cumsum(n)[:-1])]
    net = gru_lm.start(v)
    want = []
    for d in docs:  # token by token
        state, given, total = np.zeros((1, gru_lm.UNITS), np.float32), gru_lm.SLOTS, 0.0
        for t in d:
            state = one_step(net, [given], state)
            total += float(gru_lm._output(net, state, np.array([t]))[0])
            given = t
        want.append(total)
    for stretch, lanes in ((7, 3), (96, 256), (1, 1)):
        monkeypatch.setattr(gru_lm, "STRETCH", stretch)
        monkeypatch.setattr(gru_lm, "LANES", lanes)
        assert np.allclose(gru_lm.score(net, docs), want, rtol=1e-4)


def test_outputs_are_a_distribution():
    v, _, _ = small_vocabulary([b"a b c"])
    net = gru_lm.start(v)
    state = np.random.default_rng(1).normal(size=(1, gru_lm.UNITS)).astype(np.float32)
    whole = gru_lm._output(net, np.repeat(state, len(gru_lm.LIVE), 0), gru_lm.LIVE)
    assert math.isclose(np.exp(whole.astype(float)).sum(), 1, rel_tol=1e-3)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(gru_lm, "WINDOW", 16)
    v, _, _ = small_vocabulary([b"a b c d e f"])
    rng = np.random.default_rng(2)
    docs = [np.append(gru_lm.WORD_SLOT[rng.integers(0, 40, n)], gru_lm.END).astype(np.int32) for n in (5, 4, 3)]
    net = gru_lm.Net(*[p.astype(np.float64) for p in gru_lm.start(v)])
    found = {}
    monkeypatch.setattr(gru_lm.Trainer, "_update", lambda self, grads: found.setdefault("g", grads))
    gru_lm.Trainer(net, lanes=2).learn(docs)
    scale = 16 * 2
    loss = lambda n: -gru_lm.score(n, docs).sum() / scale
    for k, p in enumerate(net):
        live = np.argwhere(np.abs(found["g"][k]) > 1e-4)
        for at in live[rng.choice(len(live), min(4, len(live)), replace=False)]:
            at, step = tuple(at), 1e-2
            up, down = [q.copy() for q in net], [q.copy() for q in net]
            up[k][at] += step
            down[k][at] -= step
            assert math.isclose((loss(gru_lm.Net(*up)) - loss(gru_lm.Net(*down))) / (2 * step), found["g"][k][at], rel_tol=0.05, abs_tol=3e-4), (k, at)
            assert p.shape == found["g"][k].shape


@pytest.mark.parametrize("table_words", [1 << 19, 30])
def test_counts_and_base_equal_brute_force(spark, documents, table_words):
    texts = [*labelled(50)[0], None, "", "Zum  zum ZUM\x0bzum", "only_here once"]
    ids = [*range(53), 1000]
    rows = {r["doc_id"]: r for r in gru_lm.lm_scores(documents(texts, ids), table_words=table_words).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in zip(ids, texts, strict=True)}
    train = [i for i in ids if crc_remainder(i, 5) != 1]
    c = Counter(w for i in train for w in words[i])
    total, kinds = sum(c.values()) + len(train), len(c) + 1
    for i in ids:
        r, scale = rows[i], math.log10(total + 0.5 * (kinds + 1))
        base = sum(math.log10(c[w] + 0.5) for w in words[i]) + math.log10(len(train) + 0.5) - (len(words[i]) + 1) * scale
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(words[i]) + 1, sum(w in c for w in words[i]) + 1, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


@pytest.mark.parametrize("share", [gru_lm.SHARE, 1.0, 0.1])
def test_every_training_document_reaches_the_network(spark, documents, share):
    texts = [*labelled(60)[0], None, "", "only_here once"]
    docs = documents(texts).select("doc_id", "text")
    train = docs.where(gru_lm.remainder(F.col("doc_id"), 5) != 1)
    v = gru_lm.vocabulary(gru_lm.word_counts(docs, 5, 1), train.count(), 1 << 19)
    net, seen = gru_lm.trained(gru_lm.looked_up(docs, v, 5, 1, share), v, share)
    assert seen == v.total == sum(len((r["text"] or "").split()) + 1 for r in train.collect())
    assert all(np.isfinite(p).all() for p in net)


def test_language_model_of_odd_tables(odd, documents):
    assert gru_lm.lm_scores(odd).count() == odd.count()
    assert gru_lm.lm_scores(documents([])).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_language_model_beats_the_base_on_held_out_text(spark, size):
    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    r = gru_lm.op6_lm_score(spark, folder).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print(size, r[0] / r[2], r[1] / r[2])
    assert r[0] > r[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize(
    ("query", "label", "area", "recall", "left"), [(toxicity.op1_toxicity, "toxic", 0.94, 0.8, 0.97), (quality_cnn.op3_quality, "quality", 0.99, 0.95, 0.9)])
def test_held_out_scores_on_the_test_tables(spark, query, label, area, recall, left):
    rows = query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()
    score, said, y = (np.array([r[k] for r in rows]) for k in range(3))
    assert auc(score, y) > area and said[y == 1].mean() >= recall and 1 - said[y == 0].mean() >= left


def test_windows_cover_every_byte():
    for text in (b"", b"a", b"x" * 1000, b"a " * 400, b"one two " + b"y" * 777 + b" three", b"\n\t ", "äöü ".encode() * 99):
        t = toxicity.plain(text)
        start, length = toxicity.windows(t)
        seen = np.zeros(len(t), bool)
        for s, n in zip(start, length, strict=True):
            assert 1 <= n <= 2 * toxicity.STEP + 1
            seen[s : s + n] = True
        assert seen.all()


def test_texts_score_alone_as_together():
    texts, labels = labelled(80)
    m = toxicity.train([t.encode() for t in texts], np.array(labels, float))
    many = [toxicity.plain(t) for t in (b"", b"x" * 300_000, *(t.encode() for t in texts[:9]), " ".join(texts * 30).encode())]
    scorer = toxicity.Scorer(m.ordinary, m.toxic)
    assert np.allclose(scorer.features(many), [scorer.features([t])[0] for t in many])


def test_labelled_sample_holds_whole_texts_within_its_bound(spark, documents):
    docs, labels, _ = tables(spark, documents, 60)
    from tessella.llm.common import labelled_sample

    whole = {r["text"].encode() for r in docs.collect()}
    texts, y = labelled_sample(docs, labels, "toxic", 3, 1, 1000, 1 << 30)
    assert len(texts) == len(y) == sum(crc_remainder(i, 3) != 1 for i in range(60)) and set(texts) <= whole
    fewer, _ = labelled_sample(docs, labels, "toxic", 3, 1, 1000, 5000)
    assert fewer and sum(map(len, fewer)) <= 5000 and set(fewer) <= whole


def test_a_long_document_beside_short_ones_takes_memory_for_its_tokens():
    rng = np.random.default_rng(8)
    docs = [rng.choice(gru_lm.LIVE, n).astype(np.int32) for n in (2_000_000, *rng.integers(1, 60, 300))]
    lanes = gru_lm.Lanes(docs, gru_lm.lanes_for(docs))
    assert lanes.target.size <= 6 * sum(map(len, docs)) and lanes.steps == 2_000_000
    v, _, _ = small_vocabulary([b"a b c a b", b"c a"])
    net, some = gru_lm.start(v), [d[:5000] for d in docs]
    alone = np.array([gru_lm.score(net, [d])[0] for d in some])
    np.testing.assert_allclose(gru_lm.score(net, some), alone, rtol=1e-4)
    assert gru_lm.lanes_for([]) == gru_lm.lanes_for([np.zeros(0, np.int32)]) == 1


def test_training_takes_no_new_memory_for_each_window():
    code = """if True:
        import resource
        import numpy as np
        from tessella.llm import gru_lm
        v = gru_lm.Vocabulary(np.arange(1, 5, dtype=np.uint64), np.array([3, 2, 2, 1]), np.zeros((gru_lm.GROUPS, 2), np.int64), 10, 5, 2)
        rng = np.random.default_rng(3)
        docs = [np.append(gru_lm.WORD_SLOT[rng.integers(0, 2000, 500)], gru_lm.END).astype(np.int32) for _ in range(256)]
        trainer = gru_lm.Trainer(gru_lm.start(v), lanes=gru_lm.MANY_LANES)
        trainer.learn(docs)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        trainer.learn(docs)
        print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    """
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(gru_lm.__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=top, env=os.environ | {"PYTHONPATH": top}, capture_output=True, text=True, check=True).stdout
    assert int(out) < 2000  # pages; with new memory for each window some 10,000


def test_updates_are_those_of_adam(monkeypatch):
    v, _, _ = small_vocabulary([b"a b c a b", b"c a"])
    trainer, rng = gru_lm.Trainer(gru_lm.start(v)), np.random.default_rng(4)
    want = [p.astype(np.float64) for p in trainer.net]
    m, w = [np.zeros_like(p) for p in want], [np.zeros_like(p) for p in want]
    for step in range(1, 30):
        grads = [(rng.normal(size=p.shape) * 0.003 * (rng.random(p.shape) < 0.3)).astype(np.float32) for p in want]
        clip = min(1.0, 1.0 / math.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in grads)))
        for k, g in enumerate(grads):
            m[k], w[k] = 0.9 * m[k] + 0.1 * clip * g, 0.99 * w[k] + 0.01 * (clip * g.astype(float)) ** 2
            want[k] -= 0.02 * min(1, step / 20) * m[k] / (1 - 0.9**step) / (np.sqrt(w[k] / (1 - 0.99**step)) + 1e-8)
        trainer._update(grads)
    for p, q in zip(trainer.net, want, strict=True):
        np.testing.assert_allclose(p, q, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("size", [1, 300, 1 << 18])
def test_words_of_texts_together_are_those_of_each(size):
    texts = [b"", *(t.encode() for t in labelled(20)[0]), b" ", b"one", b"", b"x" * 5000, b"so-called \"end.\")", b"a b\n" * (5 << 18), b"last\n"]
    got = list(gru_lm._groups(texts, size))
    assert len(got) < len(texts) or size == 1
    want = [gru_lm.tokens([t]) for t in texts]
    for at in range(3):
        assert np.array_equal(np.concatenate([x[at] for x in got]), np.concatenate([x[at] for x in want]))
