"""Log-likelihood of whole documents under a gated recurrent language model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import remainder, small_batches, table, texts_of
from tessella.llm.spans import LOWER, HashTable, mix, span_hashes, word_spans
from tessella.scratch import stored

_U = np.uint64
#: The output's classes: of words, the commonest in small ones, and of groups of all other words by how they end.
WORD_CLASSES, GROUP_CLASSES, GROUP_SIZE = 44, 4, 16
CLASSES, GROUPS = WORD_CLASSES + GROUP_CLASSES, GROUP_CLASSES * GROUP_SIZE
SIZES = np.array([8 + 3 * k for k in range(WORD_CLASSES)] + [GROUP_SIZE] * GROUP_CLASSES)
SIZE = int(SIZES.max())
#: A slot is a class times SIZE and a place in it: the end, the words that the network knows one by one, the groups.
SLOTS = CLASSES * SIZE
LIVE = np.concatenate([k * SIZE + np.arange(n) for k, n in enumerate(SIZES)]).astype(np.int32)
END, WORD_SLOT, GROUP_SLOT = int(LIVE[0]), LIVE[1:-GROUPS], LIVE[-GROUPS:]
WORDS, FIRST_GROUP = len(WORD_SLOT), int(GROUP_SLOT[0])
#: Numbers for a token; units; tokens through which gradients are followed; documents scored side by side.
EMBED, UNITS, WINDOW, LANES = 16, 16, 32, 256
#: Documents trained on side by side, at first and at most: doubled after each chunk, of DEPTH tokens a lane.
#: Documents of more than PIECE tokens are trained on in pieces.
FEW_LANES, MANY_LANES, DEPTH, PIECE = 16, 256, 2048, 1024
#: Where each token's numbers are in the flat table of them; weights that are updated at a time, for the cache.
EMBED_AT, UPDATED = np.arange((SLOTS + 1) * EMBED).reshape(-1, EMBED), 1 << 14
#: Tokens of a lane whose outputs are computed together when scoring.
STRETCH = 96
#: Share of the training documents, by a hash of the text, that each round of training reads; tokens of a trainer at
#: least; trainers of a round at most (beyond that, each reads more). The rounds together read every training document
#: once; weights are averaged after each round.
SHARE, TRAINER_TOKENS, TRAINERS = 0.25, 1 << 20, 4096
#: Words whose counts are broadcast at most; counts of all others are joined.
TABLE_WORDS = 1 << 19
#: Tokens that a worker scores at a time; bytes of texts whose words are found together.
HELD, GROUPED = 1 << 21, 1 << 18
BLOCKS = 16


class Net(NamedTuple):
    embed: np.ndarray  # SLOTS + 1 x EMBED: a token, or the start
    into: np.ndarray  # EMBED x 3 * UNITS: what it gives the gates
    gates: np.ndarray  # UNITS x 3 * UNITS
    gate_bias: np.ndarray
    to_class: np.ndarray  # UNITS x CLASSES
    class_bias: np.ndarray
    to_word: np.ndarray  # CLASSES x UNITS x SIZE
    word_bias: np.ndarray  # CLASSES x SIZE


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of the words of all texts, and how many words each text has.

    A word's group is its last two letters' or digits' hash.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    data = LOWER[data]
    s, e = word_spans(data)
    h = span_hashes(data, s, e)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(s, ends)]))
    last = e - 1
    for _ in range(2):  # up to two marks at the end
        mark = (last > s) & ~(((data[last] >= 97) & (data[last] <= 122)) | (data[last] >= 128) | ((data[last] >= 48) & (data[last] <= 57)))
        last = last - mark
    pair = data[last].astype(_U) << _U(8) | np.where(last > s, data[np.maximum(last - 1, 0)], 0).astype(_U)
    return h, (mix(pair + _U(1)) % _U(GROUPS)).astype(np.int64), counts


def _pieces(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """A long text in parts cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size))
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _groups(texts: list[bytes], size: int = GROUPED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``tokens`` gives, for some texts of about ``size`` bytes together at a time, or one longer one."""
    i = 0
    while i < len(texts):
        j, held = i + 1, len(texts[i])
        while j < len(texts) and held + len(texts[j]) <= size:
            held += len(texts[j])
            j += 1
        if held <= 4 << 20:
            yield tokens(texts[i:j])
        else:
            parts = [tokens([p])[:2] for p in _pieces(texts[i])]
            h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield h, g, np.array([len(h)])
        i = j


def word_counts(docs: DataFrame, fold: int, held: int) -> DataFrame:
    """``h``, ``g`` and ``n``: every word of the training documents, its group and its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, g in _blocks(batch):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g[first].astype(np.int32)), pa.array(n)], names=["h", "g", "n"])

    train = docs.where(remainder(F.col("doc_id"), fold) != held)
    return train.select("text").mapInArrow(run, "h long, g int, n long").groupBy("h", "g").agg(F.sum("n").alias("n"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = texts_of(batch)
    for text in texts:
        if len(text) > 4 << 20:
            for part in _pieces(text):
                yield tokens([part])[:2]
    small = [x[:2] for x in _groups([t for t in texts if len(t) <= 4 << 20])]
    if small:
        h, g = (np.concatenate(x) for x in zip(*small, strict=True))
        yield h, g


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # of the commonest words, commonest first
    counts: np.ndarray
    groups: np.ndarray  # total count and number of words of each group, without the network's words: GROUPS x 2
    total: int  # tokens, ends included
    kinds: int  # distinct tokens, the end included
    documents: int


def vocabulary(counts: DataFrame, documents: int, table_words: int) -> Vocabulary:
    """The bounded part of the counts that every worker holds, and totals over all of them."""
    top = counts.orderBy(F.desc("n"), "h").limit(table_words).select("h", "g", "n").toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(_U)
    n, g = top.column("n").to_numpy().astype(np.int64), top.column("g").to_numpy().astype(np.int64)
    groups = np.zeros((GROUPS, 2), np.int64)
    total = kinds = 0
    for r in counts.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        groups[r["g"]] = r["n"], r["k"]
        total, kinds = total + r["n"], kinds + r["k"]
    np.subtract.at(groups, g[:WORDS], np.stack([n[:WORDS], np.ones(len(n[:WORDS]), np.int64)], axis=1))
    return Vocabulary(h, n, groups, total + documents, kinds + (documents > 0), documents)


class Lookup:
    """A worker's table of the broadcast words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.table = HashTable(max(8, (2 * len(v.hashes) + 2).bit_length()), np.int32)
        self.table.insert(v.hashes, np.arange(len(v.hashes), dtype=np.int32))

    def slots(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The network's slot of each word, its place in the table and whether it is absent there."""
        rank, absent = self.table.find(h)
        known = ~absent & (rank < WORDS)
        slot = GROUP_SLOT[g]
        slot[known] = WORD_SLOT[rank[known]]
        return slot, rank, absent


def start(v: Vocabulary, seed: int = 1) -> Net:
    """Weights before training: the biases make it the unigram model."""
    rng, f32 = np.random.default_rng(seed), np.float32
    mass = np.zeros(SLOTS)
    mass[LIVE] = 0.5
    mass[WORD_SLOT[: len(v.counts)]] += v.counts[:WORDS]
    mass[END] += v.documents
    mass[GROUP_SLOT] += v.groups[:, 0]
    mass = mass.reshape(CLASSES, SIZE)
    by_class = mass.sum(1)
    share = np.log(np.maximum(mass, 0.5) / by_class[:, None])
    return Net(
        rng.normal(0, 1, (SLOTS + 1, EMBED)).astype(f32), rng.normal(0, 0.3 * EMBED**-0.5, (EMBED, 3 * UNITS)).astype(f32),
        rng.normal(0, UNITS**-0.5, (UNITS, 3 * UNITS)).astype(f32), np.zeros(3 * UNITS, f32),
        rng.normal(0, 0.02, (UNITS, CLASSES)).astype(f32), np.log(by_class / by_class.sum()).astype(f32),
        rng.normal(0, 0.02, (CLASSES, UNITS, SIZE)).astype(f32), share.astype(f32))


class Lanes:
    """Documents laid end to end in lanes of about the same length, longest lane first."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        length, held = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        for i in order:
            k = int(length.argmin())
            held[k].append(i)
            length[k] += len(docs[i])
        by_length = np.argsort(-length, kind="stable")
        self.length = length[by_length]
        self.steps, n = int(self.length[0]) if len(docs) else 0, lanes
        self.target = np.zeros((self.steps, n), np.int32)
        self.doc = np.full((self.steps, n), -1, np.int32)
        self.fresh = np.zeros((self.steps, n), bool)
        for lane, k in enumerate(by_length):
            at = 0
            for i in held[k]:
                self.target[at : at + len(docs[i]), lane] = docs[i]
                self.doc[at : at + len(docs[i]), lane] = i
                self.fresh[at, lane] = True
                at += len(docs[i])
        self.source = np.full_like(self.target, SLOTS)
        self.source[1:] = np.where(self.fresh[1:], SLOTS, self.target[:-1])

    def windows(self, size: int = WINDOW) -> Iterator[tuple[int, int, int]]:
        """First step, end and number of lanes that still run, window after window."""
        for a in range(0, self.steps, size):
            yield a, min(a + size, self.steps), int((self.length > a).sum())


def table_of(net: Net) -> np.ndarray:
    """What each token gives the gates."""
    return net.embed @ net.into + net.gate_bias


def _lying(*shape: int, kind: np.dtype) -> np.ndarray:
    """An empty array of ... x lanes x numbers in which the lanes lie side by side: a gate of all lanes is one stretch."""
    return np.empty((*shape[:-2], shape[-1], shape[-2]), kind).swapaxes(-1, -2)


def _step(net: Net, given: np.ndarray, h: np.ndarray, own: np.ndarray, gate: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """One step of the network: fills what the state gives, the gates (update and reset), the new values and the state."""
    np.matmul(h, net.gates, out=own)
    np.add(own[:, : 2 * UNITS], given[:, : 2 * UNITS], out=gate)
    np.negative(gate, out=gate)
    np.exp(gate, out=gate)
    gate += 1
    np.reciprocal(gate, out=gate)
    np.multiply(gate[:, UNITS:], own[:, 2 * UNITS :], out=new)
    new += given[:, 2 * UNITS :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= gate[:, :UNITS]
    out += new


def _exponentials(x: np.ndarray) -> None:
    """Turns logits into their exponentials in place."""
    if max(x.max(initial=0), -x.min(initial=0)) > 60:
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)


class Outputs:
    """Exponentials for targets in the order of their classes: of all classes, and of all places in the target's class.

    States have a one behind their numbers and weights the bias below theirs, so that one product adds it and one product
    gives both gradients."""

    def __init__(self, net: Net, states: np.ndarray, target: np.ndarray, rows: np.ndarray):
        """``states``: rows of UNITS numbers and a one; ``rows``: which of them belongs to each target."""
        c, self.order, bounds = _by_class(target)
        self.rows = rows[self.order]
        self.states = np.take(states, self.rows, axis=0)
        c, place = c[self.order], target[self.order] % SIZE
        self.to_class = np.concatenate([net.to_class, net.class_bias[None]])
        self.to_word = np.concatenate([net.to_word, net.word_bias[:, None]], axis=1)
        self.of_class = self.states @ self.to_class
        _exponentials(self.of_class)
        counts = np.diff(bounds)
        begins = np.concatenate([[0], np.cumsum(counts * SIZES)])
        self.words = np.empty(begins[-1], self.of_class.dtype)
        #: Class, size, and first and last target of each class that has any, and its part of ``words``, a row a target.
        self.classes = [
            (k, n, i, j, self.words[a:b].reshape(j - i, n))
            for k, (n, i, j, a, b) in enumerate(zip(SIZES.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True))
            if i < j]
        for k, n, i, j, q in self.classes:
            np.matmul(self.states[i:j], self.to_word[k, :, :n], out=q)
        _exponentials(self.words)
        ones = np.ones(max(CLASSES, SIZE), self.words.dtype)
        self.class_total, self.word_total = self.of_class @ ones[:CLASSES], np.empty(len(c), self.words.dtype)
        for _, n, i, j, q in self.classes:
            np.matmul(q, ones[:n], out=self.word_total[i:j])
        row = np.arange(len(c))
        #: Where the targets' own exponentials are in the flat arrays.
        self.class_at, self.word_at = row * CLASSES + c, begins[c] + (row - bounds[c]) * SIZES[c] + place


def lanes_for(docs: list[np.ndarray]) -> int:
    """Lanes that together are at most some four times as long as the documents: every lane is as large as the longest
    document, for which more of them would only wait."""
    longest = max(map(len, docs), default=0)
    return max(1, min(LANES, len(docs), 1 + 4 * sum(map(len, docs)) // max(1, longest)))


def score(net: Net, docs: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each document's slots; the state runs through the whole document."""
    out, table, kind = np.zeros(len(docs)), table_of(net), net.gates.dtype
    lanes = Lanes(docs, lanes_for(docs))
    h = np.zeros((UNITS, lanes.target.shape[1]), kind).T
    for a, b, n in lanes.windows(STRETCH):
        states, given = _lying(b - a, n, UNITS, kind=kind), _lying(b - a, n, 3 * UNITS, kind=kind)
        given[:] = np.take(table, lanes.source[a:b, :n], axis=0)
        own, gate, new = _lying(n, 3 * UNITS, kind=kind), _lying(n, 2 * UNITS, kind=kind), _lying(n, UNITS, kind=kind)
        fresh = lanes.fresh[a:b, :n]
        begins = fresh.any(1).tolist()
        h = h[:n]
        for t in range(b - a):
            if begins[t]:
                h = np.where(fresh[t][:, None], kind.type(0), h)
            _step(net, given[t], h, own, gate, new, states[t])
            h = states[t]
        doc = lanes.doc[a:b, :n].ravel()
        live = np.flatnonzero(doc >= 0)
        out += np.bincount(doc[live], weights=_output(net, states.reshape(-1, UNITS)[live], lanes.target[a:b, :n].ravel()[live]), minlength=len(docs))
    return out


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of targets, their order by class and where each class begins in it."""
    c = target // SIZE
    order = np.argsort(c.astype(np.uint8), kind="stable")
    return c, order, np.searchsorted(c[order], np.arange(CLASSES + 1))


def _output(net: Net, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target: its class, then its place in the class, class by class."""
    o = Outputs(net, np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1), target, np.arange(len(target)))
    out = np.empty(len(target), states.dtype)
    out[o.order] = np.log(np.take(o.of_class, o.class_at) / o.class_total) + np.log(np.take(o.words, o.word_at) / o.word_total)
    return out


class Trainer:
    """Adam on the log loss with gradients through ``WINDOW`` tokens; the state goes on from window to window."""

    def __init__(self, net: Net, speed: float = 0.02, lanes: int = FEW_LANES):
        _reuse_memory()
        self.weights = _flat(net)
        self.net, self.speed, self.step, self.lanes = _parts(self.weights, net), speed, 0, lanes
        self.m, self.v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        self.tokens = 0

    def learn(self, docs: list[np.ndarray]) -> None:
        """One pass over documents; the next one has twice the lanes."""
        docs = [d[i : i + PIECE] for d in docs for i in range(0, len(d), PIECE)]
        if not docs:
            return
        lanes = Lanes(docs, max(1, min(self.lanes, len(docs))))
        h = np.zeros((lanes.target.shape[1], UNITS), self.net.gates.dtype)
        for a, b, n in lanes.windows():
            h = self._window(lanes, a, b, n, h[:n])
        self.lanes = min(2 * self.lanes, MANY_LANES)

    def _window(self, lanes: Lanes, a: int, b: int, n: int, h: np.ndarray) -> np.ndarray:
        net, steps, kind = self.net, b - a, self.net.gates.dtype
        source, fresh = lanes.source[a:b, :n], lanes.fresh[a:b, :n]
        going, begins = (~fresh[:, :, None]).astype(kind), fresh.any(1).tolist()
        # a one behind a token's numbers: one product adds the bias, and one gives both gradients
        seen = np.take(np.concatenate([net.embed, np.ones((SLOTS + 1, 1), kind)], axis=1), source, axis=0)
        given = np.matmul(seen, np.concatenate([net.into, net.gate_bias[None]]), out=_lying(steps, n, 3 * UNITS, kind=kind))
        before, states, new = (_lying(steps, n, UNITS, kind=kind) for _ in range(3))
        own, gate = _lying(steps, n, 3 * UNITS, kind=kind), _lying(steps, n, 2 * UNITS, kind=kind)
        for t in range(steps):
            if begins[t]:
                np.multiply(h, going[t], out=before[t])
            else:
                before[t] = h
            _step(net, given[t], before[t], own[t], gate[t], new[t], states[t])
            h = states[t]
        live = np.flatnonzero(lanes.doc[a:b, :n].ravel() >= 0)
        grads: list[np.ndarray] = [np.zeros(0)] * len(net)
        target = lanes.target[a:b, :n].ravel()[live]
        # a window with few lanes left counts by its tokens
        g_states = _lying(steps, n, UNITS, kind=kind)
        g_states[:] = self._outputs(states, live, target, 1 / (WINDOW * lanes.target.shape[1]), grads)
        z, r = gate[:, :, :UNITS], gate[:, :, UNITS:]
        to_new, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), own[:, :, 2 * UNITS :] * r * (1 - r)
        g_own, g_new = own, new  # their values are not needed again
        gh, more = np.zeros((UNITS, n), kind).T, _lying(n, UNITS, kind=kind)
        back = np.ascontiguousarray(net.gates.T)
        for t in range(steps - 1, -1, -1):
            gh += g_states[t]
            np.multiply(gh, to_new[t], out=g_new[t])
            np.multiply(gh, to_z[t], out=g_own[t, :, :UNITS])
            np.multiply(g_new[t], to_r[t], out=g_own[t, :, UNITS : 2 * UNITS])
            np.multiply(g_new[t], r[t], out=g_own[t, :, 2 * UNITS :])
            gh *= z[t]
            gh += np.matmul(g_own[t], back, out=more)
            if begins[t]:
                gh *= going[t]
        grads[2] = np.matmul(before.swapaxes(1, 2), g_own).sum(0)
        g_own[:, :, 2 * UNITS :] = g_new
        got = np.matmul(seen.swapaxes(1, 2), g_own).sum(0)
        grads[1], grads[3] = got[:EMBED], got[EMBED]
        g_seen = np.matmul(g_own, net.into.T).reshape(-1, EMBED)
        grads[0] = np.bincount(np.take(EMBED_AT, source.ravel(), axis=0).ravel(), g_seen.ravel(), net.embed.size).astype(kind).reshape(net.embed.shape)
        self._update(grads)
        self.tokens += len(target)
        return h

    def _outputs(self, states: np.ndarray, live: np.ndarray, target: np.ndarray, scale: float, grads: list[np.ndarray]) -> np.ndarray:
        """Gradients of the states; those of the outputs' weights go into ``grads``."""
        kind = states.dtype
        ending = np.ones((*states.shape[:2], UNITS + 1), kind)
        ending[:, :, :UNITS] = states
        o = Outputs(self.net, ending.reshape(-1, UNITS + 1), target, live)
        p, q = o.of_class, o.words
        p *= (scale / o.class_total)[:, None].astype(kind)
        p.ravel()[o.class_at] -= kind.type(scale)
        share = (scale / o.word_total)[:, None].astype(kind)
        for _, _, i, j, x in o.classes:
            x *= share[i:j]
        q[o.word_at] -= kind.type(scale)
        got = o.states.T @ p
        grads[4], grads[5] = got[:UNITS], got[UNITS]
        got = np.zeros_like(o.to_word)
        grads[6], grads[7] = got[:, :UNITS], got[:, UNITS]
        gs, more = p @ o.to_class[:UNITS].T, np.empty((len(target), UNITS), kind)
        for k, n, i, j, x in o.classes:
            np.matmul(o.states[i:j].T, x, out=got[k, :, :n])
            np.matmul(x, o.to_word[k, :UNITS, :n].T, out=more[i:j])
        gs += more
        out = np.zeros((states.shape[0] * states.shape[1], UNITS), kind)
        out[o.rows] = gs
        return out.reshape(states.shape)

    def _update(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        flat = np.concatenate([g.ravel() for g in grads])
        clip = min(1.0, 1.0 / (float(np.sqrt(np.vdot(flat, flat))) + 1e-9))
        rate = self.speed * min(1.0, self.step / 20)
        c1, c2 = 1 - 0.9**self.step, 1 - 0.99**self.step
        kind = flat.dtype.type
        share, small, rate = kind(0.1 * clip), kind(1e-8 * c2**0.5), kind(rate / c1 * c2**0.5)
        for i in range(0, len(flat), UPDATED):
            p, g, m, v = (x[i : i + UPDATED] for x in (self.weights, flat, self.m, self.v))
            g *= share
            m *= kind(0.9)
            m += g
            g *= g  # of a tenth, which is the hundredth that is wanted
            v *= kind(0.99)
            v += g
            np.sqrt(v, out=g)
            g += small
            np.divide(m, g, out=g)
            g *= rate
            p -= g


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net])


def _parts(flat: np.ndarray, like: Net) -> Net:
    """Views of ``flat`` in the shapes of ``like``."""
    ends = np.cumsum([p.size for p in like])
    return Net(*[x.reshape(p.shape) for x, p in zip(np.split(flat, ends[:-1]), like, strict=True)])


def _shaped(flat: np.ndarray, like: Net) -> Net:
    return _parts(flat.astype(np.float32), like)


def _reuse_memory() -> None:
    """Gives back one large array, after which a worker's C library keeps the memory of smaller ones for the next instead
    of asking the system for it at each window (a sixth of the time of training)."""
    np.empty(30 << 20, np.uint8)


def trained(rows: DataFrame, v: Vocabulary, share: float) -> tuple[Net, int]:
    """Weights after all rounds of training on rows of ``row``, ``part`` and ``slots``, and how many tokens they saw.

    A round reads the rows of one part. Trainers start alike, each reads its share of the round's documents in the
    order of ``row``, and their weights are averaged by tokens, block by block, in Spark; only the average comes to the
    driver."""
    spark, net, seen = rows.sparkSession, start(v), 0
    number = max(1, min(TRAINERS, round(v.total * share / TRAINER_TOKENS)))
    for r in range(parts_of(share)):
        weights = spark.sparkContext.broadcast(_flat(net))

        def learn(batches: Iterator[pa.RecordBatch], weights=weights, like=net) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(_shaped(weights.value, like))
            held: list[np.ndarray] = []
            size = 0
            for batch in batches:
                for x in batch.column("slots"):
                    held.append(np.frombuffer(x.as_buffer(), np.int16).astype(np.int32))
                    size += len(held[-1])
                    if size >= trainer.lanes * DEPTH:
                        trainer.learn(held)
                        held, size = [], 0
            trainer.learn(held)
            if trainer.tokens:
                for k, part in enumerate(np.array_split(trainer.weights, BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([trainer.tokens], pa.int64())], names=["k", "w", "n"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, w, n in zip(*(batch.column(c).to_pylist() for c in ("k", "w", "n")), strict=True):
                    s = sums.setdefault(k, [0, 0])
                    s[0], s[1] = s[0] + np.frombuffer(w, np.float32) * np.float64(n), s[1] + n
            for k, (w, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(w / n).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["k", "w", "n"])

        own = rows.where(F.col("part") == r).select("row", "slots").repartition(number, "row").sortWithinPartitions("row").select("slots")
        got = own.mapInArrow(learn, "k int, w binary, n long").repartition(min(number, BLOCKS), "k").sortWithinPartitions("k", "n", "w").mapInArrow(average, "k int, w binary, n long").collect()
        if got:
            net = _shaped(np.concatenate([np.frombuffer(x["w"]) for x in sorted(got, key=lambda x: x["k"])]), net)
            seen += got[0]["n"]
    return net, seen


def parts_of(share: float) -> int:
    """Rounds of training."""
    return max(1, round(1 / share))


def looked_up(docs: DataFrame, v: Vocabulary, fold: int, held: int, share: float) -> DataFrame:
    """Per row of ``docs``, written once and read by training and by scoring: ``doc_id``, ``row`` (a number of its own),
    ``held_out``, ``part`` (the round that trains on it, null if none), ``slots`` (of 16 bits), and of the table's words
    what counts give: ``n_tokens``, ``top_known``, ``top_base``, ``extra`` (what the words of groups add to the
    network's probability); hashes and counts of the words that the table does not have in ``rare`` and ``rare_n``."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(v)
    names = ["doc_id", "row", "held_out", "part", "slots", "n_tokens", "top_known", "top_base", "extra", "rare", "rare_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        lookup, row = Lookup(v), TaskContext.get().partitionId() << 36
        log_counts = np.log10(np.append(v.counts, 0) + 0.5)
        group_total = np.log10(v.groups[:, 0] + 0.5 * (v.groups[:, 1] + 1))
        end_log = np.log10(v.documents + 0.5)
        for batch in batches:
            # of each group of texts: slots, numbers a text, how many rare words a text has, these words and their counts
            cols: list[list] = [[] for _ in range(5)]
            for h, g, counts in _groups(texts_of(batch)):
                slot, rank, absent = lookup.slots(h, g)
                own, k = np.repeat(np.arange(len(counts)), counts), len(counts)
                of_table = np.where(absent, 0.0, log_counts[rank])
                of_group = np.where(slot >= FIRST_GROUP, of_table - group_total[g], 0.0)
                ends = np.cumsum(counts)
                ended = np.insert(slot, ends, END).astype(np.int16)
                rare, of = h[absent], own[absent]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])])[: len(rare)])
                cols[0] += [x.tobytes() for x in np.split(ended, (ends + np.arange(1, k + 1))[:-1])]
                cols[1].append(np.stack([np.bincount(own, x, k) if k > 1 else [x.sum()] for x in (~absent, of_table, of_group)] + [counts]))
                cols[2].append(np.bincount(of[new], minlength=k))
                cols[3].append(rare[new].view(np.int64))
                cols[4].append(np.diff(np.append(new, len(rare))).astype(np.int32))
            if not batch.num_rows:
                continue
            n, (known, base, extra, words) = batch.num_rows, np.concatenate(cols[1], axis=1)
            starts = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(cols[2]))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(row, row + n)), batch.column("held_out"), batch.column("part"), pa.array(cols[0], pa.binary()),
                 pa.array(words.astype(np.int64) + 1), pa.array(known.astype(np.int64) + int(v.documents > 0)), pa.array(base + end_log), pa.array(extra),
                 *(pa.ListArray.from_arrays(starts, pa.array(np.concatenate(c))) for c in cols[3:])],
                names=names)
            row += n

    out = F.col("held_out")
    source = docs.withColumn("held_out", remainder(F.col("doc_id"), fold) == held).withColumn(
        "part", F.when(~out, F.pmod(F.xxhash64("text", "doc_id"), F.lit(parts_of(share))).cast("int")))
    schema = f"doc_id {kind}, row long, held_out boolean, part int, slots binary, n_tokens long, top_known long, top_base double, extra double, rare array<long>, rare_n array<int>"
    return stored(source.mapInArrow(run, schema), "lm-rows")


def network_scores(rows: DataFrame, net: Net) -> DataFrame:
    """``rows`` with ``network``, log10 of the network's probability of each row's ``slots``, in their place."""
    weights = rows.sparkSession.sparkContext.broadcast(_flat(net))
    shapes = [p.shape for p in net]
    names = [c for c in rows.columns if c != "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _reuse_memory()
        own = _shaped(weights.value, Net(*[np.empty(s, np.float32) for s in shapes]))
        waiting: list[pa.RecordBatch] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            likely, at = score(own, held) / np.log(10), 0
            for batch in waiting:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(likely[at : at + n])], names=[*names, "network"])
                at += n

        for batch in batches:
            some = [np.frombuffer(x.as_buffer(), np.int16).astype(np.int32) for x in batch.column("slots")]
            waiting.append(batch.select(names))
            held += some
            size += sum(map(len, some))
            if size >= HELD:
                yield from flush()
                waiting, held, size = [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, rows.select(*names).schema.add("network", "double"))


def lm_scores(docs: DataFrame, *, fold: int = 5, held: int = 1, share: float = SHARE, table_words: int = TABLE_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``, both log10 probabilities of the whole text.

    Tokens are the words, A-Z lowered, and one end. Counts are taken over all documents whose crc32 remainder by
    ``fold`` is not ``held``, and the network is trained on all of them. The base is the smoothed unigram model. The
    network gives each token a class and a place in it; a word that it does not know one by one gets its group's
    probability times its smoothed share of the group, in which half a count is left to words never seen. Counts of
    the commonest ``table_words`` words are broadcast; those of other words are joined, counted per document.

    Null and empty texts are one end. Rows with a null id count by the crc32 of empty text. Repeated rows give a row
    each. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select("doc_id", "text")
    counts = stored(word_counts(source, fold, held), "word-counts")
    documents = source.where(remainder(F.col("doc_id"), fold) != held).count()
    v = vocabulary(counts, documents, table_words)
    rows = looked_up(source, v, fold, held, share)
    net, _ = trained(rows, v, share)
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("k"))
    known = pairs.join(counts.select("h", F.col("n")), "h", "left")
    rest = known.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    scale = float(np.log10(v.total + 0.5 * (v.kinds + 1)))
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    scored = network_scores(rows.select("row", "doc_id", "held_out", "n_tokens", "top_known", "top_base", "extra", "slots"), net)
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("top_known") + rare_known).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("top_base") + rare_log - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("network") + F.col("extra") + rare_log).alias("score"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm_scores(table(spark, sf_dir, "documents"))
