"""Toxicity by compression distance: two Zstandard dictionaries, and how much better the toxic one fits a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import labelled_sample, logistic, remainder, sigmoid, small_batches, table, texts_of

#: Bytes from one window to the next; a window goes from a word's start to the next window's, 2 * STEP bytes at most.
STEP = 20
#: Labelled documents that the dictionaries and thresholds are learned from at most, and bytes of all their texts.
SAMPLE, SAMPLE_BYTES = 8_000, 40 << 20
#: Grams by which stretches that mark toxic documents are found: their bytes, and slots of the table that counts
#: documents; a marked gram is RATIO times commoner in toxic documents, with a likelihood ratio of EVIDENCE or more.
GRAM, SLOTS = 6, 1 << 23
RATIO, EVIDENCE = 4, 20
#: Bytes of the ordinary dictionary and of what the toxic one has more.
ORDINARY, TOXIC = 64 << 10, 4 << 10
#: How often a toxic document counts against an ordinary one where the score is calibrated.
RARE = 2
#: A document is toxic from this score on.
THRESHOLD = 0.7
#: Gains of a window, in bytes, that are counted.
GAINS = np.arange(1, 9)
#: Windows that are compressed in one call.
CALL = 1 << 16
#: Fixed value of the published dictionary format: the three repeat offsets before the content, as training sets them.
_REPEATS = bytes.fromhex("010000000400000008000000")


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def plain(text: bytes) -> bytes:
    """The words with A-Z lowered, one space before and behind each."""
    return b" " + b" ".join(text.lower().split()) + b" "


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each window of a text from ``plain``: they begin at words, but for words too long for that,
    and each ends with the byte at which the next begins."""
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    start = space[np.unique(space // STEP, return_index=True)[1]]
    end = np.append(start[1:], max(len(text) - 1, 1))
    cuts = np.maximum(1, -(-(end - start) // (2 * STEP)))
    if len(start) != cuts.sum():
        within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(start, cuts) + within * 2 * STEP
        end = np.append(start[1:], max(len(text) - 1, 1))
    return start, np.minimum(end + 1, len(text)) - start


def _slots(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h << np.uint64(8)) | a[j : j + n]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)).astype(np.int32)


def _documents(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """How many ordinary and how many toxic documents have each slot's grams."""
    counts = np.zeros((2, SLOTS), np.uint16 if len(texts) < 1 << 16 else np.uint32)
    for text, y in zip(texts, toxic, strict=True):
        counts[int(y)][np.unique(_slots(text))] += 1
    return counts


def _marks(counts: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """For each slot, whether its grams mark toxic documents, by a likelihood-ratio test of the counts."""
    live = np.flatnonzero(counts[1] > 2)
    k0, k1 = counts[0][live].astype(float), counts[1][live].astype(float)

    def fit(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        return k * np.log(p) + (n - k) * np.log1p(-p)

    p0, p1, p = (k0 + 0.5) / (n0 + 1), (k1 + 0.5) / (n1 + 1), (k0 + k1 + 0.5) / (n0 + n1 + 1)
    gain = 2 * (fit(k0, n0, p0) + fit(k1, n1, p1) - fit(k0, n0, p) - fit(k1, n1, p))
    mark = np.zeros(SLOTS, bool)
    mark[live[(gain >= EVIDENCE) & (p1 >= RATIO * p0)]] = True
    return mark


def _marked_words(text: bytes, mark: np.ndarray) -> bytes:
    """The words of a text that hold a marked gram, with the spaces around them, each once for each of its places."""
    at = np.flatnonzero(mark[_slots(text)])
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    word = np.searchsorted(space, at, side="right") - 1
    inside = space[np.minimum(word + 1, len(space) - 1)] >= at + GRAM - 1
    some = np.unique(word[inside])
    # of a word without end, its first bytes: a dictionary of TOXIC bytes could not hold more
    return b"".join(text[space[k] : min(space[k + 1] + 1, space[k] + 4 * STEP)] for k in some.tolist() if k + 1 < len(space))


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    try:
        return zs.train_dictionary(size, samples, k=k, d=d, level=3).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[:size]


def dictionaries(texts: list[bytes], toxic: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """The dictionary trained on all windows of ordinary texts, and the toxic one: the same content and tables, and
    before them the content of a dictionary trained on the words that mark toxic texts.

    Most of a toxic text is ordinary, so a dictionary trained on all of it hardly differs from the ordinary one. What
    both share costs the same under both; only what is trained on marked words makes a difference.
    """
    samples = []
    for text, y in zip(texts, toxic, strict=True):
        if not y:
            samples += [text[i : i + n] for i, n in zip(*(x.tolist() for x in windows(text)), strict=True)]
    ordinary = _trained(ORDINARY, samples, 32, 8)
    del samples
    mark = _marks(counts, int((toxic == 0).sum()), int(toxic.sum()))
    more = [w for text, y in zip(texts, toxic, strict=True) if y and (w := _marked_words(text, mark))]
    content = _trained(TOXIC + 1024, more, 24, 6)
    at = content.find(_REPEATS)
    content = (content[at + len(_REPEATS) :] if at >= 0 else content)[-TOXIC:]
    at = ordinary.find(_REPEATS)
    at = at + len(_REPEATS) if at >= 0 else 0
    return ordinary, ordinary[:at] + content + ordinary[at:]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    kind = zs.DICT_TYPE_FULLDICT if content.find(_REPEATS) >= 0 else zs.DICT_TYPE_RAWCONTENT
    known = zs.ZstdCompressionDict(content if len(content) >= 8 else content.ljust(8), dict_type=kind)
    # level 13 with tables that hold a whole dictionary
    how = zs.ZstdCompressionParameters.from_level(13, window_log=18, hash_log=17, chain_log=18, write_content_size=False, write_dict_id=False)
    known.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=known, compression_params=how)


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)

    @staticmethod
    def _lengths(compressor: zs.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
        return np.array([len(x) for x in compressor.multi_compress_to_buffer(zs.BufferWithSegments(data, segments), threads=1)], np.int64)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text from ``plain``: how many windows, and what share, gain at least so many bytes under the toxic
        dictionary; the number of windows, the largest gain and the mean one."""
        out = np.empty((len(texts), 2 * len(GAINS) + 3))
        gains: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            base = np.cumsum([0] + [len(h[1]) for h in held[:-1]])
            start, length = (np.concatenate([x + b for (_, _, x, _), b in zip(held, base, strict=True)]), np.concatenate([h[3] for h in held]))
            data, segments = b"".join(h[1] for h in held), np.stack([start, length], 1).astype(np.uint64).tobytes()
            d = self._lengths(self.ordinary, data, segments) - self._lengths(self.toxic, data, segments)
            for (i, _, s, _), own in zip(held, np.split(d, np.cumsum([len(h[2]) for h in held])[:-1]), strict=True):
                gains[i].append(own)
            held, size = [], 0

        for i, text in enumerate(texts):
            start, length = windows(text)
            for a in range(0, len(start), CALL):
                s, n = start[a : a + CALL], length[a : a + CALL]
                held.append((i, text[s[0] : s[-1] + n[-1]], s - s[0], n))
                size += len(s)
                if size >= CALL:
                    flush()
        if held:
            flush()
        for i, parts in enumerate(gains):
            d = np.concatenate(parts)
            n = (d[:, None] >= GAINS).sum(0)
            out[i] = np.concatenate([np.log1p(n), n / len(d), [np.log(len(d)), d.max(), np.clip(d - 1, 0, None).mean()]])
        return out


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Dictionaries from all texts; the calibration from features that each half has under the other's dictionaries."""
    width = 2 * len(GAINS) + 3
    if not len(texts) or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(texts) + 1)
        flat = np.zeros(width + 1)
        flat[-1] = np.log(rate / (1 - rate))
        return Model(b"", b"", np.zeros(width), np.ones(width), flat)
    texts = [plain(t) for t in texts]
    x, half = np.zeros((len(texts), width)), np.arange(len(texts)) // 2 % 2
    both = np.zeros((2, SLOTS), np.uint16 if len(texts) < 1 << 16 else np.uint32)
    for side in (0, 1):
        own = np.flatnonzero(half != side)
        mine = [texts[i] for i in own]
        counts = _documents(mine, toxic[own])
        both += counts
        other = np.flatnonzero(half == side)
        pair = dictionaries(mine, toxic[own], counts)
        del counts, mine
        x[other] = Scorer(*pair).features([texts[i] for i in other])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    times = np.where(toxic > 0, RARE, 1)
    weights = logistic(np.repeat((x - mean) / scale, times, axis=0), np.repeat(toxic, times))
    return Model(*dictionaries(texts, toxic, both), mean, scale, weights)


def _shared(docs: DataFrame, labels: DataFrame, fold: int, held: int, sample: int):
    return docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "toxic", fold, held, sample, SAMPLE_BYTES)))


def _scoring(m: Model) -> Callable[[pa.RecordBatch], np.ndarray]:
    scorer = Scorer(m.ordinary, m.toxic)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        x = scorer.features([plain(t) for t in texts_of(batch)])
        return sigmoid(((x - m.mean) / m.scale) @ m.weights[:-1] + m.weights[-1])

    return score


def without_toxic(docs: DataFrame, labels: DataFrame, *, fold: int = 3, held: int = 1, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` less the rows that score ``threshold`` or more; one map over the rows, as in ``toxicity_scores``."""
    small_batches(docs.sparkSession)
    shared = _shared(docs.select("doc_id", "text"), labels, fold, held, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scoring(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, fold: int = 3, held: int = 1, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Learns from at most ``sample`` rows of ``labels`` whose crc32 remainder by ``fold`` is not ``held``, whole texts of
    ``SAMPLE_BYTES`` together at most. Every text is cut into windows at words; the lengths to which both
    dictionaries compress a window are compared, and the counts of gains become a probability.
    Null and empty texts are one empty window. Repeated rows get a row each; an empty table gives none; without
    labels of both kinds every score is the rate of the label.
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    shared = _shared(source, labels, fold, held, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scoring(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch))], names=["doc_id", "score"])

    scored = source.mapInArrow(run, source.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
