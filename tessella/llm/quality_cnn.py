"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import labelled_sample, remainder, sigmoid, small_batches, table, texts_of

#: Bytes of a chunk, of a filter, and between a filter's places; chunks overlap, so that every place lies in one.
CHUNK, WIDTH, STRIDE = 512, 8, 2
#: Numbers for a byte, and filters.
EMBED, FILTERS = 8, 16
#: Labelled documents to learn from at most, and bytes of all their texts; steps, documents of a step, chunks of each
#: of them at most (others are drawn anew each time, from the whole text).
SAMPLE, SAMPLE_BYTES = 8000, 40 << 20
STEPS, DOCS, CHUNKS = 500, 48, 8
THRESHOLD = 0.3
_NEXT = CHUNK - WIDTH + STRIDE
#: Chunks that are computed at a time.
_BLOCK = 256


class Net(NamedTuple):
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # 2 * FILTERS: of the largest and of the mean over chunks
    constant: np.ndarray


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text, padded with zeros; an empty text has one."""
    n = max(1, -(-(len(text) - WIDTH + STRIDE) // _NEXT))
    data = np.zeros((n - 1) * _NEXT + CHUNK, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::_NEXT]


def _windows(net: Net, chunks: np.ndarray) -> np.ndarray:
    """Embedded bytes of every place of the filters: chunks x places x (WIDTH * EMBED)."""
    x = net.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def _pooled(net: Net, chunks: np.ndarray) -> np.ndarray:
    """The largest answer of each filter in each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), _BLOCK):
        w = _windows(net, chunks[i : i + _BLOCK])
        z = np.ascontiguousarray(w).reshape(-1, WIDTH * EMBED) @ net.filters
        out[i : i + _BLOCK] = z.reshape(w.shape[0], w.shape[1], FILTERS).max(1)
    return np.maximum(out + net.bias, 0)


def _combined(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest and mean over the chunks of each document; ``first`` is each one's first row."""
    n = np.diff(np.append(first, len(pooled)))[:, None]
    return np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / n], axis=1)


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; chunks of many texts are computed together, long texts in blocks."""
    out = np.zeros(len(texts))
    held, which, size = [], [], 0

    def flush() -> None:
        if held:
            first = np.concatenate([[0], np.cumsum([len(c) for c in held])[:-1]]).astype(np.int64)
            x = _combined(_pooled(net, np.concatenate(held)), first)
            out[which] = sigmoid(x @ net.dense + net.constant[0])
            held.clear()
            which.clear()

    for i, text in enumerate(texts):
        held.append(chunks_of(text))
        which.append(i)
        size += len(held[-1])
        if size >= 4 * _BLOCK:
            flush()
            size = 0
    flush()
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Net:
    """Adam on the log loss; gradients pass the maxima at the place that won."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    net = Net(
        rng.normal(0, 0.5, (256, EMBED)).astype(f32), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f32),
        np.zeros(FILTERS, f32), rng.normal(0, 0.1, 2 * FILTERS).astype(f32), np.array([np.log(rate / (1 - rate))], f32))
    if not len(texts) or labels.min() == labels.max():
        return net._replace(dense=np.zeros(2 * FILTERS, f32))
    m, v = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    order: list[int] = []
    kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
    for step in range(1, STEPS + 1):
        # a quarter of each step from the rarer label, weighted back to its share
        rare = int(len(kinds[1]) < len(kinds[0]))
        share = len(kinds[rare]) / len(labels)
        while len(order) < DOCS:
            order += rng.permutation(len(texts)).tolist()
        ids = np.array(order[:DOCS])
        del order[:DOCS]
        weight = np.ones(DOCS)
        if share < 0.25:
            ids[: DOCS // 4] = rng.choice(kinds[rare], DOCS // 4)
            seen = (labels[ids] == rare).mean()
            weight = np.where(labels[ids] == rare, share / seen, (1 - share) / (1 - seen))
        parts = []
        for i in ids:
            c = chunks_of(texts[i])
            parts.append(c if len(c) <= CHUNKS else c[np.sort(rng.choice(len(c), CHUNKS, replace=False))])
        count = np.array([len(c) for c in parts])
        doc, first = np.repeat(np.arange(DOCS), count), np.cumsum(count) - count
        chunks = np.concatenate(parts)
        at, value = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), f32)
        for i in range(0, len(chunks), _BLOCK):
            w = _windows(net, chunks[i : i + _BLOCK])
            z = (np.ascontiguousarray(w).reshape(-1, WIDTH * EMBED) @ net.filters).reshape(w.shape[0], w.shape[1], FILTERS)
            at[i : i + _BLOCK] = z.argmax(1)
            value[i : i + _BLOCK] = z.max(1)
        pooled = np.maximum(value + net.bias, 0)
        x = _combined(pooled, first)
        p = sigmoid(x @ net.dense + net.constant[0])
        g = (weight * (p - labels[ids]) / DOCS).astype(f32)
        gx = g[:, None] * net.dense
        top = x[doc, :FILTERS]
        share_of_top = (pooled == top) & (pooled > 0)
        ties = np.maximum(np.add.reduceat(share_of_top, first, dtype=f32), 1)[doc]
        gp = (gx[doc, :FILTERS] * share_of_top / ties + gx[doc, FILTERS:] / count[doc][:, None]) * (pooled > 0)
        place = at * STRIDE
        spots = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        won = net.embed[spots].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        g_filters = np.einsum("mf,mfk->kf", gp, won)
        g_embed = np.zeros_like(net.embed)
        back = (gp[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        flat = spots.reshape(-1)
        for e in range(EMBED):
            g_embed[:, e] = np.bincount(flat, weights=back[:, e], minlength=256)
        grads = [g_embed, g_filters, gp.sum(0), x.T @ g, np.array([g.sum()], f32)]
        speed = 0.01 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        new = []
        for k, (w, d) in enumerate(zip(net, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            new.append((w - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(f32))
        net = Net(*new)
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, *, fold: int = 5, held: int = 0, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Learns from at most ``sample`` rows of ``labels`` whose crc32 remainder by ``fold`` is not ``held``, whole texts
    of ``SAMPLE_BYTES`` together at most. Every filter slides over every chunk of a text;
    its largest answers, and their largest and mean over the chunks, become one probability. Null and empty texts are
    one chunk of padding. Repeated rows get a row each; an empty table gives none; without labels of both kinds every
    score is the rate of the label.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(train(*labelled_sample(source, labels, "quality", fold, held, sample, SAMPLE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(net, texts_of(batch)))], names=["doc_id", "score"])

    scored = source.mapInArrow(run, source.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
