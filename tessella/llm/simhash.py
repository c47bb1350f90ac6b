"""Near-duplicates by SimHash fingerprints that are compared bit-sliced."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import small_batches, table, texts_of, with_ids
from tessella.operators.graph import connected_components
from tessella.scratch import stored

_U = np.uint64
#: Shingle hashes of one text that are held at a time.
CHUNK = 1 << 16
#: Fingerprints of one key that a task compares in the first pass; keys with more are split into pairs of parts.
PART = 8192
#: Texts of a group that are compared shingle by shingle in one task; larger groups are split likewise.
SIMILAR = 512
#: Sketches of a cell that are compared in one task; larger cells are split likewise.
SKETCHES = 2048


def _add(ones: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum bit and the carry bit of three bits, in every lane."""
    x = ones ^ a
    return x ^ b, (ones & a) | (x & b)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, counted bit-sliced: carry-save adders thin out the rows of
    each weight until one is left."""
    rows, weight = h, 0
    total = np.zeros(64, np.int64)
    while len(rows):
        carries = []
        while len(rows) >= 3:
            k = len(rows) // 3
            s, c = _add(rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k])
            carries.append(c)
            rows = np.concatenate([s, rows[3 * k :]])
        if len(rows) == 2:
            carries.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        total += (((rows[0] >> np.arange(64, dtype=_U)) & _U(1)).astype(np.int64)) << weight
        rows = np.concatenate(carries) if carries else rows[:0]
        weight += 1
    return total


def fingerprint(text: bytes, shingle: int, distinct: bool = False) -> tuple[int, np.ndarray]:
    """SimHash of all shingles of the text's words, repeats included unless ``distinct``, and the shingles' hashes.

    Words are separated by ASCII white space and A-Z is lowered; a text of fewer words is one shingle; without words
    the fingerprint is 0.
    """
    words = text.lower().split()
    if not words:
        return 0, np.zeros(0, _U)
    total, n, digest, parts = np.zeros(64, np.int64), max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest, []
    for at in range(0, n, CHUNK):
        some = words[at : min(at + CHUNK, n) + shingle - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(some) >= shingle:
            starts, ends = starts[: len(some) - shingle + 1], ends[shingle - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        h = np.array([digest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], _U)
        if not distinct:
            total += bit_counts(h)
        parts.append(h)
    h = np.concatenate(parts) if len(parts) > 1 else parts[0]
    if distinct:
        h = np.unique(h)
        total, n = bit_counts(h), len(h)
    bits = (2 * total > n).astype(_U)
    return int((bits << np.arange(64, dtype=_U)).sum()), h


def fingerprints(docs: DataFrame, shingle: int, min_keys: int = 0) -> DataFrame:
    """``doc_id``, ``fp`` (signed) and, with ``min_keys``, ``keys``, the smallest shingle hashes in that many orders,
    ``node``, a hash of the words, ``size``, the number of distinct shingles, and their ``sketch``; ``fp`` is then of
    distinct shingles. One map over the rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, nodes, sizes, sketches = [], [], [], [], []
            for text in texts_of(batch):
                fp, h = fingerprint(text, shingle, distinct=min_keys > 0)
                fps.append(fp)
                if min_keys:
                    keys.append(minima(h, min_keys))
                    nodes.append(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())))
                    sizes.append(len(h))
                    sketches.append(sketch(h))
            out = [batch.column("doc_id"), pa.array(np.array(fps, _U).view(np.int64))]
            names = ["doc_id", "fp"]
            if min_keys:
                out.append(pa.array(keys, pa.list_(pa.int64())))
                out.append(pa.array(np.array(nodes, _U).view(np.int64)))
                out.append(pa.array(sizes, pa.int64()))
                out.append(pa.array(sketches, pa.binary()))
                names += ["keys", "node", "size", "sketch"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = docs.select("doc_id").schema.add("fp", "long")
    if min_keys:
        schema = schema.add("keys", T.ArrayType(T.LongType())).add("node", "long").add("size", "long").add("sketch", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def minima(h: np.ndarray, k: int) -> np.ndarray:
    """For each of ``k`` ways to order the hashes, the smallest one, mixed with the way's number."""
    if not len(h):
        return np.zeros(0, np.int64)
    out = []
    for way in range(k):
        mixed = (h ^ _U(0x9E3779B97F4A7C15 * (way + 1) % 2**64)) * _U(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> _U(31)
        out.append(mixed.min() ^ _U(way))
    return np.array(out, _U).view(np.int64)


def short_set(h: np.ndarray) -> np.ndarray:
    """The 32-bit hashes by which sets of shingles are compared, each once."""
    short = np.sort(h.astype(np.uint32))  # np.unique gives the same, in several times the time
    return short[np.append(np.ones(min(1, len(short)), bool), short[1:] != short[:-1])]


def sketch(h: np.ndarray) -> bytes:
    """Whether odd numbers of a set's 32-bit hashes fall on each of some bits: a power of two, as many as ``h`` has
    hashes or more, and 64 at least.

    A value that lies in one of two sets only turns one bit, so that sketches never differ in more bits than there are
    such values. A sketch becomes one of half as many bits by the exclusive or of its halves.
    """
    bits = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((short_set(h) & np.uint32(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def band_keys(fp: Column, radius: int) -> Column:
    """Keys of which two fingerprints within ``radius`` share at least one.

    The 64 bits are cut into ``radius + 2`` blocks. At least two of them hold no differing bit, so the two
    fingerprints agree on one of the pairs of blocks; a key is such a pair's bits and its number.
    """
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(signed(masks[i] | masks[j])).cast("long")), F.lit(k)) for k, (i, j) in enumerate(combinations(range(n), 2))])


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p of every fingerprint, 64 of them in a word; two spare words at the end."""
    n = -(-len(fp) // 64)
    padded = np.zeros((n + 2) * 64, _U)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(_U)


def _words(mask: np.ndarray, n: int) -> np.ndarray:
    """A mask of lanes as ``n`` words."""
    out = np.zeros(n * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view(_U)


def within(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose fingerprint is within ``radius`` of the one ``shift`` lanes on, of those wanted.

    ``wanted`` is a mask in words. Differences are added plane by plane with carry-save counters in 64 lanes at once;
    after every four planes the blocks (words) in which all lanes are beyond the radius are left out.
    """
    at = np.flatnonzero(wanted)
    want = wanted[at]
    jump, turn = divmod(shift, 64)
    width = (radius + 4).bit_length() + 1
    counter = [np.zeros(len(at), _U) for _ in range(width)]
    over = np.zeros(len(at), _U)
    for first in range(0, 64, 4):
        d = []
        for p in range(first, first + 4):
            row = planes[p]
            other = row[at + jump] >> _U(turn) if turn else row[at + jump]
            if turn:
                other = other | (row[at + jump + 1] << _U(64 - turn))
            d.append(row[at] ^ other)
        counter[0], c1 = _add(counter[0], d[0], d[1])
        counter[0], c2 = _add(counter[0], d[2], d[3])
        counter[1], carry = _add(counter[1], c1, c2)
        for k in range(2, width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        # lanes whose counter exceeds the radius: compare from the highest bit
        more, equal = over.copy(), ~over
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                equal &= counter[k]
            else:
                more |= equal & counter[k]
                equal &= ~counter[k]
        over = more
        alive = np.flatnonzero(want & ~over)
        if len(alive) < len(at):
            at, want, over = at[alive], want[alive], over[alive]
            counter = [c[alive] for c in counter]
        if not len(at):
            break
    lanes = np.unpackbits((want & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool) if len(at) else np.zeros((0, 64), bool)
    word, bit = np.nonzero(lanes)
    i = at[word] * 64 + bit
    return i, i + shift


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked places the smallest label among them, in place."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label[:] = label[label]


def links_of_runs(key: np.ndarray, fp: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within every run of equal keys, all fingerprints that chains of close pairs connect.

    Rows are ordered by key. Each diagonal (rows 1 apart, 2 apart, ...) is one bit-sliced comparison of all runs at
    once. Rows that are connected already are not compared again, so a dense run soon needs no further diagonal, and
    each row gives one link at most.
    """
    n = len(key)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, n))
    keep = np.repeat(size > 1, size)
    key, fp = key[keep], fp[keep]
    n = len(key)
    if n < 2:
        return fp[:0], fp[:0]
    size = size[size > 1]
    after = np.repeat(np.cumsum(size), size) - np.arange(n)  # rows from here to the end of the run
    first = np.repeat(np.cumsum(size) - size, size)
    label, planes, words = np.arange(n), _planes(fp), -(-n // 64)
    for shift in range(1, int(size.max())):
        wanted = after > shift
        wanted[: n - shift] &= label[: n - shift] != label[shift:]
        if not wanted.any():
            if (label == first).all():
                break
            continue
        a, b = within(planes, shift, _words(wanted, words), radius)
        if len(a):
            _settle(label, a, b)
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def _by_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Arrays of many rows; a run of equal first columns is never cut."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows += len(held[-1][0])
        if rows < 1 << 16:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = np.flatnonzero(cols[0] != cols[0][-1])
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held, rows = [[c[cut:] for c in cols]], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def close_links(keyed: DataFrame, radius: int) -> DataFrame:
    """``a`` and ``b``: links of fingerprints within ``radius`` that share a key, enough of them to connect all such.

    ``keyed`` has ``fp`` and ``keys``; fingerprints are distinct. Runs of one key come to one task as 16 bytes a row.
    A run of more than ``PART`` rows is passed on, and each pair of its parts is compared by another task.
    """
    n_tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = pa.int64()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _by_runs(batches, ["k", "fp"]):
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edge, len(key)))
            hot = np.repeat(size > PART, size)
            a, b = links_of_runs(key[~hot], fp[~hot].view(_U), radius)
            order = np.arange(len(key)) - np.repeat(edge, size)
            parts = np.repeat(-(-size // PART), size)
            none = np.zeros(len(a), bool)
            hot_key, hot_fp, part, of = key[hot], fp[hot], (order // PART)[hot], parts[hot]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a.view(np.int64), hot_fp])), pa.array(np.concatenate([b.view(np.int64), hot_fp])),
                    pa.array(np.concatenate([np.zeros(len(a), np.int64), hot_key]), long, mask=np.concatenate([~none, np.zeros(len(hot_key), bool)])),
                    pa.array(np.concatenate([np.zeros(len(a), np.int64), part]), long), pa.array(np.concatenate([np.zeros(len(a), np.int64), of]), long),
                ],
                names=["a", "b", "k", "part", "parts"],
            )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _by_runs(batches, ["k", "fp"]):
            a, b = links_of_runs(key, fp.view(_U), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    runs = keyed.select("fp", F.explode("keys").alias("k")).repartition(n_tasks, "k").sortWithinPartitions("k", "fp")
    found = stored(runs.select("k", "fp").mapInArrow(first, "a long, b long, k long, part long, parts long"), "links")
    # each part meets every part of its key, itself too: (part, other) with the smaller first
    pairs = found.where("k is not null").select(
        F.col("a").alias("fp"),
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.xxhash64("k", F.least("part", o), F.greatest("part", o)))).alias("k"),
    )
    more = pairs.repartition(n_tasks, "k").sortWithinPartitions("k", "fp").select("k", "fp").mapInArrow(second, "a long, b long")
    return found.where("k is null").select("a", "b").union(more)


def _meet(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a group (``cell``) of ``parts`` parts, each ``part`` with every other and itself: sorted by ``k``, a
    key of the two parts, and ``id``."""
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    pairs = F.explode(F.transform(others, lambda o: F.xxhash64("cell", F.least("part", o), F.greatest("part", o)))).alias("k")
    return rows.select(pairs, "id", *columns).repartition(n_tasks, "k").sortWithinPartitions("k", "id")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (id, cell, n) with the number of ``parts`` of about ``size`` rows that the cell has, and the row's part."""
    return rows.withColumn("parts", F.ceil(F.col("n") / size)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("n")


def _links_by_key(batches: Iterator[pa.RecordBatch], columns: list[str], labels: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``a`` and ``b``: the rows of each ``k`` linked to the row that ``labels`` of their columns names."""
    key, rows = None, []

    def links() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            names, *values = zip(*rows, strict=True)
            label, names = labels(*map(list, values)), np.array(names, np.int64)
            child = np.flatnonzero(label != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[label[child]])], names=["a", "b"])

    for batch in batches:
        values = [batch.column(c) for c in columns]
        values = [[x.values.to_numpy() for x in v] if pa.types.is_list(v.type) else v.to_pylist() for v in values]
        for k, *row in zip(batch.column("k").to_pylist(), batch.column("id").to_pylist(), *values, strict=True):
            if k != key:
                yield from links()
                key, rows = k, []
            rows.append(row)
    yield from links()


def sketch_links(rows: DataFrame, similarity: float) -> DataFrame:
    """``a`` and ``b``: links of rows (id, size, sketch, and the cell as in ``_meet``) that share a cell and whose
    sketches allow a similarity of at least ``similarity``, enough of them to connect all such rows."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _links_by_key(batches, ["size", "sketch"], lambda sizes, sketches: similar_sketches(sizes, sketches, similarity))

    return _meet(rows, "size", "sketch").mapInArrow(compare, "a long, b long")


def similar_sketches(sizes: list[int], sketches: list[bytes], similarity: float) -> np.ndarray:
    """A label for each sketch: one of those that links reach. Two link unless their sizes or the bits in which they
    differ rule out that their sets have a Jaccard similarity of at least ``similarity``."""
    n = len(sizes)
    order = np.argsort(np.array(sizes, np.int64), kind="stable")
    size, words = np.array(sizes, np.int64)[order], np.array([len(x) // 8 for x in sketches])[order]
    # two sets of that similarity have at most this share of their sizes' sum in one of them only
    share, label = (1 - similarity) / (1 + similarity), np.arange(n)
    # sizes are of 64-bit hashes, and one or two more than the sets' of 32 bits at times
    ends = np.searchsorted(size, size / similarity + 2, "right")
    for w in np.unique(words).tolist():
        low, high = np.searchsorted(words, [w, w + 1])
        own = np.array([np.bitwise_xor.reduce(np.frombuffer(sketches[r], _U).reshape(-1, w)) for r in order[low : ends[high - 1]]])
        for i in range(low, high):
            rest = slice(i + 1, ends[i])
            if (label[rest] == label[i]).all():
                continue
            differ = np.bitwise_count(own[i - low] ^ own[i + 1 - low : ends[i] - low]).sum(axis=1, dtype=np.int64)
            joined = np.unique(label[rest][differ <= share * (size[i] + size[rest]) + 1e-9])
            if len(joined) and (len(joined) > 1 or joined[0] != label[i]):
                joined = np.append(joined, label[i])
                label[np.isin(label, joined)] = joined.min()
    found = np.empty(n, np.int64)
    found[order] = order[label]
    return found


def similar_links(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a`` and ``b``: links of texts (id, text, and the cell as in ``_meet``) that share a cell and whose sets of
    shingles have a Jaccard similarity of at least ``similarity``, enough of them to connect all such texts.

    Each pair of parts of about ``SIMILAR`` texts is compared by a task of its own, which holds two parts at most.
    """
    own = ["cell", "parts", "part"]

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [short_set(fingerprint(t, shingle)[1]).view(np.int32) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ["id", *own]), pa.array(sets, pa.list_(pa.int32()))], names=["id", *own, "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _links_by_key(batches, ["s"], lambda sets: similar_sets(sets, similarity))

    # shingles are made once for a text, and dealt to its pairs of parts after that
    hashed = texts.select("id", *own, "text").mapInArrow(shingles, "id long, cell long, parts long, part long, s array<int>")
    return _meet(hashed, "s").mapInArrow(compare, "a long, b long")


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A label for each set: the first set that links of a Jaccard similarity of at least ``similarity`` reach.

    Values are put in one order, rare ones first. Two sets that link must share a value among the first
    ``n - ceil(similarity * n) + 1`` of each, so only sets that do, and whose sizes allow it, are compared; no pair is
    left out. Pairs that are connected already are not compared again.
    """
    n = len(sets)
    label, size = np.arange(n), np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return label
    owner = np.repeat(np.arange(n), size)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((value, count[value], owner))
    owner, value = owner[order], value[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    first = place <= (size - np.ceil(similarity * size - 1e-9).astype(np.int64))[owner]
    owner, value = owner[first], value[first]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    tried: set[int] = set()
    shift = 1
    while True:
        # runs of one value that are long enough for this shift and not connected yet
        edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        if not len(edge):
            return label
        run, own = np.diff(np.append(edge, len(value))), label[owner]
        keep = np.repeat((run > shift) & (np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)), run)
        owner, value = owner[keep], value[keep]
        a, b = owner[:-shift], owner[shift:]
        wanted = (value[:-shift] == value[shift:]) & (label[a] != label[b])
        wanted &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        for code in np.unique(a[wanted] * n + b[wanted]).tolist():
            i, j = divmod(code, n)
            if label[i] != label[j] and code not in tried:
                tried.add(code)
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both):
                    low, high = min(label[i], label[j]), max(label[i], label[j])
                    label[label == high] = low
        shift += 1


def _components(per_doc: DataFrame, keyed: DataFrame, radius: int) -> DataFrame:
    """``fp`` and ``component_id``, the smallest doc_id that links of fingerprints reach."""
    ids = per_doc.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    parts = connected_components(close_links(keyed, radius))
    named = parts.withColumnRenamed("node", "fp").join(ids, "fp")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(smallest, "component").select("fp", "component_id")
    alone = ids.join(parts.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("doc_id").alias("component_id"))
    return stored(linked.union(alone), "components")


def close_fingerprints(docs: DataFrame, *, shingle: int, radius: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints are SimHashes of word shingles; two link where at most ``radius`` of the 64 bits differ; all such
    pairs are found, through keys of which close fingerprints must share one. ``component_id`` is the smallest doc_id
    that links reach. Null and empty texts have the fingerprint 0 and link like any other. Rows with a null id keep
    their rows. Repeated rows each give a row; an empty table gives none. Other columns of ``docs`` are ignored.
    """
    per_doc = stored(fingerprints(docs, shingle), "fingerprints")
    keyed = per_doc.select("fp").distinct().select("fp", band_keys(F.col("fp"), radius).alias("keys"))
    return per_doc.join(_components(per_doc, keyed, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 18, min_keys: int = 8) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``component_id``, the smallest doc_id of its group of near-duplicates.

    Two texts link where their sets of word shingles have a Jaccard similarity of at least ``similarity``. Candidates
    share one of ``min_keys`` smallest shingle hashes, which such a pair misses once in 0.2**-min_keys times, and all of
    them are compared: those whose SimHashes connect within ``radius`` bits in their cluster, the others with the texts
    of other clusters that have the same key and about as many shingles. They are compared by sketches first, which rule
    out no pair that is similar, and those that links of such pairs connect exactly. Texts with the same words are one
    node. Texts without words are one group. Rows with a null id are alone, with a null component. Repeated rows each
    give a row; an empty table gives none. Other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    per_doc = stored(fingerprints(docs, shingle, min_keys), "fingerprints")
    keyed = per_doc.select("fp", F.explode("keys").alias("k")).distinct().select("fp", F.array("k").alias("keys"))
    clusters = _components(per_doc, keyed, radius)
    # one row for each different sequence of words: its smallest id
    kinds = per_doc.where("doc_id is not null").groupBy("node", "fp").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    kinds = stored(kinds.join(clusters, "fp").select("node", F.col("id").cast("long").alias("id"), "keys", "size", "sketch", F.col("component_id").cast("long").alias("cluster")), "kinds")
    # texts that may be similar have sizes of the same class or of neighbours: each comes to its own class and the next
    step = F.floor(F.log("size") / F.lit(-math.log(similarity) + 1e-6))
    by_key = kinds.select("node", "cluster", F.explode("keys").alias("k"), step.alias("step")).select("node", "cluster", F.explode(F.array(F.xxhash64("k", "step"), F.xxhash64("k", F.col("step") + 1))).alias("cell"))
    apart = by_key.groupBy("cell").agg(F.count("*").alias("n"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("cell", "n")
    several = kinds.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    held = kinds.join(several, "cluster").select("node", F.xxhash64("cluster", F.lit("cluster")).alias("cell"), "n").union(by_key.join(apart.hint("merge"), "cell").select("node", "cell", "n"))
    sketched = _dealt(held.join(kinds.select("node", "id", "size", "sketch").hint("merge"), "node"), SKETCHES)
    may_be = stored(connected_components(sketch_links(sketched, similarity)), "may-be-similar")
    group = may_be.groupBy(F.col("component").alias("cell")).agg(F.count("*").alias("n"))
    kind = dict(docs.dtypes)["doc_id"]
    chosen = _dealt(may_be.select(F.col("node").alias("id"), F.col("component").alias("cell")).join(group, "cell"), SIMILAR)
    chosen = stored(chosen.withColumn("doc_id", F.col("id").cast(kind)), "chosen")
    texts = with_ids(docs.select("doc_id", "text"), chosen).dropDuplicates(["doc_id"])
    parts = connected_components(similar_links(texts, shingle, similarity))
    groups = kinds.join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = stored(groups.select("node", F.coalesce("component", "id").cast(kind).alias("component_id")), "groups")
    some = per_doc.where("doc_id is not null").join(named, "node").select("doc_id", "component_id")
    return some.union(per_doc.where("doc_id is null").select("doc_id", F.col("doc_id").alias("component_id")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint of 4-word shingles, component_id; links at 4 or fewer differing bits."""
    return close_fingerprints(table(spark, sf_dir, "documents"), shingle=4, radius=4)
