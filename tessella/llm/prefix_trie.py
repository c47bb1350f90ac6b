"""The trie of conversation prefixes: conversations are sorted, and every prefix finds its members as an interval, by
range minima over the lengths of the prefixes that neighbours share."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import rows_to_batches, small_batches, table
from tessella.llm.spans import mix
from tessella.scratch import stored

#: Turns in one sorted row: a longer conversation is several rows, so that no row grows with it.
SEGMENT = 512
#: Turns and rows whose range minima are built at once: bounds a task's memory.
BLOCK_TURNS, BLOCK_ROWS = 1 << 18, 1 << 16
#: Members whose ids travel together.
CHUNK = 4096
#: Bytes of a turn's hash, and of what precedes the hashes in a key: the segment's number and the hash of the path to it.
WIDE, HEADER = 16, 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

RUNS = "conv_id long, pos long, hashes binary, sizes binary"
PARTS = ("kind int, part long, depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, n long, saved long, leaves long, children long, "
         "ids array<long>, key binary, sizes binary, last_key binary, last_sizes binary, last_conv long")
_NAMES = [x.split()[0] for x in PARTS.split(", ")]
_NODE, _ENDS, _EDGE, _TAIL = range(4)


def _concatenated(parts: Column, field: str) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda held, x: F.concat(held, x[field]))


# turns in order ---------------------------------------------------------------------------------------------------

def turn_runs(conversations: DataFrame) -> DataFrame:
    """Turns in the order of ``turn`` (null first; of equal ones, of their hash), as runs of at most ``SEGMENT``:
    conv_id, pos (turns before the run), hashes (16 bytes a turn: md5 of role and text) and sizes (bytes of each text).

    Null roles and texts are empty; rows without conv_id belong to no conversation and are left out. Turns are sorted over
    range partitions, so that one conversation may lie in many; what a partition's first conversation has before it comes
    from a summary of each partition (five numbers, on the driver).
    """
    small_batches(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = stored(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.unhex(F.md5(named.cast("binary"))).alias("hash"), F.octet_length(text).alias("size")), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "hash"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def rows() -> Iterator[tuple]:
            part, first, own, seen, run = TaskContext.get().partitionId(), None, None, 0, 0
            for batch in batches:
                ids = batch.column("conv_id").to_numpy()
                hashes, sizes = b"".join(batch.column("hash").to_pylist()), batch.column("size").to_numpy().astype("<i4").tobytes()
                cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a and ids[a] != own:
                        own, seen = int(ids[a]), 0
                        first = own if first is None else first
                    for i in range(a, b, SEGMENT):
                        j = min(b, i + SEGMENT)
                        yield part, run, own, seen, own == first, j - i, hashes[WIDE * i : WIDE * j], sizes[4 * i : 4 * j]
                        seen, run = seen + j - i, run + 1

        names = ["part", "run", "conv_id", "seen", "first", "n", "hashes", "sizes"]
        yield from rows_to_batches(names, [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary(), pa.binary()], rows(), 512)

    runs = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, "part long, run long, conv_id long, seen long, first boolean, n long, hashes binary, sizes binary"), "runs")
    summary = runs.groupBy("part").agg(
        F.min_by("conv_id", "run"), F.max_by("conv_id", "run"), F.max_by(F.col("seen") + F.col("n"), "run")).collect()
    before, total, open_ = [], 0, None
    for part, first, last, n in sorted(map(tuple, summary)):
        carried = total if first == open_ else 0
        before.append((part, carried))
        total, open_ = n + (carried if last == first else 0), last
    carry = runs.sparkSession.createDataFrame(before, "part long, carried long")
    return runs.join(F.broadcast(carry), "part").select(
        "conv_id", (F.col("seen") + F.when(F.col("first"), F.col("carried")).otherwise(0)).alias("pos"), "hashes", "sizes")


def with_borrowed_heads(runs: DataFrame, every: int = 5, below: int = 9) -> DataFrame:
    """Runs of the rebuilt conversations: the first h turns of conversation c - c % ``every`` (all if fewer, none if it is
    absent), then c's own turns after its first h; h is crc32(c in decimal) % ``below``. A conversation that has no turn
    left has one empty run.

    The heads are one row a conversation of at most ``below`` - 1 turns; runs meet them in a plain join, which adaptive
    execution may split where one conversation has very many runs.
    """
    base, most = F.col("conv_id") - F.col("conv_id") % every, below - 1
    short = runs.where((F.col("conv_id") % every == 0) & (F.col("pos") < most))
    start = F.array_sort(F.collect_list(F.struct(
        "pos", F.substring("hashes", 1, WIDE * most).alias("hashes"), F.substring("sizes", 1, 4 * most).alias("sizes"))))
    heads = short.groupBy(F.col("conv_id").alias("base")).agg(start.alias("parts")).select(
        "base", _concatenated(F.col("parts"), "hashes").alias("head"), _concatenated(F.col("parts"), "sizes").alias("head_sizes"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for c, pos, hashes, sizes, head, head_sizes in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "hashes", "sizes", "head", "head_sizes")), strict=True):
                    h = zlib.crc32(str(c).encode()) % below
                    head, head_sizes = (head or b"")[: WIDE * h], (head_sizes or b"")[: 4 * h]
                    skipped = max(0, h - pos)
                    own, own_sizes, at = hashes[WIDE * skipped :], sizes[4 * skipped :], len(head) // WIDE + max(pos, h) - h
                    if pos == 0:
                        yield c, 0, head, head_sizes
                    if own:
                        yield c, at, own, own_sizes

        yield from rows_to_batches(["conv_id", "pos", "hashes", "sizes"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows(), 512)

    joined = runs.withColumn("base", base).join(heads.hint("merge"), "base", "left")
    return joined.select("conv_id", "pos", "hashes", "sizes", "head", "head_sizes").mapInArrow(rebuild, RUNS)


# rows that are sorted ---------------------------------------------------------------------------------------------

def lanes(hashes: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """128 bits for each turn and where it stands: the hash of a path is the exclusive or of its turns'."""
    return np.stack([mix(hashes[:, k] + depth.astype(np.uint64) * _ODD[k]) for k in (0, 1)], axis=1)


def keyed(runs: DataFrame) -> DataFrame:
    """One row for each ``SEGMENT`` turns of a conversation: conv_id, seg, sizes and key, which sorts by segment, by the
    path to it and by its turns. The last row of a conversation is the one with fewer turns, maybe with none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for c, pos, hashes, sizes in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "hashes", "sizes")), strict=True):
                    end = pos + len(sizes) // 4
                    at = pos
                    while at < end or at == pos:
                        to = min(end, (at // SEGMENT + 1) * SEGMENT)
                        yield c, at // SEGMENT, at, hashes[WIDE * (at - pos) : WIDE * (to - pos)], sizes[4 * (at - pos) : 4 * (to - pos)]
                        if to > at and to % SEGMENT == 0:
                            yield c, to // SEGMENT, to, b"", b""
                        if to == at:
                            break
                        at = to

        yield from rows_to_batches(["conv_id", "seg", "pos", "hashes", "sizes"], [pa.int64()] * 3 + [pa.binary()] * 2, rows(), 512)

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg = batch.column("seg").to_numpy()
            h = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<u8").reshape(-1, 2)
            depth = (seg[:, None] * SEGMENT + np.arange(SEGMENT)).ravel()
            p = np.bitwise_xor.reduce(lanes(h, depth).reshape(-1, SEGMENT, 2), axis=1).view(np.int64) if len(seg) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(seg + 1), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["conv_id", "seg", "p1", "p2"])

    parts = F.array_sort(F.collect_list(F.struct("pos", "hashes", "sizes")))
    whole = stored(runs.mapInArrow(cut, "conv_id long, seg long, pos long, hashes binary, sizes binary").groupBy("conv_id", "seg").agg(parts.alias("parts")).select(
        "conv_id", "seg", _concatenated(F.col("parts"), "hashes").alias("hashes"), _concatenated(F.col("parts"), "sizes").alias("sizes")), "segments")
    full = whole.where(F.octet_length("sizes") == 4 * SEGMENT).select("conv_id", "seg", "hashes")
    so_far = Window.partitionBy("conv_id").orderBy("seg")
    bases = full.mapInArrow(path, "conv_id long, seg long, p1 long, p2 long").select(
        "conv_id", "seg", F.bit_xor("p1").over(so_far).alias("p1"), F.bit_xor("p2").over(so_far).alias("p2"))
    header = F.concat(F.lpad(F.hex("seg"), 8, "0"), *(F.lpad(F.hex(F.coalesce(p, F.lit(0))), 16, "0") for p in ("p1", "p2")))
    return stored(whole.join(bases.hint("merge"), ["conv_id", "seg"], "left").select(
        "conv_id", "seg", F.concat(F.unhex(header), "hashes").alias("key"), "sizes"), "keyed")


class Rows:
    """Sorted rows as arrays. ``path`` and ``size`` answer for the first ``j`` turns of a row."""

    def __init__(self, keys: list[bytes], sizes: list[bytes]):
        self.keys = keys
        head = np.frombuffer(b"".join(k[:HEADER] for k in keys), np.uint8).reshape(-1, HEADER)
        self.seg = head[:, :4].copy().view(">u4").ravel().astype(np.int64)
        self.base = np.stack([head[:, a : a + 8].copy().view(">u8").ravel().astype(np.uint64) for a in (4, 12)], axis=1)
        self.length = np.array([len(k) - HEADER for k in keys], np.int64) // WIDE
        self.start = np.cumsum(self.length) - self.length
        self.hashes = np.frombuffer(b"".join(k[HEADER:] for k in keys), "<u8").reshape(-1, 2)
        within = np.arange(len(self.hashes)) - np.repeat(self.start, self.length)
        mixed = lanes(self.hashes, np.repeat(self.seg, self.length) * SEGMENT + within)
        self._paths = np.concatenate([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(mixed, axis=0)]) if len(mixed) else np.zeros((1, 2), np.uint64)
        self._sizes = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(sizes), "<i4").astype(np.int64))])
        self.total = self.size(np.arange(len(keys)), self.length)

    def path(self, row: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self._paths[self.start[row] + j] ^ self._paths[self.start[row]] ^ self.base[row]).view(np.int64)

    def size(self, row: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._sizes[self.start[row] + np.maximum(j, 0)] - self._sizes[self.start[row]]

    def shared(self) -> np.ndarray:
        """Turns that each row shares with the one before; -1 where they have no common path, and for the first."""
        n = len(self.keys)
        lcp = np.full(n, -1, np.int64)
        if n < 2:
            return lcp
        m = np.minimum(self.length[1:], self.length[:-1])
        j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        other = (self.hashes[np.repeat(self.start[1:], m) + j] != self.hashes[np.repeat(self.start[:-1], m) + j]).any(axis=1)
        lcp[1:] = m
        row = np.repeat(np.arange(n - 1), m)[other]
        if len(row):
            where, first = np.unique(row, return_index=True)
            lcp[where + 1] = j[other][first]
        apart = (self.seg[1:] != self.seg[:-1]) | (self.base[1:] != self.base[:-1]).any(axis=1)
        lcp[1:][apart] = -1
        return lcp


class RangeMinima:
    """A sparse table: the minimum of every stretch whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
        self.n = len(values)

    def minimum(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of ``values[left : right + 1]``."""
        out = np.empty(len(left), self.levels[0].dtype)
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][left[at]], self.levels[k][right[at] - (1 << k) + 1])
        return out

    def extent(self, row: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The furthest rows on either side of ``row`` that share ``least`` turns with it, by binary search on each side."""
        left, right = row.copy(), row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, level = 1 << k, self.levels[k]
            to = left - step
            ok = to >= 0
            ok[ok] = level[to[ok] + 1] >= least[ok]
            left[ok] = to[ok]
            to = right + step
            ok = to < self.n
            ok[ok] = level[right[ok] + 1] >= least[ok]
            right[ok] = to[ok]
        return left, right


def _batch(kind: int, **columns: np.ndarray | list | pa.Array) -> pa.RecordBatch:
    """Rows of ``PARTS`` of one kind; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    types = {"kind": pa.int32(), "ids": pa.list_(pa.int64()), **dict.fromkeys(("key", "sizes", "last_key", "last_sizes"), pa.binary())}
    arrays = [pa.array(columns[x], types.get(x, pa.int64())) if x in columns else pa.nulls(n, types.get(x, pa.int64())) for x in _NAMES[1:]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *arrays], names=_NAMES)


def _nodes(depth: np.ndarray, path: np.ndarray, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return _batch(_NODE, depth=depth, p1=path[:, 0].copy(), p2=path[:, 1].copy(), **columns)


def block_parts(conv: np.ndarray, keys: list[bytes], sizes: list[bytes]) -> Iterator[pa.RecordBatch]:
    """What sorted rows tell of every node on their paths, as if no row stood before the first or behind the last.

    Candidates are the end of each row and what each row shares with the one before; each searches its two extents in
    the sparse table. Equal intervals are one; the depths between an interval's and its parent's have the same members.
    """
    rows = Rows(keys, sizes)
    n, length, lcp = len(keys), rows.length, rows.shared()
    minima = RangeMinima(lcp)
    bound = np.flatnonzero(lcp >= 0)
    row, depth = np.concatenate([np.arange(n), bound]), np.concatenate([length, lcp[bound]])
    left, right = minima.extent(row, depth)
    _, first, same = np.unique(left * (SEGMENT + 1) + depth, return_index=True, return_inverse=True)
    left, right, depth = left[first], right[first], depth[first]
    after = np.append(lcp, -1)
    above = np.maximum(after[left], after[right + 1])
    candidate = np.full(n + 1, -1)
    candidate[bound] = n + np.arange(len(bound))
    at = np.where(after[left] >= after[right + 1], left, right + 1)
    parents = same[candidate[at[above >= 0]]]
    branches = np.bincount(parents, minlength=len(left))

    ends = length < SEGMENT
    leaf = ends & (after[1:] < length)
    new = rows.total - rows.size(np.arange(n), lcp)
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("leaf", leaf), ("total", rows.total), ("new", new))}

    of = np.repeat(np.arange(len(left)), depth - above)
    j = above[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(depth - above) - (depth - above), depth - above)
    l, r = left[of], right[of]
    real = (j > 0) | (rows.seg[l] == 0)  # a later segment's start is the last node of the segment before, which counts it
    before = rows.size(l, j - 1)
    many = r - l + 1
    total = sums["total"][r + 1] - sums["total"][l] - many * before
    distinct = sums["new"][r + 1] - sums["new"][l + 1] + rows.total[l] - before
    smallest = RangeMinima(conv).minimum(l, r)
    up, no_parent = rows.path(l, np.maximum(j - 1, 0)), j == 0
    yield _nodes(
        rows.seg[l] * SEGMENT + j, rows.path(l, j), q1=pa.array(up[:, 0].copy(), mask=no_parent), q2=pa.array(up[:, 1].copy(), mask=no_parent),
        conv_id=pa.array(smallest, mask=~real), n=np.where(real, many, 0), saved=np.where(real, total - distinct, 0),
        leaves=np.where(real, sums["leaf"][r + 1] - sums["leaf"][l], 0), children=np.where(j < depth[of], 1, branches[of]))

    last = np.flatnonzero(ends)
    if len(last):
        fresh = np.concatenate([[True], (lcp[last[1:]] < length[last[1:]]) | (length[last[1:]] != length[last[:-1]]) | (np.diff(last) > 1)])
        begin = np.flatnonzero(fresh)
        cuts = np.unique(np.concatenate([begin, *(np.arange(a, b, CHUNK) for a, b in zip(begin, np.append(begin[1:], len(last)), strict=True) if b - a > CHUNK)]))
        offsets = np.append(cuts, len(last)).astype(np.int32)
        i = last[cuts]
        p = rows.path(i, length[i])
        yield _batch(_ENDS, depth=rows.seg[i] * SEGMENT + length[i], p1=p[:, 0].copy(), p2=p[:, 1].copy(), ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(conv[last])))
    deep = np.flatnonzero(rows.seg > 0)
    if len(deep):
        yield _batch(_TAIL, conv_id=conv[deep], depth=rows.seg[deep], saved=(rows.total - new)[deep], leaves=leaf[deep].astype(np.int64))


def seam_parts(a_conv: int, a_key: bytes, a_sizes: bytes, conv: int, key: bytes, sizes: bytes) -> Iterator[pa.RecordBatch]:
    """What must be added when a row turns out to follow another: the nodes on their common path are not new again, and
    the row before is no leaf if the other goes on from its end."""
    rows = Rows([a_key, key], [a_sizes, sizes])
    shared = int(rows.shared()[1])
    if shared < 0:
        return
    j, row = np.arange(shared + 1), np.ones(shared + 1, np.int64)
    twice = int(rows.size(np.array([1]), np.array([shared]))[0])
    leaf = int(rows.length[0] == shared and shared < SEGMENT)
    real, seg = (j > 0) | (rows.seg[1] == 0), int(rows.seg[1])
    yield _nodes(seg * SEGMENT + j, rows.path(row, j), saved=np.where(real, twice - rows.size(row, j - 1), 0),
                 leaves=np.where(real, -leaf, 0), children=-(j < shared).astype(np.int64))
    if seg:
        yield _batch(_TAIL, conv_id=[conv, a_conv], depth=[seg, seg], saved=[twice, 0], leaves=[0, -leaf])


def sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sorted rows, block after block; at the end its first and its last row."""
    from pyspark import TaskContext

    first: tuple | None = None
    last: tuple | None = None
    held: list[tuple[int, bytes, bytes]] = []
    turns = 0

    def close() -> Iterator[pa.RecordBatch]:
        conv, keys, sizes = zip(*held, strict=True)
        if last is not None:
            yield from seam_parts(*last, *held[0])
        yield from block_parts(np.array(conv, np.int64), list(keys), list(sizes))

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "key", "sizes")), strict=True):
            held.append(row)
            first = first or row
            turns += len(row[2]) // 4
            if turns >= BLOCK_TURNS or len(held) >= BLOCK_ROWS:
                yield from close()
                last, held, turns = row, [], 0
    if held:
        yield from close()
        last = held[-1]
    if first is not None:
        yield _batch(_EDGE, part=[TaskContext.get().partitionId()], conv_id=[first[0]], key=[first[1]], sizes=[first[2]], last_conv=[last[0]], last_key=[last[1]], last_sizes=[last[2]])


def _seams(parts: DataFrame) -> DataFrame:
    """Corrections between one task's last row and the next one's first. The driver sees the numbers of the tasks alone."""
    edges = parts.where(f"kind = {_EDGE}")
    found = sorted(r[0] for r in edges.select("part").collect())
    pairs = edges.sparkSession.createDataFrame(list(zip(found[1:], found[:-1], strict=True)), "part long, before long")
    ends = edges.select(F.col("part").alias("before"), "last_conv", "last_key", "last_sizes")
    both = edges.select("part", "conv_id", "key", "sizes").join(F.broadcast(pairs), "part").join(ends.hint("merge"), "before")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("last_conv", "last_key", "last_sizes", "conv_id", "key", "sizes")), strict=True):
                yield from seam_parts(*row)

    return both.mapInArrow(join, PARTS)


def _tails(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """What later segments of a conversation add to the nodes of its earlier ones."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg"))
    tails = parts.where(f"kind = {_TAIL}").groupBy("conv_id", F.col("depth").alias("seg")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(
        "conv_id", (F.col("seg") - 1).alias("seg"), F.sum("saved").over(later).alias("saved"), F.sum("leaves").over(later).alias("leaves"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, sizes, saved, leaves in zip(*(batch.column(x).to_pylist() for x in ("key", "sizes", "saved", "leaves")), strict=True):
                one = Rows([key], [sizes])
                j = np.arange(int(one.seg[0] > 0), int(one.length[0]) + 1)
                yield _nodes(one.seg[0] * SEGMENT + j, one.path(np.zeros(len(j), np.int64), j), saved=np.full(len(j), saved), leaves=np.full(len(j), leaves))

    return rows.join(tails.hint("merge"), ["conv_id", "seg"]).select("key", "sizes", "saved", "leaves").mapInArrow(spread, PARTS)


def _digests(parts: DataFrame) -> DataFrame:
    """sha256 of the ids that end at each node. Chunks come in order, so a node takes constant memory, however many end there."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, sha = None, None
            for batch in batches:
                for *own, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "p1", "p2", "ids")), strict=True):
                    if own != node:
                        if node is not None:
                            yield *node, sha.hexdigest()
                        node, sha = own, hashlib.sha256()
                    else:
                        sha.update(b",")
                    sha.update(",".join(map(str, ids)).encode())
            if node is not None:
                yield *node, sha.hexdigest()

        yield from rows_to_batches(["depth", "p1", "p2", "sha"], [pa.int64()] * 3 + [pa.string()], rows())

    chunks = parts.where(f"kind = {_ENDS}").select("depth", "p1", "p2", "ids", F.col("ids")[0].alias("first"))
    return chunks.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "first").mapInArrow(digest, "depth long, p1 long, p2 long, sha string")


def prefix_nodes(runs: DataFrame) -> DataFrame:
    """Per node of the trie of all conversations' prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as ``conversation_trie`` has them; from runs of turns."""
    small_batches(runs.sparkSession)
    rows = keyed(runs)
    order = ["key", "conv_id"]
    parts = stored(rows.select("conv_id", "key", "sizes").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sorted_parts, PARTS), "trie-parts")
    seams = stored(_seams(parts), "trie-seams")
    every = parts.unionByName(seams)
    told = ["depth", "p1", "p2", "q1", "q2", "conv_id", "n", "saved", "leaves", "children"]
    stats = every.where(f"kind = {_NODE}").select(*told).unionByName(_tails(rows, every).select(*told)).withColumn("sha", F.lit(None).cast("string"))
    merged = stats.unionByName(_digests(parts), allowMissingColumns=True).groupBy("depth", "p1", "p2").agg(
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("sha").alias("sha"))
    nodes = stored(merged, "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents.hint("merge"), ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the prefixes of all conversations (columns conv_id, turn, role, text; others are left out).

    A node at depth d is a distinct sequence of the first d turns (role, text); its members are the conversations that
    begin with it. Per node: conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs,
    n_children, n_leaves (childless nodes below or at it), saved_tokens (over its subtree, members but one times the bytes
    of the last text) and ends_sha256 (of the comma-joined ids, ascending, of the members that end there). ``turn`` orders
    a conversation, null first; turns of one number, repeated rows included, follow the hash of role and text. Null roles
    and texts are empty; rows without conv_id are left out; conv_id must cast to long. An empty table gives no row.
    """
    return prefix_nodes(turn_runs(conversations))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_nodes(with_borrowed_heads(turn_runs(table(spark, sf_dir, "conversations"))))


#: The same in SQL. crc32 is a reduction in which eight marks behind each byte are its steps; a path is 33 characters a turn.
OP13_SQL = """
with turns as (
  select conv_id c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 i
  from conversations where conv_id is not null),
convs as (
  select c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(c::varchar) + 1),
      lambda k: [ascii((c::varchar)[k])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda v, x: case when x >= 0 then xor(v, x) else xor(v >> 1, (v & 1) * 3988292384) end)) % 9 h
  from (select distinct c from turns)),
heads as (select v.c, t.i, t.role, t.text from convs v join turns t on t.c = v.c - v.c % 5 and t.i < v.h),
own as (
  select t.c, coalesce(k.n, 0) + t.i - v.h i, t.role, t.text
  from turns t join convs v using (c) left join (select c, count(*) n from heads group by c) k using (c) where t.i >= v.h),
members as (
  select c, i + 1 d, strlen(text) b, string_agg(md5(strlen(role) || ':' || role || text) || '/', '') over (partition by c order by i) p from (from heads union all from own)
  union all select c, 0, 0, '' from convs),
nodes as (select d, p, min(c) conv_id, count(*) n, any_value(b) b from members group by d, p),
ends as (select d, p, sha256(string_agg(c::varchar, ',' order by c)) sha from (select * from members qualify d = max(d) over (partition by c)) group by d, p),
kids as (select d - 1 d, left(p, 33 * (d - 1)) p, count(*) n from nodes where d > 0 group by 1, 2),
under as (
  select a d, left(p, 33 * a) p, sum((n - 1) * b) saved, count(*) filter (where leaf) leaves
  from (select n.*, k.n is null leaf, unnest(range(0, n.d + 1)) a from nodes n left join kids k using (d, p)) group by 1, 2)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens,
  coalesce(e.sha, sha256('')) ends_sha256
from nodes n join under s using (d, p) left join kids k using (d, p) left join ends e using (d, p) left join nodes u on u.d = n.d - 1 and u.p = left(n.p, 33 * (n.d - 1))
"""
