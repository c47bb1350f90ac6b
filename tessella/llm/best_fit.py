"""Best-fit packing planned on the histogram of lengths; documents take the planned slots by their rank within a length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessella.llm.bpe import loaded
from tessella.llm.common import small_batches, table
from tessella.scratch import stored

#: Bits of a rank within a length, in the number that holds both.
RANK_BITS = 44
IDS = ArrayType(IntegerType())


class Pattern(NamedTuple):
    """``bins`` sequences filled alike: ``parts`` are (length, how many of it), in the order in which they lie there."""

    bins: int
    parts: tuple[tuple[int, int], ...]


def plan(counts: np.ndarray, limit: int) -> list[Pattern]:
    """Best-fit decreasing over ``counts[length]``: the sequences that item-by-item best-fit makes, as patterns.

    All sequences of one pattern are alike, so a step fills them together; a length splits off two patterns at most.
    Work and result depend on ``limit``, not on the number of items.
    """
    rooms: list[int] = []  # of patterns that are not full, ascending
    by_room: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def keep(room: int, pattern: Pattern) -> None:
        if room == 0:
            done.append(pattern)
        elif room in by_room:
            by_room[room].append(pattern)
        else:
            by_room[room] = [pattern]
            insort(rooms, room)

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, parts = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, bins, parts = limit, left, ()
            each = room // length
            full = min(bins, left // each)
            if full:
                keep(room - each * length, Pattern(full, (*parts, (length, each))))
                left -= full * each
                bins -= full
            if bins and left:  # fewer than fill one sequence
                keep(room - left * length, Pattern(1, (*parts, (length, left))))
                left, bins = 0, bins - 1
            if bins and parts:
                keep(room, Pattern(bins, parts))
    return done + [p for room in rooms for p in by_room[room]]


class Slots(NamedTuple):
    """Ranges of slots of one length, in the order of (length, rank): arrays of equal size."""

    key: np.ndarray  # length << RANK_BITS | first rank of the range
    each: np.ndarray  # slots of the range in one sequence
    sequence: np.ndarray  # the first sequence of the range
    offset: np.ndarray  # where the range's first slot lies in a sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the slot with that rank among all slots of that length."""
        key = (length << RANK_BITS) | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        nth = key - self.key[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def slots(patterns: list[Pattern]) -> Slots:
    """The slots of a plan. At most two patterns a length, and distinct lengths whose sum is the limit in each: a few MB."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for bins, parts in patterns:
        offset = 0
        for length, each in parts:
            rows.append((length << RANK_BITS | taken.get(length, 0), each, first, offset))
            taken[length] = taken.get(length, 0) + bins * each
            offset += length * each
        first += bins
    rows.sort()
    return Slots(*np.array(rows, np.int64).reshape(-1, 4).T)


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, with_ids: bool) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids), and ``part`` with ``nth``, the task that made it and
    its number among the pieces of its length there."""
    source = docs.select("doc_id", "text")
    names = ["piece", "start", "length", "ids_crc32", "part", "nth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, seen, part = loaded(tokenizer), np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            texts = [np.append(x, np.uint32(end_id)).astype("<u4") for x in bpe.ids(batch.column("text").to_pylist())]
            total = np.array([len(x) for x in texts], np.int64)
            n = -(-total // limit)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            short = total - (n - 1) * limit  # of the first piece
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * limit)
            length = np.where(piece == 0, short[row], limit)
            own = [texts[i][a : a + m] for i, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            same, many = np.unique(length, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen[same], many)
            seen[same] += many
            crc = np.fromiter((zlib.crc32(x.tobytes()) for x in own), np.int64, len(own))
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (piece.astype(np.int32), start, length, crc, np.full(len(row), part), nth))]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names] + ["ids"] * with_ids)

    schema = source.select("doc_id").schema.add("piece", "integer")
    for name in names[1:]:
        schema = schema.add(name, "long")
    return source.mapInArrow(cut, schema.add("ids", IDS) if with_ids else schema)


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, limit: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Packs the ids of every text, and ``end_id`` after each, into as few sequences of at most ``limit`` ids as best-fit
    decreasing needs.

    Columns: doc_id, piece (int), start, length, ids_crc32, sequence_id, offset, and ``ids`` where asked for. A document
    longer than ``limit`` is cut into pieces of ``limit`` ids, of which the first may be shorter. Only the histogram of
    lengths (``limit`` numbers) is planned, on the driver; a piece finds its slot by its rank among the pieces of its
    length. A rank is the piece's number in the task that cut it, which is stored, plus the pieces of that length in
    earlier tasks, so that a common length needs no sort and meets in no task. Null and empty texts have the end id alone;
    repeated rows are packed each; doc_id is of any type and may be null; other columns are left out; an empty table gives
    no row.
    """
    small_batches(docs.sparkSession)
    cut = stored(pieces(docs, tokenizer, limit, end_id, with_ids), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = np.zeros(limit + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        total[length] = n
    planned = docs.sparkSession.sparkContext.broadcast(slots(plan(total, limit)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first.hint("merge"), ["part", "length"]).withColumn("nth", F.col("first") + F.col("nth")).drop("first", "part")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = planned.value.of(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            columns = [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset), *([batch.column("ids")] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "sequence_id", "offset"] + ["ids"] * with_ids)

    schema = ranked.select(*keep).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema.add("ids", IDS) if with_ids else schema)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
