"""Packing of token sequences into training sequences under several limits at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import loaded
from tessella.llm.common import rows_to_batches, small_batches, table

#: Sequences of one task that may be open at once: bounds the heuristic's work for a piece and the task's memory.
OPEN = 64


class Piece(NamedTuple):
    doc: int
    start: int
    ids: np.ndarray
    total: int
    loss: np.ndarray  # which ids bear loss

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n], loss=self.loss[:n]), self._replace(start=self.start + n, ids=self.ids[n:], loss=self.loss[n:])

    def size(self) -> np.ndarray:
        return np.array([len(self.ids), 1, np.count_nonzero(self.loss)], np.int64)


class VectorPacker:
    """Vector bin packing by the dot-product heuristic, one batch of items after another.

    An item has a size in each dimension: tokens, segments (1) and loss-bearing tokens. Whole sequences are first
    taken from its front. Of the open sequences that have room in every dimension, the rest goes to the one whose
    remaining room has the largest dot product with the rest's size, both as shares of the limits; the fuller one
    wins a tie. The largest rests of a batch go first. A rest that fits nowhere opens a sequence, or, where ``OPEN``
    are open, is cut to fill the one with the most room. At the end the pieces of the sequences that are not full are
    put one after another into new ones, and what is left into sequences of powers of two, which need no padding.
    """

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, np.int64)
        self.room = np.zeros((0, 3), np.int64)
        self.held: list[list[Piece]] = []

    def _fitting(self, piece: Piece, room: np.ndarray) -> int:
        """The most ids of the front of a piece for which there is room."""
        if room[1] < 1:
            return 0
        n = int(min(len(piece.ids), room[0]))
        return int(np.searchsorted(np.cumsum(piece.loss[:n]), room[2], side="right"))

    def _put(self, k: int, piece: Piece) -> Iterator[list[Piece]]:
        self.held[k].append(piece)
        self.room[k] -= piece.size()
        if not self.room[k].all():
            self.room = np.delete(self.room, k, axis=0)
            yield self.held.pop(k)

    def _open(self) -> int:
        self.room = np.vstack([self.room, self.limits])
        self.held.append([])
        return len(self.held) - 1

    def add(self, items: list[Piece]) -> Iterator[list[Piece]]:
        """Sequences that the items fill; the rest stays open."""
        rests = []
        for piece in items:
            while len(piece.ids) >= self.limits[0] and self._fitting(piece, self.limits) == self.limits[0]:
                full, piece = piece.cut(int(self.limits[0]))
                yield [full]
            if len(piece.ids):
                rests.append(piece)
        rests.sort(key=lambda p: -len(p.ids))
        for piece in rests:
            while len(piece.ids):
                size = piece.size()
                fits = np.flatnonzero((self.room >= size).all(axis=1))
                if len(fits):
                    score = (self.room[fits] / self.limits) @ (size / self.limits)
                    k, n = int(fits[np.lexsort((self.room[fits, 0], -score))[0]]), len(piece.ids)
                else:
                    k = int(np.argmax(self.room[:, 0])) if len(self.held) >= OPEN else self._open()
                    n = self._fitting(piece, self.room[k])
                    if not n:  # of loss-bearing ids there is no room: this one closes as it is
                        self.room = np.delete(self.room, k, axis=0)
                        yield self.held.pop(k)
                        continue
                front, piece = piece.cut(n)
                yield from self._put(k, front)

    def finish(self) -> Iterator[list[Piece]]:
        """Sequences of what is still open."""
        loose = [p for held in self.held for p in held]
        self.room, self.held = np.zeros((0, 3), np.int64), []
        while loose:
            left = sum(len(p.ids) for p in loose)
            # all that is left, cut to the next power of two below it where no whole sequence can be filled
            goal = self.limits.copy()
            if left < goal[0]:
                goal[0] = 1 << (left.bit_length() - 1)
            out = []
            while loose and goal[0] and (n := self._fitting(loose[0], goal)):
                front, rest = loose.pop(0).cut(n)
                goal -= front.size()
                out.append(front)
                if len(rest.ids):
                    loose.insert(0, rest)
            yield out


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, limit: int = 2048, segments: int = 256,
                   loss_tokens: int | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every id of every text, and ``end_id`` after each, in pieces of sequences of at most ``limit`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss (loss-bearing ids), and ``ids``
    where asked for. Each task packs the rows of its own partition, so nothing is shuffled; ``sequence_id`` is the
    partition's number times 2**36 plus a count. All ids bear loss unless ``docs`` has a boolean ``loss`` column
    (null: true). ``loss_tokens`` (``limit`` if None) and ``segments`` are the other limits of a sequence. Null and
    empty texts have the end id alone. Repeated rows are packed each; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    limits = (limit, min(segments, limit), min(loss_tokens or limit, limit))
    flag = F.coalesce(F.col("loss"), F.lit(True)) if "loss" in docs.columns else F.lit(True)
    source = docs.select("doc_id", F.col("text"), flag.cast("boolean").alias("__loss"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss"] + ["ids"] * with_ids
    types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, packer = loaded(tokenizer), VectorPacker(limits)
        number = count(TaskContext.get().partitionId() << 36)

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            for pieces in sequences:
                name, offset = next(number), 0
                for p in pieces:
                    ids = p.ids.astype("<u4")
                    yield (p.doc, p.start, len(ids), zlib.crc32(ids.tobytes()), p.total, name, offset, int(np.count_nonzero(p.loss)), *([ids.astype(np.int32)] * with_ids))
                    offset += len(ids)

        def sequences() -> Iterator[list[Piece]]:
            for batch in batches:
                ids = [np.append(x, np.uint32(end_id)) for x in bpe.ids(batch.column("text").to_pylist())]
                doc, bears = batch.column("doc_id").to_pylist(), batch.column("__loss").to_pylist()
                yield from packer.add([Piece(d, 0, x, len(x), np.full(len(x), b)) for d, x, b in zip(doc, ids, bears, strict=True)])
            yield from packer.finish()

        yield from rows_to_batches(names, types, rows(sequences()))

    kind = dict(source.dtypes)["doc_id"]
    schema = ", ".join(f"{n} long" for n in names[:8]) + ", ids array<int>" * with_ids
    return source.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(pack, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
