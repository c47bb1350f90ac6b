"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import rows_to_batches, small_batches, table, texts_of
from tessella.scratch import stored
from tessella.llm.spans import LOWER, HashTable, mix, span_hashes, word_spans

_U = np.uint64
#: A match is a stretch of WINDOW words of an item with at most SUBSTITUTIONS other words in their places.
WINDOW, SUBSTITUTIONS = 13, 2
#: Fixed masks: the places of a seed whose words count. Wherever two words of thirteen differ, one of these masks
#: meets only equal words at some place of the thirteen (tests/llm tries all cases), so no match is without a hit.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Items of fewer than WINDOW words must occur whole and unchanged; their seed is their first SHORT words. Items of
#: fewer than SHORT words match nothing.
SHORT = 5
#: Characters of benchmark text in one broadcast block; of a longer item's pieces and their overlap; bytes of a
#: document whose words are hashed at a time, and words of it whose seeds are looked up again at a time.
BLOCK, PIECE, OVERLAP = 8 << 20, 1 << 20, 1 << 13
READ, AGAIN = 1 << 19, 1 << 14
#: Progressions of places of seeds in items, and cells of diagonals by words of an item, that are looked at together.
POSTINGS, CELLS = 1 << 20, 1 << 20
#: Words after which a text may repeat itself for its places to be taken together; diagonals of an item and a document
#: from which on repeats are left out before they are verified.
PERIOD, MANY = 64, 64

_KEEP = np.ones(256, bool)
_KEEP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False
_FACTORS = np.random.default_rng(7).integers(0, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, with A-Z lowered and ASCII punctuation left out, and where each starts."""
    data = np.frombuffer(text, np.uint8)
    keep = _KEEP[data]
    data = LOWER[data[keep]]
    s, e = word_spans(data)
    return span_hashes(data, s, e), s


def seeds(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The seed at each place where the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, number + 1, _U)
    for k, o in enumerate(mask):
        total += h[o : o + n] * _FACTORS[k]
    return mix(total)


def _progressions(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first and last place and step of the arithmetic progressions of equal keys' places, which come in order.

    A text that repeats itself after ``step`` words, ``PERIOD`` at most, has few of them, however long it is. A place in
    no progression is one of its own, of step 0; an end of one may be the start of the next.
    """
    n = len(key)
    step = np.zeros(n + 1, np.int64)  # between a place and the one before; 0 where they do not go together
    if n > 1:
        gap = place[1:] - place[:-1]
        step[1:-1] = np.where((key[1:] == key[:-1]) & (gap <= PERIOD), gap, 0)
    begin = np.flatnonzero((step[1:-1] > 0) & (step[1:-1] != step[:-2])) if n > 1 else np.zeros(0, np.int64)
    end = np.flatnonzero((step[1:-1] > 0) & (step[1:-1] != step[2:])) + 1 if n > 1 else begin
    alone = np.flatnonzero((step[:-1] == 0) & (step[1:] == 0))
    first, last = np.concatenate([begin, alone]), np.concatenate([end, alone])
    return key[first], place[first], place[last], np.concatenate([step[1:][begin], np.zeros(len(alone), np.int64)])


def _spread(first: np.ndarray, last: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which progression and the number, for all numbers of all progressions."""
    n = (last - first) // np.maximum(step, 1) + 1
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + step[of] * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))


class Benchmark:
    """Items' words and a table from seed to the places that have it, as progressions of places."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.items = ids, [words(t)[0] for t in texts]
        found: list[list[np.ndarray]] = [[np.zeros(0, _U)], *([np.zeros(0, np.int64)] for _ in range(4))]
        for i, h in enumerate(self.items):
            for number, mask in enumerate(self.masks(len(h))):
                own = seeds(h, mask, number) if len(h) >= WINDOW else seeds(h, mask, len(MASKS))[:1]
                order = np.argsort(own, kind="stable")
                key, first, last, step = _progressions(own[order], order)
                for column, x in zip(found, (key, np.full(len(key), i), first, last, step), strict=True):
                    column.append(x)
        key, item, low, high, step = (np.concatenate(x) for x in found)
        order = np.argsort(key, kind="stable")
        self.item, self.low, self.high, self.step = item[order], low[order], high[order], step[order]
        unique, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.table = HashTable(max(8, (4 * len(unique)).bit_length()), np.int32)
        self.table.insert(unique, np.arange(len(unique), dtype=np.int32))

    @staticmethod
    def masks(n: int) -> tuple[tuple[int, ...], ...]:
        return MASKS if n >= WINDOW else (tuple(range(SHORT)),) if n >= SHORT else ()

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items with a hit, each with its diagonals (document place less item place), ascending and each once."""
        spans = [np.zeros((0, 4), np.int64)]  # item, first and last diagonal, step
        for number, mask in enumerate((*MASKS, tuple(range(SHORT)))):
            for start in range(0, len(h), AGAIN):
                found = seeds(h[start : start + AGAIN + mask[-1]], mask, number)
                which, absent = self.table.find(found)
                place = np.flatnonzero(~absent)
                place = place[np.argsort(which[place], kind="stable")]
                key, first, last, step = _progressions(which[place], place)
                total = np.cumsum(self.count[key])
                # as many at a time as have about POSTINGS progressions in the items
                for part in np.split(np.arange(len(key)), np.searchsorted(total, np.arange(POSTINGS, total[-1] if len(total) else 0, POSTINGS))):
                    if len(part):
                        n = self.count[key[part]]
                        post = np.repeat(self.first[key[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        spans.append(self._diagonals(post, np.repeat(first[part] + start, n), np.repeat(last[part] + start, n), np.repeat(step[part], n)))
        every = np.concatenate(spans)
        every = every[np.argsort(every[:, 0], kind="stable")]
        for own in np.split(every, np.flatnonzero(np.diff(every[:, 0])) + 1):
            if len(own):
                yield int(own[0, 0]), np.unique(_spread(own[:, 1], own[:, 2], own[:, 3])[1])

    def _diagonals(self, post: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Items and progressions of diagonals where progressions of places in the document meet those in the items."""
        item, low, high, own = self.item[post], self.low[post], self.high[post], self.step[post]
        # of two different steps the shorter progression is taken place by place
        apart = (own != step) & (own > 0) & (step > 0)
        if apart.any():
            mine = apart & (high - low) * step <= (last - first) * own
            parts = [np.stack([item, first - high, last - low, np.maximum(own, step)], axis=1)[~apart]]
            for take in (mine, apart & ~mine):
                a, b, s = (low, high, own) if take is mine else (first, last, step)
                of, place = _spread(a[take], b[take], s[take])
                i, f, l, t = (x[take][of] for x in ((item, first, last, step) if take is mine else (item, low, high, own)))
                parts.append(np.stack([i, f - place, l - place, t] if take is mine else [i, place - l, place - f, t], axis=1))
            out = np.concatenate(parts)
        else:
            out = np.stack([item, first - high, last - low, np.maximum(own, step)], axis=1)
        return np.unique(out, axis=0)

    def verify(self, h: np.ndarray, item: int, diagonals: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Start in the document, words and substitutions of what matches on each diagonal, in their order.

        Where the document repeats itself below the item, a diagonal one period on gives the same again, further on: it is
        left out.
        """
        own = self.items[item]
        window, allowed = (WINDOW, SUBSTITUTIONS) if len(own) >= WINDOW else (len(own), 0)
        if len(diagonals) > MANY:
            diagonals = diagonals[~self._again(h, len(own), diagonals)]
        places = np.arange(len(own))
        rows = max(1, CELLS // len(own))
        for start in range(0, len(diagonals), rows):
            d = diagonals[start : start + rows]
            if len(d) == 1 or len(own) > CELLS:
                low, high = max(0, -int(d[0])), min(len(own), len(h) - int(d[0]))
                equal = np.zeros((1, len(own)), bool)
                equal[0, low:high] = h[low + int(d[0]) : high + int(d[0])] == own[low:high]
                outside = np.ones((1, len(own)), bool)
                outside[0, low:high] = False
            else:
                at = d[:, None] + places
                outside = (at < 0) | (at >= len(h))
                equal = (h[np.clip(at, 0, len(h) - 1)] == own) & ~outside
            wrong = np.zeros((len(d), len(own) + 1), np.int32)
            np.cumsum(~equal + outside * np.int32(window), axis=1, out=wrong[:, 1:])
            good = wrong[:, window:] - wrong[:, :-window] <= allowed
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            good, equal = good[some], equal[some]
            covered = np.zeros((len(some), len(own) + 1), np.int32)
            covered[:, : good.shape[1]] += good
            covered[:, window : window + good.shape[1]] -= good
            inside = np.cumsum(covered[:, :-1], axis=1) > 0
            yield from zip((good.argmax(axis=1) + d[some]).tolist(), inside.sum(axis=1).tolist(), (inside & ~equal).sum(axis=1).tolist(), strict=True)

    @staticmethod
    def _again(h: np.ndarray, length: int, diagonals: np.ndarray) -> np.ndarray:
        """Which diagonals have, some period before them, another with the same words of the document below the item."""
        out = np.zeros(len(diagonals), bool)
        for period in range(1, min(PERIOD + 1, len(h))):
            before = diagonals - period
            there = np.searchsorted(diagonals, before)
            also = (diagonals[there] == before) & (before >= 0) & (diagonals + length <= len(h))
            if not also.any():
                continue
            # up to where the words repeat after a period, from each place on
            differs = np.flatnonzero(h[period:] != h[:-period])
            until = np.append(differs, len(h) - period)[np.searchsorted(differs, np.maximum(before, 0))]
            out |= also & (until >= diagonals + length - period)
        return out


_WHITE_SPACE = re.compile(rb"[\t-\r ]")


def _reads(text: bytes) -> Iterator[bytes]:
    """Parts of a text, each cut at white space: a part has more than ``READ`` bytes only to keep its last word whole."""
    at = 0
    while len(text) - at > READ:
        found = _WHITE_SPACE.search(text, at + READ)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def blocks_of(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts: ids and texts of at most ``2 * BLOCK`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE - OVERLAP))
    pieces = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.explode(starts).alias("at"), "text").select("item_id", "at", F.substring("text", F.col("at"), F.lit(PIECE)).alias("text"))
    size = pieces.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // BLOCK)) if size > BLOCK else 1
    while True:
        numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "at", "text"), F.lit(n)))
        largest = numbered.groupBy("block").agg(F.sum(F.length("text")).alias("s"), F.count("*").alias("k")).agg(F.max(F.when(F.col("k") > 1, F.col("s")))).first()[0] if n > 1 else 0
        if (largest or 0) <= 2 * BLOCK or n > 16 * size // BLOCK:  # repeated pieces cannot be parted
            return [numbered.where(F.col("block") == b).select("item_id", "text").distinct().orderBy("item_id", "text") for b in range(n)]
        n *= 2


def _broadcast(block: DataFrame):
    rows = block.collect()
    return block.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1].encode() for r in rows]))


def matches(items: Benchmark, text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Item, first word, words and substitutions of each stretch that a text shares with an item; where the text repeats
    itself, of the first."""
    h = np.concatenate([words(part)[0] for part in _reads(text)])
    for item, diagonals in items.candidates(h):
        for found in items.verify(h, item, diagonals):
            yield items.ids[item], *found


def longest(items: Benchmark, text: bytes) -> list[tuple[int, int, int, int]]:
    """Of ``matches``, the longest of each item; of those the one with the fewest substitutions, then the first."""
    h = np.concatenate([words(part)[0] for part in _reads(text)])
    best: dict[int, tuple[int, int, int]] = {}
    for item, diagonals in items.candidates(h):
        for start, n, wrong in items.verify(h, item, diagonals):
            best[item] = max(best.get(item, (0, 0, 0)), (n, -wrong, -start))
            if n == len(items.items[item]) and not wrong:
                break  # the whole item, and diagonals rise
    return [(items.ids[item], -start, n, -wrong) for item, (n, wrong, start) in best.items()]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``doc_start``, ``n_words``, ``n_substitutions``: for each document and item that
    share a stretch, the longest one: its first word in the document, its words and how many of them differ.

    Words ignore case and ASCII punctuation. The benchmark goes to the workers in blocks of at most ``2 * BLOCK``
    characters, one pass over the documents each, so that what is broadcast is bounded whatever its size. Null and
    empty texts match nothing; rows with a null id give rows with a null id; repeated rows of an id give one row for
    an item. An empty table on either side gives none.
    """
    small_batches(docs.sparkSession)
    item_kind, doc_kind = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    source = docs.select(F.col("doc_id").cast("long"), "text")

    def against(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Benchmark(*shared.value)
            found = ((doc_id, *m) for batch in batches for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) for m in longest(items, text))
            yield from rows_to_batches(["doc_id", "item_id", "doc_start", "n_words", "n_substitutions"], [pa.int64()] * 5, found)

        return source.mapInArrow(run, "doc_id long, item_id long, doc_start long, n_words long, n_substitutions long")

    blocks = blocks_of(benchmark)
    found = against(_broadcast(blocks[0]))
    for block in blocks[1:]:
        # one block after another, so that the driver and the workers hold one at a time
        shared = _broadcast(block)
        found = found.unionByName(stored(against(shared), "leaks"))
        shared.destroy()
    best = F.max(F.struct("n_words", (-F.col("n_substitutions")).alias("fewer"), (-F.col("doc_start")).alias("sooner"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        F.col("doc_id").cast(doc_kind), F.col("item_id").cast(item_kind), (-F.col("b.sooner")).alias("doc_start"), F.col("b.n_words"), (-F.col("b.fewer")).alias("n_substitutions"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the rows that hold a stretch of an item: a map over the rows for each block, without a shuffle."""
    small_batches(docs.sparkSession)

    def against(rest: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Benchmark(*shared.value)
            for batch in batches:
                yield batch.filter(pa.array([next(matches(items, t), None) is None for t in texts_of(batch)], pa.bool_()))

        return rest.mapInArrow(run, docs.schema)

    *others, last = blocks_of(benchmark)
    for block in others:
        shared = _broadcast(block)
        docs = stored(against(docs, shared), "without-leaks")
        shared.destroy()
    return against(docs, _broadcast(last))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that share a stretch: doc_id, item_id, doc_start, n_words, n_substitutions."""
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
