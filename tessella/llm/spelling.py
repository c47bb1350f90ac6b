"""Spelling variants: words that differ by one code point, found as equal pairs of trie nodes."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, table, texts_of
from tessella.llm.spans import LOWER, HashTable, span_hashes
from tessella.scratch import stored

#: Bytes of text whose words are found at once; words that a task counts before it gives them out (log2 of the slots of
#: its table). They bound memory and decide no count.
BLOCK, BITS = 1 << 22, 20
#: Words whose crc32 is put together from tables are at most so many bytes long.
SHORT = 64
#: Rows of the sample that sets the ranges of words, and letters of a bound. They decide how even ranges are, no result.
SAMPLE, BOUND = 20_000, 64
#: Bits of a number within a range.
OWN = 40
#: Node numbers in one record batch, about.
OUT = 1 << 20


# words and how often they occur -----------------------------------------------------------------------------------

def _advance() -> np.ndarray:
    """``[n, k, b]``: what byte k of a crc32, if it is b, gives to the crc32 of what is n bytes longer."""
    step = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        step[b] = c
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = step[out[n] & 255] ^ out[n] >> np.uint32(8)
    return out


class WordCounter:
    """Counts of the words of many texts: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased.

    With ``drop``, the crc32 of ``<id>:<word>`` decides whether an occurrence loses a code point: if ``drop`` divides it,
    the one at crc32 % length. A word's crc32 is kept with it; that of an occurrence follows from it and from the id's by
    table, for a block of text at once. Words under ``least`` code points, before or after, are not counted.
    """

    def __init__(self, drop: int | None, least: int):
        self.drop, self.least, self.advance = drop, least, _advance()
        self.places = HashTable(BITS, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.places.clear()
        self.words: list[bytes] = []
        self.crc, self.size, self.length, self.count = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64, np.int64))
        self.dropped: Counter[tuple[int, int]] = Counter()

    def add(self, ids: list[bytes], texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
        """Takes texts; gives out what was counted when the table is full."""
        a = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        lead = a == 0xC3
        letter = (a >= 97) & (a <= 122) | lead
        letter[1:] |= lead[:-1]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
        start, end = edge[::2], edge[1::2]
        leads = np.concatenate([[0], np.cumsum(lead)])
        length = end - start - (leads[end] - leads[start])
        long = length >= self.least
        start, end, length = start[long], end[long], length[long]
        if not len(start):
            return
        h, first, same = np.unique(span_hashes(a, start, end), return_index=True, return_inverse=True)
        at, absent = self.places.find(h)
        if not self.places.room(int(absent.sum())) and self.words:
            yield from self.finish()
            at, absent = self.places.find(h)
        if (new := first[absent]).size:
            data = a.tobytes()
            words = [data[i:j] for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            at[absent] = len(self.words) + np.arange(len(words))
            if self.places.room(len(words)):
                self.places.insert(h[absent], at[absent])
            self.words += words
            self.crc = np.append(self.crc, np.array([zlib.crc32(w) for w in words], np.uint32))
            self.size = np.append(self.size, end[new] - start[new])
            self.length = np.append(self.length, length[new])
            self.count = np.append(self.count, np.zeros(len(words), np.int64))
        word = at[same]
        if self.drop:
            text_ends = np.cumsum([len(t) + 1 for t in texts])
            of = np.searchsorted(text_ends, start, side="right")
            before = np.array([zlib.crc32(i) for i in ids], np.uint32)[of]
            size = self.size[word]
            short = np.minimum(size, SHORT)
            crc = self.crc[word]
            for k in range(4):
                crc = crc ^ self.advance[short, k, before >> np.uint32(8 * k) & np.uint32(255)]
            for k in np.flatnonzero(size > SHORT).tolist():
                crc[k] = zlib.crc32(self.words[word[k]], int(before[k]))
            lost = crc % np.uint32(self.drop) == 0
            for key, n in zip(*np.unique(word[lost] << 32 | (crc[lost] % length[lost]), return_counts=True), strict=True):
                if self.length[key >> 32] > self.least:
                    self.dropped[int(key)] += int(n)
            word = word[~lost]
        self.count += np.bincount(word, minlength=len(self.count))
        if not self.places.room(0) or len(self.words) >= 1 << (BITS - 1):
            yield from self.finish()

    def finish(self) -> Iterator[tuple[bytes, int]]:
        """Every word counted since the last time, and its count."""
        out: Counter[bytes] = Counter({w: n for w, n in zip(self.words, self.count.tolist(), strict=True) if n})
        for key, n in self.dropped.items():
            word, at = self.words[key >> 32].decode(), key & 0xFFFFFFFF
            out[(word[:at] + word[at + 1 :]).encode()] += n
        self._clear()
        yield from out.items()


def word_counts(docs: DataFrame, *, drop: int | None = None, least: int = 7) -> DataFrame:
    """word, n: the words of all whole texts with at least ``least`` code points and how often they occur.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. ``drop``: see ``WordCounter``; a null
    doc_id counts as empty. Null texts have no word. Each task adds up its own words before the one exchange.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(drop, least)

        def out(rows: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
            if found := list(rows):
                for a in range(0, len(found), 1 << 14):
                    words, n = zip(*found[a : a + (1 << 14)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = [b"%s:" % i for i in texts_of(batch, "id")]
            texts = texts_of(batch)
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (size < BLOCK or b == a):
                    size += len(texts[b])
                    b += 1
                yield from out(counter.add(ids[a:b], texts[a:b]))
                a = b
        yield from out(counter.finish())

    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# numbers of trie nodes --------------------------------------------------------------------------------------------

def common(a: str, b: str) -> int:
    """Letters that two words begin with alike."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Ranges:
    """Ranges of words in code-point order, and numbers for the trie nodes that words of several ranges pass.

    A node passed by words on both sides of a bound is a prefix of the bound. It is numbered, in every range, by the first
    bound that it is a prefix of and by its depth; all other nodes lie within one range, which numbers them itself.
    """

    def __init__(self, bounds: list[str]):
        self.bounds = bounds
        self.shared: list[np.ndarray] = []
        for q, bound in enumerate(bounds):
            own = -(q << OWN) - 1 - np.arange(len(bound) + 1)
            if q:
                same = common(bounds[q - 1], bound) + 1
                own[:same] = self.shared[-1][:same]
            self.shared.append(own)

    def of(self, word: str) -> int:
        return bisect_right(self.bounds, word)


def ranges(words: DataFrame, column: Column, parts: int) -> Ranges:
    """At most ``parts`` ranges of about equal numbers of words, from a sample of ``SAMPLE`` words by their hash."""
    every = max(1, words.count() // SAMPLE)
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(F.substring(column, 1, BOUND))
    found = sorted({r[0] for r in sample.collect()})
    return Ranges([found[len(found) * k // parts] for k in range(1, parts)] if len(found) > 4 * parts else [])


class Numbering:
    """Numbers of the trie nodes on the path of each word; words come sorted, range after range."""

    def __init__(self, ranges: Ranges):
        self.ranges, self.part = ranges, -1

    def path(self, part: int, word: str) -> np.ndarray:
        """Of each prefix, the empty one first."""
        if part != self.part:
            self.part, self.used, self.rows, self.last, self.own = part, 0, -1, "", np.zeros(0, np.int64)
        same = common(self.last, word) if len(self.own) else -1
        fresh = len(word) - same
        self.own = np.concatenate([self.own[: same + 1], (part << OWN) + self.used + np.arange(fresh)])
        self.used += fresh
        self.rows += 1
        self.last = word
        best, out = -1, self.own
        for q in (part - 1, part):  # the bounds below and above
            if 0 <= q < len(self.ranges.bounds) and (n := common(self.ranges.bounds[q], word)) > best:
                best = n
                out = np.concatenate([self.ranges.shared[q][: n + 1], self.own[n + 1 :]])
        return out


def _lists(paths: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, paths)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(paths)))


def _in_ranges(words: DataFrame, word: Column, found: Ranges) -> DataFrame:
    """The rows by range, sorted within each."""
    bounds = words.sparkSession.sparkContext.broadcast(found)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([bounds.value.of(w) for w in batch.column("__sorted").to_pylist()], pa.int64()))

    source = words.withColumn("__sorted", word)
    return source.mapInArrow(part, source.select("*").schema.add("part", "long")).repartition("part").sortWithinPartitions("part", "__sorted")


def numbered(words: DataFrame, parts: int) -> DataFrame:
    """wid (in code-point order), word, n and ``prefixes``, the numbers of the word's prefixes in the trie of all words."""
    found = ranges(words, F.col("word"), parts)
    shared = words.sparkSession.sparkContext.broadcast(found)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Numbering(shared.value)
        for batch in batches:
            wid, paths, at, size = [], [], 0, 0
            for k, (part, word) in enumerate(zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), strict=True)):
                paths.append(trie.path(part, word))
                wid.append((part << OWN) + trie.rows)
                size += len(paths[-1])
                if size >= OUT or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(wid, pa.int64()), *(batch.column(c).slice(at, len(wid)) for c in ("word", "n")), _lists(paths)], names=["wid", "word", "n", "prefixes"])
                    wid, paths, at, size = [], [], k + 1, 0

    return _in_ranges(words, F.col("word"), found).mapInArrow(number, "wid long, word string, n long, prefixes array<long>")


#: Kinds of keys: between two letters, over a letter, and over a letter that is the last of equal ones.
_GAP, _SKIP, _SKIP_LAST = range(3)


def keys(words: DataFrame, parts: int) -> DataFrame:
    """prefix, suffix (numbers of nodes), wid, n, kind: for each word, the nodes on both sides of each place between
    letters and of each letter."""
    backwards = F.reverse("word")
    found = ranges(words, backwards, parts)
    shared = words.sparkSession.sparkContext.broadcast(found)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Numbering(shared.value)

        def out(wid: list[int], n: list[int], before: list[np.ndarray], after: list[np.ndarray], text: list[str]) -> pa.RecordBatch:
            size = np.array([len(x) for x in before])
            row = np.repeat(np.arange(len(size)), size)
            prefix, suffix = np.concatenate(before), np.concatenate(after)
            last = np.cumsum(size) - 1
            letter = np.ones(len(prefix), bool)
            letter[last] = False
            # no letter has the number that stands behind each word
            code = np.full(len(prefix) + 1, 0x110000, np.uint32)
            code[:-1][letter] = np.frombuffer("".join(text).encode("utf-32-le"), "<u4")
            kind = np.where(code[:-1] != code[1:], _SKIP_LAST, _SKIP)[letter]
            skip = np.flatnonzero(letter)
            wid, n = np.array(wid), np.array(n)
            both = np.concatenate([row, row[skip]])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([prefix, prefix[skip]])), pa.array(np.concatenate([suffix, suffix[skip + 1]])), pa.array(wid[both]), pa.array(n[both]),
                 pa.array(np.concatenate([np.full(len(row), _GAP), kind]).astype(np.int32))], names=["prefix", "suffix", "wid", "n", "kind"])

        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for k, wid, n, word, back, part, before in zip(range(batch.num_rows), *(batch.column(c).to_pylist() for c in ("wid", "n", "word", "__sorted", "part")), batch.column("prefixes"), strict=True):
                for to, x in zip(held, (wid, n, before.values.to_numpy(), trie.path(part, back)[::-1], word), strict=True):
                    to.append(x)
                size += len(word) + 1
                if size >= OUT or k == batch.num_rows - 1:
                    yield out(*held)
                    held, size = ([], [], [], [], []), 0

    return _in_ranges(words, backwards, found).mapInArrow(pairs, "prefix long, suffix long, wid long, n long, kind int")


def near_in_groups(prefix: np.ndarray, suffix: np.ndarray, wid: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """wid, number of near words, n and wid of the commonest near word, for each key that has any; keys come sorted.

    Words that skip a letter between equal nodes differ in that letter. A word with a place between the same nodes lacks
    it; of equal letters in a row only the last counts there, so that every two near words meet once. A group holds a word
    for each letter at most; its members get their counts from the group's, not from pairs.
    """
    group = np.concatenate([[0], np.cumsum((np.diff(prefix) != 0) | (np.diff(suffix) != 0))])
    more = np.flatnonzero(np.bincount(group)[group] > 1)
    order = more[np.lexsort((wid[more], -n[more], group[more]))]
    g, w, c, k = np.unique(group[order], return_inverse=True)[1], wid[order], n[order], kind[order]
    groups = int(g[-1]) + 1 if len(g) else 0
    skips, lasts = np.bincount(g[k != _GAP], minlength=groups), np.bincount(g[k == _SKIP_LAST], minlength=groups)
    # positions of: the gap, the first and second that skip, the first that skips a last letter
    gap, one, two, last = (np.full(groups, -1) for _ in range(4))
    for to, at in ((gap, np.flatnonzero(k == _GAP)), (one, np.flatnonzero(k != _GAP)), (last, np.flatnonzero(k == _SKIP_LAST))):
        to[g[at][::-1]] = at[::-1]
    at = np.flatnonzero(k != _GAP)
    at = at[at != one[g[at]]]
    two[g[at][::-1]] = at[::-1]

    is_gap = k == _GAP
    other = np.where(is_gap, last[g], np.where(one[g] == np.arange(len(g)), two[g], one[g]))
    lacks = np.where(k == _SKIP_LAST, gap[g], -1)
    near = np.where(is_gap, lasts[g], skips[g] - 1 + (lacks >= 0))
    better = (lacks >= 0) & ((other < 0) | (c[lacks] > c[other]) | ((c[lacks] == c[other]) & (w[lacks] < w[other])))
    best = np.where(better, lacks, other)
    some = near > 0
    return w[some], near[some], c[best[some]], w[best[some]]


def near_words(pairs: DataFrame) -> DataFrame:
    """wid, n_near, and ``best``, a struct of the count and the negative wid of the near word that comes first."""
    names = ["prefix", "suffix", "wid", "n", "kind"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            tail = int(np.flatnonzero(np.concatenate([[True], (np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)]))[-1])
            held = [x[tail:] for x in now]
            if tail:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, near_in_groups(*(x[:tail] for x in now)))), names=["wid", "near", "best_n", "best_wid"])
        if held is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, near_in_groups(*held))), names=["wid", "near", "best_n", "best_wid"])

    met = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix").mapInArrow(match, "wid long, near long, best_n long, best_wid long")
    return met.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best_wid")).alias("wid"))).alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """wid, form, root: every link followed to its end by doubling. A form has ``ratio`` times the count at least, so that
    a chain has some 18 links at most and a few rounds do."""
    at = stored(links.select("wid", "form", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("wid").alias("root"), F.col("root").alias("ahead"))
        at = stored(at.join(ahead.hint("merge"), "root", "left").select("wid", "form", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "forms")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def spelling_groups(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """Per distinct word: word, form, root, n, n_near, form_n; from (word, n), where repeated words add up.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts near
    words. ``form`` is the near word of the largest n (ties: the first in code-point order) if that is at least ``ratio``
    (2 or more) times the word's own, and ``form_n`` its n; else both are null. ``root`` is where forms lead in the end,
    the word itself if it has none. Words of any length and any code points are taken; null words are left out; the
    empty word is near every word of one letter. Work and rows grow with the letters of all words: pairs of words are
    never made.
    """
    spark = words.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    told = stored(numbered(given, parts), "numbered")
    known = told.select("wid", "word", "n")
    near = stored(known.join(near_words(keys(told, parts)).hint("merge"), "wid", "left"), "near")
    links = near.where(F.col("best.n") >= ratio * F.col("n")).select("wid", (-F.col("best.wid")).alias("form"))
    form = known.select(F.col("wid").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = known.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    ends = _roots(links).join(form.hint("merge"), "form").join(root.hint("merge"), "root").select("wid", "form_word", "root_word", "form_n")
    return near.join(ends.hint("merge"), "wid", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of at least 7 code points that occurs twice or more: word, form, root, n, n_near, form_n."""
    counts = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=31, least=7)
    return spelling_groups(counts.where("n >= 2"))


#: The same in SQL; crc32 is a reduction in which eight marks behind each byte are its steps.
OP12_SQL = """
with recursive runs as (
  select coalesce(doc_id::varchar, '') || ':' id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w from documents),
counted as (select id, w, count(*) n, hex((id || w)::varchar) x from runs where length(w) >= 7 group by all),
hashed as (
  select w, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(x), 2),
      lambda k: [(16 * (instr('0123456789ABCDEF', x[k]) - 1) + instr('0123456789ABCDEF', x[k + 1]) - 1)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda v, b: case when b >= 0 then xor(v, b) else xor(v >> 1, (v & 1) * 3988292384) end)) h
  from counted),
words as (
  select word, sum(n)::bigint n
  from (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end word, n from hashed)
  where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(0, length(word) + 1)) i from words),
skips as (select word, n, substr(word, 1, i) a, substr(word, i + 2) b from places where i < length(word)),
gaps as (select word, n, substr(word, 1, i) a, substr(word, i + 1) b from places),
pairs as (
  select x.word, y.word near, y.n from skips x join skips y using (a, b) where x.word <> y.word
  union select x.word, y.word, y.n from skips x join gaps y using (a, b)
  union select y.word, x.word, x.n from skips x join gaps y using (a, b)),
best as (select word, near, n, count(*) over (partition by word) n_near from pairs qualify row_number() over (partition by word order by n desc, near) = 1),
told as (
  select w.word, case when b.n >= 10 * w.n then b.near end form, w.n, coalesce(b.n_near, 0) n_near, case when b.n >= 10 * w.n then b.n end form_n
  from words w left join best b using (word)),
chain as (
  select word, word at_word, form ahead from told
  union all select c.word, c.ahead, t.form from chain c join told t on t.word = c.ahead)
select t.word, t.form, c.at_word as root, t.n, t.n_near, t.form_n from told t join chain c on c.word = t.word and c.ahead is null
"""
