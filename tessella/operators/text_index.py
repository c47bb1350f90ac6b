"""A text index that stays: postings in files by term, new documents as segments, and top matches by the bounds of blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.search import K1, TOKEN, B, query_words
from tessella.scratch import ship_package, stored

#: Documents of a block at most, about; blocks that are scored first for a bound on the best matches.
BLOCK, FIRST = 4096, 8
#: Bytes of text that a task counts together, or one document; terms of a batch that it gives.
BYTES, GIVEN = 1 << 24, 1 << 14


class StoredIndex(NamedTuple):
    """One version of an index: its folder and the rows of its manifest.

    A segment has ``postings``, in folders by the first letter of a term and sorted by term; ``terms`` (term, df), sorted;
    and ``docs`` (id, n). A row of postings is a block: the documents of one term in one slice of the segment, with their
    counts and lengths, and the largest count and smallest length among them. Slices are documents of about one length, in
    parts of about ``BLOCK`` by the batch that they were read in or (after a merge) by a hash, the same for all terms.
    """

    spark: SparkSession
    path: str
    version: int
    segments: tuple[int, ...]
    documents: int
    mean: float
    replaced: bool

    def table(self, name: str) -> DataFrame:
        """The rows of all segments, with ``segment``."""
        read = [_read(self.spark, self.path, s, name).withColumn("segment", F.lit(s)) for s in self.segments]
        rows = read[0]
        for more in read[1:]:
            rows = rows.unionByName(more)
        return rows

    def matches(self, text: str) -> DataFrame:
        return stored_matches(self, text)

    def terms(self) -> DataFrame:
        """term, df and tf over all documents as they are now."""
        if self.replaced:
            return _live(self, _postings(self.table("postings"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
        own = F.aggregate("tfs", F.lit(0).cast("long"), lambda held, x: held + x)
        return self.table("postings").groupBy("term").agg(F.sum("docs").alias("df"), F.sum(own).alias("tf"))


def _at(path: str, segment: int, name: str) -> str:
    return f"{path.rstrip('/')}/segment-{segment}/{name}"


def _read(spark: SparkSession, path: str, segment: int, name: str) -> DataFrame:
    """A table of a segment. Postings that have no row leave no file, so their columns are named here."""
    docs = spark.read.parquet(_at(path, segment, "docs"))
    if name == "docs":
        return docs
    kind = dict(docs.dtypes)["id"]
    columns = {"terms": "term string, df long", "postings": f"term string, slice long, docs long, max_tf long, min_n long, ids array<{kind}>, tfs array<long>, ns array<long>, lead string"}
    return spark.read.schema(columns[name]).parquet(_at(path, segment, name))


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The newest version. A version is one row file of the manifest, so that it is there as a whole or not at all."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    m = rows.orderBy(F.desc("version")).first()
    return StoredIndex(spark, path, m["version"], tuple(m["segments"]), m["documents"], m["length"] / max(1, m["documents"]), m["replaced"])


MANIFEST = "version long, segments array<int>, documents long, length long, replaced boolean"


def _publish(spark: SparkSession, path: str, version: int, segments: Sequence[int], documents: int, length: int, replaced: bool) -> StoredIndex:
    row = spark.createDataFrame([(version, list(segments), documents, length, replaced)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return open_index(spark, path)


def _counts(ids: pa.Array, texts: pa.Array, batch: int) -> Iterator[pa.RecordBatch]:
    """For each term of some documents, in lower case, the documents that have it; a row without a term for all of them."""
    found = [re.findall(TOKEN, x) for x in texts.to_pylist()]
    n = np.array([len(x) for x in found], np.int64)
    coded = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    code, doc = np.divmod(key, len(n))
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(key))

    def rows(terms: pa.Array, offsets: np.ndarray, of: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in (ids.take(pa.array(of)), pa.array(tfs, pa.int64()), pa.array(n[of]))]
        return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), batch)), *lists], names=["term", "batch", "ids", "tfs", "ns"])

    yield rows(pa.array([None], pa.string()), np.array([0, len(n)]), np.arange(len(n)), np.zeros(len(n), np.int64))
    for at in range(0, len(start), GIVEN):
        first, last = start[at], ends[at : at + GIVEN][-1]
        yield rows(coded.dictionary.take(pa.array(code[start[at : at + GIVEN]])), np.append(start[at : at + GIVEN], last) - first, doc[first:last], tf[first:last])


def _counter(block: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the documents (id, text) of a task, ``block`` of them, or about ``most`` bytes, at a time."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends, at = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))), 0
            while at < batch.num_rows:
                upto = min(max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1), at + block, batch.num_rows)
                yield from _counts(batch.column("id").slice(at, upto - at), batch.column("text").slice(at, upto - at), (task << 24) + number)
                number, at = number + 1, upto

    return counted


def _cutter(parts: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks from rows of ``_counts`` in order of terms: documents of about one length, dealt by the batch that they were
    counted in. A term whose rows come in several batches has several blocks of a slice."""
    count = np.array([parts.get(k, 1) for k in range(128)], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            term = b.column("term").dictionary_encode()
            size = np.diff(b.column("ids").offsets.to_numpy())
            ids, tf, n = b.column("ids").flatten(), b.column("tfs").flatten().to_numpy(), b.column("ns").flatten().to_numpy()
            kind = (2 * np.log2(n + 1.0)).astype(np.int64)
            part = (kind << 32) + np.repeat(b.column("batch").to_numpy(), size) % count[kind]
            code = np.repeat(term.indices.to_numpy().astype(np.int64), size)
            order = np.lexsort((part, code))
            code, part, tf, n = code[order], part[order], tf[order], n[order]
            start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])))
            offsets = pa.array(np.append(start, len(code)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (ids.take(pa.array(order)), pa.array(tf), pa.array(n))]
            terms = term.dictionary.take(pa.array(code[start]))
            yield pa.RecordBatch.from_arrays([pc.utf8_slice_codeunits(terms, 0, 1), terms, pa.array(part[start]), pa.array(np.diff(np.append(start, len(code)))), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(n, start)), *lists],
                                             names=["lead", "term", "slice", "docs", "max_tf", "min_n", "ids", "tfs", "ns"])

    return cut


def _write_terms(spark: SparkSession, path: str, segment: int) -> None:
    _read(spark, path, segment, "postings").groupBy("term").agg(F.sum("docs").alias("df")).orderBy("term").write.parquet(_at(path, segment, "terms"))


def _parts(docs: DataFrame) -> dict[int, int]:
    """Parts of the documents of a length, by half powers of two: some sixty rows."""
    kind = F.floor(2 * F.log2(F.col("n") + 1)).cast("int")
    return {r["k"]: -(-r["d"] // BLOCK) for r in docs.groupBy(kind.alias("k")).agg(F.count("*").alias("d")).collect()}


def _write_postings(postings: DataFrame, docs: DataFrame, path: str, segment: int) -> None:
    """A segment from rows (term, id, tf, n) and (id, n)."""
    kind = F.floor(2 * F.log2(F.col("n") + 1)).cast("int")
    parts = F.create_map(*[F.lit(x) for pair in (_parts(docs) or {0: 1}).items() for x in pair])
    slice_ = (kind.cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.element_at(parts, kind))).alias("slice")
    each = F.sort_array(F.collect_list(F.struct("id", "tf", "n")))
    blocks = postings.withColumn("slice", slice_).groupBy("term", "slice").agg(
        F.count("*").alias("docs"), F.max("tf").alias("max_tf"), F.min("n").alias("min_n"), each.alias("e")).select(
        F.substring("term", 1, 1).alias("lead"), "term", "slice", "docs", "max_tf", "min_n", *(F.col(f"e.{c}").alias(c + "s") for c in ("id", "tf", "n")))
    blocks.repartitionByRange("lead", "term", "slice").sortWithinPartitions("lead", "term", "slice").write.partitionBy("lead").parquet(_at(path, segment, "postings"))
    _write_terms(docs.sparkSession, path, segment)


def _read_in(rows: DataFrame, id_: str, fields: Sequence[str], path: str, segment: int) -> DataFrame:
    """Writes the documents as a segment; gives them back as (id, n). The texts are read once and never shuffled: a task
    counts the words of the documents that it reads together, and one row a term of these is shuffled once."""
    spark = rows.sparkSession
    ship_package(spark)
    t = rows.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.lower(F.concat_ws(" ", *fields)).alias("text"))
    kind = dict(t.dtypes)["id"]
    lists = f"ids array<{kind}>, tfs array<long>, ns array<long>"
    counts = stored(t.mapInArrow(_counter(BLOCK, BYTES), f"term string, batch long, {lists}"), "index-counts")
    found = counts.where("term is null").select(F.explode(F.arrays_zip("ids", "ns")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.ns").alias("n"))
    found.write.parquet(_at(path, segment, "docs"))
    docs = spark.read.parquet(_at(path, segment, "docs"))
    if docs.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        raise ValueError(f"{id_} is not unique")
    sorted_ = counts.where("term is not null").repartitionByRange("term").sortWithinPartitions("term")
    blocks = sorted_.mapInArrow(_cutter(_parts(docs)), f"lead string, term string, slice long, docs long, max_tf long, min_n long, {lists}")
    blocks.sortWithinPartitions("lead", "term", "slice").write.partitionBy("lead").parquet(_at(path, segment, "postings"))
    _write_terms(spark, path, segment)
    return docs


def build_index(rows: DataFrame, id_: str, fields: Sequence[str], path: str) -> StoredIndex:
    """An index over the fields taken together, in the new folder ``path``. Null fields are empty; rows without an
    id are left out, repeated ids are an error. Empty tables give an index that finds nothing."""
    docs = _read_in(rows, id_, fields, path, 0)
    n, length = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return _publish(rows.sparkSession, path, 0, [0], n, length, False)


def append_documents(index: StoredIndex, rows: DataFrame, id_: str, fields: Sequence[str]) -> StoredIndex:
    """A new version with more documents, as a segment of their own; nothing that is there is read but the old ids and
    lengths. A document with an id that is there takes the old one's place."""
    segment = max(index.segments) + 1
    while True:  # a segment that was written but never published is no part of any version
        try:
            docs = _read_in(rows, id_, fields, index.path, segment)
            break
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            segment += 1
    old = _live_docs(index).join(docs.select("id"), "id", "left_semi")
    gone, lost = old.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, length = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    before = round(index.mean * max(1, index.documents))
    return _publish(index.spark, index.path, index.version + 1, [*index.segments, segment], index.documents + n - gone, before + length - lost, index.replaced or gone > 0)


def merge_segments(index: StoredIndex) -> StoredIndex:
    """A new version of one segment, from the stored postings: no text is read again. Older versions stay readable."""
    segment = max(index.segments) + 1
    _live_docs(index).select("id", "n").write.parquet(_at(index.path, segment, "docs"))
    docs = index.spark.read.parquet(_at(index.path, segment, "docs"))
    _write_postings(_live(index, _postings(index.table("postings"))).select("term", "id", "tf", "n"), docs, index.path, segment)
    n, length = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return _publish(index.spark, index.path, index.version + 1, [segment], n, length, False)


def _live_docs(index: StoredIndex) -> DataFrame:
    docs = index.table("docs")
    if len(index.segments) == 1:
        return docs
    return docs.groupBy("id").agg(F.max(F.struct("segment", "n")).alias("d")).select("id", "d.n", "d.segment")


def _postings(blocks: DataFrame) -> DataFrame:
    """A row for each document of each block."""
    kept = [c for c in blocks.columns if c not in ("ids", "tfs", "ns", "docs", "max_tf", "min_n", "lead", "slice")]
    return blocks.select(*kept, F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("p")).select(*kept, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.ns").alias("n"))


def _live(index: StoredIndex, postings: DataFrame) -> DataFrame:
    """Without documents that a later segment has again."""
    return postings.join(_live_docs(index).select("id", "segment"), ["id", "segment"]) if index.replaced else postings


def word_blocks(index: StoredIndex, words: Sequence[str], postings: DataFrame | None = None) -> DataFrame:
    """Blocks of the terms that begin with one of the words, with ``word``. Only the folders of the words' first letters
    are listed, and in their files only row groups whose terms may begin so are read."""
    rows = index.table("postings") if postings is None else postings
    begins = [F.startswith(F.col("term"), F.lit(w)) for w in words]
    some = begins[0]
    for more in begins[1:]:
        some = some | more
    rows = rows.where(F.col("lead").isin(sorted({w[0] for w in words})) & some)
    return rows.withColumn("word", F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.startswith(F.col("term"), w))))


def _part(index: StoredIndex, df: Column, f: Column, n: Column) -> Column:
    idf = F.greatest(F.log((F.lit(float(index.documents)) - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n / F.lit(index.mean)))


def _scored(index: StoredIndex, blocks: DataFrame, df: DataFrame | None = None) -> DataFrame:
    hits = _live(index, _postings(blocks.drop("term"))).groupBy("word", "id").agg(F.sum("tf").alias("f"), F.first("n").alias("n"))
    df = hits.groupBy("word").agg(F.count("*").alias("df")) if df is None else df
    return hits.join(F.broadcast(df), "word").groupBy("id").agg(F.sum(_part(index, F.col("df"), F.col("f"), F.col("n"))).alias("bm25"))  # at most one row a word


def stored_matches(index: StoredIndex, text: str) -> DataFrame:
    """I4: ``id`` and ``bm25``, as ``text_matches`` gives them, from the files of the words' terms alone."""
    words = query_words(text)
    if not words or not index.documents:
        return index.table("docs").where("false").select("id", F.lit(0.0).alias("bm25"))
    return _scored(index, word_blocks(index, words))


def top_matches(index: StoredIndex, text: str, k: int) -> DataFrame:
    """The ``k`` best of ``stored_matches``, ties at nine decimals by id.

    What a slice can score at most follows from its blocks' largest counts and smallest lengths, without their lists. The
    slices that can score most are scored first; the k-th best score there excludes every slice that cannot reach it.
    """
    words = query_words(text)
    if not words or not index.documents:
        return stored_matches(index, text)
    every = word_blocks(index, words)
    counts = _live(index, _postings(every.select("word", "segment", "ids", "tfs", "ns"))).groupBy("word", "id").agg(F.lit(1)).groupBy("word").agg(F.count("*").alias("df"))
    df = index.spark.createDataFrame([tuple(r) for r in counts.collect()], "word string, df long")  # a row a word
    most = every.groupBy("word", "segment", "slice").agg(F.sum("max_tf").alias("f"), F.min("min_n").alias("n"))
    bound = most.join(F.broadcast(df), "word").groupBy("segment", "slice").agg(F.sum(_part(index, F.col("df"), F.col("f"), F.col("n"))).alias("bound"))
    bound = stored(bound, "bounds")
    first = bound.orderBy(F.desc("bound"), "segment", "slice").limit(FIRST)
    order = [F.desc(F.round("bm25", 9)), F.col("id")]
    best = _scored(index, every.join(F.broadcast(first.select("segment", "slice")), ["segment", "slice"]), df).orderBy(*order).limit(k).collect()
    least = best[-1]["bm25"] - 1e-8 if len(best) == k else 0.0
    reach = bound.where(F.col("bound") >= least).select("segment", "slice")
    return _scored(index, every.join(reach, ["segment", "slice"], "left_semi"), df).orderBy(*order).limit(k)
