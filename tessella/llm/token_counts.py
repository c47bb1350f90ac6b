"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import loaded
from tessella.llm.common import small_batches, table
from tessella.llm.spans import HashTable

#: Rows of the sample from which frequent pre-tokens are taken, and entries of the broadcast table at most. They
#: decide how many lookups the first tier answers, never a count.
SAMPLE_ROWS, TABLE_ENTRIES = 2000, 100_000


def frequent_lengths(docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest pre-tokens of a sample and their lengths in ids, as compact arrays (9 bytes an entry).

    The sample is about ``rows`` documents spread evenly by a hash of the text. At most ``entries`` pre-tokens come to
    the driver: the table's size is bounded whatever the corpus. Lengths of 255 and more stay out of the table.
    """
    every = max(1, docs.count() // max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t and bpe.ordinary(t)]
            for _, s, e, h, data in bpe.pieces(texts):
                keys, first, n = np.unique(h, return_index=True, return_counts=True)
                length = [min(255, len(bpe.merged(data[s[i] : e[i]]))) for i in first.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(length, pa.int32()), pa.array(n, pa.int64())], names=["h", "length", "n"])

    top = (
        sample.mapInArrow(count, "h long, length int, n long").where("length < 255")
        .groupBy("h").agg(F.max("length").alias("length"), F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "h").limit(entries).toArrow()
    )
    return top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("length").to_numpy().astype(np.uint8)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, limit: int = 1024, text: str = "text",
                 sample_rows: int = SAMPLE_ROWS, table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes``, ``n_tokens`` and ``over_limit``; one map over the rows, no shuffle.

    ``tokenizer`` is the path of a vocabulary that the executors have. Null and empty texts have no token. Very long
    texts are read in blocks. Repeated rows each give a row; an empty table gives none. Columns of those names in
    ``docs`` are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    source = docs.select(*keep, F.col(text).alias("__text"))
    shared = spark.sparkContext.broadcast(frequent_lengths(source.select(F.col("__text").alias("text")), tokenizer, sample_rows, table_entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (hashes, lengths) = loaded(tokenizer), shared.value
        first = HashTable(max(4, (4 * len(hashes)).bit_length()), np.uint8)
        first.insert(hashes, lengths)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            n = bpe.counts(texts, first)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = source.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return source.mapInArrow(count, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than 1024 tokens)."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
