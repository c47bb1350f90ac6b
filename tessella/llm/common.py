"""What the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.scratch import ship_package

#: Rows and bytes in an Arrow batch that goes to a Python worker: bounds its memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: As a power of two, the most bits of a filter of ids: 8 MB.
FILTER_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and by bytes, and gives the executors this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of ids that holds for all ``doc_id`` of ``ids``, and for few others (one in 16 at most, until
    ``FILTER_BITS`` are too few for that). Its bitmap of hashes is broadcast; ids of another type do not pass."""
    size = 1 << min(FILTER_BITS, max(6, (16 * ids.count()).bit_length()))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(size - 1))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    ship_package(ids.sparkSession)
    held = ids.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def holds(p: pa.Array) -> pa.Array:
        at = p.to_numpy()
        return pa.array((held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda doc_id: holds(F.xxhash64(doc_id).bitwiseAND(F.lit(size - 1)))


def with_ids(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` joined with the stored ``rows`` by ``doc_id``; only texts that an ``id_filter`` lets through are
    shuffled."""
    return docs.where(id_filter(rows)(F.col("doc_id"))).join(rows.hint("merge"), "doc_id")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is not in the stored ``ids``; only texts that an ``id_filter`` lets through are
    shuffled, the others stay as no id is theirs."""
    held = id_filter(ids)(F.col("doc_id"))
    return docs.where(~held).union(docs.where(held).join(ids.hint("merge"), "doc_id", "left_anti").select(docs.columns))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def crc_remainder(doc_id: object, by: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def rows_to_batches(names: list[str], types: list[pa.DataType], rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    schema, held = pa.schema(list(zip(names, types, strict=True))), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)


def logistic(features: np.ndarray, labels: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last one is the intercept."""
    x = np.c_[features, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - labels) / len(x) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, bound: int, size: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``bound`` labelled training texts, whole, of ``size`` bytes together at most, and their labels, in the
    order of a hash of the id. A text that would exceed ``size`` is left out; shorter ones behind it are not.

    A training row's crc32 remainder by ``fold`` is not ``held``; rows without a label are left out. A document with
    several label rows counts once, with the largest; of a doc_id's texts the smallest counts. The order by hash makes
    the sample the same on every run.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("__y"))
    known = known.where(remainder(F.col("doc_id"), fold) != held)
    # ids first, so that only the chosen texts are joined; their lengths before their texts, so that the bound holds
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    lengths = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()
    if sum(r["n"] for r in lengths) > size:
        kept, total = [], 0
        for doc_id, n in sorted(((r[0], r["n"]) for r in lengths), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])):
            if total + n <= size:
                kept.append((doc_id,))
                total += n
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(kept, docs.select("doc_id").schema)), "doc_id", "left_semi")
    rows = texts.groupBy("doc_id", "__y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return [r["text"].encode() for r in rows], np.array([r["__y"] for r in rows], np.float64)
