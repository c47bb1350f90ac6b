"""Streams of scan events: incremental ingest, de-duplication, bursts, rates and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.merge import merge_into


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> StreamingQuery:
    """K1: merges each micro-batch into the table below ``folder`` (see ``merge_into``), the last row of each key winning.

    A batch makes the version of its own number: what it writes grows with it, not with the table, and a batch that is run
    again after a failure overwrites its own work only, or nothing where it was published.
    """
    def fold(batch: DataFrame, number: int) -> None:
        merge_into(batch, folder, number, keys, order, buckets)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """K2: the first event of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def bursts(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """K3: sessions of a key that end after a gap; late rows are dropped."""
    s = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")


def rates(stream: DataFrame, at: str, late: str, limit: int, width: str = "60 seconds", slide: str = "60 seconds") -> DataFrame:
    """K4: events in each window, and whether they are more than the limit."""
    s = stream.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


def totals(stream: DataFrame, status: str) -> DataFrame:
    """K5: running numbers of each status."""
    return stream.groupBy(status).agg(F.count("*").alias("n"))


def finished(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote (append mode)."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
