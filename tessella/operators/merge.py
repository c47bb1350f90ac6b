"""A table in buckets by key: a merge rewrites the buckets that it touches, and a manifest makes it visible at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relational import latest
from tessella.scratch import discard, exists, stored

MANIFEST = "version long, buckets int, held map<int, long>"


class Version(NamedTuple):
    """The newest version of a table: in how many buckets it lies, and the version whose files each bucket has."""

    number: int
    buckets: int
    held: dict[int, int]


def newest(spark: SparkSession, folder: str) -> Version:
    """A version is one file of the manifest, so that it is there as a whole or not at all; -1 where there is none."""
    path = f"{folder.rstrip('/')}/manifest"
    row = spark.read.schema(MANIFEST).parquet(path).orderBy(F.desc("version")).first() if exists(spark, path) else None
    return Version(row["version"], row["buckets"], row["held"]) if row else Version(-1, 0, {})


def _files(folder: str, held: dict[int, int], some: Sequence[int]) -> list[str]:
    return [f"{folder.rstrip('/')}/data/version={held[b]}/bucket={b}" for b in some if b in held]


def rows_of(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table as it is now."""
    v = newest(spark, folder)
    files = _files(folder, v.held, sorted(v.held))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def merge_into(changes: DataFrame, folder: str, number: int, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> int:
    """K1: makes version ``number``, in which the row of each key with the largest ``order`` stands, of those of the table
    and of ``changes``; how many buckets were written.

    Only the buckets that hold a key of the changes are read and written. Their files belong to the new version alone and
    are seen when its line of the manifest is there: a merge that failed before is run again over its own files, one that
    was published is not run again. ``buckets`` counts when the table is new.
    """
    spark, columns = changes.sparkSession, changes.columns
    before = newest(spark, folder)
    if before.number >= number:
        return 0
    buckets = before.buckets or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    own = stored(latest(changes, keys, order).select(*columns), "merge-changes")
    touched = sorted(r[0] for r in own.select(bucket).distinct().collect())  # ``buckets`` numbers at most
    files = _files(folder, before.held, touched)
    if files:
        own = latest(own.unionByName(spark.read.schema(own.schema).parquet(*files)), keys, order).select(*columns)
    own.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.rstrip('/')}/data/version={number}")
    _publish(spark, folder, Version(number, buckets, before.held | dict.fromkeys(touched, number)))
    return len(touched)


def _publish(spark: SparkSession, folder: str, version: Version) -> None:
    spark.createDataFrame([tuple(version)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/manifest")


def expire(spark: SparkSession, folder: str) -> None:
    """Deletes the files of versions that no bucket of the newest one has. Nobody may be reading an older version."""
    v = newest(spark, folder)
    discard(spark, *(f"{folder.rstrip('/')}/data/version={n}" for n in range(v.number) if n not in v.held.values()))
