"""File listings, manifests and sidecar documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.paths import PHOTO, VIDEO, basename, extension, is_vault, media_id, media_type
from tessella.functions.texts import error_class, parse_tags, stored_tags
from tessella.functions.times import first_filled, parse_datetime, seconds
from tessella.schemas import SIDECAR

#: Texts of an analysis that metadata rows carry.
DESCRIBED = ("summary", "summary_ru", "description", "description_ru", "environment", "lighting", "weather", "time_of_day", "ocr_text")

#: Files that a task that writes documents has open at once; rows of further folders are sorted.
OPEN_FILES = 64


def scanned(spark: SparkSession, roots: list[str], vault: bool = False, extensions: Sequence[str] = (*PHOTO, *VIDEO)) -> DataFrame:
    """A1: files below the roots with one of the extensions: path, file_size, mtime and media_type (null for other than
    media). The content is not read; private folders are left out unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    out = files.select("path", F.col("length").alias("file_size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    out = out.where(extension("path").isin(*extensions)).withColumn("media_type", media_type("path"))
    return out if vault else out.where(~is_vault("path"))


def manifest(rows: DataFrame) -> DataFrame:
    """A2: a supplied file list with the path from whichever alias is filled (file_path, file, path), and its name."""
    names = [c for c in ("file_path", "file", "path") if c in rows.columns]
    if not names:
        raise ValueError("the list has no column with a path")
    path = first_filled(*names)
    given = [c for c in ("file_name", "filename") if c in rows.columns]
    return rows.select(path.alias("file_path"), first_filled(*given, basename(path)).alias("file_name"), *[c for c in rows.columns if c not in (*names, *given)]).where("file_path is not null")


def sidecars(spark: SparkSession, path: str, schema: str = SIDECAR, whole_files: bool = True) -> DataFrame:
    """A3: sidecar documents, one a file (or one a line); a broken one is a row with its text in ``_corrupt_record``."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)


def write_sidecars(docs: DataFrame, path: str, by: tuple[str, ...] = ("media_type",)) -> None:
    """A4: documents as JSON, in a folder for each media type (and tenant). A task keeps a file open for each of its
    folders, up to ``OPEN_FILES``, so that whole documents are not sorted by folder first."""
    conf, name = docs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_FILES)
    try:
        docs.write.mode("errorifexists").partitionBy(*by).json(path)
    finally:
        conf.set(name, before)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table of the catalogue; filters and columns reach the Parquet scan."""
    return spark.read.parquet(path)


class Ingest(NamedTuple):
    items: DataFrame
    metadata: DataFrame
    tags: DataFrame
    faces: DataFrame
    timeline: DataFrame
    sync: DataFrame


def ingested(docs: DataFrame) -> Ingest:
    """Sidecar documents as rows of six tables. The documents are read once for each table that is used;
    write or cache them before where that costs more."""
    a = F.col("gemini_analysis")
    d = docs.where("file_path is not null").withColumn("media_id", media_id("file_path"))
    items = d.select(
        F.col("media_id").alias("id"), "file_path", F.coalesce("file_name", basename("file_path")).alias("file_name"), F.coalesce("media_type", media_type("file_path")).alias("media_type"),
        "file_size", "mtime", F.col("video_metadata.duration").alias("duration"),
        parse_datetime(first_filled("exif.datetime", "video_metadata.datetime"), F.col("mtime")).alias("media_date"), "phash", F.lit("PROCESSED").alias("status"))
    metadata = d.select(
        "media_id", *[first_filled(a[c]).alias(c) for c in DESCRIBED],
        F.col("exif.camera_make").alias("camera_make"), F.col("exif.camera_model").alias("camera_model"), F.col("exif.gps.latitude").alias("latitude"), F.col("exif.gps.longitude").alias("longitude"),
        F.nullif(F.concat_ws(", ", "exif.location.city", "exif.location.region", "exif.location.country"), F.lit("")).alias("location_name"),
        F.nullif(F.to_json("exif"), F.lit("{}")).alias("raw_exif"), F.when(a["error"].isNull(), F.to_json(a)).alias("raw_analysis"))
    tags = d.select("media_id", F.explode(stored_tags(F.coalesce("tags", a["tags"]))).alias("t")).select("media_id", "t.*")
    found = d.select("media_id", F.explode("faces").alias("f"))
    faces = found.select("media_id", "f.face_id", F.coalesce(first_filled("f.name"), F.col("f.face_id")).alias("name"), "f.confidence", "f.bbox").where("face_id is not null").dropDuplicates(["media_id", "face_id"])
    events = d.select("media_id", F.explode(a["timeline_events"]).alias("e")).select("media_id", "e.*")
    timeline = events.withColumns({"start_sec": seconds("timestamp_start"), "end_sec": seconds("timestamp_end")})
    sync = d.select("file_path", "file_size", "mtime", F.when(a["error"].isNull(), "PROCESSED").otherwise("FAILED").alias("status"), a["error"].alias("error_message"))
    return Ingest(items, metadata, tags, faces, timeline, sync)


def raw_tags(rows: DataFrame, id_: str, raw: str) -> DataFrame:
    """L4: a row for each tag of a raw JSON or comma-separated value."""
    return rows.select(id_, F.explode(stored_tags(parse_tags(raw))).alias("t")).select(id_, "t.*")


def enriched(items: DataFrame, analyse: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """L1: items with what ``analyse`` returns for them (columns of ``schema``), batch by batch.

    A batch that raises is tried row by row, and still given as one; a row that raises has nulls, the message in ``error`` and its class in
    ``error_class``.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def only(values: pd.Series) -> object:
        (value,) = values.to_numpy()
        return value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = analyse(batch)
                yield batch.assign(**{n: got[n].to_numpy() for n in names}, error=None)
            except Exception:  # noqa: BLE001
                got, errors = [], []
                for i in range(len(batch)):
                    try:
                        one = analyse(batch.iloc[i : i + 1])
                        got.append([only(one[n]) for n in names])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        got.append([None] * len(names))
                        errors.append(str(e))
                yield batch.assign(**{n: pd.Series([g[k] for g in got], batch.index, object) for k, n in enumerate(names)}, error=errors)

    whole = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + f", {schema}, error string"
    return items.mapInPandas(run, whole).withColumn("error_class", F.when(F.col("error").isNotNull(), error_class("error")))
