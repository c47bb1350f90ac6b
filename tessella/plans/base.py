"""The register of queries, and the test tables in the shape of a catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.paths import basename, dirname, media_type
from tessella.functions.vectors import sign_bits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "mp4", "avi", "mov", "mkv", "txt")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under an operator's id."""
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: an invented path, the text's length as size."""
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 10 + 1).cast("int"))
    d = d.withColumn("file_path", F.concat(F.lit("/media/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext))
    return d.select("doc_id", "file_path", basename("file_path").alias("file_name"), dirname("file_path").alias("folder"), media_type("file_path").alias("media_type"),
                    F.col("n_chars").alias("file_size"), (F.col("doc_id") * 10.0).alias("mtime"), "lang", "source", "text")


#: The same in SQL.
MEDIA = """media AS (
  SELECT doc_id, p AS file_path, regexp_extract(p, '[^/]*$') AS file_name, '/media/' || source AS folder,
    CASE WHEN doc_id % 10 < 5 THEN 'photo' WHEN doc_id % 10 < 9 THEN 'video' END AS media_type,
    n_chars AS file_size, doc_id * 10.0::DOUBLE AS mtime, lang, source, text
  FROM (SELECT *, '/media/' || source || '/' || doc_id || '.' ||
    (['jpg','jpeg','png','webp','heic','mp4','avi','mov','mkv','txt'])[doc_id % 10 + 1] AS p FROM documents))"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as faces: three of ten are references, one of seven is unnamed."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("face_id"), "embedding", sign_bits("embedding").alias("bits"), F.col("label").alias("person"),
        F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("FACE_ID_"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("Person "), F.col("label").cast("string"))).alias("name"),
        F.when(F.col("vec_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/crops/"), F.col("vec_id").cast("string"), F.lit(".jpg"))).alias("image_path"),
        (F.lit(0.5) + (F.col("vec_id") % 50) / 100.0).alias("confidence"), F.concat(F.lit("/media/a/"), (F.col("vec_id") % 40).cast("string"), F.lit(".jpg")).alias("source_file"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("created_at"), (F.col("vec_id") % 10 < 3).alias("is_reference"))


FACES = """faces AS (
  SELECT vec_id AS face_id, embedding, label AS person,
    CASE WHEN vec_id % 7 = 0 THEN 'FACE_ID_' || vec_id ELSE 'Person ' || label END AS name,
    CASE WHEN vec_id % 3 = 0 THEN '' ELSE '/crops/' || vec_id || '.jpg' END AS image_path,
    0.5 + (vec_id % 50) / 100.0::DOUBLE AS confidence, '/media/a/' || (vec_id % 40) || '.jpg' AS source_file,
    lpad(vec_id::VARCHAR, 12, '0') AS created_at, vec_id % 10 < 3 AS is_reference
  FROM embeddings)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: the user is the folder, ``at`` the second, the value's bits a hash."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("folder"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at"), F.col("event_type").alias("name"),
                    (F.col("event_id") * 2654435761 % 16).alias("hi"), (F.col("event_id") * 40503 % 64).alias("lo"), "value", "props")


CAPTURES = """captures AS (
  SELECT event_id AS id, user_id AS folder, epoch_us(ts) // 1000000 AS sec, event_type AS name,
    event_id * 2654435761 % 16 AS hi, event_id * 40503 % 64 AS lo, value, props
  FROM events)"""
