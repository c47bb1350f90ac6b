"""J, K and L: changes to tables, streams, and functions that a caller supplies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import upserts as U
from tessella.operators.merge import rows_of
from tessella.plans.base import FACES, faces, query, read
from tessella.scratch import new_path, ship_package
from tessella.sources import catalogue as S
from tessella.streaming import catalogue as K

_HALF = "o AS (SELECT * FROM events WHERE event_id % 2 = 0), n AS (SELECT * FROM events WHERE event_id % 2 = 1)"
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("x")).select("user_id", "x.*")
    return old, e.where("event_id % 2 = 1 and user_id % 3 <> 0")


_OLD = "old AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), new AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1)"


@query("J1", f"WITH {_OLD} SELECT user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(o.value, n.value) AS value FROM old o FULL JOIN new n USING (user_id)")
def upsert_item(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return U.upserted(old, new, ["user_id"], "event_id", keep_old=["value"]).select("user_id", "event_type", "value")


@query("J2", f"WITH {_OLD} SELECT user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n USING (user_id)")
def upsert_metadata(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return U.upserted(old, new, ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("J4", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 OR user_id % 3 <> 0 GROUP BY user_id")
def upsert_sync(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    # a later change to the same row: the newest of both tables
    return U.upserted(old, new.unionByName(old), ["user_id"], "event_id").select("user_id", "event_id")


@query("J5", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def upsert_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label", F.lit(1).alias("v"))
    return U.upserted(e, e.where("vec_id % 3 = 0").withColumns({"label": F.col("label") + 100, "v": F.lit(2)}), ["vec_id"], "v").select("vec_id", "label")


@query("J3", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 5 NOT IN (0, 1) UNION ALL SELECT DISTINCT l_orderkey, -1 FROM lineitem WHERE l_orderkey % 5 = 0")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    new = l.where("l_orderkey % 5 = 0").select("l_orderkey", F.lit(-1).cast("bigint").alias("l_suppkey")).distinct()
    return U.children_replaced(l, new, "l_orderkey", l.where("l_orderkey % 5 = 1").select("l_orderkey"))


@query("J6", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber < 4 UNION ALL (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber >= 4 EXCEPT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber < 4)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    old, new = l.where("l_linenumber < 4").drop("l_linenumber"), l.where("l_linenumber >= 4").drop("l_linenumber")
    return U.inserted(old, new, ["l_orderkey", "l_suppkey"], [F.col("l_suppkey")])


@query("J8", f"WITH {FACES} SELECT face_id, CASE WHEN face_id % 4 = 0 THEN 'New' ELSE name END AS name, true AS same FROM faces")
def register(spark: SparkSession, d: str) -> DataFrame:
    f = faces(spark, d).select("face_id", "name", "embedding", F.lit(1).alias("v"))
    new = f.where("face_id % 4 = 0").select("face_id", F.lit("New").alias("name"), F.transform("embedding", lambda x: x * 0).alias("embedding"), F.lit(2).alias("v"))
    out = U.upserted(f, new, ["face_id"], "v", keep_filled=["embedding"]).withColumnRenamed("embedding", "e")
    return out.join(f.select("face_id", "embedding"), "face_id").select("face_id", "name", (F.col("e") == F.col("embedding")).alias("same"))


@query("J9", f"""WITH {FACES}, t AS (
  SELECT face_id, CASE WHEN source_file LIKE '%/7.jpg%' OR face_id % 5 = 1 THEN face_id::VARCHAR WHEN face_id % 5 = 0 THEN 'Ann' ELSE name END AS name,
    CASE WHEN source_file LIKE '%/7.jpg%' OR face_id % 5 = 1 THEN false WHEN face_id % 5 = 0 THEN true ELSE is_reference END AS is_reference
  FROM faces WHERE face_id % 5 <> 2 OR source_file LIKE '%/7.jpg%')
SELECT *, name AS person_id, 'registry' AS held_in FROM t UNION ALL SELECT *, name, 'items' FROM t WHERE face_id % 3 = 0""")
def rename(spark: SparkSession, d: str) -> DataFrame:
    f = faces(spark, d).select(F.col("face_id").cast("string").alias("face_id"), "name", F.col("name").alias("person_id"), "is_reference", F.concat(F.lit("x"), F.regexp_replace("source_file", "^.*/", "-")).alias("source_file"))
    i = F.col("face_id").cast("bigint") % 5
    first = f.where(i < 3).select("face_id", F.lit("assign").alias("op"), F.lit("Bob").alias("name"), F.lit(1).alias("seq"))
    last = f.where(i < 3).select("face_id", F.when(i == 0, "assign").when(i == 1, "reset").otherwise("delete").alias("op"), F.lit("Ann").alias("name"), F.lit(2).alias("seq"))
    changes = first.unionByName(last).unionByName(U.resets_by_file(f, ["/in/X-7.JPG", " "], 3))
    f = f.drop("source_file")
    both = U.renamed(f, changes).withColumn("held_in", F.lit("registry")).unionByName(U.renamed(f.where(F.col("face_id").cast("bigint") % 3 == 0), changes).withColumn("held_in", F.lit("items")))
    return both.withColumn("face_id", F.col("face_id").cast("bigint"))


@query("J10", f"""WITH {FACES}, s AS (SELECT name, arg_min(embedding, face_id)[1]::DOUBLE AS first_value, arg_min(image_path, face_id) AS image_path FROM faces WHERE image_path <> '' GROUP BY name)
SELECT item_id AS media_id, 'Person ' || (item_id % 12) AS name, image_path, first_value FROM benchmark LEFT JOIN s ON s.name = 'Person ' || (item_id % 12) WHERE item_id % 4 <> 3""")
def link_person(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("media_id"), F.concat(F.lit(" Person "), (F.col("item_id") % 12).cast("string")).alias("name"))
    f = faces(spark, d).select("face_id", "name", "image_path", "embedding")
    none = U.manual_faces(b, f).limit(0)
    out = U.linked(none, b, f)
    gone = out.where("cast(media_id as bigint) % 4 = 3").select("media_id", "face_id")
    return U.unlinked(out, gone).select(F.col("media_id").cast("bigint").alias("media_id"), "name", "image_path", F.element_at("embedding", 1).cast("double").alias("first_value"))


@query("J11", "SELECT l_suppkey, tag FROM (SELECT DISTINCT l_suppkey, 'new' AS tag FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_suppkey % 2 = 1)")
def person_tags(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("tag")).distinct()
    return U.children_replaced(l, l.where("l_suppkey % 2 = 0").select("l_suppkey", F.lit("new").alias("tag")).distinct(), "l_suppkey")


@query("J12", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS lang, source FROM documents")
def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "documents").select("doc_id", "lang", "source")
    new = old.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("lang"), F.lit(None).cast("string").alias("source"))
    return U.merged_documents(old, new, "doc_id", ["lang", "source"])


@query("J13", "SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'PROCESSED' ELSE 'PENDING' END, event_id) AS status, arg_max(CASE WHEN event_type = 'error' THEN props ELSE '' END, event_id) AS message FROM events GROUP BY user_id")
def states(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "PROCESSED").otherwise("PENDING").alias("status"), F.col("props").alias("error_message"))
    return U.transitions(e, "user_id", ["event_id"]).select("user_id", "status", F.coalesce("error_message", F.lit("")).alias("message"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    # a folder of its own for the stream to watch, filled from the given table
    path = new_path(spark, "stream-in")
    read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return K.file_stream(spark, path, _EVENTS.replace("timestamp_ntz", "timestamp"))


@query("K1", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "snapshots")
    q = K.ingest(_stream(spark, d).select("user_id", "event_id", "event_type"), folder, new_path(spark, "stream-state"), ["user_id"], ["event_id"], 8)
    q.awaitTermination()
    return rows_of(spark, folder, "user_id bigint, event_id bigint, event_type string")


@query("K2", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = K.deduplicated(_stream(spark, d), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    return K.finished(out, new_path(spark, "stream-out"), new_path(spark, "stream-state"))


@query("K3", """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 3600000000, true) AS fresh FROM e),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(t) AS burst_start, max(t) + 3600000000 AS burst_end, count(*) AS n FROM s GROUP BY user_id, i HAVING max(t) + 3600000000 <= (SELECT max(t) // 1000 * 1000 - 600000000 FROM e)""")
def stream_bursts(spark: SparkSession, d: str) -> DataFrame:
    out = K.bursts(_stream(spark, d), "ts", "user_id", "1 hour", "10 minutes")
    done = K.finished(out, new_path(spark, "stream-out"), new_path(spark, "stream-state"))
    return done.select("user_id", F.unix_micros("burst_start").alias("burst_start"), F.unix_micros("burst_end").alias("burst_end"), "n")


@query("K4", """WITH e AS (SELECT epoch_us(ts) AS t FROM events)
SELECT t // 60000000 * 60000000 AS window_start, count(*) AS n, count(*) > 1 AS over_limit FROM e GROUP BY 1 HAVING window_start + 60000000 <= (SELECT max(t) // 1000 * 1000 - 600000000 FROM e)""")
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    out = K.rates(_stream(spark, d), "ts", "10 minutes", 1)
    done = K.finished(out, new_path(spark, "stream-out"), new_path(spark, "stream-state"))
    return done.select(F.unix_micros("window_start").alias("window_start"), "n", "over_limit")


@query("K5", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "totals")
    t = K.totals(_stream(spark, d), "event_type")
    q = t.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/batch={i}")).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("event_type string, n bigint, batch bigint").option("basePath", folder).parquet(folder)
    return out.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))


@query("L1", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE length(text) END AS size, CASE WHEN doc_id % 10 = 3 THEN 'network' END AS error_class FROM documents")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)

    def analyse(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["doc_id"] % 10 == 3).any():
            raise TimeoutError("connection timed out")
        return pd.DataFrame({"size": rows["text"].str.len()})

    return S.enriched(read(spark, d, "documents").select("doc_id", "text"), analyse, "size bigint").select("doc_id", "size", "error_class")


@query("L4", "SELECT doc_id, unnest(['a', lang]) AS tag, unnest(['general', source]) AS category FROM documents")
def many_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("a, "), "source", F.lit(":"), "lang", F.lit(", ,A"))
    return S.raw_tags(read(spark, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw").select("doc_id", "tag", "category")
