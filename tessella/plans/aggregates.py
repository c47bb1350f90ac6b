"""D, E, F and G: aggregations, sequences, orders and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.paths import basename
from tessella.functions.times import frame_second
from tessella.operators import relational as R
from tessella.operators.duplicates import exact_members, group_rows
from tessella.operators.faces import cluster_summary, known_persons
from tessella.operators.scan import anchored_bursts, chain_bursts
from tessella.plans.base import CAPTURES, FACES, MEDIA, captures, faces, media, query, read
from tessella.scratch import stored

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("D1", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def per_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("D2", f"WITH {FACES} SELECT source_file, string_agg(face_id::VARCHAR, ',' ORDER BY confidence DESC, face_id) AS faces FROM faces GROUP BY source_file")
def faces_per_source(spark: SparkSession, d: str) -> DataFrame:
    lists = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "face_id")))
    return faces(spark, d).groupBy("source_file").agg(F.array_join(F.transform(lists, lambda x: x.face_id.cast("string")), ",").alias("faces"))


@query("D3", "SELECT lower(regexp_extract(url, '[^/]*$')) AS name, count(*) AS n, sum(page_id) AS ids FROM pages GROUP BY 1")
def per_basename(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "pages").groupBy("url").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"))
    return per.groupBy(F.lower(basename("url")).alias("name")).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


@query("D4", f"""WITH {FACES} SELECT name, count(*) AS n_references, string_agg(face_id::VARCHAR, ',' ORDER BY face_id) AS face_ids,
  coalesce(string_agg(image_path, ',' ORDER BY image_path) FILTER (WHERE image_path <> ''), '') AS images
FROM faces WHERE is_reference AND NOT starts_with(lower(name), 'face_') GROUP BY name""")
def persons(spark: SparkSession, d: str) -> DataFrame:
    k = known_persons(faces(spark, d))
    return k.select("name", "n_references", F.array_join(k.face_ids.cast("array<string>"), ",").alias("face_ids"), F.array_join("images", ",").alias("images"))


@query("D5", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, bool_or(l_linestatus = 'F') AS has_open FROM lineitem GROUP BY 1")
def deduped_faces(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.countDistinct("l_suppkey").alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.bool_or(F.col("l_linestatus") == "F").alias("has_open"))


def _exact(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).withColumns({"content_hash": F.md5("text"), "width": F.lit(0), "height": F.lit(0)})
    return exact_members(m)


EXACT = f"""{MEDIA}, h AS (SELECT *, md5(text) AS content_hash FROM media), m AS (
  SELECT *, 'exact_' || content_hash[1:12] AS group_id, row_number() OVER (PARTITION BY content_hash ORDER BY mtime DESC, file_size DESC, file_path) AS rank, count(*) OVER (PARTITION BY content_hash) AS n FROM h)"""


@query("D6", f"""WITH {EXACT} SELECT group_id, arg_min(file_path, rank) AS "primary", count(*) AS n_members, 1.0::DOUBLE AS similarity,
  coalesce(sum(file_size) FILTER (WHERE rank > 1), 0)::BIGINT AS reclaimable_bytes FROM m WHERE n > 1 GROUP BY group_id""")
def group_summaries(spark: SparkSession, d: str) -> DataFrame:
    return group_rows(_exact(spark, d), "newest").select("group_id", "primary", "n_members", "similarity", "reclaimable_bytes")


@query("D7", f"""WITH {FACES}, seen AS (SELECT person, source_file, max(created_at) AS last FROM faces GROUP BY ALL),
  o AS (SELECT person, string_agg(source_file, ',' ORDER BY last DESC, source_file DESC) AS sources FROM seen GROUP BY person)
SELECT person AS cluster, arg_max(face_id, (image_path <> '', confidence, created_at, face_id)) AS representative, count(*) AS n_faces,
  round_even(avg(confidence), 3) AS avg_confidence, any_value(sources) AS sources FROM faces JOIN o USING (person) GROUP BY person""")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster_summary(faces(spark, d).withColumn("cluster", F.col("person")), "cluster")


@query("D8", """SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
  count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS pending, round_even(count(*) FILTER (WHERE event_type IN ('purchase', 'error')) * 100.0::DOUBLE / count(*), 2) AS percent FROM events""")
def queue_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.status_totals(read(spark, d, "events"), "event_type", "purchase", "error")


@query("D9", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.union, [read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES])


@query("D10", "SELECT printf('Supplier#%02d', max(s_suppkey) + 1) AS next_id FROM supplier")
def next_face(spark: SparkSession, d: str) -> DataFrame:
    return R.next_id(read(spark, d, "supplier"), "s_name", "Supplier#")


@query("D11", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def distinct_persons(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"))


@query("D11_sketch", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY 1")
def sketched_persons(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of two halves of the rows, stored, merged and held against the exact numbers: within five per cent."""
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey")
    halves = [stored(R.distinct_sketches(rows.where(F.col("l_orderkey") % 2 == k), ["l_returnflag"], "l_orderkey"), "sketches") for k in (0, 1)]
    both = R.merged_sketches(*halves, ["l_returnflag"]).select("l_returnflag", F.hll_sketch_estimate("sketch").alias("about"))
    exact = rows.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n"))
    return exact.join(both, "l_returnflag").select("l_returnflag", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


@query("D12", "SELECT md5(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.md5("text").alias("content_hash")).agg(F.count("*").alias("n")).where("n > 1")


@query("E1", f"""WITH {CAPTURES}, s AS (SELECT DISTINCT folder, sec FROM captures), g AS (
  SELECT *, CASE WHEN sec - lag(sec) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY folder ORDER BY sec)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY sec) AS i FROM g)
SELECT folder, min(sec) AS interval_start, max(sec) AS interval_end, count(*) AS n FROM i GROUP BY folder, i.i""")
def intervals_(spark: SparkSession, d: str) -> DataFrame:
    return R.intervals(captures(spark, d), ["folder"], "at", 3600)


CHAIN = f"""WITH {CAPTURES}, g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 3600 AND (64 - bit_count(xor(hi, lag(hi) OVER w)) - bit_count(xor(lo, lag(lo) OVER w))) / 64.0 >= 0.95 THEN 0 ELSE 1 END AS fresh
  FROM captures WINDOW w AS (PARTITION BY folder ORDER BY sec, id)), c AS (SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY sec, id) AS i FROM g),
b AS (SELECT *, first_value(id) OVER (PARTITION BY folder, i ORDER BY sec, id) AS burst, count(*) OVER (PARTITION BY folder, i) AS burst_size FROM c)"""


@query("E2", f"{CHAIN} SELECT id, burst, burst_size FROM b")
def chains(spark: SparkSession, d: str) -> DataFrame:
    return chain_bursts(captures(spark, d), 3600, similarity=0.95).select("id", "burst", "burst_size")


@query("E3", f"""WITH RECURSIVE {CAPTURES}, o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY sec, id::VARCHAR) AS rn FROM captures),
starts AS (SELECT folder, rn, sec, hi, lo, id FROM o WHERE rn = 1 UNION ALL
  SELECT c.folder, min(c.rn), arg_min(c.sec, c.rn), arg_min(c.hi, c.rn), arg_min(c.lo, c.rn), arg_min(c.id, c.rn) FROM starts a JOIN o c ON c.folder = a.folder AND c.rn > a.rn
    AND (c.sec - a.sec > 7200 OR bit_count(xor(c.hi, a.hi)) + bit_count(xor(c.lo, a.lo)) > 6) GROUP BY c.folder)
SELECT o.id::VARCHAR AS file_path, arg_max(a.id, a.rn)::VARCHAR AS series FROM o JOIN starts a ON a.folder = o.folder AND a.rn <= o.rn GROUP BY o.id""")
def anchored(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d).select(F.col("folder").cast("string").alias("folder"), F.col("at").cast("double").alias("at"), F.col("id").cast("string").alias("file_path"), "hi", "lo")
    return anchored_bursts(c, 7200, 0.90)


@query("E4", f"WITH {EXACT} SELECT file_path, rank FROM m WHERE n > 1")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_exact(spark, d), ["group_id"], "newest").select("file_path", "rank")


@query("E5", "SELECT l_orderkey, l_suppkey, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    return R.first_per(l, ["l_orderkey", "l_suppkey"], [F.col("price")])


@query("E6", f"WITH {CAPTURES} SELECT folder, printf('dup_group_%03d', row_number() OVER (ORDER BY min(sec), folder)) AS group_id FROM captures GROUP BY folder")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    g = captures(spark, d).groupBy("folder").agg(F.min("at").alias("at"))
    return R.numbered(g, ["at", "folder"], "dup_group_").select("folder", "group_id")


@query("E7", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM n WHERE n <= 3 OR i IN (0, (n - 1) // 2, n - 1)""")
def spaced(spark: SparkSession, d: str) -> DataFrame:
    return R.evenly_spaced(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")], 3)


@query("E8", """WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, turn, round(CASE WHEN n <= 3 THEN turn ELSE turn * n / 3.0 END, 4)::DOUBLE AS second FROM n WHERE i <= 3""")
def sampled(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = c.withColumn("i", F.row_number().over(R.Window.partitionBy("conv_id").orderBy("turn"))).where("i <= 3")
    return first.join(n, "conv_id").select("conv_id", "turn", F.round(frame_second("turn", "n", "n", 3), 4).alias("second"))


@query("E9", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS last FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return R.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("last"))


@query("F1", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC")
def by_newest(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1999-06-01'")
    return o.orderBy(F.desc_nulls_last("o_orderdate"), F.desc_nulls_last("o_orderkey")).select("o_orderkey")


@query("F2", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    # one row joined to twenty
    return R.ordered_page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 40).crossJoin(F.broadcast(R.total(o))).select("o_orderkey", "total")


@query("F2_keyset", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 50 AS page FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def pages_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Four pages, each from the keys of the last row of the one before."""
    o, order, last, out = read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], None, []
    for k in range(4):
        rows = R.page_after(o, order, last, 50).collect()  # a page
        out += [(r["o_orderkey"], k) for r in rows]
        last = [rows[-1][c] for c, _ in order] if rows else last
    return spark.createDataFrame(out, "o_orderkey long, page long")


@query("F3", "SELECT vec_id, round_even(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: 1.0::DOUBLE)), 4) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def top_vectors(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.similarity import vector_search

    return vector_search(read(spark, d, "embeddings"), "vec_id", "embedding", [1.0] * 64, 10).select(F.col("id").alias("vec_id"), "score")


@query("F4", f"WITH {MEDIA} SELECT doc_id, media_type FROM media WHERE media_type IS NOT NULL ORDER BY media_type, doc_id")
def photos_first(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).where("media_type is not null").orderBy((F.col("media_type") == "video").cast("int"), "doc_id").select("doc_id", "media_type")


@query("F5", f"""WITH {EXACT} SELECT group_id, coalesce(sum(file_size) FILTER (WHERE rank > 1), 0)::BIGINT AS reclaimable_bytes FROM m WHERE n > 1 GROUP BY group_id ORDER BY 2 DESC, 1""")
def by_reclaimable(spark: SparkSession, d: str) -> DataFrame:
    return group_rows(_exact(spark, d), "newest").select("group_id", "reclaimable_bytes").orderBy(F.desc("reclaimable_bytes"), "group_id")


@query("F6", f"WITH {FACES} SELECT source_file, arg_max(face_id, (image_path <> '', confidence, created_at, face_id)) AS representative FROM faces GROUP BY source_file")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    return cluster_summary(faces(spark, d).withColumn("g", F.col("source_file")), "g").select(F.col("g").alias("source_file"), "representative")


@query("F7", "SELECT s_name, s_nationkey FROM supplier ORDER BY s_name, s_nationkey")
def by_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select("s_name", "s_nationkey").orderBy("s_name", "s_nationkey")


@query("F8", "SELECT lower(regexp_extract(url, '[^/]*$')) AS name, min(url) AS url FROM pages GROUP BY 1")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per(read(spark, d, "pages").select(F.lower(basename("url")).alias("name"), "url"), ["name"], [F.col("url")])


@query("G1", f"WITH {MEDIA} SELECT doc_id, CASE WHEN media_type = 'video' THEN 1 ELSE 0 END AS priority FROM media WHERE media_type IS NOT NULL")
def photos_and_videos(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).select("doc_id", "media_type")
    both = m.where("media_type = 'photo'").withColumn("priority", F.lit(0)).unionByName(m.where("media_type = 'video'").withColumn("priority", F.lit(1)))
    return both.orderBy("priority", "doc_id").select("doc_id", "priority")


@query("G2", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def unassigned(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).select("doc_id", "file_path").join(_exact(spark, d).select("file_path"), "file_path", "left_anti").select("doc_id")


@query("G4", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").dropDuplicates()


@query("G5", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def additive_union(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(read(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)

