"""C: joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.paths import media_id
from tessella.operators import relational as R
from tessella.operators.cosine import near_vectors, nearest_reference
from tessella.operators.faces import faces_of_files
from tessella.operators.places import nearest_place
from tessella.operators.hamming import near_hashes
from tessella.operators.scan import window_pairs
from tessella.plans.base import CAPTURES, FACES, MEDIA, captures, faces, media, query, read


@query("C1", """SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey""")
def left_joins(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("C2", "SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("C3", """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def all_persons(spark: SparkSession, d: str) -> DataFrame:
    o, l = read(spark, d, "orders"), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    found = R.with_all(o, l, "o_orderkey", "l_suppkey", ["1", " 2", "2"])
    page = R.ordered_page(found, [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 50)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("C4", "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#7')")
def any_tag(spark: SparkSession, d: str) -> DataFrame:
    tags = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand")
    return R.with_any(tags.select("o_orderkey").distinct(), tags, "o_orderkey", "p_brand", ["brand#1", "BRAND#7 ", ""])


@query("C5", """WITH p AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)
SELECT o_orderkey, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey), '') AS suppliers FROM p LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def page_with_children(spark: SparkSession, d: str) -> DataFrame:
    page = R.ordered_page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)
    out = R.nested(page, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey", "s", ["l_suppkey"])
    return out.select("o_orderkey", F.array_join(F.transform("s", lambda x: x.l_suppkey.cast("string")), ",").alias("suppliers"))


@query("C6", f"""WITH {FACES}, {MEDIA}, r AS (SELECT doc_id, '/in/' || doc_id || '.JPG' AS file FROM documents WHERE doc_id % 100 = 0), h AS (
  SELECT doc_id, 'q' || quality AS face_id, 0.9::DOUBLE AS confidence FROM labels UNION ALL SELECT doc_id, 'q' || quality, 0.5 FROM labels UNION ALL SELECT doc_id, 't' || toxic, 0.7 FROM labels
), a AS (SELECT file, face_id, max(confidence) AS confidence, 'items' AS found_in FROM r JOIN media m ON ends_with(lower(file_path), r.doc_id || '.jpg') JOIN h ON h.doc_id = m.doc_id WHERE m.doc_id % 3 > 0 GROUP BY file, face_id),
k AS (SELECT face_id::VARCHAR AS face_id, confidence, '/media/' || CASE WHEN face_id % 2 = 0 THEN 'a/' || face_id || '.jpg' ELSE 'in/' || face_id * 10 || '.jpg.bak' END AS source FROM faces)
SELECT * FROM a UNION ALL SELECT file, face_id, confidence, 'registry' FROM r JOIN k ON ends_with(source, r.doc_id || '.jpg') OR contains(source, lower(file)) WHERE file NOT IN (SELECT file FROM a)""")
def faces_of_file(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d)
    items = m.select(media_id("file_path").alias("id"), "file_path", "doc_id")
    found = F.array(*[F.struct(F.concat(F.lit(p), F.col(c).cast("string")).alias("face_id"), F.lit(x).alias("confidence")) for p, c, x in (("q", "quality", 0.9), ("q", "quality", 0.5), ("t", "toxic", 0.7))])
    held = items.where("doc_id % 3 > 0").join(read(spark, d, "labels"), "doc_id").select(F.col("id").alias("media_id"), F.inline(found)).withColumn("name", F.col("face_id"))
    i = F.col("face_id").cast("string")
    source = F.when(F.col("face_id") % 2 == 0, F.concat(F.lit("/media/a/"), i, F.lit(".jpg"))).otherwise(F.concat(F.lit("/media/in/"), (F.col("face_id") * 10).cast("string"), F.lit(".jpg.bak")))
    known = faces(spark, d).select(i.alias("face_id"), "name", "confidence", source.alias("source_file"))
    asked = m.where("doc_id % 100 = 0").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("file"))
    return faces_of_files(asked, items, held, known).select("file", "face_id", "confidence", "found_in")


@query("C7", """WITH t AS (SELECT url, page_id FROM pages WHERE page_id % 2 = 0), b AS (
  SELECT b, min_by(page_id, url) AS page_id FROM (SELECT lower(regexp_extract(url, '[^/]*$')) AS b, url, page_id FROM t) GROUP BY b)
SELECT p.page_id AS request, coalesce(t.page_id, b.page_id) AS found, CASE WHEN t.page_id IS NOT NULL THEN 'path' WHEN b.page_id IS NOT NULL THEN 'name' END AS matched_by
FROM pages p LEFT JOIN t ON t.url = p.url LEFT JOIN b ON b.b = lower(regexp_extract(p.url, '[^/]*$'))""")
def basename_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", "url")
    table = p.where("page_id % 2 = 0").select("url", F.col("page_id").alias("found"))
    return R.lookup(p.select(F.col("page_id").alias("request"), F.col("url").alias("want")), table, "want", "url", "found").select("request", "found", "matched_by")


@query("C8", """WITH f AS (SELECT doc_id, '/m/' || doc_id || '.jpg' AS p FROM documents),
l AS (SELECT '/m/' || doc_id || '.jpg' AS p, quality, toxic FROM labels),
b AS (SELECT '/m/' || item_id || '.jpg' AS p, 'text ' || item_id AS summary FROM benchmark)
SELECT f.p AS file_path, CASE WHEN toxic = 1 THEN 'FAILED' WHEN toxic = 0 THEN 'PROCESSED' ELSE 'UNPROCESSED' END AS status,
  CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS face_count, CASE WHEN quality = 1 THEN 'Ann' WHEN quality = 0 THEN 'face_9' ELSE '' END AS names,
  coalesce(quality = 0, false) AS has_unassigned, coalesce(b.summary, CASE WHEN doc_id % 5 = 0 THEN 'side' ELSE '' END) AS summary
FROM f LEFT JOIN l USING (p) LEFT JOIN b USING (p)""")
def gallery_(spark: SparkSession, d: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("/m/"), F.col(c).cast("string"), F.lit(".jpg")).alias("file_path")
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    history = labels.select(path("doc_id"), F.when(F.col("toxic") == 1, "FAILED").otherwise("PROCESSED").alias("status"))
    found = labels.select(path("doc_id"), F.lit("f1").alias("face_id"), F.when(F.col("quality") == 1, "Ann").otherwise("face_9").alias("name"), F.lit(True).alias("is_reference"))
    meta = read(spark, d, "benchmark").select(F.concat(F.lit("/other/"), F.col("item_id").cast("string"), F.lit(".JPG")).alias("file_path"), F.concat(F.lit("text "), F.col("item_id").cast("string")).alias("summary"))
    side = docs.select(path("doc_id"), F.when(F.col("doc_id") % 5 == 0, "side").alias("summary"))
    return R.gallery(docs.select(path("doc_id")), history, found, meta, side)


@query("C9", """WITH f AS (SELECT l_orderkey, l_suppkey AS id, 'n' || (l_suppkey % 10) AS name FROM lineitem),
t AS (SELECT p_partkey AS id, 'n' || p_size AS name, p_brand AS tag, p_type AS category FROM part WHERE p_partkey < 20)
SELECT DISTINCT l_orderkey, tag, category FROM f JOIN t ON f.id = t.id OR f.name = t.name""")
def tag_inheritance(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("id"), F.concat(F.lit("n"), (F.col("l_suppkey") % 10).cast("string")).alias("name"))
    t = read(spark, d, "part").where("p_partkey < 20").select(F.col("p_partkey").alias("id"), F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("tag"), F.col("p_type").alias("category"))
    return R.inherited_tags(f, t, "l_orderkey", "id", "name")


_SUFFIX = """WITH r AS (SELECT DISTINCT regexp_extract(url, '[^/]*/[^/]*$') AS r FROM pages)
SELECT r, min(url) AS url FROM r JOIN pages ON ends_with(lower(rtrim(url, '/')), '/' || lower(rtrim(r, '/'))) GROUP BY r"""


@query("C10", _SUFFIX)
def link_target(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("url")
    return R.by_suffix(p.select(F.regexp_extract("url", "[^/]*/[^/]*$", 0).alias("r")).distinct(), p, "r", "url")


@query("C18", "SELECT page_id, url AS found FROM pages")
def find_file(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", "url")
    asked = p.select("page_id", F.replace(F.upper("url"), F.lit("/"), F.lit("\\")).alias("want"))
    return asked.join(R.found_files(asked.select("want"), p.select(F.col("url").alias("found")), "want", "found"), "want").select("page_id", "found")


@query("C11", f"""WITH {CAPTURES} SELECT a.id AS left_id, b.id AS right_id, b.sec - a.sec AS gap FROM captures a JOIN captures b
  ON a.folder = b.folder AND b.sec - a.sec BETWEEN 0 AND 900 AND (b.sec > a.sec OR a.id < b.id)""")
def time_pairs(spark: SparkSession, d: str) -> DataFrame:
    return window_pairs(captures(spark, d).select("folder", "at", "id"), ["folder"], "at", "id", 900).select("left_id", "right_id", (F.col("t2") - F.col("t1")).alias("gap"))


_NEAR = f"""WITH {FACES}, b AS (SELECT min(face_id) AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS s FROM faces GROUP BY s)
SELECT l.id AS left_id, r.id AS right_id, hamming(l.s, r.s) AS distance FROM b l JOIN b r ON l.id < r.id WHERE hamming(l.s, r.s) <= 17"""


@query("C12", _NEAR)
def hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_hashes(faces(spark, d), "face_id", "bits", 0.73)


@query("C13", """SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(faces(spark, d), "face_id", "embedding", 0.3, "person").withColumn("similarity", F.round("similarity", 4))


@query("C14", f"""WITH {FACES}, r AS (SELECT * FROM faces WHERE face_id % 50 < 5), x AS (
  SELECT q.face_id AS id, r.face_id AS ref_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM faces q, r)
SELECT id, arg_max(ref_id, s) AS ref_id, round(max(s), 4) AS similarity FROM x GROUP BY id HAVING max(s) >= 0.2""")
def best_reference(spark: SparkSession, d: str) -> DataFrame:
    f = faces(spark, d)
    return nearest_reference(f, f.where("face_id % 50 < 5"), "face_id", "embedding", "face_id", 0.2).withColumn("similarity", F.round("similarity", 4))


@query("C15", """SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN '/mobile/' || substr(url, 11) WHEN starts_with(url, 'https://') THEN '/net/' || substr(url, 9) ELSE url END AS mapped FROM pages""")
def path_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([(2, "https://", "/net/"), (1, "https://m.", "/mobile/")], "ordinal int, src string, dst string")
    return R.prefix_mapped(read(spark, d, "pages").select("page_id", "url"), m, "url").select("page_id", "mapped")


@query("C16", """WITH q AS (SELECT o_orderkey, (o_custkey % 160) / 2.0 - 40 + 0.1 AS lat, (o_orderkey % 340) / 2.0 - 85 + 0.2 AS lon FROM orders),
p AS (SELECT s_suppkey AS place, (s_suppkey * 7 % 160) / 2.0 - 40 AS lat, (s_suppkey * 13 % 340) / 2.0 - 85 AS lon FROM supplier),
x AS (SELECT o_orderkey, place, round(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))), 6) AS km
  FROM q, p)
SELECT o_orderkey, min(struct_pack(km := km, place := place)).place AS place, round(min(km), 3) AS km FROM x GROUP BY o_orderkey""")
def nearest_place_(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 160 / 2.0 - 40 + 0.1).alias("lat"), (F.col("o_orderkey") % 340 / 2.0 - 85 + 0.2).alias("lon"))
    p = read(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") * 7 % 160 / 2.0 - 40).alias("lat"), (F.col("s_suppkey") * 13 % 340 / 2.0 - 85).alias("lon"))
    return nearest_place(q, p, "o_orderkey").withColumn("km", F.round("km", 3))


_NEED = """SELECT doc_id, l.doc_id IS NULL OR toxic = 1 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0 OR quality = 0 AS need FROM documents LEFT JOIN labels l USING (doc_id)"""


def _need(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.lit("/m/"), i.cast("string")).alias("file_path")
    labels = read(spark, d, "labels")
    files = read(spark, d, "documents").select("doc_id", path, F.when(i % 5 == 0, 0).otherwise(F.col("n_chars")).alias("file_size"), (i * 1.0).alias("mtime"), F.lit("photo").alias("media_type"), (i % 7 != 0).alias("sidecar"))
    files = files.join(labels.select("doc_id", F.create_map(F.lit("vision"), F.col("quality") == 1).alias("modules")), "doc_id", "left")
    sizes = read(spark, d, "documents").select("doc_id", "n_chars")
    history = labels.join(sizes, "doc_id").select(path, F.when(F.col("toxic") == 1, "FAILED").otherwise("PROCESSED").alias("status"),
                                                 F.when((i % 11 == 0) & (i % 5 != 0), F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("file_size"), F.when((i % 13 == 0) | ((i % 11 == 0) & (i % 5 == 0)), i + 1.0).otherwise(i + 0.005).alias("mtime"))
    return R.need_processing(files, history, ["vision", "transcribe"]).select("doc_id", "need")


# mtime 0 is unknown, so document 0 is never changed by its time
_NEED = _NEED.replace("doc_id % 11 = 0 OR doc_id % 13 = 0", "((doc_id % 11 = 0 OR doc_id % 13 = 0) AND doc_id > 0)")
query("C17", f"SELECT doc_id FROM ({_NEED}) WHERE need")(lambda spark, d: _need(spark, d).where("need").select("doc_id"))
query("J7", _NEED)(_need)
