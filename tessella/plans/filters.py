"""A, B and H: sources, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import media as M
from tessella.functions import paths as P
from tessella.functions import texts as X
from tessella.functions import times as T
from tessella.functions.vectors import cosine, from_blob, to_blob
from tessella.operators.faces import candidates
from tessella.operators.relational import in_folders
from tessella.plans.base import FACES, MEDIA, faces, media, query, read
from tessella.scratch import new_path, ship_package
from tessella.sources import catalogue as S


@query("A1", "SELECT DISTINCT '/source=' || source || '/lang=' || lang AS folder, 'parquet' AS extension, true AS filled, true AS dated FROM documents")
def scan(spark: SparkSession, d: str) -> DataFrame:
    """A tree of the documents, by source and language, and a folder that is left out."""
    root = new_path(spark, "tree")
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    docs.write.partitionBy("source", "lang").parquet(root)
    docs.limit(1).write.parquet(f"{root}/vault/source=none")  # private
    files = S.scanned(spark, [root], extensions=["parquet"])
    folder = F.regexp_extract("path", "(/source=[^/]*/lang=[^/]*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder"), P.extension("path").alias("extension")).agg(F.bool_and(F.col("file_size") > 0).alias("filled"), F.bool_and(F.col("mtime").isNotNull()).alias("dated"))


@query("A2", f"WITH {MEDIA} SELECT file_path, file_name, file_size FROM media")
def manifest_(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).select(F.when(F.col("doc_id") % 2 == 0, F.col("file_path")).alias("file_path"), F.when(F.col("doc_id") % 2 == 1, F.col("file_path")).alias("file"), "file_size")
    return S.manifest(m)


@query("A3", "SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 = 0 AS broken, count(*) AS n FROM events GROUP BY ALL")
def sidecar_read(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as lines, one of five cut off, and read by the reader."""
    path = new_path(spark, "raw-sidecars")
    read(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))).write.text(path)
    back = S.sidecars(spark, path, "k bigint, _corrupt_record string", whole_files=False)
    return back.select("k", F.col("_corrupt_record").isNotNull().alias("broken")).groupBy("k", "broken").agg(F.count("*").alias("n"))


@query("A5", """SELECT page_id, '/out/' || CASE WHEN starts_with(lower(url), 'https://') THEN substr(url, 9) ELSE regexp_extract(url, '[^/]*$') END || '.json' AS nested,
  '/out/' || regexp_extract(url, '[^/]*$') || '.json' AS flat FROM pages""")
def sidecar_paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", P.sidecar_path("url", "HTTPS:/", "/out").alias("nested"), P.sidecar_path("url", "HTTPS:/", "/out", False).alias("flat"))


def _sidecars(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).where("media_type is not null")
    """Documents as sidecars; their different words are tags, of the file or, for one of two, of its analysis."""
    words = F.array_distinct(F.split("text", "\\s+"))
    tags = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("tag"), F.col("lang").alias("category"), F.lit(1.0).alias("confidence")))
    face = F.struct(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("face_id"), F.nullif("lang", F.lit("en")).alias("name"), F.lit(0.5).alias("confidence"))
    found = F.when(F.col("doc_id") % 3 == 0, F.array(face, face))
    event = F.struct(F.lit("00:10").alias("timestamp_start"), F.lit("01:02:03").alias("timestamp_end"), F.col("lang").alias("activity"), F.lit(None).cast("string").alias("activity_ru"))
    return m.select(
        "file_path", "file_name", "file_size", "mtime", "media_type", F.when(F.col("doc_id") % 2 == 0, tags).alias("tags"),
        F.struct(F.lit("2024:01:02 03:04:05").alias("datetime"), F.col("lang").alias("camera_make"), F.col("source").alias("camera_model"),
                 F.struct(F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude")).alias("gps"),
                 F.struct(F.lit("X").alias("city"), F.lit(None).cast("string").alias("region"), F.lit("Y").alias("country")).alias("location")).alias("exif"),
        F.struct(F.lit(12.5).alias("duration"), F.lit(None).cast("string").alias("datetime")).alias("video_metadata"), F.lit(None).cast("string").alias("phash"), found.alias("faces"),
        F.struct(F.col("source").alias("summary"), F.lit("").alias("description"), F.col("lang").alias("summary_ru"), F.lit(None).cast("string").alias("description_ru"),
                 F.lit("outdoors").alias("environment"), F.lit(" ").alias("lighting"), F.col("source").alias("weather"), F.col("lang").alias("time_of_day"), F.lit(None).cast("string").alias("ocr_text"), F.when(F.col("doc_id") % 9 == 0, "timed out").alias("error"),
                 F.when(F.col("doc_id") % 2 == 1, tags).alias("tags"), F.when(F.col("media_type") == "video", F.array(event)).alias("timeline_events")).alias("gemini_analysis"))


@query("A4", f"""WITH {MEDIA} SELECT file_path, media_type, file_size, len(list_filter(list_distinct(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')), lambda x: x <> '')) AS n_tags FROM media WHERE media_type IS NOT NULL""")
def sidecar_write(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as sidecars and read again."""
    docs, path = _sidecars(spark, d), new_path(spark, "sidecars")
    S.write_sidecars(docs, path)
    back = spark.read.schema("file_path string, file_size bigint, tags array<struct<tag:string>>, gemini_analysis struct<tags:array<struct<tag:string>>>, media_type string").json(path)
    return back.select("file_path", "media_type", "file_size", F.size(F.coalesce("tags", "gemini_analysis.tags")).alias("n_tags"))


@query("A6", f"""WITH {MEDIA}, w AS (
  SELECT file_path, lang, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM media WHERE media_type IS NOT NULL
), t AS (SELECT DISTINCT sha256(file_path)[1:16] AS media_id, lower(trim(unnest(ws))) AS tag, lower(lang) AS category FROM w)
SELECT media_id, tag, category FROM t""")
def ingest_tags(spark: SparkSession, d: str) -> DataFrame:
    return S.ingested(_sidecars(spark, d)).tags.select("media_id", "tag", "category")


@query("A7", f"""WITH {MEDIA} SELECT sha256(file_path)[1:16] AS id, media_type, file_size, 1704164645 AS taken, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'PROCESSED' END AS status,
  CASE WHEN media_type = 'video' THEN 3723.0 END::DOUBLE AS end_sec, source AS summary, lang AS summary_ru, source AS weather, lang AS time_of_day, 'outdoors' AS environment, doc_id % 9 <> 0 AS analysed,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN lang = 'en' THEN 'f' || doc_id ELSE lang END END AS face_name, 'X, Y' AS location_name FROM media WHERE media_type IS NOT NULL""")
def ingest_results(spark: SparkSession, d: str) -> DataFrame:
    t = S.ingested(_sidecars(spark, d))
    out = t.items.select("id", "file_path", "media_type", "file_size", F.unix_timestamp("media_date").alias("taken"))
    out = out.join(t.sync.select("file_path", "status"), "file_path").join(t.timeline.select(F.col("media_id").alias("id"), "end_sec"), "id", "left")
    out = out.join(t.faces.select(F.col("media_id").alias("id"), F.col("name").alias("face_name")), "id", "left")
    seen = t.metadata.select(F.col("media_id").alias("id"), "summary", "summary_ru", "weather", "time_of_day", "environment", F.col("raw_analysis").isNotNull().alias("analysed"), "location_name")
    return out.join(seen, "id").drop("file_path")


@query("A8", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 250000")
def table_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, f"{d}/orders.parquet").where("o_totalprice > 250000").select("o_orderkey", "o_orderstatus")


@query("B1", f"WITH {MEDIA} SELECT media_type, count(*) AS n FROM media WHERE media_type IS NOT NULL GROUP BY 1")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).select(P.media_type("file_path").alias("media_type")).where("media_type is not null").groupBy("media_type").agg(F.count("*").alias("n"))


@query("B2", "SELECT page_id FROM pages WHERE page_id % 4 = 1")
def vault(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    folder = F.element_at(F.array(F.lit("Vaulted"), F.lit("VAULT"), F.lit("my.vault"), F.lit("photos")), (F.col("page_id") % 4 + 1).cast("int"))
    return p.where(P.is_vault(F.concat(folder, F.lit("\\"), "url"))).select("page_id")


@query("B3", """WITH p AS (SELECT page_id, rtrim(lower(url), '/') AS u, regexp_replace(rtrim(lower(url), '/'), '/[^/]*$', '') AS parent, rtrim(regexp_replace(lower(url), '/[^/]*$', ''), '/') AS folder FROM pages),
w AS (SELECT rtrim(f, '/') AS nt, regexp_extract(rtrim(f, '/'), '[^/]*$') AS base FROM (SELECT unnest(['en', 'x', '/de/', 'elsewhere/fr']) AS f))
SELECT DISTINCT page_id FROM p, w WHERE folder = nt OR ends_with(folder, '/' || nt) OR starts_with(u, nt || '/') OR u = nt OR starts_with(parent, nt || '/') OR parent = nt
  OR regexp_extract(parent, '[^/]*$') IN (nt, base) OR regexp_extract(folder, '[^/]*$') IN (nt, base) OR contains(u, '/' || nt || '/')""")
def folders(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", "url", P.dirname("url").alias("folder"))
    wanted = spark.createDataFrame([("en",), ("x",), ("/de/",), ("elsewhere/fr",)], "wanted string")
    return in_folders(p, wanted, "url", "folder", "wanted").select("page_id")


@query("B4", "SELECT page_id FROM pages WHERE page_id % 50 = 0 OR (starts_with(url, 'http:/') AND NOT list_contains(string_split(url, '/'), '..'))")
def workspace(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    return p.where(P.in_workspace("url", F.array(F.lit("http:")), F.col("page_id") % 50 == 0)).select("page_id")


@query("B6", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def by_type(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("lang") == "fr").select("doc_id")


@query("B7", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%'")
def by_camera(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.ilike("p_name", F.lit("%ring%")) | F.ilike("p_brand", F.lit("%ring%"))).select("p_partkey")


@query("B8", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def by_date(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_orderdate between timestamp_ntz '1997-01-01' and timestamp_ntz '1997-03-31'").select("o_orderkey")


@query("B9", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def by_status(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")


@query("B10", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Face_"), "s_name")).otherwise(F.col("s_name"))
    return read(spark, d, "supplier").where(P.is_placeholder_name(name)).select("s_suppkey")


@query("B11", "SELECT doc_id FROM documents WHERE source IS NOT NULL AND source <> '' AND doc_id % 6 <> 0")
def with_source(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("source"))
    return read(spark, d, "documents").where(s.isNotNull() & (s != "")).select("doc_id")


@query("B12", f"WITH {FACES} SELECT face_id FROM faces WHERE (NOT is_reference OR starts_with(lower(name), 'face_')) AND embedding IS NOT NULL")
def candidate_faces(spark: SparkSession, d: str) -> DataFrame:
    return candidates(faces(spark, d)).select("face_id")


@query("B13", f"""WITH {MEDIA} SELECT doc_id, CASE WHEN media_type = 'video' THEN quality IS NOT NULL END AS transcribe,
  CASE WHEN media_type = 'video' THEN toxic IS NOT NULL ELSE quality IS NOT NULL END AS faces, coalesce(lang <> '', false) AS duplicates, toxic = 0 AND toxic IS NOT NULL AS vision
FROM media LEFT JOIN labels USING (doc_id) WHERE media_type IS NOT NULL""")
def modules(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).where("media_type is not null").join(read(spark, d, "labels"), "doc_id", "left")
    s = X.module_status(F.col("media_type"), F.col("quality").cast("string"), F.col("quality"), F.col("toxic"), F.col("lang"), F.col("toxic"), F.when(F.col("toxic") == 1, "error"))
    return m.select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("B14", "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return read(spark, d, "events").select("event_id", "user_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.x", "string").alias("missing"))


@query("B15", "SELECT s_suppkey, s_name FROM supplier")
def names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select("s_suppkey", "s_name")


@query("H1", f"WITH {MEDIA} SELECT doc_id, sha256(file_path)[1:16] AS media_id FROM media")
def ids(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).select("doc_id", P.media_id("file_path").alias("media_id"))


@query("H2", "SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '\\.([^.]*)$', 1)) AS ext FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    win = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", P.basename(win).alias("base"), P.dirname(win).alias("dir"), P.extension(win).alias("ext"))


@query("H3", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_id ELSE epoch_us(ts) // 1000000 END AS at FROM events")
def datetimes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")).otherwise("bad")
    return e.select("event_id", F.unix_timestamp(T.parse_datetime(text, F.col("event_id").cast("double"))).alias("at"))


@query("H4", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS first FROM documents")
def first_time(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.first_filled(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.lit("")), "source").alias("first"))


@query("H5", "SELECT event_id, printf('%02d:%02d', event_id // 60, event_id % 60) AS t FROM events")
def as_minutes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", T.minutes("event_id").alias("t"))


@query("H6", "SELECT event_id, event_id::DOUBLE AS s, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END::DOUBLE AS strict FROM events")
def as_seconds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    long = F.format_string("%02d:%02d:%02d", F.floor(i / 3600).cast("long"), F.floor(i % 3600 / 60).cast("long"), i % 60)
    t = F.when(i % 2 == 0, T.minutes(i)).otherwise(long)
    return read(spark, d, "events").select("event_id", T.seconds(t).alias("s"), T.seconds(t, strict=True).alias("strict"))


@query("H7", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE
  round((CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END) * (l_quantity + l_linenumber / 60.0 + l_linenumber / 3600.0), 6) END AS deg FROM lineitem""")
def to_degrees(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber").cast("double")
    dms = F.when(F.col("l_linenumber") % 3 == 0, F.array("l_quantity", n)).otherwise(F.array("l_quantity", n, n))
    deg = M.degrees(dms, F.when(F.col("l_linestatus") == "F", "S").otherwise("n"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(deg, 6).alias("deg"))


@query("H8", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 > 0 AND l_returnflag <> 'R' THEN l_quantity END AS latitude,
  CASE WHEN l_linenumber % 3 > 0 AND l_returnflag <> 'R' THEN -l_quantity END AS longitude FROM lineitem""")
def positions(spark: SparkSession, d: str) -> DataFrame:
    z = F.lit(0.0)
    dms = F.when(F.col("l_linenumber") % 3 == 0, F.array("l_quantity")).otherwise(F.array("l_quantity", z, z))
    p = M.position(dms, F.lit("N"), dms, F.when(F.col("l_returnflag") != "R", "W"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.latitude", "p.longitude")


@query("H9", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 < 25 THEN printf('%.5f', (o_orderkey % 50) / 25.0) ELSE printf('%.1f', (o_orderkey % 50) / 25.0) END AS exposure, printf('f/%.1f', (o_orderkey % 8)::DOUBLE) AS aperture FROM orders")
def exposures(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", M.exposure(F.col("o_orderkey") % 50 / 25.0).alias("exposure"), M.aperture(F.col("o_orderkey") % 8).alias("aperture"))


@query("H10", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN round(user_id * 1000 / 1001.0, 6) ELSE user_id END::DOUBLE AS fps FROM events")
def rates(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id"), F.col("event_id") % 4
    t = F.when(k == 0, F.concat(u.cast("string"), F.lit("/0"))).when(k == 1, F.concat((u * 1000).cast("string"), F.lit("/1001"))).otherwise(u.cast("string"))
    return read(spark, d, "events").select("event_id", F.round(M.rate(t), 6).alias("fps"))


@query("H11", """WITH n AS (SELECT p_partkey, p_size * p_partkey AS n FROM part)
SELECT p_partkey, (n // 10 + CASE WHEN n % 10 > 5 OR (n % 10 = 5 AND n // 10 % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS mp FROM n""")
def megapixel(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", M.megapixels(F.col("p_size") * 1000, "p_partkey").alias("mp"))


@query("H12", """SELECT vec_id, bit_count(xor(('0x' || md5(vec_id::VARCHAR)[1:8])::BIGINT, ('0x' || md5((vec_id + 1)::VARCHAR)[1:8])::BIGINT))
  + bit_count(xor(('0x' || md5(vec_id::VARCHAR)[9:16])::BIGINT, ('0x' || md5((vec_id + 1)::VARCHAR)[9:16])::BIGINT)) AS distance, 64 AS invalid FROM embeddings""")
def distances(spark: SparkSession, d: str) -> DataFrame:
    h = lambda x: M.halves_of_hex(F.substring(F.md5(x.cast("string")), 1, 16))
    v = F.col("vec_id")
    return read(spark, d, "embeddings").select("vec_id", M.hamming(h(v), h(v + 1)).alias("distance"), M.hamming(h(v), M.halves_of_hex(F.lit("xyz"))).alias("invalid"))


@query("H13", "SELECT vec_id, 1 - (vec_id % 65) / 64.0::DOUBLE AS similarity, 6 AS most FROM embeddings")
def similarities(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", M.hash_similarity(F.col("vec_id") % 65).alias("similarity"), F.lit(M.max_distance(0.90)).alias("most"))


@query("H14", """WITH g AS (SELECT doc_id, list_transform(range(72), lambda i: ascii(md5(doc_id || '/' || i)[1]) % 16) AS g FROM documents)
SELECT doc_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN g[i // 8 * 9 + i % 8 + 1] > g[i // 8 * 9 + i % 8 + 2] THEN '1' ELSE '0' END), '') AS bits FROM g""")
def luminance_hash(spark: SparkSession, d: str) -> DataFrame:
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.ascii(F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), i.cast("string"))), 1, 1)) % 16)
    return read(spark, d, "documents").select("doc_id", F.array_join(M.luminance_bits(grid).cast("array<string>"), "").alias("bits"))


@query("H16", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosines(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("similarity"))


@query("H17", "SELECT vec_id, len(embedding) * 4 AS n_bytes, true AS same FROM embeddings")
def blobs(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    e = read(spark, d, "embeddings").withColumn("blob", to_blob("embedding"))
    return e.select("vec_id", F.octet_length("blob").alias("n_bytes"), (from_blob("blob") == F.col("embedding").cast("array<float>")).alias("same"))


@query("H18", """SELECT doc_id, CASE WHEN n <= 4000 THEN md5(text) ELSE
  md5(encode('size:' || n) || unhex(x[1:1024]) || unhex(x[2 * (n // 2 - 256) + 1:2 * (n // 2 - 256) + 1024]) || unhex(x[2 * n - 1023:])) END AS fingerprint
FROM (SELECT doc_id, text, strlen(text) AS n, hex(text) AS x FROM documents)""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    f = M.fingerprint(F.col("text").cast("binary"), F.octet_length("text"), whole=4000, part=512)
    return read(spark, d, "documents").select("doc_id", f.alias("fingerprint"))


@query("H19", """SELECT doc_id, 'scene' AS category, lang AS tag, 1.0::DOUBLE AS confidence FROM documents
UNION ALL SELECT doc_id, 'documents', source, 0.5 FROM documents UNION ALL SELECT doc_id, 'general', 'plain', 1.0 FROM documents""")
def tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('["scene: '), "lang", F.lit('", {"tag": "'), "source", F.lit('", "category": "documents", "confidence": 0.5}, {"name": " plain ", "confidence": "?"}, ""]'))
    t = read(spark, d, "documents").select("doc_id", F.explode(X.parse_tags(raw)).alias("t"))
    return t.select("doc_id", "t.category", "t.tag", "t.confidence")


@query("H20", "SELECT doc_id, lang || ':' || source AS a, source AS b, lang || ':' || source AS c, '#' || source AS d FROM documents")
def tag_formats(spark: SparkSession, d: str) -> DataFrame:
    f = lambda s: X.format_tag(F.col("source"), F.col("lang"), s)
    return read(spark, d, "documents").select("doc_id", f("categorized").alias("a"), f("flat").alias("b"), f("prefixed").alias("c"), f("hash").alias("d"))


@query("H21", "SELECT doc_id, source || ',' || CASE WHEN doc_id % 2 = 0 THEN 'Ann' ELSE 'Bob,Ann' END AS tags FROM documents")
def people_tags(spark: SparkSession, d: str) -> DataFrame:
    own = F.array(F.struct(F.col("source").alias("tag"), F.lit("general").alias("category"), F.lit(1.0).alias("confidence")))
    names_ = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Ann"), F.lit("ANN"), F.lit("face_3"))).otherwise(F.array(F.lit("Bob"), F.lit(" Ann "), F.upper("source")))
    t = X.with_people(own, names_)
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(t, lambda x: x.tag), ",").alias("tags"))


@query("H22", "SELECT vec_id, '1. ' || CASE WHEN vec_id % 2 = 0 THEN 'Ann' ELSE 'unknown person' END || ' in [1, ' || vec_id || ']' || chr(10) || '2. Bob in [3]' AS lines FROM embeddings")
def people_text(spark: SparkSession, d: str) -> DataFrame:
    f = lambda name, box: F.struct(name.alias("name"), box.alias("bbox"))
    v = F.col("vec_id").cast("int")
    both = F.array(f(F.when(v % 2 == 0, "Ann").otherwise("face_1"), F.array(F.lit(1), v)), f(F.lit("Bob"), F.array(F.lit(3))))
    return read(spark, d, "embeddings").select("vec_id", X.people_lines(both).alias("lines"))


@query("H23", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A ' || lang || chr(10) || chr(10) || 'B' || chr(10) || chr(10) || source ELSE 'A ' || lang || ' ' || source END AS prompt FROM documents")
def templates(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 2 == 0, F.lit("A {context}\n\n\n\nB")).otherwise(F.lit("A {context} {people}"))
    return read(spark, d, "documents").select("doc_id", X.fill_template(t, {"context": F.col("lang"), "people": F.col("source")}).alias("prompt"))


@query("H24", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def repaired(spark: SparkSession, d: str) -> DataFrame:
    p, i = F.col("props"), F.col("event_id") % 4
    raw = (F.when(i == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 1, F.concat(F.lit("Here: "), p, F.lit(" done")))
           .when(i == 2, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "x": "cut'))).otherwise(p))
    return read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(X.repair_json(raw)), "$.k", "bigint").alias("k"))


@query("H25", "SELECT doc_id FROM documents WHERE lang = 'en' OR substr(lang, 1, 2) = 'en'")
def languages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(X.same_language("lang", F.lit("EN-us"))).select("doc_id")


@query("H26", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'quota' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'network' ELSE 'other' END AS kind FROM events")
def errors(spark: SparkSession, d: str) -> DataFrame:
    m = F.element_at(F.array(F.lit("Quota exhausted"), F.lit("HTTP 429 Too Many Requests"), F.lit("Connection timed out"), F.lit("bad picture")), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", X.error_class(m).alias("kind"))


@query("H27", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS merged FROM documents")
def merges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.first_filled(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("")), "source").alias("merged"))


@query("H28", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("H32", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'family_memories' WHEN lang = 'fr' THEN 'food' WHEN lang = 'de' THEN 'nature' ELSE 'other' END AS content_type FROM documents")
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.createDataFrame([(a, c) for c, names_ in X.CATEGORIES.items() for a in names_], "alias string, content_type string")
    raw = F.when(F.col("lang") == "fr", "meal").when(F.col("lang") == "de", "Landscape").otherwise("?")
    m = read(spark, d, "documents").select("doc_id", raw.alias("raw")).join(F.broadcast(alias), F.lower("raw") == F.col("alias"), "left")
    return m.select("doc_id", F.when(F.col("doc_id") % 10 == 0, X.PEOPLE).otherwise(F.coalesce("content_type", F.lit("other"))).alias("content_type"))

