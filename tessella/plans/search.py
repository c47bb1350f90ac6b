"""I: search, duplicates and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import duplicates as D
from tessella.operators import faces as P
from tessella.operators import search as S
from tessella.operators import text_index as T
from tessella.operators.hamming import near_hashes
from tessella.operators.scan import chain_bursts
from tessella.operators.similarity import vector_search
from tessella.plans.aggregates import CHAIN, EXACT
from tessella.plans.base import CAPTURES, FACES, MEDIA, captures, faces, media, query, read
from tessella.scratch import new_path

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿß]+')"
BM25 = f"""t AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), n AS (SELECT id, len(t) AS n FROM t), p AS (SELECT id, unnest(t) AS term FROM t),
q AS (SELECT unnest(['idiot', 'thre']) AS w), f AS (SELECT w, id, count(*) AS f FROM p JOIN q ON starts_with(term, w) GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM f GROUP BY 1), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
b AS (SELECT id, sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM f JOIN df USING (w) JOIN n USING (id), s GROUP BY id)"""


_INDEXES: dict[tuple[str, str], T.StoredIndex] = {}


def _index(spark: SparkSession, d: str) -> T.StoredIndex:
    """The index of the documents, written once for an application: half of them, then the others as a segment."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        docs = read(spark, d, "documents").select("doc_id", "text")
        first = T.build_index(docs.where("doc_id % 2 = 0"), "doc_id", ["text"], new_path(spark, "text-index"))
        _INDEXES[key] = T.append_documents(first, docs.where("doc_id % 2 <> 0"), "doc_id", ["text"])
    return _INDEXES[key]


@query("I1", f"""WITH {BM25}, {MEDIA}, i AS (SELECT m.doc_id AS media_id, round(bm25, 4) AS score FROM media m JOIN b ON b.id = m.doc_id WHERE media_type = 'photo' AND lang IN ('en', 'fr')
  AND m.doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (3, 4) GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 1))
SELECT media_id, score, (SELECT count(*) FROM i) AS total FROM i ORDER BY media_id DESC LIMIT 20""")
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).select(F.col("doc_id").alias("media_id"), "file_path", "media_type", F.col("lang").alias("camera"), F.timestamp_seconds(F.col("doc_id") * 60).alias("media_date"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("PROCESSED").alias("status"))
    m = m.where(F.col("camera").isin("en", "fr"))
    persons = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("name"))
    tags = persons.where(F.col("name").isin("p3", "p4")).select("media_id", F.col("name").alias("tag"), F.lit("people").alias("category"))
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("media_id"), "embedding")
    page, total = S.hybrid_search(m, persons, tags, _index(spark, d), e, query_text="idiot thre x", wanted_tags=["P3", "p4 "], media_type="PHOTO", limit=20)
    return page.select("media_id", F.round("score", 4).alias("score")).crossJoin(F.broadcast(total))  # one row


@query("I1_vector", """WITH s AS (SELECT doc_id AS media_id, coalesce(round_even(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE)), 4), 0) AS score
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT media_id, score, (SELECT count(*) FROM s) AS total FROM s ORDER BY score DESC, media_id DESC LIMIT 10""")
def hybrid_by_vector(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).select(F.col("doc_id").alias("media_id"), "file_path", "media_type", F.col("lang").alias("camera"), F.timestamp_seconds(F.col("doc_id") * 60).alias("media_date"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("PROCESSED").alias("status"))
    none = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.lit("x").alias("name"), F.lit("x").alias("tag"), F.lit("x").alias("category"))
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("media_id"), "embedding")
    index = S.text_index(read(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"])  # never run: with a vector no text is read
    page, total = S.hybrid_search(m, none, none, index, e, query_vector=[1.0, 0.5] * 32, query_text="unused words", limit=10)
    return page.select("media_id", "score").crossJoin(F.broadcast(total))  # one row


@query("I2", "SELECT vec_id AS id, round_even(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (i + 1.0)::DOUBLE)), 4) AS score FROM embeddings ORDER BY score DESC, id LIMIT 25")
def brute_force(spark: SparkSession, d: str) -> DataFrame:
    return vector_search(read(spark, d, "embeddings"), "vec_id", "embedding", [i + 1.0 for i in range(64)], 25)


@query("I3", f"SELECT term, count(*) AS df, sum(tf) AS tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms()


@query("I4", f"WITH {BM25} SELECT id, round(bm25, 4) AS bm25 FROM b")
def text_match(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).matches("idiot Thre a").select("id", F.round("bm25", 4).alias("bm25"))


@query("I4_top", f"WITH {BM25} SELECT id, round(bm25, 4) AS bm25 FROM b ORDER BY round(b.bm25, 9) DESC, id LIMIT 50")
def best_text_matches(spark: SparkSession, d: str) -> DataFrame:
    return T.top_matches(_index(spark, d), "idiot Thre a", 50).select("id", F.round("bm25", 4).alias("bm25"))


#: The files of ``_files``, with the signature as text, and greedy groups: nodes in order of k, each with its earlier
#: neighbours; the rounds carry the list of leaders.
_PHOTOS = f"""{FACES}, photos AS (SELECT '/p/' || face_id || '.jpg' AS file_path, face_id AS ordinal, face_id * 10 AS file_size, md5((face_id % 450)::VARCHAR) AS content_hash, (face_id // 5)::DOUBLE AS t,
  array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS s FROM faces)"""
_GREEDY = """r(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT r.k + 1, CASE WHEN list_has_any(n.near, r.leaders) THEN r.leaders ELSE list_append(r.leaders, n.node) END FROM r JOIN nodes n ON n.k = r.k + 1),
led AS (SELECT leaders FROM r ORDER BY k DESC LIMIT 1)"""


def _visual(files: str) -> str:
    """Members of the visual groups of a table at a similarity of 0.70."""
    return f"""sig AS (SELECT s, min(ordinal) AS node FROM {files} GROUP BY s),
pairs AS (SELECT a.node, list(b.node) AS near FROM sig a JOIN sig b ON b.node < a.node AND hamming(a.s, b.s) <= 19 GROUP BY a.node),
nodes AS (SELECT node, coalesce(near, []) AS near, row_number() OVER (ORDER BY node) AS k FROM sig LEFT JOIN pairs USING (node)), {_GREEDY},
anchored AS (SELECT node, coalesce(list_min(list_intersect(near, leaders)), node) AS anchor FROM nodes, led),
named AS (SELECT f.*, anchor, count(*) OVER (PARTITION BY anchor) AS n, round_even(1 - hamming(f.s, b.s) / 64.0::DOUBLE, 3) AS own_similarity
  FROM {files} f JOIN sig USING (s) JOIN anchored USING (node) JOIN sig b ON b.node = anchor),
visual AS (SELECT *, 'visual_' || anchor AS group_id, min(own_similarity) OVER (PARTITION BY anchor) AS similarity FROM named WHERE n > 1)"""


def _series(far: int) -> str:
    """Groups of the anchored bursts of all photos."""
    return f"""o AS (SELECT *, row_number() OVER (ORDER BY t, file_path) AS rn FROM photos WHERE t > 0),
starts AS (SELECT rn, t, s, file_path FROM o WHERE rn = 1 UNION ALL
  SELECT min(c.rn), arg_min(c.t, c.rn), arg_min(c.s, c.rn), arg_min(c.file_path, c.rn) FROM starts a JOIN o c ON c.rn > a.rn AND (c.t - a.t > 3 OR hamming(c.s, a.s) > {far}) HAVING min(c.rn) IS NOT NULL),
m AS (SELECT o.file_path, o.s, o.file_size, arg_max(a.rn, a.rn) AS g FROM o JOIN starts a ON a.rn <= o.rn GROUP BY ALL),
p AS (SELECT g, arg_max(file_path, file_size) AS "primary", arg_max(s, file_size) AS ps, count(*) AS n FROM m GROUP BY g HAVING count(*) > 1),
burst AS (SELECT 'burst_' || regexp_extract(any_value("primary"), '([0-9]+)[.]', 1) AS group_id, 'burst' AS kind, any_value("primary") AS "primary", count(*) AS n_members,
  string_agg(file_path, ',' ORDER BY file_size DESC) AS members, min(round_even(1 - hamming(s, ps) / 64.0::DOUBLE, 2)) AS similarity, 0::BIGINT AS reclaimable_bytes FROM m JOIN p USING (g) GROUP BY g)"""


_GROUP = """arg_max(file_path, file_size) AS "primary", count(*) AS n_members, string_agg(file_path, ',' ORDER BY file_size DESC) AS members"""


@query("I5", f"""WITH {FACES}, b AS (SELECT min(face_id) AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS s FROM faces GROUP BY s)
SELECT l.id AS left_id, r.id AS right_id, hamming(l.s, r.s) AS distance FROM b l JOIN b r ON l.id < r.id WHERE hamming(l.s, r.s) <= 16""")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_hashes(faces(spark, d), "face_id", "bits", 0.75)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Faces' signatures as photos."""
    f = faces(spark, d)
    return f.select(F.concat(F.lit("/p/"), F.col("face_id").cast("string"), F.lit(".jpg")).alias("file_path"), F.col("face_id").alias("ordinal"), "bits", F.md5((F.col("face_id") % 450).cast("string")).alias("content_hash"),
                    F.floor(F.col("face_id") / 5).cast("double").alias("at"), F.lit(100).alias("width"), (F.col("face_id") % 7).cast("int").alias("height"), (F.col("face_id") * 10).alias("file_size"), (F.col("face_id") * 1.0).alias("mtime"), F.lit("photo").alias("media_type"))


@query("I6", f"WITH RECURSIVE {_PHOTOS}, {_visual('photos')} SELECT group_id, file_path, own_similarity, similarity FROM visual")
def visual_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.visual_members(_files(spark, d), 0.70).select("group_id", "file_path", "own_similarity", "similarity")


@query("I7", f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42),
c(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach), {FACES},
g AS (SELECT node AS face_id, min(reach) AS cluster FROM c GROUP BY node), s AS (SELECT * FROM faces JOIN g USING (face_id)),
seen AS (SELECT cluster, source_file, max(created_at) AS last FROM s GROUP BY ALL), o AS (SELECT cluster, string_agg(source_file, ',' ORDER BY last DESC, source_file DESC) AS sources FROM seen GROUP BY cluster)
SELECT cluster, arg_max(face_id, (image_path <> '', confidence, created_at, face_id)) AS representative, count(*) AS n_faces,
  round_even(avg(confidence), 3) AS avg_confidence, any_value(sources) AS sources FROM s JOIN o USING (cluster) GROUP BY cluster""")
def components(spark: SparkSession, d: str) -> DataFrame:
    f = faces(spark, d)
    return P.cluster_summary(f.join(P.face_components(f, 0.42), "face_id"), "cluster")


@query("I8", f"""WITH RECURSIVE {FACES}, e AS (SELECT a.face_id AS node, list(b.face_id) AS near FROM faces a JOIN faces b ON b.face_id > a.face_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35 GROUP BY 1),
nodes AS (SELECT face_id AS node, coalesce(near, []) AS near, row_number() OVER (ORDER BY face_id DESC) AS k FROM faces LEFT JOIN e ON node = face_id), {_GREEDY}
SELECT node AS face_id, coalesce(list_max(list_intersect(near, leaders)), node) AS leader FROM nodes, led""")
def leaders(spark: SparkSession, d: str) -> DataFrame:
    return P.face_groups(faces(spark, d), 0.35)


@query("I9", f"""WITH RECURSIVE {FACES}, x AS (SELECT *, confidence >= 0.6 AS sure FROM faces WHERE NOT is_reference),
h AS (SELECT x.face_id AS node, g.face_id AS ref, g.face_id % 2 = 0 AS is_ref, list_cosine_similarity(x.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS sim FROM x JOIN faces g ON g.is_reference WHERE sure AND sim >= 0.35),
by_ref AS (SELECT node, arg_max(ref, (sim, -ref)) AS ref FROM h WHERE is_ref GROUP BY node),
rest AS (SELECT * FROM x WHERE face_id NOT IN (SELECT node FROM by_ref)),
old AS (SELECT node, arg_max(ref, (sim, -ref)) AS ref, max(sim) AS sim FROM h WHERE NOT is_ref AND node IN (SELECT face_id FROM rest) GROUP BY node),
e AS (SELECT a.face_id AS node, b.face_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM rest a JOIN rest b ON b.face_id < a.face_id WHERE sim >= 0.35),
ne AS (SELECT node, list(other) AS near FROM e GROUP BY node),
nodes AS (SELECT r.face_id AS node, CASE WHEN sure THEN coalesce(near, []) ELSE [] END AS near, row_number() OVER (ORDER BY r.face_id) AS k
  FROM rest r LEFT JOIN ne ON ne.node = r.face_id WHERE r.face_id NOT IN (SELECT node FROM old)), {_GREEDY},
new AS (SELECT node, 'FACE_ID_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS name FROM (SELECT node, row_number() OVER (ORDER BY node) AS n FROM (SELECT unnest(leaders) AS node FROM led))),
c AS (SELECT e.node, sim, -1 AS k, -other AS age, name FROM e JOIN new ON new.node = other UNION ALL SELECT node, sim, 0, -ref, 'REF_' || ref FROM old)
SELECT node AS ordinal, 'REF_' || ref AS face_id FROM by_ref UNION ALL SELECT node, name FROM new
UNION ALL SELECT node, arg_max(c.name, (sim, k, age)) FROM c JOIN rest ON face_id = node AND sure WHERE node NOT IN (SELECT node FROM new) GROUP BY node""")
def match_faces(spark: SparkSession, d: str) -> DataFrame:
    f = faces(spark, d)
    registry = f.where("is_reference").select(F.concat(F.lit("REF_"), F.col("face_id").cast("string")).alias("face_id"), F.col("face_id").alias("seq"), "embedding", (F.col("face_id") % 2 == 0).alias("is_reference"))
    new = f.where("not is_reference").select(F.col("face_id").alias("ordinal"), "embedding", "confidence")
    return P.match_or_register(new, registry, similarity=0.35, confidence=0.6)


@query("I10", f"WITH RECURSIVE {_PHOTOS}, {_series(38)} SELECT * FROM burst")
def burst_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.group_rows(D.burst_members(_files(spark, d), 3.0, 0.40, "largest_file_size"), "largest_file_size", reclaim=False)


@query("I11", f"""WITH RECURSIVE {CAPTURES}, e AS (SELECT a.id AS a, b.id AS b FROM captures a JOIN captures b ON a.id <> b.id AND abs(a.sec - b.sec) <= 600
  WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
c(node, reach) AS (SELECT a, a FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach), g AS (SELECT node AS id, min(reach) AS component FROM c GROUP BY node),
r AS (SELECT component, row_number() OVER (ORDER BY min(sec), arg_min(g.id, (sec, g.id))) AS n FROM g JOIN captures USING (id) GROUP BY component)
SELECT id, printf('dup_group_%03d', n) AS group_id FROM g JOIN r USING (component)""")
def sets(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_sets(captures(spark, d), 600, 3)


@query("I12", f"{CHAIN} SELECT burst, burst_size FROM b WHERE id = burst AND burst_size > 1")
def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    b = chain_bursts(captures(spark, d), 3600, similarity=0.95)
    return b.where("id = burst and burst_size > 1").select("burst", "burst_size")


@query("I13", f"""WITH {EXACT} SELECT group_id, arg_min(file_path, rank) AS "primary", count(*) AS n_members, string_agg(file_path, ',' ORDER BY rank) AS members FROM m WHERE n > 1 GROUP BY group_id""")
def exact_report(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).withColumns({"content_hash": F.md5("text"), "width": F.lit(0), "height": F.lit(0)})
    return D.group_rows(D.exact_members(m), "newest").select("group_id", "primary", "n_members", "members")


@query("I14", f"""WITH RECURSIVE {_PHOTOS}, same AS (SELECT * FROM photos QUALIFY count(*) OVER (PARTITION BY content_hash) > 1),
others AS (SELECT * FROM photos WHERE file_path NOT IN (SELECT file_path FROM same)), {_visual('others')}, {_series(19)}
SELECT 'exact_' || content_hash[1:12] AS group_id, 'exact' AS kind, {_GROUP}, 1.0::DOUBLE AS similarity, (sum(file_size) - max(file_size))::BIGINT AS reclaimable_bytes FROM same GROUP BY content_hash
UNION ALL SELECT group_id, 'visual', {_GROUP}, min(similarity), (sum(file_size) - max(file_size))::BIGINT FROM visual GROUP BY group_id
UNION ALL SELECT * FROM burst""")
def report(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_report(_files(spark, d), "all", 0.70, 3.0, "largest_file_size")


@query("I15", f"""{CHAIN} SELECT b.id, p.name AS summary, b.id <> b.burst AS is_burst_duplicate, CASE WHEN b.id <> b.burst THEN b.burst END AS burst_primary,
  CASE WHEN b.id <> b.burst THEN b.burst_size END AS similar_files_count FROM b JOIN captures p ON p.id = b.burst""")
def propagation(spark: SparkSession, d: str) -> DataFrame:
    b = chain_bursts(captures(spark, d), 3600, similarity=0.95).withColumn("summary", F.col("name"))
    return D.propagated(b).select("id", "summary", "is_burst_duplicate", "burst_primary", "similar_files_count")


@query("I16", f"""WITH {EXACT}, v AS (SELECT group_id, min(file_name) AS best FROM m WHERE n > 1 AND doc_id % 3 = 0 GROUP BY group_id)
SELECT file_path, coalesce(file_name = best, false) AS is_best, best AS best_name FROM m LEFT JOIN v USING (group_id) WHERE n > 1""")
def judged(spark: SparkSession, d: str) -> DataFrame:
    m = D.exact_members(media(spark, d).withColumns({"content_hash": F.md5("text"), "width": F.lit(0), "height": F.lit(0)}))
    v = m.where("doc_id % 3 = 0").groupBy("group_id").agg(F.min("file_name").alias("best_name"))
    return D.verdicts(m, v).select("file_path", "is_best", "best_name")
