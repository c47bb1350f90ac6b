"""Faces: known persons, clusters, and matching to a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import basename, is_placeholder_name
from tessella.operators.cosine import near_vectors, nearest_reference, vector_leaders, vector_links
from tessella.operators.graph import PASS_EDGES, connected_components, leader_groups
from tessella.operators.relational import first_per, numbered
from tessella.scratch import stored


def known_persons(registry: DataFrame) -> DataFrame:
    """For each named person the number of references, their face ids and their images, by name."""
    r = registry.where(~is_placeholder_name("name") & F.col("is_reference"))
    return r.groupBy("name").agg(
        F.count("*").alias("n_references"), F.sort_array(F.collect_list("face_id")).alias("face_ids"),
        F.sort_array(F.collect_list(F.nullif("image_path", F.lit("")))).alias("images")).orderBy("name")


def candidates(registry: DataFrame, with_embedding: bool = True) -> DataFrame:
    """Faces that are no reference or have a placeholder's name."""
    c = registry.where(~F.coalesce("is_reference", F.lit(False)) | is_placeholder_name("name"))
    return c.where(F.col("embedding").isNotNull()) if with_embedding else c


def cluster_summary(faces: DataFrame, group: str) -> DataFrame:
    """For each cluster its size, the mean confidence (1.0 where none is known), its distinct sources and
    the representative: with an image first, then by confidence and time.

    Sources stand as they are first seen, newest face first (at one time, the larger name first); faces without a
    source add none. Faces meet by cluster and source before they meet by cluster.
    """
    rank = F.struct(F.coalesce(F.col("image_path") != "", F.lit(False)), F.coalesce("confidence", F.lit(0.0)), F.coalesce("created_at", F.lit("")), "face_id")
    parts = faces.groupBy(group, F.nullif("source_file", F.lit("")).alias("__source")).agg(
        F.max(rank).alias("__best"), F.count("*").alias("__n"), F.sum("confidence").alias("__sum"), F.count("confidence").alias("__known"),
        F.max(F.coalesce("created_at", F.lit(""))).alias("__seen"))
    seen = F.sort_array(F.collect_list(F.when(F.col("__source").isNotNull(), F.struct("__seen", "__source"))), False)
    return parts.groupBy(group).agg(
        F.max("__best").getField("face_id").alias("representative"), F.sum("__n").alias("n_faces"),
        F.bround(F.coalesce(F.sum("__sum") / F.nullif(F.sum("__known"), F.lit(0)), F.lit(1.0)), 3).alias("avg_confidence"),
        F.array_join(F.transform(seen, lambda s: s["__source"]), ",").alias("sources"))


def _parts_asked(paths: DataFrame, column: str, asked: DataFrame, words: str, suffix: bool) -> DataFrame:
    """``paths`` joined with the rows of ``asked`` whose word their column ends in (or holds anywhere).

    A path meets words as an equal key: it gives its parts of the lengths that words have, of which there are few.
    """
    lengths = sorted(r[0] for r in asked.where(F.length(words) > 0).select(F.length(words)).distinct().collect())
    if not lengths:
        return paths.join(asked, F.lit(False))
    size, n = F.array(*map(F.lit, lengths)), F.length(column)
    fit = F.filter(size, lambda k: k <= n)
    ends = F.transform(fit, lambda k: F.substring(F.col(column), n - k + 1, k))
    inside = F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(column), i, k)))))
    return paths.withColumn("__part", F.explode(ends if suffix else inside)).join(asked, F.col("__part") == F.col(words)).drop("__part")


def faces_of_files(requests: DataFrame, items: DataFrame, item_faces: DataFrame, registry: DataFrame) -> DataFrame:
    """For each requested ``file`` its faces: file, face_id, name, confidence, found_in.

    A request finds the items (id, file_path) whose path ends in its file name, in any case, and each face id of theirs
    (media_id, face_id, name, confidence) once, the surest first. Where no item has faces, it finds the registry's
    (source_file): those whose source ends in its file name or holds the whole request. Null and empty requests find
    nothing; a sign in a name stands for itself. Requests are the small side: the lengths of their names, at most some
    hundred numbers, come to the driver.
    """
    want = requests.where("file <> ''").select("file", F.lower(basename("file")).alias("__base"), F.lower("file").alias("__whole")).distinct()
    paths = items.select(F.col("id").alias("media_id"), F.lower("file_path").alias("__path"))
    met = _parts_asked(paths, "__path", want.select("file", "__base"), "__base", True).select("file", "media_id").distinct()
    held = met.join(item_faces.select("media_id", "face_id", "name", "confidence"), "media_id")
    first = first_per(held.where("face_id is not null"), ["file", "face_id"], [F.desc_nulls_last("confidence"), F.col("name"), F.col("media_id")])
    spare = want.join(held.select("file").distinct(), "file", "left_anti")
    known = registry.select(F.lower("source_file").alias("__source"), "face_id", "name", "confidence")
    columns = ["file", "face_id", "name", "confidence"]
    ends = _parts_asked(known, "__source", spare.select("file", "__base"), "__base", True).select(*columns)
    holds = _parts_asked(known, "__source", spare.select("file", F.col("__whole").alias("__w"), "__base"), "__w", False)
    holds = holds.where(~F.endswith("__source", "__base") | (F.col("__base") == "")).select(*columns)  # the others came already
    spares = ends.unionByName(holds).withColumn("found_in", F.lit("registry"))
    return first.select(*columns, F.lit("items").alias("found_in")).unionByName(spares)


def face_components(faces: DataFrame, threshold: float) -> DataFrame:
    """``face_id`` and ``cluster``: connected components of faces whose cosine is at least ``threshold``; faces
    without an embedding are alone."""
    parts = connected_components(vector_links(faces, "face_id", "embedding", threshold), small=PASS_EDGES)
    return faces.select("face_id").join(parts, F.col("face_id") == F.col("node"), "left").select("face_id", F.coalesce("component", "face_id").alias("cluster"))


def face_groups(faces: DataFrame, threshold: float) -> DataFrame:
    """I8: ``face_id`` and ``leader``: greedy groups, newest face first (then by id), faces alone included; faces
    without an embedding are left out. ``created_at`` orders. Faces meet leaders only (``leader_rounds``)."""
    nodes = faces.where("embedding is not null").select(
        F.col("face_id").alias("node"), F.struct((-F.col("created_at").cast("double")).alias("t"), F.col("face_id").alias("id")).alias("ordinal"), F.col("embedding").alias("x"))
    return vector_leaders(nodes, threshold).select(F.col("node").alias("face_id"), "leader")


def match_or_register(faces: DataFrame, registry: DataFrame, *, similarity: float = 0.70, confidence: float = 0.70, last_id: int = 0) -> DataFrame:
    """``ordinal`` and ``face_id`` (a text) for faces in order of arrival.

    ``faces``: ordinal, embedding, confidence; ``registry``: face_id, seq (its order), embedding, is_reference. A
    face takes the best reference if that is similar and the face sure enough; else, on the same test, the best
    candidate, of those in the registry and the ones before it that were registered; else it is registered under the
    next number. A face without an embedding is registered too. Ties in similarity go to the earlier candidate.
    """
    sure = F.coalesce("confidence", F.lit(0.0)) >= confidence
    refs = registry.where("is_reference")
    by_ref = nearest_reference(faces.where(sure), refs, "ordinal", "embedding", "seq", similarity)
    matched = stored(by_ref.join(refs.select(F.col("seq").alias("ref_id"), "face_id"), "ref_id").select(F.col("id").alias("ordinal"), "face_id"), "by-reference")
    rest = stored(faces.join(matched.select("ordinal"), "ordinal", "left_anti"), "unmatched")
    known = registry.where(~F.col("is_reference"))
    old = stored(nearest_reference(rest.where(sure), known, "ordinal", "embedding", "seq", similarity), "by-candidate")
    # who leads: unsure faces always; sure ones without an old candidate unless an earlier new one is similar
    edges = stored(near_vectors(rest, "ordinal", "embedding", similarity), "new-edges")
    free = rest.join(old.select(F.col("id").alias("ordinal")), "ordinal", "left_anti")
    nodes = free.select(F.col("ordinal").alias("node"), "ordinal", (~sure | F.col("embedding").isNull()).alias("forced"))
    lead = leader_groups(nodes, edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    new = stored(lead.where("node = leader").select("node"), "registered")
    named = numbered(new, ["node"], "").select("node", F.format_string("FACE_ID_%02d", F.col("group_id").cast("long") + last_id).alias("face_id"))
    named = stored(named, "new-names")
    # followers, and faces with an old candidate, take the most similar of both kinds
    follow = rest.where(sure).join(new.select(F.col("node").alias("ordinal")), "ordinal", "left_anti").select("ordinal")
    fresh = edges.join(named, F.col("left_id") == F.col("node")).select(F.col("right_id").alias("ordinal"), "similarity", F.lit(1).alias("kind"), F.col("left_id").alias("age"), "face_id")
    held = old.join(known.select(F.col("seq").alias("ref_id"), "face_id"), "ref_id").select(F.col("id").alias("ordinal"), "similarity", F.lit(0).alias("kind"), F.col("ref_id").alias("age"), "face_id")
    best = fresh.union(held).join(follow, "ordinal", "left_semi").groupBy("ordinal").agg(F.max(F.struct("similarity", (-F.col("kind")).alias("k"), (-F.col("age")).alias("a"), "face_id")).alias("b"))
    return matched.union(best.select("ordinal", "b.face_id")).union(named.select(F.col("node").alias("ordinal"), "face_id"))
