"""Duplicate, burst and similar photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.media import halves, hamming, max_distance
from tessella.functions.paths import basename, dirname
from tessella.operators.graph import PASS_EDGES, connected_components, leader_groups
from tessella.operators.hamming import cell_links, celled, near_hashes, scheme, signature_leaders, time_cells
from tessella.operators.relational import numbered, ranked
from tessella.operators.scan import anchored_bursts
from tessella.scratch import stored


def group_rows(members: DataFrame, strategy: str, reclaim: bool = True) -> DataFrame:
    """A row for each group (group_id, kind, members with file_path, file_size): the primary, the members in order
    of rank, their number, the smallest similarity and the bytes of all but the primary. ``group_key``, where there is
    one, tells groups apart; ``group_id`` is then only their name."""
    keys = ["group_key", "group_id"] if "group_key" in members.columns else ["group_id"]
    r = ranked(members, keys, strategy)
    size = F.coalesce("file_size", F.lit(0))
    return r.groupBy(*keys).agg(
        F.first("kind").alias("kind"), F.min(F.when(F.col("rank") == 1, F.col("file_path"))).alias("primary"), F.count("*").alias("n_members"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file_path"))), lambda x: x.file_path), ",").alias("members"),
        F.min("similarity").alias("similarity"), (F.sum(F.when(F.col("rank") > 1, size).otherwise(0)) if reclaim else F.lit(0)).cast("long").alias("reclaimable_bytes")).drop("group_key")


def exact_members(files: DataFrame) -> DataFrame:
    """Members of groups of two and more files with the same non-empty ``content_hash``."""
    again = files.where(F.coalesce("content_hash", F.lit("")) != "").groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select("content_hash")
    return files.join(again, "content_hash").withColumns({"group_id": F.concat(F.lit("exact_"), F.substring("content_hash", 1, 12)), "group_key": F.col("content_hash"), "kind": F.lit("exact"), "similarity": F.lit(1.0)})


def visual_members(files: DataFrame, similarity: float) -> DataFrame:
    """Members of greedy groups: in order of ``ordinal`` a file that no group has yet takes all later ones without
    a group whose signature is close. ``similarity`` is the group's smallest one to that first file.

    Files with equal signatures follow the first of them, so the rounds run over distinct signatures. Where a key of blocks
    of bits pays, close pairs are few and all are made (``near_hashes``); where none does, they may be a share of all pairs,
    and signatures meet leaders only (``signature_leaders``).
    """
    f = files.where(F.size("bits") == 64)
    first = stored(f.groupBy("bits").agg(F.min("ordinal").alias("node")), "visual-signatures")
    if scheme(first.count(), max_distance(similarity)):
        edges = near_hashes(first, "node", "bits", similarity).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
        lead = leader_groups(first.select("node", F.col("node").alias("ordinal")), stored(edges, "visual-edges"))
    else:
        lead = signature_leaders(first, max_distance(similarity))
    named = f.join(first, "bits").join(lead, "node").withColumnRenamed("leader", "anchor")
    size = named.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    named = named.join(size, "anchor").join(first.select(F.col("node").alias("anchor"), F.col("bits").alias("anchor_bits")), "anchor")
    own = F.bround(1 - hamming(halves("bits"), halves("anchor_bits")) / 64.0, 3)
    return named.withColumns({"own_similarity": own, "kind": F.lit("visual"), "group_id": F.format_string("visual_%d", "anchor")}).withColumn(
        "similarity", F.min("own_similarity").over(Window.partitionBy("group_id"))).drop("node", "anchor_bits", "anchor")


def burst_members(files: DataFrame, window: float, similarity: float, strategy: str) -> DataFrame:
    """Members of anchored bursts of two and more, with the similarity of each to the group's primary."""
    f = files.where((F.size("bits") == 64) & (F.col("at") > 0)).withColumns({"folder": dirname("file_path"), "h": halves("bits")})
    s = stored(anchored_bursts(f.select("folder", "at", "file_path", F.col("h.hi").alias("hi"), F.col("h.lo").alias("lo")), window, similarity), "bursts")
    many = s.groupBy("series").agg(F.count("*").alias("n")).where("n > 1").select("series")
    r = ranked(f.join(s.join(many, "series"), "file_path").withColumn("group_id", F.col("series")), ["group_id"], strategy)
    primary = r.where("rank = 1").select("group_id", F.col("file_path").alias("primary"), F.col("h").alias("ph"))  # here still the series
    stem = F.regexp_replace(basename("primary"), "\\.[^.]*$", "")
    return r.join(primary, "group_id").withColumns({"similarity": F.bround(1 - hamming(F.col("h"), F.col("ph")) / 64.0, 2), "kind": F.lit("burst"), "group_key": F.col("series"), "group_id": F.concat(F.lit("burst_"), stem)}).drop("ph", "h", "primary", "rank", "series")


def duplicate_report(files: DataFrame, mode: str = "all", similarity: float = 0.90, window: float = 3.0, strategy: str = "highest_resolution", videos: bool = False) -> DataFrame:
    """Groups of exact, then of visual duplicates among the other photos, and bursts, most reclaimable first.

    ``files``: file_path, ordinal, content_hash, bits, at, width, height, file_size, mtime, media_type.
    """
    if mode not in ("all", "exact", "visual", "burst"):
        raise ValueError(f"unknown mode {mode}")
    files = files if videos else files.where("media_type = 'photo'")
    out = []
    exact = exact_members(files)
    if mode in ("all", "exact"):
        out.append(group_rows(exact, strategy))
    photos = files.where("media_type = 'photo'")
    if mode in ("all", "visual"):
        left = photos.join(exact.select("file_path"), "file_path", "left_anti") if mode == "all" else photos
        out.append(group_rows(visual_members(left, similarity), strategy))
    if mode in ("all", "burst"):
        out.append(group_rows(burst_members(photos, window, similarity, strategy), strategy, reclaim=False))
    groups = out[0]
    for more in out[1:]:
        groups = groups.unionByName(more)
    return groups.orderBy(F.desc("reclaimable_bytes"), "group_id")


def propagated(rows: DataFrame, id_: str = "id", metadata: str = "summary") -> DataFrame:
    """Rows of ``chain_bursts`` with the metadata of their first row, and marks on the others."""
    primary = rows.where(F.col(id_) == F.col("burst")).select(F.col(id_).alias("burst"), F.col(metadata).alias("__m"))
    sibling = F.col(id_) != F.col("burst")
    return rows.join(primary, "burst").withColumns({
        metadata: F.when(sibling, F.col("__m")).otherwise(F.col(metadata)), "is_burst_duplicate": sibling,
        "burst_primary": F.when(sibling, F.col("burst")), "similar_files_count": F.when(sibling, F.col("burst_size"))}).drop("__m")


def duplicate_sets(rows: DataFrame, window: int, distance: int) -> DataFrame:
    """``id``, ``group_id`` of rows (id, at, hi, lo) that chains of pairs connect which are at most ``window``
    seconds apart and differ in at most ``distance`` bits; sets of two and more, numbered by their earliest row. Rows of
    one signature within a window meet, and are united, as one cell."""
    r = stored(celled(rows, window), "sweep-rows")
    cells = stored(time_cells(r), "sweep")
    links = cell_links(cells, window, distance)
    again = stored(r.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "sweep-again")
    repeated = again.limit(1).count() > 0
    if repeated:  # an id that stands in several cells is one node
        of = stored(r.join(again, "id").join(cells.select("h", "bucket", F.col("id").alias("b")), ["h", "bucket"]).select("id", "b"), "sweep-again")
        links = links.union(of.join(of.groupBy("id").agg(F.min("b").alias("a")), "id").where("a <> b").select("a", "b"))
    parts = connected_components(links, small=PASS_EDGES)
    named = cells.join(parts, F.col("id") == F.col("node"), "left").where("component is not null or several").withColumn("component", F.coalesce("component", "id"))
    named = stored(named.select("h", "bucket", "component", "at", "first"), "sets")
    groups = named.groupBy("component").agg(F.min(F.struct("at", "first")).alias("f")).select("component", "f.at", "f.first")
    sets = named.select("h", "bucket", "component").join(numbered(groups, ["at", "first"], "dup_group_").select("component", "group_id"), "component")
    out = r.join(sets, ["h", "bucket"]).select("id", "group_id")
    return out.distinct() if repeated else out


def verdicts(members: DataFrame, judged: DataFrame) -> DataFrame:
    """I16: members (group_id, file_name) with the verdict on their group (best_name, reasoning): whether they are the
    best of it."""
    return members.join(judged, "group_id", "left").withColumn("is_best", F.coalesce(F.col("file_name") == F.col("best_name"), F.lit(False)))
