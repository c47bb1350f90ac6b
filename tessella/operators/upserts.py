"""Changes to tables without a transactional format: a new snapshot from the old one and the changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.times import first_filled


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str, keep_old: Sequence[str] = (), keep_filled: Sequence[str] = ()) -> DataFrame:
    """One row for each key. A new row (the one with the largest ``order`` of its key) replaces
    the old one, but for the columns ``keep_old``, which stay, and ``keep_filled``, which stay unless they are null.
    """
    rest = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), F.struct(*rest).alias("r"))).alias("__n"))
    both = old.select(*keys, F.struct(*rest).alias("__old")).join(last, list(keys), "full_outer")
    def pick(c: str) -> Column:
        was, now, fresh = F.col(f"__old.{c}"), F.col(f"__n.r.{c}"), F.col("__n").isNotNull()
        if c in keep_old:
            return F.when(F.col("__old").isNotNull(), was).otherwise(now).alias(c)
        if c in keep_filled:
            return F.coalesce(was, now).alias(c)
        return F.when(fresh, now).otherwise(was).alias(c)
    return both.select(*keys, *[pick(c) for c in rest])


def children_replaced(old: DataFrame, new: DataFrame, key: str, cleared: DataFrame | None = None) -> DataFrame:
    """The children of every key in ``new`` (and in ``cleared``) are replaced by those in ``new``."""
    keys = new.select(key) if cleared is None else new.select(key).union(cleared.select(key))
    return old.join(keys.distinct(), key, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """New rows whose key is not there yet, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh)


def renamed(faces: DataFrame, changes: DataFrame) -> DataFrame:
    """Faces (face_id, name, is_reference, perhaps person_id) after changes (face_id, op, name, seq): assign sets
    the name and makes a reference, rename only sets the name, reset gives the placeholder back, delete removes. The
    last change of a face counts. The registry and the faces of items take the same changes."""
    last = changes.groupBy("face_id").agg(F.max_by(F.struct("op", F.col("name").alias("to")), "seq").alias("c"))
    out = faces.join(last, "face_id", "left").where("c is null or c.op <> 'delete'")
    names = [n for n in ("name", "person_id") if n in faces.columns]
    return out.withColumns({
        **{n: F.when(F.col("c.op").isin("assign", "rename"), F.col("c.to")).when(F.col("c.op") == "reset", F.col("face_id")).otherwise(F.col(n)) for n in names},
        "is_reference": F.when(F.col("c.op") == "assign", True).when(F.col("c.op") == "reset", False).otherwise(F.col("is_reference"))}).drop("c")


def resets_by_file(registry: DataFrame, wanted: Sequence[str], seq: int) -> DataFrame:
    """Changes that reset every face whose source holds the base name of a wanted file, in any case; blank
    requests reset nothing."""
    names = [w.strip().rstrip("/").rsplit("/", 1)[-1].lower() for w in wanted]
    hit = F.lit(False)
    for n in names:
        if n:
            hit = hit | F.lower("source_file").contains(n)
    return registry.where(hit).select("face_id", F.lit("reset").alias("op"), F.lit(None).cast("string").alias("name"), F.lit(seq).alias("seq"))


def manual_faces(links: DataFrame, registry: DataFrame) -> DataFrame:
    """A reference face for each person linked to an item by hand (media_id, name), with the image and embedding
    of the person's first face that has an image; both are null where there is none, and blank names are left out."""
    sample = registry.where(F.coalesce("image_path", F.lit("")) != "").groupBy("name").agg(F.min_by(F.struct("image_path", "embedding"), "face_id").alias("s"))
    named = links.select("media_id", F.trim("name").alias("name")).where("name <> ''")
    face_id = F.concat(F.lit("manual_"), F.substring(F.sha2(F.concat_ws("/", "media_id", "name"), 256), 1, 12))
    return named.join(sample, "name", "left").select(
        "media_id", face_id.alias("face_id"), "name", F.col("s.image_path").alias("image_path"), F.col("s.embedding").alias("embedding"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_reference"))


def linked(item_faces: DataFrame, links: DataFrame, registry: DataFrame) -> DataFrame:
    """The faces of items with those of ``manual_faces``, in the columns of ``item_faces``."""
    return inserted(item_faces, manual_faces(links, registry).select(item_faces.columns), ["media_id", "face_id"], [F.col("name")])


def unlinked(item_faces: DataFrame, links: DataFrame) -> DataFrame:
    """Without the given faces (media_id, face_id)."""
    return item_faces.join(links, ["media_id", "face_id"], "left_anti")


def merged_documents(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the new document where they are filled, else of the old one."""
    n = new.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return old.join(n, key, "full_outer").select(key, *[first_filled(f"__{f}", f).alias(f) for f in fields])


def transitions(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last state of each key in an append-only log; a state FAILED keeps its message, others have none."""
    from tessella.operators.relational import latest

    out = latest(log, [key], order)
    return out.withColumn("error_message", F.when(F.col("status") == "FAILED", F.col("error_message")))


def swap_snapshot(spark: SparkSession, df: DataFrame, folder: str, version: int) -> str:
    """Writes a snapshot as a new version below ``folder``; readers take the largest version that is complete."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
