"""Paths, names and kinds of media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each kind of media, and names of folders that are private.
PHOTO = ("jpg", "jpeg", "png", "webp", "heic")
VIDEO = ("mp4", "avi", "mov", "mkv")
VAULT = (".vault", "vault", "secret_vault", "private_vault")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slashes(path: Column | str) -> Column:
    """The path with forward slashes only."""
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def media_id(path: Column | str) -> Column:
    """H1: the first 16 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(col(path), 256), 1, 16)


def basename(path: Column | str) -> Column:
    """H2: what follows the last slash of either kind."""
    return F.element_at(F.split(slashes(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    """H2: what precedes the last slash; empty where there is none."""
    return F.regexp_extract(slashes(path), "^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """H2: the lower-case extension without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), "\\.([^.]*)$", 1))


def media_type(path: Column | str) -> Column:
    """B1: photo, video, or null for any other file."""
    ext = extension(path)
    return F.when(ext.isin(*PHOTO), "photo").when(ext.isin(*VIDEO), "video")


def is_vault(path: Column | str) -> Column:
    """B2: whether any segment of the path names a private folder."""
    parts = F.split(F.lower(slashes(path)), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, VAULT)))


def in_workspace(path: Column | str, roots: Column, admin: Column | None = None) -> Column:
    """Whether the path is one of the roots or below one; a path with a ``..`` segment never is. Admins pass."""
    p = slashes(path)
    below = F.exists(roots, lambda r: (p == F.rtrim(r, F.lit("/"))) | F.startswith(p, F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))
    ok = ~F.array_contains(F.split(p, "/"), "..") & below
    return ok if admin is None else admin | ok


def matches_folder(path: Column | str, folder: Column | str, wanted: Column) -> Column:
    """Whether a wanted folder is the file's folder or its end, the path or a prefix of it, lies in between, or it
    or its last segment is the name of the folder. Compared without case."""
    tidy = lambda c: F.rtrim(F.lower(slashes(c)), F.lit("/"))
    p, f, w = tidy(path), tidy(folder), tidy(wanted)
    parent = dirname(p)
    names = F.array(w, basename(w))
    return (wanted != "") & (
        (f == w) | F.endswith(f, F.concat(F.lit("/"), w)) | (p == w) | F.startswith(p, F.concat(w, F.lit("/"))) | (parent == w)
        | F.array_contains(names, basename(parent)) | F.array_contains(names, basename(f)) | F.contains(p, F.concat(F.lit("/"), w, F.lit("/"))))


def sidecar_path(path: Column | str, root: str, out: str, preserve: bool = True) -> Column:
    """A5: where a file's sidecar lies below ``out``: in the file's place below ``root`` (compared without case), or
    flat by its name; a file that is not below ``root`` by its name too."""
    p, r = slashes(path), root.replace("\\", "/").rstrip("/") + "/"
    rest = F.when(F.startswith(F.lower(p), F.lit(r.lower())), F.ltrim(F.substring(p, len(r) + 1, 1 << 20), F.lit("/"))).otherwise(basename(p))
    return F.concat(F.lit(out.rstrip("/") + "/"), rest if preserve else basename(p), F.lit(".json"))


def is_placeholder_name(name: Column | str) -> Column:
    """Whether a name stands for an unknown person; null and empty do."""
    n = F.lower(F.trim(F.coalesce(col(name), F.lit(""))))
    return (n == "") | F.startswith(n, F.lit("face_")) | F.startswith(n, F.lit("face-")) | F.startswith(n, F.lit("person_")) | n.isin("unknown", "unnamed")
