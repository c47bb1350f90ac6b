"""Times: dates of captures, seconds and positions in videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.paths import col


def parse_datetime(text: Column | str, mtime: Column | None = None) -> Column:
    """H3: a timestamp from ``yyyy:MM:dd HH:mm:ss`` or with ``-`` and ``T``; else from ``mtime``, else null."""
    plain = F.translate(F.substring(col(text), 1, 19), "-T", ": ")
    at = F.try_to_timestamp(plain, F.lit("yyyy:MM:dd HH:mm:ss"))
    return at if mtime is None else F.coalesce(at, F.timestamp_seconds(mtime))


def first_filled(*texts: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(t), F.lit("")) for t in texts])


def minutes(seconds: Column | str) -> Column:
    """H5: ``MM:SS``; minutes may exceed 59."""
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def seconds(text: Column | str, strict: bool = False) -> Column:
    """H6: seconds of ``MM:SS`` and, unless ``strict``, ``HH:MM:SS``; 0 for anything else."""
    parts = F.split(F.coalesce(col(text), F.lit("")), ":")
    n = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    got = F.when(F.size(parts) == 2, F.get(n, F.lit(0)) * 60 + F.get(n, F.lit(1)))
    if not strict:
        got = got.when(F.size(parts) == 3, F.get(n, F.lit(0)) * 3600 + F.get(n, F.lit(1)) * 60 + F.get(n, F.lit(2)))
    return F.coalesce(got, F.lit(0.0))


def frame_second(index: Column | str, frames: Column | str, duration: Column | str, most: int = 30) -> Column:
    """The second of a sampled frame: one a second while they are at most ``most``, else evenly over the video."""
    fps = F.when(col(duration) <= most, F.lit(1.0)).otherwise(F.lit(float(most)) / col(duration))
    return col(index) / fps
