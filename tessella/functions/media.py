"""What cameras and files say: positions, exposures, rates, sizes, luminance hashes, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.paths import col


def degrees(dms: Column | str, ref: Column | str) -> Column:
    """H7: decimal degrees of (degrees, minutes, seconds) and a hemisphere; null unless there are three numbers."""
    d = col(dms)
    value = d[0] + d[1] / 60.0 + d[2] / 3600.0
    return F.when((F.size(d) == 3) & F.forall(d, lambda x: x.isNotNull()) & col(ref).isNotNull(), F.when(F.upper(col(ref)).isin("S", "W"), -value).otherwise(value))


def position(lat: Column | str, lat_ref: Column | str, lon: Column | str, lon_ref: Column | str) -> Column:
    """H8: a struct of latitude and longitude, both null unless all four parts are there."""
    a, b = degrees(lat, lat_ref), degrees(lon, lon_ref)
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).alias("latitude"), F.when(both, b).alias("longitude"))


def exposure(seconds: Column | str) -> Column:
    """H9: an exposure time as text, with five decimals below one second."""
    s = col(seconds)
    return F.when(s < 1, F.format_string("%.5f", s)).otherwise(F.format_string("%.1f", s))


def aperture(f_number: Column | str) -> Column:
    """H9: ``f/`` and one decimal."""
    return F.format_string("f/%.1f", col(f_number).cast("double"))


def rate(text: Column | str) -> Column:
    """Frames a second from ``30000/1001`` or a number; 0 where the denominator is 0 or the text is no number."""
    parts = F.split(col(text), "/")
    n, d = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def megapixels(width: Column | str, height: Column | str) -> Column:
    """Millions of pixels with two decimals, half-even; nulls count as 0."""
    return F.bround(F.coalesce(col(width), F.lit(0)).cast("double") * F.coalesce(col(height), F.lit(0)) / 1e6, 2)


def luminance_bits(grid: Column | str) -> Column:
    """64 bits of a 9 x 8 luminance grid (72 numbers, row by row): 1 where a place is brighter than the next.

    The grid is bound as a variable, so that it is computed once and not for each of its places.
    """
    def bits(g: Column) -> Column:
        return F.when(F.size(g) == 72, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (
            F.get(g, F.floor(i / 8).cast("int") * 9 + i % 8) > F.get(g, F.floor(i / 8).cast("int") * 9 + i % 8 + 1)).cast("int")))

    return F.get(F.transform(F.array(col(grid)), bits), F.lit(0))


def half_of(bits: Column, first: int) -> Column:
    """32 bits, the first the highest, as a number."""
    return F.aggregate(F.slice(bits, first + 1, 32), F.lit(0).cast("long"), lambda a, b: a * 2 + b)


def halves(bits: Column | str) -> Column:
    """64 bits as two numbers of 32: ``hi`` and ``lo``."""
    return F.struct(half_of(col(bits), 0).alias("hi"), half_of(col(bits), 32).alias("lo"))


def halves_of_hex(text: Column | str) -> Column:
    """16 hex digits as ``hi`` and ``lo``; null where the text is anything else."""
    t = F.lower(col(text))
    return F.when(t.rlike("^[0-9a-f]{16}$"), F.struct(
        F.conv(F.substring(t, 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(t, 9, 8), 16, 10).cast("long").alias("lo")))


def hex_of(bits: Column | str) -> Column:
    """16 hex digits of 64 bits."""
    h = halves(bits)
    return F.lower(F.concat(F.lpad(F.hex(h.hi), 8, "0"), F.lpad(F.hex(h.lo), 8, "0")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two ``halves``; 64 where one is null."""
    d = F.bit_count(a.hi.bitwiseXOR(b.hi)) + F.bit_count(a.lo.bitwiseXOR(b.lo))
    return F.coalesce(d, F.lit(64))


def hash_similarity(distance: Column | str) -> Column:
    """The share of equal bits."""
    return 1 - col(distance) / 64.0


def max_distance(similarity: float) -> int:
    """The largest number of differing bits at a similarity."""
    return int((1 - similarity) * 64 + 1e-9)


def fingerprint(content: Column | str, size: Column | str, whole: int = 20 << 20, part: int = 64 << 10) -> Column:
    """MD5 of a file: of all its bytes up to ``whole``, else of its size and its first, middle and last parts."""
    c, n = col(content), col(size)
    middle = F.floor(n / 2).cast("int") - part // 2
    ends = F.concat(F.concat(F.lit("size:"), n.cast("string"), F.lit("")).cast("binary"), F.substring(c, 1, part), F.substr(c, middle + 1, F.lit(part)), F.substring(c, -part, part))
    return F.when(n <= whole, F.md5(c)).otherwise(F.md5(ends))
