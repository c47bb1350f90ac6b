"""Vectors: similarity, and the float32 bytes in which they may be stored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.paths import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in doubles; 0 where a vector is null or zero or their lengths differ."""
    a, b = col(a), col(b)
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector over its length, in doubles; null where it is null or zero."""
    n = norm(col(a))
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blob: pd.Series) -> pd.Series:
    """float32 bytes as an array; null stays null."""
    return blob.map(lambda b: None if b is None else np.frombuffer(bytes(b[: len(b) // 4 * 4]), "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(vector: pd.Series) -> pd.Series:
    """An array as float32 bytes; null stays null."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def sign_bits(vector: Column | str) -> Column:
    """A signature: 1 where a number of the vector is above 0."""
    return F.transform(col(vector), lambda x: (x > 0).cast("int"))
