"""Copies of signatures, and the vectors most similar to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copies_of(rows: DataFrame, id_: str, bits: str) -> DataFrame:
    """``id`` and ``first_id``, the smallest id with the same signature."""
    first = rows.where(F.size(bits) == 64).groupBy(bits).agg(F.min(id_).alias("first_id"))
    return rows.join(first, bits).select(F.col(id_).alias("id"), "first_id")


def vector_search(rows: DataFrame, id_: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows most similar to a query, ties by id; rows without a vector score 0. Four decimals."""
    if not query:
        raise ValueError("the query has no numbers")
    q = F.array(*[F.lit(float(x)) for x in query])
    from tessella.functions.vectors import cosine

    scored = rows.select(F.col(id_).alias("id"), F.bround(cosine(F.col(vector), q), 4).alias("score"), F.size(vector).alias("__n"))
    wrong = F.raise_error(F.lit(f"a vector's length is not {len(query)}"))
    scored = scored.select("id", F.when((F.col("__n") > 0) & (F.col("__n") != len(query)), wrong.cast("double")).otherwise(F.col("score")).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)
