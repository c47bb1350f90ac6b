"""Search: a text index with BM25, vectors, filters and pages."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.operators.relational import cleaned, nested, with_all, with_any

if TYPE_CHECKING:
    from tessella.operators.text_index import StoredIndex

#: BM25's constants as published, and the characters of a token.
K1, B = 1.2, 0.75
TOKEN = "[a-z0-9à-öø-ÿß]+"


class Index(NamedTuple):
    """Postings (term, id, tf) and the documents' lengths (id, n)."""

    postings: DataFrame
    lengths: DataFrame

    def matches(self, text: str) -> DataFrame:
        return text_matches(self, text)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def text_index(rows: DataFrame, id_: str, fields: Sequence[str]) -> Index:
    """An inverted index over the fields taken together; no stemming. Null fields are empty."""
    t = rows.select(F.col(id_).alias("id"), terms_of(F.concat_ws(" ", *fields)).alias("t"))
    return Index(t.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf")), t.select("id", F.size("t").alias("n")))


def query_words(text: str) -> list[str]:
    """Words of two characters and more, in lower case, each once."""
    return [w for w in cleaned(text.split()) if len(w) > 1]


def text_matches(index: Index, text: str) -> DataFrame:
    """I4: ``id`` and ``bm25`` of documents with a term that begins with one of the words of ``text``.

    The request is a short list: its words become conditions on the term, so the postings are filtered where they
    lie. A word counts all its terms together; a word in over half of the documents has a tiny positive weight.
    """
    words = query_words(text)
    stats = index.lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    word = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    hit = index.postings.select("id", "tf", F.explode(F.filter(word, lambda w: F.startswith(F.col("term"), w))).alias("word"))
    f = hit.groupBy("word", "id").agg(F.sum("tf").alias("f"))
    df = f.groupBy("word").agg(F.count("*").alias("df"))
    # one row of totals and at most one row a word: both bounded by the request
    scored = f.join(F.broadcast(df), "word").crossJoin(F.broadcast(stats)).join(index.lengths, "id")
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(part).alias("bm25"))


def hybrid_search(items: DataFrame, faces: DataFrame, tags: DataFrame, index: Index | StoredIndex, embeddings: DataFrame, *, query_vector: Sequence[float] | None = None,
                  query_text: str = "", persons: Sequence[str] = (), wanted_tags: Sequence[str] = (), media_type: str | None = None, camera: str | None = None,
                  date_from: str | None = None, date_to: str | None = None, limit: int = 50, offset: int = 0, by_score: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of the items that pass all filters, with persons and tags, and a one-row table with their number.

    ``items``: media_id, file_path, media_type, camera, media_date, created_at, status. ``faces``: media_id, name;
    ``tags``: media_id, tag, category; ``embeddings``: media_id, embedding. Persons must all be there, tags need one.
    With a vector the text is not used: items come by cosine (four decimals, 0 without an embedding), then date.
    Else the text filters and scores; items come by date, or by score where asked for. A text without a usable word
    does not filter. Filters come before the embeddings are touched; only the page is joined with its children.
    """
    found = items.where("status = 'PROCESSED'")
    if media_type and media_type.lower() in ("photo", "video"):
        found = found.where(F.col("media_type") == media_type.lower())
    if camera:
        found = found.where(F.contains(F.lower("camera"), F.lit(camera.lower())))
    if date_from:
        found = found.where(F.col("media_date") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        found = found.where(F.col("media_date") <= F.lit(date_to).cast("timestamp"))
    found = with_any(with_all(found, faces, "media_id", "name", persons), tags, "media_id", "tag", wanted_tags)
    recent = [F.desc_nulls_last("media_date"), F.desc_nulls_last("created_at"), F.col("media_id")]
    if query_vector is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        found = found.join(embeddings, "media_id", "left").withColumn("score", F.bround(cosine("embedding", q), 4)).drop("embedding")
        order = [F.desc("score"), *recent]
    elif query_words(query_text):
        found = found.join(index.matches(query_text).select(F.col("id").alias("media_id"), F.round("bm25", 12).alias("score")), "media_id")
        order = [F.desc("score"), *recent] if by_score else recent
    else:
        found, order = found.withColumn("score", F.lit(1.0)), recent
    page = found.orderBy(*order).offset(offset).limit(limit)
    page = nested(nested(page, faces, "media_id", "persons", ["name"]), tags, "media_id", "tags", ["tag", "category"])
    return page.orderBy(*order), found.agg(F.count("*").alias("total"))
