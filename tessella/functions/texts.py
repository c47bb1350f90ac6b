"""Tags, prompts, broken JSON and other text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.paths import col, is_placeholder_name

#: Categories of content, and names by which they also occur. People come before all others.
PEOPLE = "family_memories"
CATEGORIES = {
    "family_memories": ("family_memories", "person", "portrait", "family", "people"), "food": ("food", "meal", "drink"), "nature": ("nature", "landscape", "outdoor"),
    "animals": ("animals", "animal", "pet"), "documents": ("documents", "document", "receipt", "screenshot"), "business_card": ("business_card", "sign", "schedule"),
    "dashcam": ("dashcam", "dash camera"), "other": ("other", "misc"),
}
TAG = "struct<tag:string,category:string,confidence:double>"


def _tag(tag: Column, category: Column, confidence: Column) -> Column:
    return F.struct(F.trim(tag).alias("tag"), F.trim(category).alias("category"), F.coalesce(confidence, F.lit(1.0)).alias("confidence"))


def tag_of_text(text: Column) -> Column:
    """``category:tag`` at the first colon, else a tag of category general."""
    parts = F.split(F.trim(text), ":", 2)
    return F.when(F.size(parts) == 2, _tag(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.lit(1.0))).otherwise(_tag(text, F.lit("general"), F.lit(1.0)))


def parse_tags(raw: Column | str) -> Column:
    """Tags of a JSON array of texts and objects, or of a comma-separated text; empty tags are left out.

    An object has ``tag`` or ``name``, ``category`` (general) and ``confidence`` (1.0 where it is no number).
    """
    raw = col(raw)
    items = F.from_json(raw, "array<string>")
    def one(x: Column) -> Column:
        obj = F.from_json(x, "tag string, name string, category string, confidence string")
        return F.when(F.startswith(F.ltrim(x), F.lit("{")), _tag(
            F.coalesce(F.nullif(obj["tag"], F.lit("")), obj["name"], F.lit("")), F.coalesce(F.nullif(obj["category"], F.lit("")), F.lit("general")), obj["confidence"].try_cast("double"))).otherwise(tag_of_text(x))
    from_array = F.transform(items, one)
    from_list = F.transform(F.split(raw, ","), tag_of_text)
    found = F.when(F.startswith(F.ltrim(raw), F.lit("[")), from_array).otherwise(from_list)
    return F.coalesce(F.filter(found, lambda t: t.tag != ""), F.array().cast(f"array<{TAG}>"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though lambdas read it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stored_tags(tags: Column | str) -> Column:
    """Q16: tags as they are stored: in lower case, the first of equal ones in its place."""
    placed = F.transform(col(tags), lambda t, i: F.struct(F.lower(t.tag).alias("tag"), F.lower(t.category).alias("category"), i.alias("i"), t.confidence.alias("confidence")))

    def first(s: Column) -> Column:
        def fresh(x: Column, j: Column) -> Column:
            before = F.get(s, j - 1)
            return (j == 0) | ~(x.tag.eqNullSafe(before.tag) & x.category.eqNullSafe(before.category))

        return F.array_sort(F.transform(F.filter(s, fresh), lambda x: F.struct(x.i.alias("i"), x.tag.alias("tag"), x.category.alias("category"), x.confidence.alias("confidence"))))

    return F.transform(_with(F.array_sort(placed), first), lambda x: F.struct(x.tag.alias("tag"), x.category.alias("category"), x.confidence.alias("confidence")))


def format_tag(tag: Column, category: Column, style: str) -> Column:
    """A tag as text: categorized or prefixed ``category:tag``, flat ``tag`` or, where asked for, hash ``#tag``."""
    if style not in ("categorized", "flat", "prefixed", "hash"):
        raise ValueError(f"unknown style {style}")
    return {"flat": tag, "hash": F.concat(F.lit("#"), tag)}.get(style, F.concat(category, F.lit(":"), tag))


def with_people(tags: Column | str, names: Column | str) -> Column:
    """Tags and, of category people, the names of known persons that no tag has yet, compared without case."""
    have = F.transform(col(tags), lambda t: F.lower(t.tag))
    known = F.array_distinct(F.filter(F.transform(F.coalesce(col(names), F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: ~is_placeholder_name(n)))
    lows = F.transform(known, F.lower)
    new = F.filter(known, lambda n, i: ~F.array_contains(have, F.lower(n)) & (F.array_position(lows, F.lower(n)) == i + 1))
    return F.concat(col(tags), F.transform(new, lambda n: F.struct(n.alias("tag"), F.lit("people").alias("category"), F.lit(1.0).alias("confidence"))))


def people_lines(faces: Column | str, video: bool = False) -> Column:
    """A line for each face: its number, its name or that it is unknown, and its box or, in videos, its times."""
    def line(f: Column, i: Column) -> Column:
        name = F.when(is_placeholder_name(f["name"]), F.lit("unknown person")).otherwise(f["name"])
        where = F.array_join(F.transform(f["intervals"], lambda x: F.concat(x[0], F.lit("-"), x[1])), ", ") if video else F.concat(F.lit("["), F.array_join(f["bbox"].cast("array<string>"), ", "), F.lit("]"))
        return F.concat((i + 1).cast("string"), F.lit(". "), name, F.lit(" at " if video else " in "), F.coalesce(where, F.lit("?")))
    return F.array_join(F.transform(col(faces), line), "\n")


def fill_template(template: Column | str, parts: dict[str, Column]) -> Column:
    """``{name}`` replaced by each part; parts that the template does not name are appended; three line ends and
    more become two."""
    t = col(template)
    spare = F.concat_ws("\n\n", *[F.when(~F.contains(t, F.lit("{" + k + "}")) & (v != ""), v) for k, v in parts.items()])
    out = t
    for k, v in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    out = F.when(spare != "", F.concat(out, F.lit("\n\n"), spare)).otherwise(out)
    return F.trim(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def repair_json(raw: Column | str) -> Column:
    """JSON text out of a fenced, surrounded or cut-off answer; null where it stays no object.

    Tried in turn: the text without its fence; from the first brace to the last; with words that repeat five times
    and more cut to one, an open string closed, and missing brackets and then braces added. Texts of any length are
    tried whole; the repeats are matched possessively, which takes no stack.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(col(raw), "^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*$", ""))
    good = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.startswith(F.ltrim(x), F.lit("{")), x)
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))

    def completed(once: Column) -> Column:
        return _let(F.when(count(F.regexp_replace(once, "(?s)\\\\.", ""), '"') % 2 == 1, F.concat(once, F.lit('"'))).otherwise(once), lambda x: F.concat(
            x, F.repeat(F.lit("]"), F.greatest(F.lit(0), count(x, "[") - count(x, "]"))), F.repeat(F.lit("}"), F.greatest(F.lit(0), count(x, "{") - count(x, "}")))))

    def tried(x: Column) -> Column:
        outer = F.nullif(F.regexp_extract(x, "(?s)(\\{.*\\})", 1), F.lit(""))
        from_brace = F.nullif(F.regexp_extract(x, "(?s)(\\{.*)$", 1), F.lit(""))
        once = F.regexp_replace(from_brace, "(?U)(\\b\\w+\\b)(?:[\\s,]+\\1\\b){4,}+", "$1")
        return F.coalesce(good(x), _let(outer, good), _let(_let(once, completed), good))

    return _let(t, tried)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def same_language(a: Column | str, b: Column | str) -> Column:
    """Equal, or alike in the first two letters."""
    a, b = F.lower(F.trim(col(a))), F.lower(F.trim(col(b)))
    return F.coalesce((a == b) | ((F.length(a) >= 2) & (F.substring(a, 1, 2) == F.substring(b, 1, 2))), F.lit(False))


def error_class(message: Column | str) -> Column:
    """Quota, rate_limit, network or other."""
    m = F.lower(col(message))
    return (F.when(m.rlike("quota|billing|exhausted"), "quota").when(m.rlike("rate.?limit|too many requests|429"), "rate_limit")
        .when(m.rlike("timeout|timed out|connection|network|unreachable|503|502"), "network").otherwise("other"))


def module_status(media_type: Column, transcription: Column, faces: Column, timeline: Column, phash: Column, analysis: Column, error: Column) -> Column:
    """Which modules are done; speech is null for photos, and an analysis with an error is not done."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    video = media_type == "video"
    return F.struct(
        F.when(video, filled(transcription)).alias("transcribe"),
        F.when(video, timeline.isNotNull()).otherwise(faces.isNotNull()).alias("faces"),
        filled(phash).alias("duplicates"),
        (analysis.isNotNull() & error.isNull()).alias("vision"))
