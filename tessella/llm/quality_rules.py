"""Quality rules as a ledger: every rule is evaluated once; policies and ablations only read the bits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.scratch import new_path

#: The white space between words and the counted symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words in a window of the repetition rule.
WINDOW = 5


class Rule(NamedTuple):
    """A rule fails where the expression over the measurements is true."""

    name: str
    fails: str


#: Bit i of a ledger's mask is rule i. Rules are only ever appended, so that stored masks stay valid.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 5 * n_text_lines"),
    Rule("shouting", "10 * n_upper > 4 * n_letters"),
    Rule("exclamations", "10 * n_exclamations > 3 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "10 * word_chars < 15 * n_words"),
    Rule("few_letters", "10 * n_letters < 5 * word_chars"),
    Rule("many_digits", "10 * n_digits > 5 * word_chars"),
    Rule("stutter", "10 * n_stutter > 3 * n_words"),
)
BITS = {rule.name: i for i, rule in enumerate(RULES)}

#: A policy drops a document that fails one of its rules.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "shouting", "exclamations", "long_words", "short_words", "few_letters", "many_digits", "stutter"),
}
CURRENT = "v2"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are one of these."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with a measurement in each column; null text counts as empty."""
    keep = [c for c in docs.columns if c != text and c not in MEASURED]
    whole = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    split = whole.select(
        *keep,
        words_of(F.col("__text")).alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("__lines"),
        count_of(F.col("__text"), SYMBOLS).alias("n_symbols"),
        count_of(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count_of(F.col("__text"), "0123456789").alias("n_digits"),
        count_of(F.col("__text"), "!").alias("n_exclamations"),
        F.length(F.translate("__text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    n = F.size("__words")
    hashes = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        *keep, *[c for c in MEASURED if c in split.columns],
        n.cast("long").alias("n_words"),
        F.size(F.filter("__words", lambda w, i: w == F.get(F.col("__words"), i - 1))).cast("long").alias("n_stutter"),
        F.size("__lines").cast("long").alias("n_text_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("__h"),
    )
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.select(
        *[c for c in hashed.columns if c != "__h"], F.when(repeats, ordered).alias("__s"))
    same = lambda s, j, d: F.coalesce(F.get(s, j + d).getField("h") == F.get(s, j).getField("h"), F.lit(False))
    places = F.array_sort(F.transform(
        F.filter("__s", lambda x, j: same(F.col("__s"), j, -1) | same(F.col("__s"), j, 1)), lambda x: x.getField("i")))
    placed = sorted_.select(*[c for c in sorted_.columns if c != "__s"], F.when(F.col("__s").isNotNull(), places).alias("__p"))
    covered = F.aggregate(
        F.transform("__p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), j + 1), p + WINDOW) - p)),
        F.lit(0), lambda a, x: a + x)
    return placed.select(
        *keep, *[c for c in MEASURED if c != "n_repeat_words"],
        F.coalesce(F.when(F.col("__p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


MEASURED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_upper", "n_letters", "n_digits", "n_exclamations", "n_stutter",
)


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` without ``text``, with every measurement and ``failures``: bit i is set where rule i fails.

    Each rule is evaluated once, in one pass over the text without a shuffle. Null text counts as empty. Repeated rows
    give a row each; an empty table gives none. Columns of the measurements' names in ``docs`` are replaced.
    """
    measured = measurements(docs.drop("failures"), text)
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn("failures", mask)


def policy_mask(policy: str, without: Sequence[str] = ()) -> int:
    return sum(1 << BITS[name] for name in POLICIES[policy] if name not in without)


def kept_by(policy: str, without: Sequence[str] = ()) -> Column:
    """Whether a row of a ledger passes a policy, less some of its rules."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy, without)).cast("long")) == 0


def ablations(ledger_: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it.

    The ledger is first counted by mask: at most two to the number of rules rows, whatever the corpus.
    """
    masks = ledger_.groupBy("failures").agg(F.count("*").alias("rows"))
    cols = []
    for name in POLICIES[policy]:
        bit, whole = 1 << BITS[name], policy_mask(policy)
        of = F.col("failures").bitwiseAND(F.lit(whole).cast("long"))
        cols.append(F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(of.bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("rows"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(of == bit, F.col("rows"))), F.lit(0)).alias("failed_alone"),
            F.coalesce(F.sum(F.when(of.bitwiseAND(F.lit(whole & ~bit).cast("long")) == 0, F.col("rows"))), F.lit(0)).alias("kept_without"),
        ))
    return masks.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def store_ledger(rows: DataFrame, path: str) -> DataFrame:
    """Writes a ledger to the new folder ``path`` and reads it. The rules' names go along, in the order of their bits, so
    that masks are read as they were written when more rules have been added."""
    rows.write.parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(i, rule.name, rule.fails) for i, rule in enumerate(RULES)], "bit int, name string, fails string").coalesce(1).write.parquet(f"{path}/rules")
    return open_ledger(rows.sparkSession, path)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger. Raises where its bits mean other rules than these."""
    for r in spark.read.parquet(f"{path}/rules").collect():
        if r["bit"] >= len(RULES) or RULES[r["bit"]] != Rule(r["name"], r["fails"]):
            raise ValueError(f"bit {r['bit']} of the ledger is the rule {r['name']}")
    return spark.read.parquet(f"{path}/rows")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The ledger is stored; both policies are read from its bits."""
    rows = store_ledger(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), new_path(spark, "ledger"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~kept_by("v1")).alias("base_failed"), kept_by(CURRENT).alias("kept"))


def ablation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy drops, from a stored ledger."""
    return ablations(store_ledger(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), new_path(spark, "ledger")))


#: The measurements in SQL, with the rules of the current policy.
OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), m AS (
  SELECT doc_id, len(ws) AS n_words, len(list_filter(ws, lambda w, i: i > 1 AND w = ws[i - 1])) AS n_stutter, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_text_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters
  FROM w
), g AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), several AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM several, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), a AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_text_lines
    OR 10 * n_upper > 4 * n_letters OR 10 * n_exclamations > 3 * n_words OR word_chars > 15 * n_words
    OR 10 * word_chars < 15 * n_words OR 10 * n_letters < 5 * word_chars OR 10 * n_digits > 5 * word_chars OR 10 * n_stutter > 3 * n_words) AS kept
FROM a
"""
