"""Removal of lines that many documents repeat, with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, table, texts_of
from tessella.scratch import discard, new_path, stored


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line stripped of ASCII white space and with A-Z lowered; None for short lines."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """Levelled sorted runs of line hashes: ``k``, ``n_docs`` and ``keeper``, each key once in a table.

    A table is bucketed and sorted by ``k``, so a batch that is partitioned alike merges with all runs without another
    exchange. ``add`` merge-anti-joins a batch with the runs: the keys that none has are a run of their own, so that runs
    are disjoint; of the others only the counts are kept, apart (``known``), and no later batch reads them. ``fanout``
    tables of a level are compacted into one of the next, where counts meet their keys again; that keeps the number of
    tables logarithmic. They lie in the shared folder until ``drop``.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        (run.withColumn("known", F.col("keeper").isNull()).repartition(self.buckets, "k").write.partitionBy("known").bucketBy(self.buckets, "k").sortBy("k")
            .option("path", self.paths[name]).saveAsTable(name))
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name).drop("known") for level in self.levels for name in level]

    def runs(self) -> list[DataFrame]:
        """The keys of each run; no key is in two."""
        return [self.spark.table(name).where("not known").drop("known") for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> str:
        """Adds a batch of ``(k, doc_id)``, one row for each document and key; the name of its table.

        Keys that no run has yet are the batch's own run: their ``keeper`` is the batch's largest doc_id that holds them.
        Keys that a run has already only add to the number of documents, with a null keeper.
        """
        own = lines.groupBy("k").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        seen = F.lit(False)
        for i, run in enumerate(self.runs()):
            own = own.join(run.select("k", F.lit(True).alias(f"in{i}")), "k", "left")
            seen = seen | F.coalesce(F.col(f"in{i}"), F.lit(False))
        # a key whose documents have no id has no keeper, and is known by its count alone
        name = self._write(own.select("k", "n_docs", F.when(~seen, F.col("last")).alias("keeper")))
        self._keep(name, 0)
        return name

    def _keep(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged([self.spark.table(x).drop("known") for x in self.levels[level]]))
            self._drop(self.levels[level])
            self.levels[level] = []
            self._keep(merged, level + 1)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, *(self.paths.pop(name) for name in names))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Merges sorted tables, two at a time."""
        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("k", F.col("n_docs").alias("n2"), F.col("keeper").alias("keeper2"))
            return a.join(b, "k", "full_outer").select(
                "k", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("keeper", "keeper2").alias("keeper"))

        return reduce(merge, runs)

    def all(self) -> DataFrame:
        """Every key with its number of documents and its keeper."""
        return self._merged(self.tables())

    def drop(self) -> None:
        """Removes all tables and their files, once what was read from them is written."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``k`` and ``doc_id``: the long lines' keys, each once for a row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(texts_of(batch)):
                own = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                keys += own
                rows += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("doc_id").take(pa.array(rows, pa.int64()))], names=["k", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select(F.lit(b"").alias("k"), "doc_id").schema)


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` with the lines of ``text`` that stay, and ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lowered. Lines whose key has at least
    ``min_chars`` code points and occurs in at least ``min_docs`` documents stay only in the document with the
    largest doc_id that holds it, all of them there. Keys go through ``LineRuns`` in ``batches`` batches of falling
    doc_id, so that the first batch to bring a key has its keeper.

    A null text is one empty line and becomes empty. Rows with a null doc_id count as documents and lose no line;
    repeated rows count each, and share what is dropped. Empty tables give no row. ``n_chars``, where there is such a
    column, is set to the new length; columns ``n_lines`` and ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    edges = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    number = sum((F.when(F.col("doc_id") < e, 1).otherwise(0) for e in edges or []), F.lit(0))
    keyed = line_keys(docs, min_chars).withColumn("batch", number)
    path = new_path(spark, "line-keys")
    keyed.write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    runs = LineRuns(spark)
    for i in range(batches):
        runs.add(keyed.where(F.col("batch") == i).select("k", "doc_id"))
    frequent = stored(runs.all().where(F.col("n_docs") >= min_docs).select("k", "keeper"), "frequent-lines")
    runs.drop()
    drops = stored(keyed.select("k", "doc_id").join(frequent, "k").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("k").alias("__drop")), "line-drops")
    discard(spark, path)
    # always by merging, so that the plan is the same at every size
    with_drops = docs.drop("n_lines", "n_dropped").join(drops.hint("merge"), "doc_id", "left").select(
        *[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "__drop")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = docs.select(*keep).schema.add("n_lines", "long").add("n_dropped", "long")

    def rewrite(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            kept, total, lost = [], [], []
            for text, drop in zip(texts_of(batch), batch.column("__drop").to_pylist(), strict=True):
                total.append(text.count(b"\n") + 1)
                if drop:
                    gone = set(drop)
                    stay = [x for x in text.split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in gone]
                    lost.append(total[-1] - len(stay))
                    text = b"\n".join(stay)
                else:
                    lost.append(0)
                kept.append(text)
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c) if c in new else batch.column(c) for c in [*keep, "n_lines", "n_dropped"]], names=[*keep, "n_lines", "n_dropped"])

    out = with_drops.mapInArrow(rewrite, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The rule of op5 as a query; what the runs hold is a detail of the operator.
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
