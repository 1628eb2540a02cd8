"""Trigram index: postings, document frequencies, candidates, and search through a written index.

The index is a rewrite of the plain scan that reads only the posting rows of the needle's trigrams; its results are the
scan's, for every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import ascii_fold, distinct_trigrams, fold_needle, needle_trigrams, trigram_key

#: Trigrams of a needle that a search looks up: all, or of more the rarest ones.
LOOKED_UP = 6
#: Candidates up to this number go into the scan's filter as a list; more meet the files in a join.
LISTED = 10_000


def content_postings(files: DataFrame) -> DataFrame:
    """(db, trigram, path) of every distinct trigram of each content folded by ASCII, for use without a written index."""
    return _postings(files.select("db", "path", F.encode("content", "UTF-8").alias("data")).filter(F.col("data").isNotNull()))


def name_postings(files: DataFrame) -> DataFrame:
    return _postings(files.select("db", "path", F.encode(F.lower("path"), "UTF-8").alias("data")))


def _postings(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at = _grams(batch.column(2))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(grams), batch.column(1).take(at)], ["db", "trigram", "path"])

    return rows.mapInArrow(run, "db string, trigram int, path string").select("db", trigram_key(F.col("trigram")).alias("trigram"), "path")


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, row) of the distinct trigrams of each row."""
    found = [distinct_trigrams(x or b"") for x in column.to_pylist()]
    counts = np.array([len(x) for x in found], np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.repeat(np.arange(len(found)), counts)


def lookup(postings: DataFrame, trigram: str) -> DataFrame:
    return postings.filter(F.col("trigram") == trigram)


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))


def rarest_trigram(postings: DataFrame, needle: str) -> DataFrame:
    """One row (trigram, df): the needle's rarest trigram, ties by key; df 0 where one is absent."""
    keys = needle_trigrams(fold_needle(needle))
    return _rarest(postings.sparkSession, document_frequencies(postings.filter(F.col("trigram").isin(keys or [None]))), keys)


def _rarest(spark: SparkSession, frequencies: DataFrame, keys: list[str]) -> DataFrame:
    wanted = spark.createDataFrame([(k,) for k in keys], "trigram string")
    both = wanted.join(frequencies, "trigram", "left").select("trigram", F.coalesce("df", F.lit(0)).cast("bigint").alias("df"))
    return both.agg(F.min(F.struct("df", "trigram")).alias("m")).select("m.trigram", "m.df")


def candidates(postings: DataFrame, needle: str) -> DataFrame:
    """(db, path) that have all trigrams of the needle."""
    keys = needle_trigrams(fold_needle(needle))
    hits = postings.filter(F.col("trigram").isin(keys or [None])).groupBy("db", "path").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(keys)).select("db", "path")


def index_search(files: DataFrame, postings: DataFrame, needle: str, sensitive: bool = False) -> DataFrame:
    """(db, path) whose content holds the needle, through the postings; shorter than three bytes, by a scan."""
    rows = files.filter(_holds(needle, sensitive)) if needle else files.filter(F.lit(False))
    if len(fold_needle(needle).encode()) >= 3:
        rows = rows.join(candidates(postings, needle), ["db", "path"], "left_semi")
    return rows.select("db", "path")


def _holds(needle: str, sensitive: bool):
    return F.col("content").contains(needle) if sensitive else ascii_fold(F.col("content")).contains(fold_needle(needle))


def distinct_trigrams_of(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(distinct_trigrams(x or b"")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], ["path", "n_trigrams"])

    return files.select("path", F.encode("content", "UTF-8").alias("data")).mapInArrow(run, "path string, n_trigrams int")


class ContentIndex:
    """A files table with a trigram index of its contents, written under one path.

    ``docs`` are the files with a number each; ``postings`` rows (trigram, docs), sorted by trigram, in which a
    trigram has a row for each batch of files that holds it; ``frequencies`` the number of files of each trigram. A
    lookup reads the row groups of its trigrams alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.docs = spark.read.parquet(f"{self.path}/docs")
        self.postings = spark.read.schema("trigram int, docs array<bigint>").parquet(f"{self.path}/postings")
        self.grams = spark.read.schema("trigram int, df bigint").parquet(f"{self.path}/frequencies")

    @classmethod
    def build(cls, files: DataFrame, path: str) -> ContentIndex:
        """Write files and their index. Postings are dealt by ranges of (trigram, first file), so a trigram that most
        files hold spreads over several partitions."""
        spark, path = files.sparkSession, path.rstrip("/")
        files.withColumn("doc", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs").filter(F.col("content").isNotNull())
        found = docs.select("doc", F.encode("content", "UTF-8").alias("data")).mapInArrow(cls._collect, "trigram int, docs array<bigint>")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = found.withColumn("first", F.col("docs")[0]).repartitionByRange(n, "trigram", "first").sortWithinPartitions("trigram", "first")
        dealt.select("trigram", "docs").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        counted = spark.read.parquet(f"{path}/postings").groupBy("trigram").agg(F.sum(F.size("docs")).cast("bigint").alias("df"))
        counted.repartitionByRange(max(1, n // 8), "trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{path}/frequencies")
        return cls(spark, path)

    @staticmethod
    def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, row = _grams(batch.column(1))
            order = np.argsort(grams, kind="stable")
            names, counts = np.unique(grams, return_counts=True)
            docs = batch.column(0).to_numpy()[row[order]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), lists], ["trigram", "docs"])

    def frequencies(self) -> DataFrame:
        return self.grams.select(trigram_key(F.col("trigram")).alias("trigram"), "df")

    def _rows(self, keys: list[str]) -> DataFrame:
        """The posting rows of some trigrams, given by key."""
        return self.postings.filter(F.col("trigram").isin([int(k, 16) for k in keys] or [None]))

    def lookup(self, trigram: str) -> DataFrame:
        """(db, path) of the files that hold the trigram."""
        return self._named(self._rows([trigram]).select(F.explode("docs").alias("doc")))

    def rarest_trigram(self, needle: str) -> DataFrame:
        keys = needle_trigrams(fold_needle(needle))
        known = self.grams.filter(F.col("trigram").isin([int(k, 16) for k in keys] or [None]))
        return _rarest(self.spark, known.select(trigram_key(F.col("trigram")).alias("trigram"), "df"), keys)

    def _having(self, keys: list[str]) -> DataFrame:
        """doc of the files that hold all of the trigrams."""
        hits = self._rows(keys).select(F.explode("docs").alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        return hits.filter(F.col("n") == len(keys)).select("doc")

    def _named(self, docs: DataFrame) -> DataFrame:
        return self.docs.select("doc", "db", "path").join(docs, "doc", "left_semi").select("db", "path")

    def candidates(self, needle: str) -> DataFrame:
        """(db, path) of the files that hold all trigrams of the needle."""
        return self._named(self._having(needle_trigrams(fold_needle(needle))))

    def holding(self, needle: str, sensitive: bool = False) -> DataFrame:
        """The files, with all their columns, whose content holds the needle; shorter than three bytes, by a scan.

        The trigrams select, and what they select is verified.
        """
        if not needle:
            return self.docs.filter(F.lit(False)).drop("doc")
        keys, rows = needle_trigrams(fold_needle(needle)), self.docs
        if len(keys) > LOOKED_UP:
            known = {r["trigram"]: r["df"] for r in self.grams.filter(F.col("trigram").isin([int(k, 16) for k in keys])).collect()}  # a row for each trigram of the needle
            if len(known) < len(keys):
                return self.docs.filter(F.lit(False)).drop("doc")
            keys = sorted(keys, key=lambda k: (known[int(k, 16)], k))[:LOOKED_UP]
        if keys:
            selected = self._having(keys)
            few = [r["doc"] for r in selected.limit(LISTED + 1).collect()]
            # a list keeps the contents where they are read; a join with unknown sizes would shuffle them first
            rows = rows.filter(F.col("doc").isin(few or [None])) if len(few) <= LISTED else rows.join(selected, "doc", "left_semi")
        return rows.filter(_holds(needle, sensitive)).drop("doc")

    def search(self, needle: str, sensitive: bool = False) -> DataFrame:
        """(db, path) whose content holds the needle."""
        return self.holding(needle, sensitive).select("db", "path")
