"""The corpus pipeline: documents through language ID, exact and near deduplication, mixing and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import exact_dedup, language_id, mixing, packing, simhash
from trawl.llm.common import LOWER, UPPER, materialise, quoted, row_key, table

#: A document whose likeliest language has a lower pooled probability is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; the network learns from the documents' own lang.

    Null and empty texts and texts without a letter are rejected, whatever their lang; a null lang is not learned from
    but its document is judged by its text like any other. Texts are read whole, however long. Equal texts get equal
    verdicts, so ties and repeated rows stay or go together. Where no language can be learned, every document goes. An
    empty table gives an empty result. Columns beyond those of documents stay, whatever their names.
    """
    return language_id.keep_identified(docs, language_id.train(docs), LEAST_LANGUAGE_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each distinct text: one with the largest doc_id, or one without where no equal text has any.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of rows that tie in text and id, any
    one stays; a null doc_id loses to any other. Rows that repeat an id with another text are not copies. Texts are
    compared whole, however long. An empty table gives an empty result. Columns beyond those of documents stay,
    whatever their names.
    """
    key = f"exact_key_{uuid.uuid4().hex}"  # docs may have columns of any name
    verdict = exact_dedup.exact_dedup(docs).filter("kept OR keep_id IS NULL")
    kept = verdict.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(key)).distinct()
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)  # A-Z alone, as in exact_dedup
    marked = docs.withColumn(key, row_key(F.col("doc_id").cast("bigint"), F.sha2(folded.cast("binary"), 256)))
    return marked.join(kept, key, "left_semi").dropDuplicates([key]).select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest doc_id, any where none has one.

    Null and empty texts have the fingerprint 0, linked like any other. Rows equal in id and text stay together; of
    rows that tie in id, the one of the smallest text digest stays. Texts are read whole, however long. An empty table
    gives an empty result. Columns beyond those of documents stay, whatever their names.
    """
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them (0, 1 or 2 rows each).

    Null is a source of its own. Null and empty texts have no words: they come as often as the rate of their source's
    smallest size says, and cost nothing. Which of equally long documents of a source come twice depends on the hash of
    doc_id alone; rows that repeat an id come equally often. Texts are counted whole, however long. An empty table gives
    an empty result. Columns beyond those of documents stay, whatever their names.
    """
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; checksums are those of the token ids in their places.

    Null and empty texts are one end id. Long texts are cut into pieces; every id of every row lies in exactly one.
    Repeated rows are packed each for itself; which of equally long pieces takes which place is open. A null doc_id
    stays null. An empty table gives an empty result. Other columns are not looked at.
    """
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix),
    ("packing", pack),
]
#: SQL expresses neither the network nor the tokenizer: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
