"""Pipeline from raw documents to packed training batches.

Each stage gets what its predecessor kept as a table with the columns of `documents`
(doc_id, text, lang, source, n_chars; others are dropped) and returns the same columns, the last
the rows of the packing operator. Null texts, null ids, repeated rows and empty tables go
through as the operators define them; near-dedup takes each row for a document, whatever its id. run() writes every stage as Parquet to the shared
folder and reads it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import language_id, near_dedup, packing, quality, substring_dedup
from veilspan.llm.tables import partitions, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILARITY_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality classifier keeps."""
    found = quality.scored(docs, quality.fit(docs), COLUMNS)
    return found.where("keep").select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known and beyond doubt; the rest (`und` or ambiguous) go."""
    found = language_id.identify(docs, language_id.fit(docs), COLUMNS)
    return found.where("lang_pred != 'und' and not ambiguous").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, a row without an id only if no other has one.

    Rows count, not ids: each gets a key of its own, so repeated ids, and null ones, are told apart. Keys follow
    the order of ids, null last, which the operator's smallest member needs; the staged table fixes them.
    """
    order = F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()
    dealt = docs.select(*COLUMNS).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    keyed = staged(dealt.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    kept = near_dedup.near_duplicates(keyed, SIMILARITY_PERCENT, id_column="_row").where("kept").select(F.col("doc_id").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words and more that also start earlier."""
    found = substring_dedup.remove_repeats(docs, keep_columns=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in optimal length buckets."""
    return packing.packed(docs, packing.word_count(F.col("text")))


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_identified),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("packing", pack),
]

#: Expectation-maximisation and trained scorers have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
