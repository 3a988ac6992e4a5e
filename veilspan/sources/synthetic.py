"""Synthetic documents with exact annotations, for scoring without anyone's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import surrogates

#: What is planted: type, words before it, original whose form the planted value takes.
PLANTED = (
    ("IN_AADHAAR", "Aadhaar ", "1 2"),
    ("IN_PAN", "PAN ", "x"),
    ("EMAIL_ADDRESS", "write to ", "x"),
    ("PHONE_NUMBER", "call ", "+"),
    ("CREDIT_CARD", "card ", "x"),
    ("IP_ADDRESS", "from ", "x"),
    ("CORPORATE_ID", "CIN ", "x"),
    ("DATE_OF_BIRTH", "date of birth ", "1/2"),
)
DECOYS = "Order No. 481920, invoice 77/2021, section 12.4.1 of the offer, the Board of 2019."


def planted(seed: Column, entity_type: str, form: str) -> Column:
    return surrogates.GENERATORS[entity_type](surrogates.Draws(surrogates.digest(F.lit(entity_type), seed)), F.lit(form))


def documents(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """doc_id, text, annotations (array of entity_type, start, end, text): all planted values, first mentions only."""
    key = F.concat_ws("/", F.lit(seed), "doc_id")
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    rows = rows.select("doc_id", *[planted(key, kind, form).alias(kind) for kind, _, form in PLANTED])
    text, marks = F.lit(f"{DECOYS} "), []
    for kind, words, _ in PLANTED:
        start = F.length(text) + len(words)
        marks.append(F.struct(F.lit(kind).alias("entity_type"), start.cast("int").alias("start"), (start + F.length(kind)).cast("int").alias("end"), F.col(kind).alias("text")))
        text = F.concat(text, F.lit(words), F.col(kind), F.lit("; "))
    return rows.select("doc_id", text.alias("text"), F.array(*marks).alias("annotations"))


def annotations(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("annotations").alias("a")).select("doc_id", "a.*")
