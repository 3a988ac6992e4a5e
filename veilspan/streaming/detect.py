"""Detection on streams: scans and decisions keep no state, so they run on readStream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators import policy, recognizers


def detected(stream: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Spans of a stream of texts that the stateless rules would redact."""
    found = recognizers.detect(stream, text_column, keys, wanted=wanted)
    return found.where(policy.decision(F.col("entity_type"), F.col("text")).isNull())


def counted(stream: DataFrame, time_column: str, text_column: str = "text", width: str = "10 minutes", late: str = "1 hour", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Spans by type in windows of event time, with a watermark for late rows."""
    found = detected(stream.withWatermark(time_column, late), (time_column,), text_column, wanted)
    return found.groupBy(F.window(time_column, width).alias("window"), "entity_type").agg(F.count("*").alias("spans"))
