"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded hash and ranked there; row r of n gets
the fractional rank (r - 1/2) / n. In the order of fractional ranks every stretch holds the
sources in their overall proportion, so equal cuts of that order give shards that match the
mixture and whose row counts are at most one apart (law `rows`).

Both ranks are computed in slices: a source's rows by the first bits of their hash,
all rows by their fractional rank. A slice's offset comes from counts, so no source,
however large, is ranked in one task. Only ids, sizes and checksums are shuffled.

Nulls: a null text has size 8 and checksum 0; null sources are one source; rows with a
null id or repeated rows are rows like others. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.tables import staged, table

SHARDS = 24
SEED = 20240229
SLICE_ROWS = 1 << 18  # in a slice of one source or of all fractional ranks, on average
MIN_SLICES = 1024  # fewer would leave cores idle


def _unit(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def slice_count(rows: int) -> int:
    """How many slices so many rows are ranked in."""
    return max(MIN_SLICES, -(-rows // SLICE_ROWS))


def ranked(df: DataFrame, within: list[str], order: list[str], slice_column: str) -> DataFrame:
    """Adds rank (from 1) and group_rows: place by order among the rows of the same `within`.

    slice_column is an int that rises with order. A group is ranked slice by slice.
    """
    counts = df.groupBy(*within, slice_column).agg(F.count("*").alias("slice_rows"))
    every = Window.partitionBy(*(within or [F.lit(0)]))
    before = every.orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*within, slice_column, F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("slice_start"), F.sum("slice_rows").over(every).alias("group_rows"))
    keys = [*within, slice_column]
    named = starts.select(*(F.col(k).alias(f"_{k}") for k in keys), "slice_start", "group_rows")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).join(named, same).withColumn("rank", F.col("_place") + F.col("slice_start")).drop("_place", "slice_start", *(f"_{k}" for k in keys))


def stratified_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, source, law, shard, slot, grown_shard (null)."""
    slices = slice_count(df.count())
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("unit", _unit(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    rows = rows.withColumn("part", F.floor(F.col("unit") * slices).cast("int"))
    in_source = ranked(rows, ["source"], ["unit", "doc_id", "text_crc32", "size"], "part")
    fraction = (2 * F.col("rank") - 1) / (2 * F.col("group_rows"))
    mixed = in_source.withColumn("fraction", fraction).withColumn("stretch", F.floor(F.col("fraction") * slices).cast("int"))
    mixed = staged(mixed.select("doc_id", "source", "size", "text_crc32", "unit", "fraction", "stretch"), "mixed")
    placed = ranked(mixed, [], ["fraction", "source", "unit", "doc_id", "text_crc32", "size"], "stretch")
    at = F.col("rank") - 1
    placed = placed.withColumn("shard", F.expr(f"cast((rank * {n_shards} - 1) div group_rows as int)"))
    first = F.expr(f"(shard * group_rows) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"), "shard", (at - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLE: dict[str, str] = {}
