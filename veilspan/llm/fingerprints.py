"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the ascending array of the k smallest distinct shingle hashes (63 bits, so
signed and unsigned order agree). Equal texts have equal sketches; the sketch of several parts is the
k smallest of their sketches' union, so parts can be sketched apart and merged. Sketches
estimate resemblance, containment and the number of distinct shingles.

A null or empty text has the empty sketch. Two empty sketches are alike (1.0), an empty
and another are not (0.0). With fewer than five words the whole sequence is the shingle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.near_dedup import WORDS, shingle_sets
from veilspan.llm.tables import bucket_of, order_cuts, partitions, table
from veilspan.llm.words import raw, slices

K = 256
NULL_ID = -(1 << 63)
_U = np.uint64
_FULL = float(1 << 63)


def sketches_of(data: np.ndarray, bounds: np.ndarray, k: int = K, n: int = WORDS) -> list[np.ndarray]:
    flat, edge = shingle_sets(data, bounds, n)
    values = flat >> _U(1)
    at = edge.tolist()
    return [_distinct(values[a : min(b, a + 2 * k)], k) for a, b in zip(at[:-1], at[1:])]


def _distinct(ordered: np.ndarray, k: int) -> np.ndarray:
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]][:k] if len(ordered) else ordered


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of common hashes among the k smallest of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    fresh = np.r_[True, ~twice]
    n = min(k, int(fresh.sum()))
    last = both[np.flatnonzero(fresh)[n - 1]]
    return float((both[1:][twice] <= last).sum()) / n


def sketches(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """One row per input row: id_column and sketch array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, text_column):
                found = sketches_of(data, bounds, k)
                edge = np.cumsum([0, *map(len, found)])
                flat = np.concatenate([np.zeros(0, _U), *found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat))], [id_column, "sketch"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {dict(df.dtypes)[id_column]}, sketch array<long>")


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, group: str, sketch: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """The sketch of each group's union. Each step keeps k hashes of a group or of a salted part of it."""
    hashes = df.select(group, F.explode(sketch).alias("_hash")).distinct().withColumn("_salt", F.pmod("_hash", F.lit(salts)))
    for keys in ([group, "_salt"], [group]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
        hashes = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return hashes.groupBy(group).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(shared, F.size(union)), F.lit(0.0)))


def distinct_count(sketch: Column, k: int = K) -> Column:
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / (F.element_at(sketch, -1) / F.lit(_FULL)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1.0 for an empty a."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def with_neighbours(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """All rows in order of id within ranges, each range led by the row before it (kind 0).

    Before the first row of all comes the last. Rows that share an id are ordered by text;
    null ids come first.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(text_column).alias("text"))
    n = partitions(spark)
    cuts = order_cuts(rows, "key", n)
    dealt = rows.withColumn("bucket", bucket_of(F.col("key"), cuts)).withColumn("kind", F.lit(1))
    tops = sorted(tuple(x) for x in dealt.groupBy("bucket").agg(F.max("key")).collect())  # a row for each range
    leads = [(key, after) for (_, key), (after, _) in zip([tops[-1], *tops[:-1]], tops, strict=True)] if tops else []
    if leads:
        few = F.broadcast(spark.createDataFrame(leads, "key long, bucket int"))  # a row for each range, so at most as many as partitions
        lead = rows.join(few, "key").withColumn("kind", F.lit(0))
        dealt = dealt.unionByName(lead.select("key", "text", "bucket", "kind"))
    return dealt.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("kind", "key", "text").select("kind", "key", "text")


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_before, sketch_before = "", np.zeros(0, _U)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                kinds = rows.column(0).to_pylist()
                texts = [x or "" for x in rows.column(2).to_pylist()]
                found = sketches_of(data, bounds, k)
                near, before = [text_before, *texts[:-1]], [sketch_before, *found[:-1]]
                text_before, sketch_before = texts[-1], found[-1]
                edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, near, strict=True)]
                changed = sketches_of(*raw(pa.array(edited, pa.large_string())), k)
                keep = [i for i, kind in enumerate(kinds) if kind]
                if not keep:
                    continue
                keys = rows.column(1).take(pa.array(keep)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, mask=keys == NULL_ID),
                        pa.array([len(texts[i]) for i in keep], pa.int64()),
                        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                        pa.array([_printed(found[i]) for i in keep], pa.string()),
                        pa.array([_printed(changed[i]) for i in keep], pa.string()),
                        pa.array([likeness(found[i], changed[i], k) for i in keep], pa.float64()),
                        pa.array([likeness(found[i], before[i], k) for i in keep], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(df, id_column, text_column).mapInArrow(run, shape)


def _printed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE: dict[str, str] = {}
