"""Packing: optimal length buckets and token-budget batches.

Dynamic programming over the histogram of all lengths chooses the bucket boundaries
with the least padding, exactly: every length is a bin of its own. Texts of S tokens in all have at most
sqrt(2 S) different lengths, six million or some 100 MB for 100 TB, and the costs satisfy the quadrangle
inequality, so each step of the programme looks at about n log n of the n * n cuts. Within a bucket rows are shuffled by a seeded hash and cut into batches of
budget // boundary rows (one at least: a longer document is a batch of its own, whole).

The main path is DataFrame operations. Nulls: a null text or length counts as 0; rows with
null ids and repeated rows are packed like others; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.sharding import ranked, slice_count
from veilspan.llm.tables import staged, table

BUCKETS = 8
BUDGET = 16_384
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def _one_more(best: np.ndarray, tops: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of each prefix of the bins with one more bucket, and where that bucket starts.

    The first best start never moves back as the prefix grows, so the prefixes are settled
    middle first, each within the starts of those around it; all of one depth at once.
    """
    n = len(tops)
    now, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    low, high, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(low):
        mid = (low + high) // 2
        last = np.minimum(most, mid - 1)
        size = last - least + 1
        first = np.cumsum(size) - size
        start = np.repeat(least - first, size) + np.arange(size.sum())
        cost = best[start] + t[start] - np.repeat(tops[mid - 1], size) * r[start]
        lowest = np.minimum.reduceat(cost, first)
        at = np.flatnonzero(cost == np.repeat(lowest, size))
        chosen = start[at[np.searchsorted(at, first)]]
        now[mid], cut[mid] = lowest + tops[mid - 1] * r[mid] - t[mid], chosen
        low, high, least, most = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (least, chosen), (chosen, most)))
        some = low <= high
        low, high, least, most = low[some], high[some], least[some], most[some]
    return now, cut


def optimal_boundaries(tops: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most `buckets` buckets with the least total padding.

    tops: ascending bin tops; rows, tokens: rows and tokens in each bin. Whole numbers throughout.
    """
    n = len(tops)
    if not n:
        return []
    tops = tops.astype(np.int64)
    r, t = (np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (rows, tokens))
    best = np.concatenate([[0], tops * r[1:] - t[1:]])
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        best, cut = _one_more(best, tops, r, t)
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(tops[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    return out[::-1]


def packed(df: DataFrame, length: Column, id_column: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket, bucket_length, batch, slot.

    Batches are numbered over all buckets, shortest first; slots from 0 within a batch.
    """
    rows = df.select(F.col(id_column).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    rows = staged(rows.withColumn("top", F.greatest("n_tokens", F.lit(1))), "lengths")
    bins = rows.groupBy("top").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")).orderBy("top").toPandas()  # a row for each length
    tops = bins["top"].to_numpy(np.int64)
    bounds = optimal_boundaries(tops, bins["rows"].to_numpy(np.int64), bins["tokens"].to_numpy(np.int64), buckets)
    bucket, bound, fill, first = F.lit(len(bounds) - 1), F.lit(0), F.lit(1), F.lit(0)
    start, plan, slices = 0, [], slice_count(int(bins["rows"].sum()))
    for i, b in enumerate(bounds):
        n = int(bins["rows"].to_numpy()[(tops <= b) & (tops > (bounds[i - 1] if i else 0))].sum())
        each = max(1, budget // b)
        plan.append((i, b, each, start))
        start += -(-n // each)
    for i, b, each, at in reversed(plan):
        here = F.col("top") <= b
        bucket, bound, fill, first = (F.when(here, F.lit(x)).otherwise(y) for x, y in ((i, bucket), (b, bound), (each, fill), (at, first)))
    rows = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), bound.cast("long").alias("bucket_length"), fill.alias("each"), first.cast("long").alias("first"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "n_tokens"), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("unit", unit).withColumn("part", F.floor(F.col("unit") * slices).cast("int"))
    out = ranked(rows, ["bucket"], ["unit", "doc_id", "n_tokens"], "part")
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", F.expr("first + (rank - 1) div each").alias("batch"), F.expr("cast((rank - 1) % each as int)").alias("slot"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), word_count(F.col("text")))


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
