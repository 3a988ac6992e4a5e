"""Shared helpers: inputs, staged tables in the cluster's shared folder, ordered buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUT_SAMPLE = 60
_own: dict[str, str] = {}  # by application, where the cluster names no folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where it is unset, a temporary folder is made on one machine; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="veilspan-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/veilspan-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application staged. DataFrames that read it are lost, so it is the last step of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _held(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> AbstractContextManager[None]:
    """Bounds the bytes of one batch sent to Python while eager steps run: each is held outside the heap, several times over."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def short_scans(spark: SparkSession, rows: int = 256) -> AbstractContextManager[None]:
    """Bounds the rows that a scan decodes at once while eager steps run: 4,096 texts stand in arrays that double as they fill."""
    return _held(spark, "spark.sql.parquet.columnarReaderBatchSize", rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_cuts(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut a long column into about equal ranges.

    They come from a sample of some CUT_SAMPLE values for each range, and set sizes of ranges, never results.
    """
    rows = df.count() if n > 1 else 0
    if not rows:
        return []
    share = min(1.0, CUT_SAMPLE * n / rows)
    found = np.sort((df if share == 1.0 else df.sample(share, seed=1)).select(column).toPandas()[column].dropna().to_numpy(np.int64))
    return sorted(set(found[len(found) * np.arange(1, n) // n].tolist())) if len(found) else []


def bucket_of(column: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below a value, so buckets follow the order; only the key column goes to Python."""
    at = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, keys.to_numpy(np.int64, na_value=-(1 << 63)), side="right").astype(np.int32))

    return bucket(column)
