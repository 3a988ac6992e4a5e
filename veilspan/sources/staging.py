"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application, where the cluster names no folder


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on one machine. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="veilspan-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/veilspan-core-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application staged. DataFrames that read it are lost, so it is the last step of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write and read again: what follows neither repeats the work nor depends on its lineage."""
    path = f"{_own_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, column: str) -> DataFrame:
    """staged, as a table bucketed by a column: later joins and groups by that column move nothing of it."""
    spark = df.sparkSession
    name, n = f"veilspan_{tag}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, column).write.format("parquet").option("path", f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}")
    writer.bucketBy(n, column).saveAsTable(name)
    return spark.table(name)
