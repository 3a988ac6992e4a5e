"""Annotation files (JSON) and the sinks for mappings, annotations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """document string, note string, region struct<start:int,end:int>,
            annotations array<struct<type:string,start:int,end:int,length:int,text:string>>"""
VALUES = "known_pii map<string,array<string>>, variants map<string,array<string>>"


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotations (doc_id, entity_type, start, end, text) and regions (doc_id, start, end)."""
    files = spark.read.schema(SCHEMA).json(path, multiLine=True)
    marks = files.select(F.col("document").alias("doc_id"), F.explode("annotations").alias("a"))
    return (
        marks.select("doc_id", F.col("a.type").alias("entity_type"), "a.start", "a.end", F.coalesce("a.text", F.lit("")).alias("text")),
        files.select(F.col("document").alias("doc_id"), "region.start", "region.end"),
    )


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """entity_type, value of known values and their variants."""
    files = spark.read.schema(VALUES).json(path, multiLine=True)
    parts = [files.select(F.explode(c).alias("entity_type", "values")) for c in ("known_pii", "variants")]
    return parts[0].unionByName(parts[1]).select("entity_type", F.explode("values").alias("value")).distinct()


def write_annotations(df: DataFrame, path: str) -> None:
    """Offsets only: texts are what the file must not hold."""
    cells = F.sort_array(F.collect_list(F.struct("start", "end", F.col("entity_type").alias("type"), (F.col("end") - F.col("start")).alias("length"))))
    df.groupBy(F.col("doc_id").alias("document")).agg(cells.alias("annotations")).write.mode("overwrite").json(path)


def write_mapping(mapped: DataFrame, path: str) -> None:
    """The mapping leads back to the originals; write it only where that is wanted."""
    mapped.orderBy("key").write.mode("overwrite").json(path)


def markdown(title: str, tables: dict[str, DataFrame], limit: int = 25) -> str:
    """A report of small result tables, each with at most `limit` rows."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("|", "\\|") for x in row) + " |" for row in df.limit(limit).collect()]
        out.append("")
    return "\n".join(out)
