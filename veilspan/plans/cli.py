"""spark-submit entry: redact packages in a folder, with optional mapping and scored report."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.functions import text as shape
from veilspan.operators import evaluate, recognizers
from veilspan.plans.redaction import Config, Outcome, RedactionJob
from veilspan.sources import annotations, images, ooxml
from veilspan.sources.staging import staged

SHOWN = 25  # unreadable packages that are named


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspan", description="Replace personal data in .docx packages.")
    p.add_argument("source", help="a .docx or a folder of them")
    p.add_argument("destination", nargs="?", help="folder for the rewritten packages")
    p.add_argument("--names", action="store_true", help="also use the rule candidates for names")
    p.add_argument("--no-images", action="store_true", help="leave images as they are")
    p.add_argument("--no-logos", action="store_true", help="leave small graphics as they are")
    p.add_argument("--mapping", help="folder for the mapping (leads back to the originals)")
    p.add_argument("--ground-truth", help="annotations to score against")
    p.add_argument("--report", help="file for a Markdown report")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, tools: images.ImageTools | None = None) -> int:
    """tools: what reads and detects in images; without it small graphics are blanked and nothing is read."""
    args = parser().parse_args(argv)
    local = "://" not in args.source
    if local and not Path(args.source).exists():
        print(f"error: no such file: {args.source}", file=sys.stderr)
        return 2
    if local and Path(args.source).is_file() and Path(args.source).suffix.lower() != ".docx":
        print("error: input must be a .docx", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("veilspan").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    began = time.monotonic()
    packages = ooxml.packages(spark, args.source)
    blocks = staged(ooxml.blocks(packages), "blocks")
    texts = ooxml.joined_text(blocks)
    rows = blocks.where("kind = 'row'").select("doc_id", F.col("block_no").alias("row_no"), "cells")
    config = Config(recognizers=(*recognizers.DEFAULT, *recognizers.NAME_RULES)) if args.names else Config()
    outcome = RedactionJob(config).run(texts, rows)
    media = None
    if not args.no_images:
        pictures = blocks.where("kind = 'media'").select("doc_id", "part", "payload")
        media = staged(images.redacted_media(pictures, tools or images.ImageTools(), not args.no_logos, config.recognizers), "media")
    rewritten = staged(ooxml.rewrite_packages(packages, outcome.mapping, media), "packages")
    destination = args.destination or f"{args.source.rstrip('/').removesuffix('.docx')}-redacted"
    written = ooxml.save(rewritten.where(~F.coalesce(F.map_contains_key("hits", F.lit(ooxml.UNREADABLE)), F.lit(False))), destination)
    print(f"wrote {written.count()} packages to {destination}")
    broken = [r.doc_id for r in rewritten.where(F.map_contains_key("hits", F.lit(ooxml.UNREADABLE))).select("doc_id").limit(SHOWN + 1).collect()]
    for name in broken[:SHOWN]:
        print(f"warning: not written, can't be read: {name}", file=sys.stderr)
    if len(broken) > SHOWN:
        print("warning: and others", file=sys.stderr)
    if args.mapping:
        annotations.write_mapping(outcome.mapping, args.mapping)
    if args.report:
        tables = run_tables(outcome, rewritten, media)
        if args.ground_truth:
            tables |= score_tables(spark, args.ground_truth, outcome, texts)
        Path(args.report).write_text(annotations.markdown(f"Redaction report ({time.monotonic() - began:.1f} s)", tables), encoding="utf-8")
    return 0


def run_tables(outcome: Outcome, rewritten: DataFrame, media: DataFrame | None) -> dict[str, DataFrame]:
    """What the run did: totals, then counts by container, type, image and reason."""
    hits = rewritten.select(F.explode("hits").alias("container", "n"))
    totals = outcome.detections.agg(F.count("*").alias("redacted")).join(outcome.suppressed.agg(F.count("*").alias("suppressed")))
    totals = totals.join(outcome.mapping.agg(F.count("*").alias("mapped"))).join(hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("replacements")))  # a row each
    out = {
        "Totals": totals,
        "Replacements by container": hits.groupBy("container").agg(F.sum("n").alias("replacements")).orderBy(F.desc("replacements"), "container"),
        "Detections by type": outcome.detections.groupBy("entity_type").count().orderBy(F.desc("count"), "entity_type"),
        "Suppressed": evaluate.by_reason(outcome.suppressed),
    }
    if media is not None:
        out["Images"] = media.select("part", "regions").orderBy(F.desc("regions"), "part")
    return out


def score_tables(spark: SparkSession, path: str, outcome: Outcome, texts: DataFrame) -> dict[str, DataFrame]:
    """Scores against annotations within their regions, what was missed and what was too much.

    Annotations name a document by its file name; packages are known by their path.
    """
    marks, regions = annotations.read_annotations(spark, path)
    bounds = regions.select("doc_id", F.col("start").alias("_low"), F.col("end").alias("_high")).dropDuplicates(["doc_id"])

    def inside(df: DataFrame) -> DataFrame:
        """Spans of annotated documents, within the region where there is one."""
        known = df.join(bounds, "doc_id")
        return known.where((F.col("start") >= F.coalesce("_low", F.lit(0))) & (F.col("end") <= F.coalesce("_high", F.col("end")))).drop("_low", "_high")

    named = lambda df: df.withColumn("doc_id", ooxml.file_name(F.col("doc_id")))
    found, marks = inside(named(outcome.detections)), inside(marks)
    body = named(texts).select("doc_id", F.col("text").alias("_body"))
    texts_of = marks.join(body, "doc_id", "left").select(*marks.columns[:-1], F.when(F.col("text") != "", F.col("text")).otherwise(spans.between(F.col("_body"), F.col("start"), F.col("end"))).alias("text"))
    out = {}
    for name in evaluate.CRITERIA:
        scored = evaluate.per_type(evaluate.matched(found, marks, name))
        out |= {f"Score, {name}": evaluate.rates(scored), f"Micro, {name}": evaluate.micro(scored), f"Macro, {name}": evaluate.macro(scored)}
    relaxed = staged(evaluate.matched(found, marks, "relaxed").where("not matched"), "unmatched")
    missed = relaxed.where("side = 'annotation'").select("entity_type", "doc_id", F.concat_ws("–", "start", "end").alias("where"))
    key = ["doc_id", "entity_type", "start", "end"]
    extra = relaxed.where("side = 'detection'").select(*key).join(found.select(*key, "text"), key)
    known = texts_of.groupBy("doc_id").agg(F.collect_set(F.lower("text")).alias("_known"))
    judged = extra.join(known, "doc_id", "left").select("entity_type", "doc_id", "start", F.col("text"), evaluate.error_class(F.col("text"), F.coalesce("_known", F.array().cast("array<string>"))).alias("kind"))
    judged = staged(judged, "extra")
    first = F.min_by("text", F.struct("doc_id", "start"))
    out["Missed"] = missed.orderBy("doc_id", "where")
    out["Too much, by kind"] = judged.groupBy("kind").agg(F.count("*").alias("spans"), shape.mask(first).alias("example")).orderBy(F.desc("spans"), "kind")
    out["Too much"] = judged.select("entity_type", "doc_id", shape.mask(F.col("text")).alias("text")).orderBy("doc_id", "text")
    return out


if __name__ == "__main__":
    raise SystemExit(main())
