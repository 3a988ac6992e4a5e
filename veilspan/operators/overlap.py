"""Interval operators: overlap resolution, address merging, canonical names, aliases, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import spans, text
from veilspan.operators.recognizers import STRUCTURED

GAP, LONGEST = 25, 180
LEAD_MARGIN = 60
# What makes a stretch of text an address, and what ends one.
POSTAL_CODE = r"(?<![A-Za-z0-9_])\d{3}\s?\d{3}(?![A-Za-z0-9_])"
ADDRESS_LEAD = r"(?i)(?:registered|corporate|branch|head)\s+office\s*[:\-]|address\s*[:\-]"
ADDRESS_STOP = r"(?i)(?<![A-Za-z0-9_])(?:telephone|tel|phone|fax|e-?mail|website|contact|cin|sebi|registration|investor|grievance)(?![A-Za-z0-9_])"
DETECTION = "struct<entity_type:string,start:int,end:int,score:double,text:string>"


def rank_class(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*STRUCTURED), 0).otherwise(1)


def islands(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds island: number of the maximal run of overlapping spans that a span belongs to."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def resolved(detections: Column) -> Column:
    """The spans of an array that a greedy choice keeps: structured types first, then the
    longest, the best scored, the earliest; a span that meets a kept one is dropped.
    """
    ranked = F.sort_array(
        F.transform(
            detections,
            lambda d: F.struct(
                rank_class(d["entity_type"]).alias("a"), (d["start"] - d["end"]).alias("b"), (-d["score"]).alias("c"),
                d["start"].alias("start"), d["entity_type"].alias("entity_type"), d["end"].alias("end"), d["score"].alias("score"), d["text"].alias("text"),
            ),
        )
    )
    kind = f"array<{DETECTION}>"

    def step(kept: Column, d: Column) -> Column:
        meets = F.exists(kept, lambda k: (d["start"] < k["end"]) & (d["end"] > k["start"]))
        one = F.struct(d["entity_type"], d["start"], d["end"], d["score"], d["text"]).cast(DETECTION)
        return F.when(meets, kept).otherwise(F.array_append(kept, one))

    return F.aggregate(ranked, F.array().cast(kind), step)


def resolve_overlaps(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Disjoint spans of each document. Islands are settled apart, so the greedy fold is short."""
    parts = islands(df, keys).groupBy(*keys, "island").agg(F.collect_list(F.struct("entity_type", "start", "end", "score", "text").cast(DETECTION)).alias("all"))
    return parts.select(*keys, F.explode(resolved(F.col("all"))).alias("d")).select(*keys, "d.*")


def merge_addresses(df: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Merges neighbouring unstructured spans of one postal address into a LOCATION.

    df: disjoint spans; texts: keys and text_column. A span joins the group before it if
    the gap has at most GAP characters without line break, sentence end or caption, the
    whole at most LONGEST, and the group reads as an address (postal code within, or a
    lead-in before).
    """
    order = Window.partitionBy(*keys).orderBy("start")
    marked = df.withColumn("_near", F.coalesce((F.col("start") - F.lag("end").over(order) <= GAP) & ~F.col("entity_type").isin(*STRUCTURED), F.lit(False)))
    marked = marked.withColumn("_near", F.max("_near").over(Window.partitionBy(*keys)) if "text" in df.columns else F.lit(True))
    apart = marked.where("not _near")  # in texts without neighbours nothing can merge, so they aren't read; spans without their text need it, though
    lists = marked.where("_near").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_type", "score"))).alias("spans"))
    joined = lists.join(texts.select(*keys, F.col(text_column).alias("_text")), list(keys))
    body = F.col("_text")
    group = "struct<start:int,end:int,entity_type:string,score:double,open:boolean>"

    def step(done: Column, d: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        gap = spans.between(body, last["end"], d["start"])
        reads = spans.between(body, last["start"], d["end"]).rlike(POSTAL_CODE) | spans.preceding(body, last["start"], LEAD_MARGIN).rlike(ADDRESS_LEAD)
        free = ~d["entity_type"].isin(*STRUCTURED)
        joins = F.coalesce(free & last["open"] & (d["start"] - last["end"] <= GAP) & (d["end"] - last["start"] <= LONGEST) & gap.rlike(r"^[^.;!?\n]{0,25}\z") & ~gap.rlike(ADDRESS_STOP) & reads, F.lit(False))
        grown = F.struct(last["start"], d["end"], F.lit("LOCATION"), F.greatest(last["score"], d["score"]), F.lit(True)).cast(group)
        alone = F.struct(d["start"], d["end"], d["entity_type"], d["score"], free).cast(group)
        return F.when(joins, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), grown)).otherwise(F.array_append(done, alone))

    merged = F.aggregate("spans", F.array().cast(f"array<{group}>"), step)
    rows = joined.select(*keys, "_text", F.explode(merged).alias("d")).select(*keys, "d.entity_type", "d.start", "d.end", "d.score", "_text")
    merged_rows = rows.withColumn("text", spans.between(F.col("_text"), F.col("start"), F.col("end"))).drop("_text")
    return merged_rows.unionByName(apart.select(merged_rows.columns)) if "text" in df.columns else merged_rows


def canonical_names(df: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every variant that a longer one of its scope and type contains word by word: the longest such.

    Columns: scope, entity_type, variant, canonical. Instead of comparing all variants,
    each offers all its word-aligned sub-phrases, and variants are looked up among them.
    """
    names = df.select(*scope, "entity_type", text.key(F.col("text")).alias("variant")).where("variant != ''").distinct()
    words = F.split("variant", " ")
    n = F.size("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("words", i, k), " "))))
    offered = names.withColumn("words", words).where(n > 1).select(*scope, "entity_type", F.col("variant").alias("canonical"), F.explode(F.array_distinct(runs)).alias("variant")).where("variant != canonical")
    found = names.join(offered, [*scope, "entity_type", "variant"])
    best = F.max_by("canonical", F.struct(F.length("canonical"), F.col("canonical")))
    return found.groupBy(*scope, "entity_type", "variant").agg(best.alias("canonical"))


HOST = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9.\-]*\.[a-z]{2,})"


def registrable_host(url: Column) -> Column:
    """The bare host of a web address, without scheme, www and path; empty if there is none."""
    return F.lower(F.rtrim(F.regexp_extract(F.regexp_replace(url, r"\s+", ""), HOST, 1), F.lit("./")))


def host_aliases(df: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """scope, variant, canonical: the bare and the www form of every web address."""
    hosts = df.where(F.col("entity_type").isin("WEB_ADDRESS", "URL")).select(*scope, text.key(F.col("text")).alias("canonical"), registrable_host(F.col("text")).alias("host")).where("host != ''")
    forms = hosts.select(*scope, "canonical", F.explode(F.array("host", F.concat(F.lit("www."), "host"))).alias("variant"))
    return forms.where("variant != canonical").groupBy(*scope, "variant").agg(F.min("canonical").alias("canonical"))


def boxes_overlap(a: Column, b: Column, share: float = 0.3) -> Column:
    """Whether two boxes (l, t, r, b) share more than `share` of the smaller one."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0))
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    smaller = F.least(area(a), area(b))
    return (smaller > 0) & (side("l", "r") * side("t", "b") > smaller * share)
