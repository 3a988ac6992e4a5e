"""Checks of rewritten text: nothing known survives, what must stay is there, counts agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.functions import text as shape
from veilspan.operators import overlap
from veilspan.operators.recognizers import SWEEPS

PROBE_CHARACTERS = 6


def probes(values: DataFrame) -> DataFrame:
    """Distinct values long enough to be looked for (column value)."""
    return values.select("value").where(F.length("value") > PROBE_CHARACTERS).distinct()


def leaks(rewritten: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """keys, value, hits of known values (keys, value) that still stand in their text."""
    both = known.join(rewritten.select(*keys, F.col(text_column).alias("_text")), list(keys))
    hits = (F.length("_text") - F.length(F.replace(F.lower("_text"), F.lower("value"), F.lit("")))) / F.length("value")
    return both.where(F.length("value") > 0).select(*keys, "value", hits.cast("int").alias("hits")).where("hits > 0")


def missing(rewritten: DataFrame, kept: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """Phrases of `kept` that no text holds any more."""
    found = [F.coalesce(F.max(F.contains(F.col(text_column), F.lit(k))), F.lit(False)).alias(f"k{i}") for i, k in enumerate(kept)]
    row = rewritten.agg(*found)
    pairs = F.array(*[F.struct(F.lit(k).alias("phrase"), F.col(f"k{i}").alias("found")) for i, k in enumerate(kept)])
    return row.select(F.explode(pairs).alias("x")).where("not x.found").select("x.phrase")


def legible_secrets(texts: DataFrame, secrets: tuple[str, ...], keys: tuple[str, ...] = ("doc_id", "name")) -> DataFrame:
    """keys, value of secrets that can still be read in redacted images (texts: keys, text as recognised), in any case."""
    asked = F.array(*[F.lit(" ".join(x.lower().split())) for x in secrets]).cast("array<string>")
    found = F.filter(asked, lambda v: (v != "") & F.contains(shape.key(F.col("text")), v))
    return texts.select(*keys, F.explode(found).alias("value")).distinct()


def structure(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, part, kind, blocks, filled: what a rewrite must not change."""
    return blocks.groupBy(*keys, "part", "kind").agg(F.count("*").alias("blocks"), F.sum(F.when(F.trim("text") != "", 1).otherwise(0)).alias("filled"))


def same_structure(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks; none are expected."""
    return before.exceptAll(after).unionByName(after.exceptAll(before))


def foreign_hosts(rewritten: DataFrame, allowed: tuple[str, ...], keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """keys, host of web addresses outside the allowed hosts and their subdomains."""
    web = next(r for r in SWEEPS if r.entity_type == "WEB_ADDRESS")
    found = rewritten.select(*keys, F.explode(spans.scan(F.col(text_column), web.pattern)).alias("s")).select(*keys, overlap.registrable_host(F.col("s.text")).alias("host"))
    ok = F.lit(False)
    for a in allowed:
        ok |= (F.col("host") == a) | F.endswith("host", F.lit(f".{a}"))
    return found.where((F.col("host") != "") & ~ok).distinct()


def shared_surrogates(mapped: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """scope, surrogate of stand-ins whose keys are not all word-aligned parts of the longest one."""
    keys = mapped.groupBy(*scope, "surrogate").agg(F.collect_set("key").alias("all")).where(F.size("all") > 1)
    longest = F.array_max(F.transform("all", lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return keys.where(~F.forall("all", lambda k: F.contains(pad(longest), pad(k)))).select(*scope, "surrogate")


def idle(value: Column) -> Column:
    """Whether a text has nothing to judge."""
    return F.coalesce(shape.key(value), F.lit("")) == ""
