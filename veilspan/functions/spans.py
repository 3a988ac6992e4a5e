"""Regular-expression scans that yield offsets, as Catalyst expressions.

Offsets are half-open and count code points, as Spark's length and substring do. A scan
takes the matches and the gaps between them in two regular-expression passes and
adds up their lengths, so no Python runs and whole-stage code generation is kept.
Word boundaries are written with ASCII classes: a letter such as e-acute is no word character.
NULL text has no spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boundaries between ASCII word characters and all others.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: A boundary of either kind, for patterns that may end in punctuation.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

SPAN = "struct<start:int,end:int,text:string>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: a lambda that holds an expression computes it anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strings(values: tuple[str, ...]) -> Column:
    """An array of literals, made in one call."""
    return F.expr("array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")")


def bounded(pattern: str) -> str:
    return f"{LEFT}(?:{pattern}){RIGHT}"


def scan(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of all non-overlapping matches, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["match"].alias("text"))
        return F.struct(end.cast("int").alias("at"), F.array_append(state["spans"], span).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["spans"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def preceding(text: Column, start: Column, width: int) -> Column:
    """Up to width characters before an offset."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, start - first)


def window(text: Column, start: Column, end: Column, margin: int) -> Column:
    """The text from margin characters before a span to margin after it."""
    first = F.greatest(start - margin, F.lit(0))
    return F.substring(text, first + 1, end + margin - first)


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
