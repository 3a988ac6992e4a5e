"""Dictionary rewriting: every mention of a mapped key is replaced, detected or not.

A mapping of its own document meets its text directly. A mapping over the whole corpus
meets a gate first: the tokens of every text are joined with one token of each key, so a
text meets only keys that can occur in it. Then one alternation of those keys, longest
first, finds the mentions: any white space between words, no letter or digit at either
end, any case. A mention inside an e-mail address is left to the address.

A token is a run of ASCII letters and digits, or one other character that isn't white
space, so keys in any script are gated too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.functions import text as shape

TOKEN = r"[a-z0-9]+|[^a-z0-9\s]"


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0))


def pattern(keys: Column, exact: bool = False) -> Column:
    """The alternation of an array of keys. exact: with their own white space, and no mention beside an underscore."""
    word = "[A-Za-z0-9_]" if exact else "[A-Za-z0-9]"
    longest = F.array_sort(keys, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))

    def one(k: Column) -> Column:
        quoted = F.regexp_replace(k, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")
        left = F.when(k.rlike(f"^{word}"), f"(?<!{word})").otherwise("")
        right = F.when(k.rlike(f"{word}$"), f"(?!{word})").otherwise("")
        return F.concat(left, F.lit("(?:"), quoted if exact else F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(")"), right)

    return F.concat(F.lit("(?iu)"), F.array_join(F.transform(longest, one), "|"))


def replaced(value: Column, keys: Column, to: Column) -> Column:
    """struct<text,hits>: value with its mentions of the keys (an array) put by the map `to`."""
    regex = pattern(keys)
    found = F.regexp_extract_all(value, regex, F.lit(0))
    gaps = F.call_function("split", value, regex, F.lit(-1))

    def step(state: Column, i: Column) -> Column:
        mention, gap, after = F.get(found, i), F.get(gaps, i), F.get(gaps, i + 1)
        inside = ~F.contains(mention, F.lit("@")) & (F.endswith(gap, F.lit("@")) | F.startswith(after, F.lit("@")))
        stand_in = F.when(inside, F.lit(None)).otherwise(F.try_element_at(to, shape.key(mention)))
        return F.struct(F.concat(state["text"], gap, F.coalesce(stand_in, mention)).alias("text"), (state["hits"] + F.when(stand_in.isNull(), 0).otherwise(1)).alias("hits"))

    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("hits"))
    done = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step)
    whole = F.struct(F.concat(done["text"], F.element_at(gaps, -1)).alias("text"), done["hits"].alias("hits"))
    return F.when(F.size(found) > 0, whole).otherwise(F.struct(value.alias("text"), F.lit(0).alias("hits")))


def gated(mapped: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, key, surrogate and gate: the longest token of each key, which is rarer than words such as `the`."""
    runs = tokens(F.col("key"))
    size = lambda x: F.when(x.rlike("[a-z0-9]"), F.length(x)).otherwise(F.lit(0))
    longest = F.array_max(F.transform(runs, lambda x: F.struct(size(x), x.alias("token"))))["token"]
    return mapped.select(*scope, "key", "surrogate", longest.alias("gate")).where("gate is not null")


def rewrite(texts: DataFrame, mapped: DataFrame, scope: tuple[str, ...] = ("doc_id",), row: tuple[str, ...] = ("doc_id",), text_column: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """row, carried, text, replacements: every text rewritten by the mapping of its scope.

    row names the columns that identify a text (scope among them, or none for one
    mapping over the whole corpus: scope=()).
    """
    keys = gated(mapped, scope)
    to = F.map_from_entries(F.collect_set(F.struct("key", "surrogate"))).alias("_to")
    if scope:
        some = keys.groupBy(*scope).agg(to)
    else:
        seen = texts.select(*row, F.explode(F.array_distinct(tokens(F.col(text_column)))).alias("gate"))
        some = seen.join(keys, "gate").groupBy(*row).agg(to)
    joined = texts.select(*row, *carried, F.col(text_column).alias("_text")).join(some, list(scope or row), "left")
    out = F.when(F.col("_to").isNotNull(), replaced(F.col("_text"), F.map_keys("_to"), F.col("_to"))).otherwise(F.struct(F.col("_text").alias("text"), F.lit(0).alias("hits")))
    return joined.withColumn("_out", out).select(*row, *carried, F.col("_out.text").alias("text"), F.col("_out.hits").alias("replacements"))


def spliced_text(value: Column, sorted_spans: Column) -> Column:
    """value with disjoint spans (start, end, surrogate), in order, put in by offset."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, d: F.struct(d["end"].alias("at"), F.concat(s["out"], spans.between(value, s["at"], d["start"]), d["surrogate"]).alias("out"))
    whole = lambda done: F.concat(done["out"], F.substring(value, done["at"] + 1, F.length(value)))
    return spans.let(F.aggregate(sorted_spans, zero, step), whole)


def spliced_rows(texts: DataFrame, found: Column, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """keys, text, replacements: the disjoint spans that an array column of each row itself holds, put in by offset."""
    rows = texts.select(*keys, F.col(text_column).alias("_text"), F.sort_array(found).alias("_spans"))
    new = F.when(F.size("_spans") > 0, spliced_text(F.col("_text"), F.col("_spans"))).otherwise(F.col("_text"))
    return rows.select(*keys, new.alias("text"), F.greatest(F.coalesce(F.size("_spans"), F.lit(0)), F.lit(0)).alias("replacements"))


def spliced(texts: DataFrame, spans_with_surrogates: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """keys, text, replacements: disjoint spans (keys, start, end, surrogate) put in by offset.

    keys must tell rows apart: rows that share them, or hold a null among them, raise no error but each get all
    the spans of those keys, or none.
    """
    lists = spans_with_surrogates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "surrogate"))).alias("_spans"))
    both = texts.select(*keys, F.col(text_column).alias("_text")).join(lists, list(keys), "left")
    new = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(spliced_text(F.col("_text"), F.col("_spans")))
    return both.select(*keys, new.alias("text"), F.coalesce(F.size("_spans"), F.lit(0)).alias("replacements"))
