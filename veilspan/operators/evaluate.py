"""Scoring of detections against annotations, error classes and suppression counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import text as shape
from veilspan.functions.spans import EDGE
from veilspan.operators import policy
from veilspan.operators.overlap import islands

MUTUAL = 0.5
CRITERIA = {"strict": (False, False), "relaxed": (True, False), "coverage": (True, True)}  # containment counts, type is ignored
# Words of postal addresses, form of headings.
ADDRESS_WORDS = rf"(?i){EDGE}(?:tower|block|wing|floor|plot|survey|gat|road|marg|street|lane|complex|centre|center|park|nagar|colony|society|building|premises|industrial|estate|village|taluka|district|east|west|north|south|opp|near|behind|khurd|budruk|phase|sector|unit|no\.){EDGE}"
HEADING = r"^[A-Z][A-Z\s/&(),.\-‘’“”]{4,}$"


def in_region(df: DataFrame, region: tuple[int, int] | None) -> DataFrame:
    return df if region is None else df.where((F.col("start") >= region[0]) & (F.col("end") <= region[1]))


def matched(detections: DataFrame, annotations: DataFrame, criterion: str = "strict", region: tuple[int, int] | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, side (annotation or detection), entity_type, start, end, matched.

    In order of start, each annotation takes the detection with the largest overlap among those that
    overlap it by half of either, or contain it where containment counts; of equals the
    first. A detection is taken once, unless it contains the annotation and that counts. Empty spans match nothing.
    """
    contain, any_type = CRITERIA[criterion]
    sides = [in_region(df, region).select(*keys, "start", "end", "entity_type", F.lit(side).alias("side")) for df, side in ((annotations, "a"), (detections, "d"))]
    apart = islands(sides[0].unionByName(sides[1]), keys)  # spans of different islands share nothing, so each is matched alone
    spans_of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("start", "end", "entity_type")))).alias(side)
    both = apart.groupBy(*keys, "island").agg(spans_of("a"), spans_of("d"))
    span = "array<struct<start:int,end:int,entity_type:string>>"
    both = both.select(*keys, *(F.col(x).cast(span).alias(x) for x in "ad"))
    state = "struct<used:array<int>,hit:array<boolean>>"

    def step(s: Column, x: Column) -> Column:
        def fits(y: Column, i: Column) -> Column:
            shared = F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
            covers = F.lit(contain) & (y["start"] <= x["start"]) & (y["end"] >= x["end"])
            mutual = (shared >= MUTUAL * (x["end"] - x["start"])) & (shared >= MUTUAL * (y["end"] - y["start"]))
            kind = F.lit(True) if any_type else y["entity_type"] == x["entity_type"]
            free = ~F.array_contains(s["used"], i) | covers
            return F.when((shared > 0) & (mutual | covers) & kind & free, F.struct(shared.alias("shared"), (-i).alias("i")))

        best = F.array_max(F.filter(F.transform(F.col("d"), fits), lambda z: z.isNotNull()))
        used = F.when(best.isNull(), s["used"]).otherwise(F.array_append(s["used"], -best["i"]))
        return F.struct(used.alias("used"), F.array_append(s["hit"], best.isNotNull()).alias("hit")).cast(state)

    zero = F.struct(F.array().alias("used"), F.array().alias("hit")).cast(state)
    done = both.withColumn("s", F.aggregate("a", zero, step))
    left = done.select(*keys, F.lit("annotation").alias("side"), F.posexplode("a").alias("i", "x"), F.col("s.hit").alias("hit")).select(*keys, "side", "x.entity_type", "x.start", "x.end", F.get("hit", F.col("i")).alias("matched"))
    right = done.select(*keys, F.lit("detection").alias("side"), F.posexplode("d").alias("i", "x"), F.col("s.used").alias("used")).select(*keys, "side", "x.entity_type", "x.start", "x.end", F.array_contains("used", F.col("i")).alias("matched"))
    return left.unionByName(right)


def per_type(scored: DataFrame) -> DataFrame:
    """entity_type, tp, fp, fn: hits and misses count annotations, false alarms count detections."""
    is_a = F.col("side") == "annotation"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return scored.groupBy("entity_type").agg(count(is_a & F.col("matched"))("tp"), count(~is_a & ~F.col("matched"))("fp"), count(is_a & ~F.col("matched"))("fn"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1 and accuracy; 0 where there is nothing to divide by."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return counts.select("*", p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1"), _share(tp, tp + fp + fn).alias("accuracy"))


def micro(counts: DataFrame) -> DataFrame:
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    return rates(counts.agg(*total))


def macro(counts: DataFrame) -> DataFrame:
    return rates(counts).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def error_class(value: Column, annotated: Column, terms: Column | None = None) -> Column:
    """What kind of false alarm a span is; annotated: lower-cased texts marked in its document."""
    x = F.trim(value)
    low = F.lower(x)
    terms = F.array().cast("array<string>") if terms is None else terms
    return (
        F.when(F.exists(annotated, lambda m: F.contains(m, low) | F.contains(low, m)), "type mismatch")
        .when(policy.is_defined_term(x, terms), "document vocabulary")
        .when(policy.is_bare_place(F.lit("LOCATION"), x), "bare place name")
        .when(x.rlike(ADDRESS_WORDS), "address fragment")
        .when(x.rlike(HEADING), "heading fragment")
        .when(x.rlike(r"(?i)(?<![A-Za-z0-9_])(?:of|and|the)\s*$"), "truncated span")
        .otherwise("other")
    )


def by_reason(suppressed: DataFrame, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """reason, spans, example (masked, of the first span), most frequent first."""
    first = F.min_by(F.col("text"), F.struct(*order))
    return suppressed.groupBy("reason").agg(F.count("*").alias("spans"), shape.mask(first).alias("example")).orderBy(F.desc("spans"), "reason")


def described(value: Column, start: Column, end: Column) -> Column:
    """A value's mask, or its offsets where the value is not at hand."""
    return F.when(F.coalesce(value, F.lit("")) != "", shape.mask(value)).otherwise(F.concat_ws("–", start, end))


def located(values: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text", exact: bool = False) -> DataFrame:
    """keys, entity_type, start, end of every mention of known values (keys, entity_type, value), in any case.

    Any white space stands between the words of a mention, unless exact; then also an underscore is part of
    a word. Null keys are equal.
    """
    from veilspan.operators.rewrite import pattern

    form = F.lower("value") if exact else shape.key(F.col("value"))
    lists = values.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), "entity_type").agg(F.collect_set(form).alias("_values"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    both = lists.join(texts.select(*keys, F.col(text_column).alias("_text")), same)
    regex = pattern(F.col("_values"), exact)
    found = F.regexp_extract_all(F.col("_text"), regex, F.lit(0))
    gaps = F.call_function("split", F.col("_text"), regex, F.lit(-1))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda s, p: F.struct((s["at"] + p["g"] + p["m"]).alias("at"), F.array_append(s["out"], F.struct((s["at"] + p["g"]).alias("start"), (s["at"] + p["g"] + p["m"]).alias("end"))).alias("out"))
    placed = both.select(*keys, "entity_type", F.explode(F.aggregate(pairs, zero, step)["out"]).alias("d"))
    return placed.select(*keys, "entity_type", "d.start", "d.end").dropDuplicates([*keys, "start", "end"])
