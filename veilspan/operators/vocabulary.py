"""What a document teaches about its own words: glossaries, aliases, common nouns, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.functions import text as shape
from veilspan.functions.spans import EDGE, let
from veilspan.operators import policy

_EDGE = " \t\"'“”‘’.,;:"
# Patterns of glossary rows and lines.
SECTION_ENDS = ("particulars", "sr. no.", "s. no.", "name")
ACRONYM = r"^[A-Z][A-Z0-9&./\-]{1,11}$"
INSTITUTION = rf"(?i){EDGE}(?:bank|limited|ltd|llp|corporation|incorporated|inc|company|holdings|trust|& co){EDGE}|{EDGE}p(?:riva)?t[ve]?\.?\s+l(?:imi)?t[ed]*{EDGE}"
ENTITY = rf"^[A-Z][\w&.,'’\- ]{{2,70}}{EDGE}(?:Limited|Ltd\.?|LLP|Private Limited|Pvt\.? Ltd\.?|Inc\.?|Corporation|Bank|Securities|Trust|Associates|& Co\.?)\s*$"
GLOSSARY_HEADING = r"(?i)^\s*(?:section\s+[ivx]+\s*[:\-]?\s*)?(?:definitions?(?:\s+and\s+abbreviations?)?|abbreviations?|glossary)\s*$"
GLOSSARY_LINE = GLOSSARY_HEADING.replace("(?i)^", "(?im)^", 1)  # in a text of several lines
DEFINITION_LINE = r"(?i)^\s*([^\n|]{2,80}?)\s*(?:\||\s{2,}|\s+means\s+|\s+shall\s+mean\s+|:)\s*\S"
SHOUTED = rf"{EDGE}[A-Z][A-Z&.'\-]*(?:\s+[A-Z][A-Z&.'\-]*){{2,}}{EDGE}"
UNLOWERED_LINE = r"(?<![^\n])[^a-z\n]++(?![^\n])"
PAGE_NUMBER = r"(?<=[A-Za-z])\d{1,3}\s*$"
SHOUT_MARGIN = 2000
PHRASE_WORDS = 6


def defines_entity(description: Column) -> Column:
    """A description that is just the name of a party."""
    plain = F.trim(F.regexp_replace(description, r"\s+", " "))
    return (shape.word_count(plain) <= 10) & plain.rlike(ENTITY)


def is_expansion(description: Column) -> Column:
    """An abbreviation spelled out."""
    plain = F.trim(F.regexp_replace(description, r"\s+", " "))
    return plain.rlike(r"^\p{Lu}") & ~defines_entity(plain) & ~plain.rlike(INSTITUTION) & (shape.word_count(plain) <= 8) & (F.length(plain) <= 70)


def is_reference(term: Column, description: Column) -> Column:
    """Technical vocabulary rather than a party."""
    return (F.trim(description) != "") & F.trim(term).rlike(ACRONYM) & ~description.rlike(INSTITUTION)


def _distinctive(value: Column) -> Column:
    return F.filter(shape.letters_list(value), lambda w: (F.length(w) >= 4) & ~w.isin(*policy.SHELL_WORDS))


def abbreviates(term: Column, full: Column) -> Column:
    """A short name that shares a distinctive word with the full one, or is its initials."""
    words = _distinctive(term)
    letters = F.regexp_replace(term, "[^A-Za-z]", "")
    initials = F.upper(F.array_join(F.transform(F.regexp_extract_all(full, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.substring(w, 1, 1)), ""))
    short = F.length(letters).between(2, 6) & (F.upper(term) == term) & F.contains(initials, F.upper(letters))
    return F.when(F.size(words) == 0, short).otherwise(F.arrays_overlap(words, _distinctive(full)))


def glossary_rows(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows under a Term / Description header, until other columns start: keys, row_no, term, description (L2, L3)."""
    first, second = F.trim(F.get("cells", 0)), F.trim(F.get("cells", 1))
    wide = rows.where(F.size("cells") >= 2).select(*keys, "row_no", first.alias("first"), second.alias("description"))
    opens = (F.lower("first") == "term") & F.startswith(F.lower("description"), F.lit("description"))
    marked = wide.withColumn("mark", F.when(opens, 1).when(F.lower("first").isin(*SECTION_ENDS), 0))
    order = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("open", F.last("mark", ignorenulls=True).over(order)).where((F.col("open") == 1) & F.col("mark").isNull())
    term = shape.stripped(F.col("first"), _EDGE)
    return inside.select(*keys, "row_no", term.alias("term"), "description").where(F.length("term").between(2, 80))


def learn_tables(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, kind, phrase, full of table glossaries; kind is term, reference or alias."""
    found = glossary_rows(rows, keys).withColumn("party", defines_entity(F.col("description")))
    alias = found.where("party").where(abbreviates(F.col("term"), F.col("description"))).select(*keys, F.lit("alias").alias("kind"), F.col("term").alias("phrase"), F.trim(F.regexp_replace("description", r"\s+", " ")).alias("full"))
    plain = found.where(~F.col("party") & ((F.length("description") >= 25) | (F.length("term") <= 40)))
    parts = F.filter(F.transform(F.split("term", r"\s*/\s*|\s+or\s+"), lambda x: shape.stripped(x, _EDGE)), lambda x: F.length(x).between(2, 80))
    spaced = F.transform(parts, lambda x: F.regexp_replace(x, "(?<=[a-z])(?=[A-Z])", " "))
    every = F.concat(F.array("term"), parts, spaced, F.when(is_expansion(F.col("description")), F.array("description")).otherwise(F.array().cast("array<string>")))
    terms = plain.select(*keys, F.lit("term").alias("kind"), F.explode(every).alias("phrase"))
    references = plain.where(is_reference(F.col("term"), F.col("description"))).select(*keys, F.lit("reference").alias("kind"), shape.key(F.col("description")).alias("phrase"))
    both = terms.unionByName(references).select(*keys, "kind", F.lower("phrase").alias("phrase"), F.lit(None).cast("string").alias("full"))
    return both.unionByName(alias).distinct()


def learn_prose(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, kind, phrase, full of definitions written line by line under a glossary heading."""
    lines = blocks.select(*keys, "block_no", F.trim("text").alias("line")).where("line != ''")
    shouted = (F.upper("line") == F.col("line")) & F.col("line").rlike(r"\p{L}") & (F.length("line") < 80)
    defines = F.col("line").rlike(DEFINITION_LINE)
    heading = F.col("line").rlike(GLOSSARY_HEADING)
    order = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("mark", F.when(heading, 1).when(shouted & ~defines, 0))
    inside = marked.withColumn("open", F.last("mark", ignorenulls=True).over(order)).where((F.col("open") == 1) & ~heading & defines)
    term = shape.stripped(F.regexp_extract("line", DEFINITION_LINE, 1), " \t\"'“”‘’.,;")
    found = inside.select(*keys, F.lit("term").alias("kind"), F.lower(term).alias("phrase"), F.lit(None).cast("string").alias("full"))
    return found.where(F.length("phrase").between(2, 80)).distinct()


def phrases(value: Column) -> Column:
    """Lower-cased runs of one to six words that start with a word written small."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).rlike("^[a-z]"))
        ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(PHRASE_WORDS), F.size(words) - i + 1))
        every = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda k: F.lower(F.array_join(F.slice(words, i, k), " ")))))
        return F.when(F.size(words) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(shape.word_list(value), runs)


def marked_words(text: Column) -> Column:
    """All words of a text in small letters between blanks, capitalised ones after a `^`, lines apart."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'&.\-]*|\n"), F.lit(0))
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.when(w.rlike("^[A-Z]"), "^").otherwise(""), F.lower(w))), " ")
    return F.concat(F.lit(" "), joined, F.lit(" "))


def uncapitalised(candidates: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Distinct keys and phrase of the candidates' phrases that their document writes small.

    candidates: keys and phrase. Each document's candidates are sent to its text and sought in
    its words, so the phrases of a text (six for each word) are never made; a candidate whose first word the
    text never writes small, as most names, is given up without a regular expression.
    """
    asked = candidates.where("phrase is not null").groupBy(*keys).agg(F.collect_set("phrase").alias("_asked"))
    met = asked.join(texts.select(*keys, F.col(text_column).alias("_text")), list(keys))
    sought = lambda p: F.concat(F.lit(" \\Q"), F.replace(p, F.lit(" "), F.lit("\\E \\^?\\Q")), F.lit("\\E "))
    found = met.select(*keys, "_asked", marked_words(F.col("_text")).alias("_words"))
    begins = lambda p: F.contains(F.col("_words"), F.concat(F.lit(" "), F.split_part(p, F.lit(" "), F.lit(1)), F.lit(" ")))
    return found.select(*keys, F.explode(F.filter("_asked", lambda p: begins(p) & F.rlike(F.col("_words"), sought(p)))).alias("phrase")).distinct()


def shouted_windows(text: Column, margin: int = SHOUT_MARGIN) -> Column:
    """array<struct<start,end>> of merged stretches around runs of three and more words in capitals."""
    found = spans.scan(text, SHOUTED)
    wide = F.transform(found, lambda s: F.struct(F.greatest(s["start"] - margin, F.lit(0)).alias("start"), F.least(s["end"] + margin, F.length(text)).alias("end")))
    kind = "struct<start:int,end:int>"

    def step(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        meets = F.coalesce(w["start"] <= last["end"], F.lit(False))
        grown = F.struct(last["start"], F.greatest(last["end"], w["end"])).cast(kind)
        return F.when(meets, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), grown)).otherwise(F.array_append(done, w.cast(kind)))

    return F.aggregate(wide, F.array().cast(f"array<{kind}>"), step)


def heading_lines(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """keys, start, end, heading of lines in capitals that repeat in their document or end in a page number."""
    found = texts.select(*keys, F.explode(spans.scan(F.col(text_column), UNLOWERED_LINE)).alias("line")).select(*keys, "line.start", F.col("line.text").alias("line"))
    bare = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    capitals = found.withColumn("bare", bare).where((F.col("bare") != "") & (F.upper("bare") == F.col("bare")) & F.col("bare").rlike(r"\p{L}"))
    keyed = capitals.withColumn("key", F.trim(F.regexp_replace("bare", PAGE_NUMBER, ""))).where("key != ''")
    again = F.count("*").over(Window.partitionBy(*keys, "key"))
    return keyed.withColumn("n", again).where("n > 1 or key != bare").select(*keys, "start", (F.col("start") + F.length("line")).cast("int").alias("end"), F.col("bare").alias("heading"))


def truecased(text: Column, headings: Column) -> Column:
    """Text with its runs of capitals in title case but for those that meet a heading span; length stays.

    headings: array<struct<start,end>>.
    """
    found = spans.scan(text, SHOUTED)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.exists(headings, lambda h: (s["start"] < h["end"]) & (h["start"] < s["end"]))
        run = F.when(kept, s["text"]).otherwise(shape.titled(s["text"]))
        return F.struct(s["end"].alias("at"), F.concat(state["out"], spans.between(text, state["at"], s["start"]), run).alias("out"))

    done = F.aggregate(found, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """array<struct<start,text>> for a model with a bounded window: cut at the last line or sentence end of a chunk's second half.

    One scan finds the ends, a fold over them sets the bounds, and chunks are taken out of pieces of fixed
    length, so the work grows with the text alone.
    """
    span, stride = "struct<start:int,end:int>", size - overlap
    kind = f"struct<at:int,best:int,out:array<{span}>>"
    one = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    state = lambda at, best, out: F.struct(at.cast("int").alias("at"), best.cast("int").alias("best"), out.alias("out")).cast(kind)

    def moved(s: Column, reach: Column) -> Column:
        """The state once no chunk ends before reach any more: the open one at its best end, then those without an end in them."""
        closed = state(s["best"] + 1 - overlap, F.lit(None), F.concat(s["out"], one(s["at"], s["best"] + 1)))
        some = lambda c: F.ceil((reach - c["at"] - size) / stride).cast("int")
        bare = lambda c: F.transform(F.sequence(F.lit(0), some(c) - 1), lambda i: F.struct((c["at"] + i * stride).cast("int").alias("start"), (c["at"] + i * stride + size).cast("int").alias("end")))
        onward = lambda c: F.when(reach > c["at"] + size, state(c["at"] + some(c) * stride, F.lit(None), F.concat(c["out"], bare(c)))).otherwise(c)
        return F.when(reach <= s["at"] + size, s).otherwise(let(F.when(s["best"].isNull(), s).otherwise(closed), onward))

    def step(s: Column, end: Column) -> Column:
        after = end["start"] + F.when(end["text"] == ".", 2).otherwise(1)  # a sentence end holds the blank behind it
        return let(moved(s, after), lambda c: F.when(end["start"] >= c["at"] + size // 2, state(c["at"], end["start"], c["out"])).otherwise(c))

    ends = F.aggregate(spans.scan(text, r"\n|\.(?= )"), state(F.lit(0), F.lit(None), F.array().cast(f"array<{span}>")), step)
    bounds = let(let(ends, lambda s: moved(s, F.length(text))), lambda s: F.concat(s["out"], one(s["at"], F.length(text))))
    whole = "(?s).{1," + str(size) + "}"
    cut = lambda parts, b: F.substring(F.array_join(F.slice(parts, F.floor(b["start"] / size).cast("int") + 1, 3), ""), (b["start"] % size + 1).cast("int"), b["end"] - b["start"])
    found = let(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), lambda parts: F.transform(bounds, lambda b: F.struct(b["start"].alias("start"), cut(parts, b).alias("text"))))
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<struct<start:int,text:string>>"))
