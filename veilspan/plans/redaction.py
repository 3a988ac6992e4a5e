"""The redaction job: detect, decide, settle overlaps, name stand-ins, rewrite.

The order is meaning: the policy judges before overlaps are settled, so a long span that is then kept
can't take a private one down with it; all detection precedes rewriting, so mentions that
no recognizer saw are replaced too.

Texts are staged once with a key for each row, so spans belong to rows, whatever the ids: rows that
share a doc_id are one document (its vocabulary and its mapping hold for all of them) and are
rewritten apart; a row with a null id is a document of its own; repeated rows are rewritten
alike. Ids of any type pass through as they are; a null text stays null, without replacements. Detections and
the mapping, small beside the texts, are staged between the steps. The
mapping's scope is a document, or the whole corpus with corpus_scope.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.operators import overlap, policy, rewrite, surrogates, vocabulary
from veilspan.operators import recognizers as rec
from veilspan.sources.staging import bucketed, staged

DETECTED = ("entity_type", "start", "end", "score", "text")


@dataclass
class Config:
    """recognizers: configuration or plug-ins; models: functions from texts (doc_id, text) to
    detections (doc_id and DETECTED), for recognizers that are not patterns.
    """

    recognizers: tuple = rec.DEFAULT
    wanted: tuple[str, ...] | None = None
    floor: float = rec.FLOOR
    models: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    corpus_scope: bool = False
    second_pass: bool = True
    headings: bool = True


@dataclass
class Outcome:
    """detections and suppressed: doc_id, row (its key within the job) and span; mapping: doc_id (null for rows without
    one; no such column with corpus_scope), key, surrogate, entity_type, is_alias; texts: doc_id, text, replacements.
    """

    detections: DataFrame
    suppressed: DataFrame
    mapping: DataFrame
    texts: DataFrame


KEYS = ("scope", "row")


def document(doc_id: Column) -> Column:
    """The name of a document's scope; NULL for a null id."""
    return F.concat(F.lit("d:"), doc_id.cast("string"))


def keyed(texts: DataFrame) -> DataFrame:
    """doc_id, text, row, scope; staged, so a row's key stays its own, and bucketed by scope, so texts move once in a job."""
    rows = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return bucketed(rows.withColumn("scope", F.coalesce(document(F.col("doc_id")), F.concat(F.lit("r:"), F.col("row").cast("string")))), "texts", "scope")


@dataclass
class RedactionJob:
    """texts: doc_id, text; rows: doc_id, row_no, cells of tables; both of any number of documents.

    The steps take texts as keyed() makes them.
    """

    config: Config = field(default_factory=Config)

    def detect(self, texts: DataFrame) -> DataFrame:
        """KEYS, DETECTED and before: the characters ahead of the span."""
        c = self.config
        found = rec.detect(texts, keys=KEYS, recognizers=c.recognizers, wanted=c.wanted, floor=c.floor, before=policy.PRECEDING)
        names = tuple(r for r in c.recognizers if r.entity_type in policy.NAMES)
        more = [self._of_model(model, texts.select(*KEYS, "text")) for model in c.models]
        if c.second_pass and (names or c.models):
            more.append(self.detect_shouted(texts, names))
        for part in more:
            led = part.join(texts.select(*KEYS, F.col("text").alias("_body")), list(KEYS))
            found = found.unionByName(led.select(*KEYS, *DETECTED[:4], spans.between(F.col("_body"), F.col("start"), F.col("end")).alias("text"), spans.preceding(F.col("_body"), F.col("start"), policy.PRECEDING).alias("before")))
        return found

    def _of_model(self, model: Callable[[DataFrame], DataFrame], texts: DataFrame) -> DataFrame:
        """KEYS and spans that a model finds; to the model a row is a document."""
        found = model(texts.select(F.col("row").alias("doc_id"), "text")).where(F.col("score") >= self.config.floor)
        return found.select(F.col("doc_id").cast("long").alias("row"), *DETECTED[:4]).join(texts.select(*KEYS), "row").select(*KEYS, *DETECTED[:4])

    def detect_shouted(self, texts: DataFrame, names: tuple) -> DataFrame:
        """Names in runs of capitals, read in title case near such runs; headings stay as they are."""
        c = self.config
        loud = texts.where(F.col("text").rlike(vocabulary.SHOUTED)).select(*KEYS, "text")
        titles = vocabulary.heading_lines(loud, KEYS).groupBy(*KEYS).agg(F.collect_list(F.struct("start", "end")).alias("titles"))
        none = F.array().cast("array<struct<start:int,end:int>>")
        recased = loud.join(titles, list(KEYS), "left").select(*KEYS, F.col("text").alias("_original"), vocabulary.truecased(F.col("text"), F.coalesce("titles", none)).alias("text"))
        near = recased.select(*KEYS, F.explode(vocabulary.shouted_windows(F.col("_original"))).alias("w"), "text")
        cut = near.select(*KEYS, F.col("w.start").alias("at"), spans.between(F.col("text"), F.col("w.start"), F.col("w.end")).alias("text"))
        found = rec.detect(cut, keys=(*KEYS, "at"), recognizers=names, wanted=c.wanted, floor=c.floor)
        found = found.select(*KEYS, "entity_type", (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"), "score")
        for model in c.models:
            found = found.unionByName(self._of_model(model, recased.select(*KEYS, "text")))
        return found

    def vocabulary(self, texts: DataFrame, rows: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Per document terms, references and headings as arrays; and alias rows."""
        glossaries = texts.where(F.col("text").rlike(vocabulary.GLOSSARY_LINE))
        lines = glossaries.select(*KEYS, F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
        learnt = vocabulary.learn_prose(lines, KEYS).drop("row")
        aliases = None
        if rows is not None:
            learnt = learnt.unionByName(vocabulary.learn_tables(rows, ("scope",)))
            aliases = learnt.where("kind = 'alias'").select("scope", F.col("phrase").alias("variant"), F.col("full").alias("canonical"))
        pick = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("phrase")))
        known = learnt.groupBy("scope").agg(pick("term").alias("terms"), pick("reference").alias("refs"))
        if self.config.headings:
            titles = vocabulary.heading_lines(texts, KEYS).groupBy("scope").agg(F.collect_set(F.upper("heading")).alias("headings"))
            known = known.join(titles, "scope", "full")
        else:
            known = known.withColumn("headings", F.array().cast("array<string>"))
        return known, aliases

    def judge(self, found: DataFrame, texts: DataFrame, known: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """found with reason: the rule against a span, or NULL."""
        lines = texts.select("scope", "text")
        lines = lines if rows is None else lines.unionByName(rows.select("scope", F.array_join("cells", " ").alias("text")))
        asked = found.where(F.col("entity_type").isin(*policy.NAMES)).select("scope", policy.phrase_key(F.col("text")).alias("phrase")).distinct()
        small = vocabulary.uncapitalised(asked, lines, ("scope",)).withColumn("small", F.lit(True))
        wide = found.join(known, "scope", "left").withColumn("phrase", policy.phrase_key(F.col("text"))).join(small, ["scope", "phrase"], "left")
        reason = policy.decision(*(F.col(c) for c in ("entity_type", "text", "before", "terms", "refs", "headings", "small")))
        return wide.select(*KEYS, *DETECTED, reason.alias("reason"))

    def settle(self, judged: DataFrame, texts: DataFrame) -> DataFrame:
        """Disjoint, merged detections; reason is NULL for those that are kept."""
        apart = overlap.resolve_overlaps(judged.where("reason is null").drop("reason"), KEYS)
        merged = overlap.merge_addresses(apart, texts, KEYS)
        return merged.withColumn("reason", policy.after_merge(F.col("entity_type"), F.col("text"), F.col("entity_type").isin(*rec.STRUCTURED)))

    def name(self, kept: DataFrame, aliases: DataFrame | None) -> DataFrame:
        """The mapping, with variants, host forms and glossary aliases at their canonical's stand-in."""
        in_scope = lambda df: df.withColumn("scope", F.lit("corpus")) if self.config.corpus_scope else df
        scoped, scope = in_scope(kept), ("scope",)
        mapped = surrogates.mapping(scoped, scope, types=self.config.wanted)
        parts = [overlap.canonical_names(scoped, scope), overlap.host_aliases(scoped, scope), *([] if aliases is None else [in_scope(aliases)])]
        forms = [df.select("scope", "variant", "canonical", F.lit(i).alias("turn")) for i, df in enumerate(parts)]  # later ones prevail
        return surrogates.with_aliases(mapped, reduce(DataFrame.unionByName, forms), scope)

    def run(self, texts: DataFrame, rows: DataFrame | None = None) -> Outcome:
        texts = keyed(texts)
        rows = rows if rows is None else rows.withColumn("scope", document(F.col("doc_id"))).where("scope is not null")
        known, aliases = self.vocabulary(texts, rows)
        judged = staged(self.judge(self.detect(texts), texts, known, rows), "judged")
        settled = staged(self.settle(judged, texts), "settled")
        kept, late = settled.where("reason is null").drop("reason"), settled.where("reason is not null")
        mapped = staged(self.name(kept, aliases), "mapping")
        if self.config.corpus_scope:
            named = mapped.drop("scope")
            done = rewrite.rewrite(texts, named, (), ("row",), carried=("doc_id",))
        else:
            done = rewrite.rewrite(texts, mapped, ("scope",), KEYS, carried=("doc_id",))
            own = F.when(F.startswith("scope", F.lit("d:")), F.expr("substring(scope, 3)")).cast(texts.schema["doc_id"].dataType)
            named = mapped.select(own.alias("doc_id"), *[c for c in mapped.columns if c != "scope"])
        out = with_ids(judged.where("reason is not null").unionByName(late), texts)
        return Outcome(with_ids(kept, texts), out, named, done.select("doc_id", "text", "replacements"))


def with_ids(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found with the doc_id of its row in place of the scope."""
    return texts.select("doc_id", "row").join(found, "row").select("doc_id", "row", *[c for c in found.columns if c not in KEYS])


def redact(texts: DataFrame, config: Config | None = None) -> DataFrame:
    """doc_id, text, replacements of every text (doc_id, text)."""
    return RedactionJob(config or Config()).run(texts).texts


def emails_only(texts: DataFrame) -> DataFrame:
    """The shortest useful job: e-mail addresses replaced by offset; doc_id, text, replacements.

    Each row is done where it stands: nothing is joined or shuffled, so ids don't matter.
    """
    kind = ("EMAIL_ADDRESS",)
    named = lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), surrogates.surrogate(d["entity_type"], d["text"], types=kind).alias("surrogate"))
    return rewrite.spliced_rows(texts, F.transform(rec.detections(F.col("text"), rec.SWEEPS, kind), named))
