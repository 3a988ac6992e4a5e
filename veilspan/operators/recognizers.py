"""Recognizers: configuration that becomes candidate spans with scores.

A recognizer is a pattern with a base score, cue words and perhaps a validator. What the
validator proves scores 1, what it disproves is dropped, what has none keeps the base score,
raised by CUE_BOOST if a cue word stands nearby. Spans under the floor are dropped.

detect() builds only the recognizers of the wanted types. Every pattern is one pass over
the text inside the JVM; a pattern that needs a certain character first tests for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans, validators

FLOOR = 0.35
CUE_BOOST = 0.35
CUE_MARGIN = 40  # characters on either side that are searched for cue words
BIRTH_MARGIN = 60

#: Types decided by form or checksum; they win overlaps.
STRUCTURED = (
    "EMAIL_ADDRESS", "PHONE_NUMBER", "IN_MOBILE", "IN_AADHAAR", "IN_PAN", "IN_GSTIN", "IN_IFSC", "IN_PASSPORT",
    "IN_VOTER_ID", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "CORPORATE_ID", "URL", "WEB_ADDRESS", "DATE_OF_BIRTH",
)

DETECTION = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"


@dataclass(frozen=True)
class Recognizer:
    """pattern: without boundaries; whole: whether ASCII word boundaries are put around it.

    near: pattern that must be found within near_margin characters of the span.
    needs: a literal without which the text can't match, tested first.
    """

    entity_type: str
    pattern: str
    score: float
    cues: tuple[str, ...] = ()
    validator: Callable[[Column], Column] | None = None
    whole: bool = True
    near: str | None = None
    near_margin: int = BIRTH_MARGIN
    needs: str | None = None

    def spans(self, text: Column) -> Column:
        """Scored detections of a text column as an array."""
        found = spans.scan(text, spans.bounded(self.pattern) if self.whole else self.pattern)
        if self.near is not None:
            found = F.filter(found, lambda s: F.rlike(spans.window(text, s["start"], s["end"], self.near_margin), F.lit(self.near)))
        if self.validator is not None:
            found = F.filter(found, lambda s: F.coalesce(self.validator(s["text"]), F.lit(False)))
        return F.transform(found, lambda s: F.struct(F.lit(self.entity_type).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), self.scored(text, s).alias("score"), s["text"].alias("text")))

    def scored(self, text: Column, span: Column) -> Column:
        if self.validator is not None:
            return F.lit(1.0)
        if not self.cues:
            return F.lit(float(self.score))
        cue = "(?i)" + spans.bounded("|".join(self.cues))
        near = F.rlike(spans.window(text, span["start"], span["end"], CUE_MARGIN), F.lit(cue))
        return F.when(near, F.lit(min(1.0, self.score + CUE_BOOST))).otherwise(F.lit(float(self.score)))


_BIRTH_CUE = r"(?iu)(?<![A-Za-z0-9_])(?:date of birth|dob|d\.o\.b|born on|born in|birth date|birthday|जन्म\s*तिथि|जन्म\s*की\s*तारीख)(?![A-Za-z0-9_])"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

# Patterns, base scores and cue words of the identifiers.
IDENTIFIERS = (
    Recognizer("IN_AADHAAR", r"[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}", 0.30, ("aadhaar", "aadhar", "uid", "uidai", "unique identification"), validators.is_aadhaar),
    Recognizer("IN_PAN", r"[A-Z]{5}\d{4}[A-Z]", 0.40, ("pan", "permanent account number", "income tax"), validators.is_pan),
    Recognizer("IN_GSTIN", r"\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z]", 0.40, ("gst", "gstin", "goods and services"), validators.is_gstin),
    Recognizer("IN_IFSC", r"[A-Z]{4}0[0-9A-Z]{6}", 0.35, ("ifsc", "bank", "branch", "neft", "rtgs"), validators.is_ifsc),
    Recognizer("IN_PASSPORT", r"[A-PR-WY]\d{7}", 0.20, ("passport", "travel document", "issued at"), validators.is_passport),
    Recognizer("IN_VOTER_ID", r"[A-Z]{3}\d{7}", 0.25, ("voter", "epic", "election", "electoral"), validators.is_voter_id),
    Recognizer("CREDIT_CARD", r"(?:\d[ -]?){12,18}\d", 0.20, ("card", "credit", "debit", "visa", "mastercard", "cvv"), validators.is_card),
    Recognizer("CORPORATE_ID", r"[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}", 0.60, ("cin", "corporate identity", "registration number")),
)
BIRTH_DATES = tuple(
    Recognizer("DATE_OF_BIRTH", pattern, 0.95, near=_BIRTH_CUE)
    for pattern in (rf"(?i:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}", r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}", r"\d{4}[/\-]\d{1,2}[/\-]\d{1,2}")
)
SWEEPS = (
    Recognizer("EMAIL_ADDRESS", r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\s?\.\s?[A-Za-z]{2,}(?![A-Za-z0-9_])", 1.0, whole=False, needs="@"),
    Recognizer("WEB_ADDRESS", r"(?<![A-Za-z0-9_])(?:https?://|www\s?\.\s?)[A-Za-z0-9.\-]+\s?\.\s?[A-Za-z]{2,}(?:/[^\s,;)\]]*)?", 1.0, whole=False),
)
#: Stand-ins for a general library's own recognizers.
GENERAL = (
    Recognizer("IP_ADDRESS", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 0.60, validator=validators.is_ipv4),
    Recognizer("PHONE_NUMBER", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,5}[ -]?\d{3,5}(?![A-Za-z0-9_])", 0.75, whole=False, needs="+"),
    Recognizer("IBAN_CODE", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 0.50, validator=validators.is_iban),
)
#: Telephone numbers of India without a country code: mobiles by their first digit, others by area code and a cue word.
NATIONAL = (
    Recognizer("IN_MOBILE", r"(?<![A-Za-z0-9_+])(?:91[ -]?|0)?[6-9]\d{4}[ -]?\d{5}(?![A-Za-z0-9_])", 0.40, validator=validators.is_mobile, whole=False),
    Recognizer(
        "PHONE_NUMBER",
        r"(?<![A-Za-z0-9_+])(?:\(0[1-9]\d\)|0[1-9]\d)[ -]?\d{4}[ -]?\d{4}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_+])(?:\(0[1-9]\d{2}\)|0[1-9]\d{2})[ -]?\d{3}[ -]?\d{4}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_+])(?:\(0[1-9]\d{3}\)|0[1-9]\d{3})[ -]?\d{3}[ -]?\d{3}(?![A-Za-z0-9_])",
        0.30, ("tel", "telephone", "phone", "ph", "fax", "call", "landline", "contact"), whole=False,
    ),
)
#: Rule candidates for names and organisations where no model is plugged in: capitalised runs with a cue.
NAME_RULES = (
    Recognizer("ORGANIZATION", r"[A-Z][A-Za-z&.'\-]*(?: (?:and|of|&|[A-Z][A-Za-z&.'\-]*)){0,5} (?:Limited|Ltd|LLP|Bank|Corporation|Inc|Holdings|Trust)", 0.60),
    Recognizer("PERSON", r"(?<![A-Za-z0-9_])(?<=(?:Mr|Ms|Dr)\.? )[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}(?![A-Za-z0-9_])", 0.60, whole=False),
    Recognizer("LOCATION", r"\d{1,4}[A-Za-z]?,? [A-Z][a-z]+(?: [A-Z][a-z]+){0,2} (?:Road|Street|Lane|Marg|Nagar|Avenue)", 0.50),
)
DEFAULT = (*IDENTIFIERS, *BIRTH_DATES, *SWEEPS, *GENERAL, *NATIONAL)


def detections(text: Column, recognizers: Iterable[Recognizer] = DEFAULT, wanted: Iterable[str] | None = None, floor: float = FLOOR) -> Column:
    """Scored spans of all wanted recognizers as one array, in no particular order."""
    wanted = set(wanted) if wanted is not None else None
    some = [r for r in recognizers if wanted is None or r.entity_type in wanted]
    parts = []
    for r in some:
        found = r.spans(text)
        parts.append(F.when(F.contains(text, F.lit(r.needs)), found).otherwise(F.array().cast(DETECTION)) if r.needs else found)
    every = reduce(F.concat, [p.cast(DETECTION) for p in parts]) if parts else F.array().cast(DETECTION)
    return F.coalesce(F.filter(every, lambda d: d["score"] >= floor), F.array().cast(DETECTION))


def detect(df: DataFrame, text_column: str = "text", keys: tuple[str, ...] = ("doc_id",), recognizers: Iterable[Recognizer] = DEFAULT, wanted: Iterable[str] | None = None, floor: float = FLOOR, before: int | None = None) -> DataFrame:
    """One row per span: keys, entity_type, start, end, score, text, and with before=n the n characters ahead of it."""
    some = [r for r in recognizers if wanted is None or r.entity_type in set(wanted)]
    if some and all(r.needs for r in some):  # then the test reaches the scan as a pushed filter
        df = df.where(reduce(lambda a, b: a | b, [F.contains(F.col(text_column), F.lit(n)) for n in sorted({r.needs for r in some})]))
    every = detections(F.col(text_column), some, None, floor)
    if before is None:
        found = df.select(*keys, F.explode(every).alias("d"))
        return found.select(*keys, "d.entity_type", "d.start", "d.end", "d.score", "d.text")
    led = F.transform(every, lambda d: F.struct(d.alias("d"), spans.preceding(F.col(text_column), d["start"], before).alias("before")))
    found = df.select(*keys, F.explode(led).alias("x"))
    return found.select(*keys, "x.d.entity_type", "x.d.start", "x.d.end", "x.d.score", "x.d.text", "x.before")


def with_floor(recognizer: Recognizer, score: float) -> Recognizer:
    """A recognizer with another base score."""
    return replace(recognizer, score=score)
