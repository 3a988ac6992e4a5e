"""Policy: which detected spans are really private.

decision() gives the first rule that speaks against a span, or NULL if it is to be redacted. The
order of rules is meaning, not tuning: the shape test comes before the types that are
always redacted, so a caption labelled with the type of its value doesn't slip through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import text as shape
from veilspan.functions.spans import EDGE, let, strings

# Institutions that are public by nature, in lower case.
PUBLIC_BODIES = (
    "sebi", "securities and exchange board of india", "rbi", "reserve bank of india", "irdai", "irda", "pfrda", "mca",
    "ministry of corporate affairs", "roc", "registrar of companies", "cci", "competition commission of india", "dgft",
    "director general of foreign trade", "directorate general of foreign trade", "npci",
    "national payments corporation of india", "income tax department", "uidai",
    "unique identification authority of india", "government of india", "bse", "bse limited", "nse", "nse limited",
    "national stock exchange", "national stock exchange of india", "national stock exchange of india limited", "nsdl",
    "cdsl", "national securities depository limited", "central depository services",
    "central depository services (india) limited", "seci", "solar energy corporation of india",
    "solar energy corporation of india limited", "cea", "central electricity authority", "cerc",
    "central electricity regulatory commission", "icdr", "sebi icdr regulations", "companies act",
    "sebi listing regulations", "fema", "sebi act", "depositories act", "income tax act", "ind as",
    "indian accounting standard", "indian accounting standards", "companies (indian accounting standards) rules",
)
# Languages name nobody.
LANGUAGES = (
    "english", "hindi", "marathi", "gujarati", "bengali", "tamil", "telugu", "kannada", "malayalam", "punjabi", "odia",
    "oriya", "assamese", "urdu", "sanskrit", "konkani", "manipuri", "nepali", "sindhi", "kashmiri", "maithili",
    "santhali", "bodo", "dogri",
)
# Words of which captions are made.
CAPTION_WORDS = (
    "telephone", "tel", "phone", "mobile", "fax", "email", "e", "mail", "website", "web", "url", "address", "name",
    "contact", "person", "designation", "title", "office", "registered", "corporate", "branch", "number", "no", "id",
    "code", "date", "details", "particulars", "investor", "grievance", "compliance", "officer", "secretary",
    "weighted", "average", "cost", "total", "amount", "value", "price", "sr", "s", "description", "term", "type",
    "category", "status", "offer", "size", "risks", "relation", "period", "closes", "opens", "bid", "issue",
    "general", "information", "table", "contents", "section", "part", "annexure", "schedule", "note", "notes",
    "summary", "overview", "our", "the", "and", "for", "of", "to", "in", "on", "at", "by", "aadhaar", "aadhar", "pan",
    "gstin", "gst", "ifsc", "passport", "voter", "din", "cin", "isin", "uid", "epic", "tan",
)
# Types of numbers, types that are always private, fillers, words too common to be names.
DIGIT_TYPES = (
    "PHONE_NUMBER", "IN_MOBILE", "IN_AADHAAR", "IN_PAN", "IN_GSTIN", "IN_PASSPORT", "IN_VOTER_ID", "CREDIT_CARD",
    "IP_ADDRESS", "IBAN_CODE", "DATE_OF_BIRTH", "BANK_ACCOUNT", "CORPORATE_ID",
)
ALWAYS = (
    "IN_AADHAAR", "IN_PAN", "IN_GSTIN", "IN_PASSPORT", "IN_VOTER_ID", "CREDIT_CARD", "EMAIL_ADDRESS", "PHONE_NUMBER",
    "IN_MOBILE", "DATE_OF_BIRTH", "IP_ADDRESS", "IBAN_CODE",
)
NAMES = ("PERSON", "ORGANIZATION", "LOCATION")
FILLERS = (
    "the", "and", "for", "with", "from", "that", "this", "our", "its", "their", "all", "any", "such", "been", "have",
    "has", "are", "was", "were", "will", "shall", "may", "not", "under", "over", "into", "onto", "upon", "per",
)
COMMON_WORDS = (
    "bank", "company", "board", "trust", "limited", "private limited", "group", "corporation", "authority",
    "government", "department", "office", "branch", "india", "indian", "state", "city", "town", "village", "district",
    "the company", "our company", "the board", "the bank", "issuer", "promoter", "promoters", "director", "directors",
    "auditor", "auditors", "shareholder", "shareholders", "investor", "investors", "member", "members",
)
SHELL_WORDS = (
    "limited", "ltd", "private", "pvt", "llp", "inc", "company", "corporation", "corp", "group", "holdings", "india",
    "indian", "bank", "trust", "the", "and", "of", "services", "solutions", "enterprises", "industries",
    "international", "national", "capital", "securities", "finance", "financial", "promoter", "promoters",
    "corporate", "our", "wealth", "management",
)
PUBLIC_SUFFIXES = (".gov.in", ".nic.in", ".gov", ".gov.uk")
HOST_QUALIFIERS = ("", "india", "indialimited", "indialtd", "ltd", "limited")
PROSE_SHARE = 0.34
PRECEDING = 80  # characters before a span that decisions may read

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Patterns of the rules.
TRANSACTION = rf"(?i){_B}(?:order|ticket|invoice|folio|receipt|challan|acknowledgement|application|transaction|reference|docket|case|batch|serial)\s*(?:no\.?|number|id|#)?\s*[:\-]?\s*$"
BARE_CODE = r"(?i)^[A-Z]{0,3}\d[\d/\-]{2,}[A-Z]?$"
PROSE_GRAMMAR = rf"(?i)^(?:the|this|these|those|our|its|their|all|any|such|details|summary){_E}|{_B}(?:of|for|in|to|on|with|from|under|and)\s+the{_E}"
ORGANISATION_WORD = rf"(?i){EDGE}(?:bank|limited|ltd|llp|corporation|incorporated|inc|& co){EDGE}"
MALFORMED = rf"(?i)[\n\r|]|@|https?://|{_B}(?:telephone|email|website|e-mail)\s*:"


def _any(phrases: tuple[str, ...]) -> str:
    return "|".join(r"\Q" + p + r"\E" for p in sorted(phrases, key=len, reverse=True))


def fits_type(entity_type: Column, value: Column) -> Column:
    """Whether a span of a structured type is shaped like it."""
    return (
        F.when(F.array_contains(strings(DIGIT_TYPES), entity_type), value.rlike("[0-9]"))
        .when(entity_type == "EMAIL_ADDRESS", F.contains(value, F.lit("@")))
        .when(entity_type.isin("URL", "WEB_ADDRESS"), F.contains(value, F.lit(".")) & (shape.word_count(value) <= 4))
        .when(entity_type == "IN_IFSC", (shape.word_count(value) == 1) & value.rlike("[0-9]"))
        .otherwise(True)
    )


def is_public_host(value: Column) -> Column:
    """A government host, or one whose first label is a public body with a usual ending."""
    host = F.lower(F.rtrim(F.regexp_extract(F.regexp_replace(value, r"\s+", ""), r"(?:https?://)?(?:www\.)?([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 1), F.lit("./")))
    suffix = F.lit(False)
    for s in PUBLIC_SUFFIXES:
        suffix |= F.endswith(host, F.lit(s))
    labels = sorted({b + q for b in PUBLIC_BODIES for q in HOST_QUALIFIERS if " " not in b})
    return (host != "") & (suffix | F.split_part(host, F.lit("."), F.lit(1)).isin(*labels))


def is_transaction_reference(value: Column, before: Column) -> Column:
    """P5: a bare code after words that name a piece of paperwork."""
    return F.trim(value).rlike(BARE_CODE) & F.coalesce(before, F.lit("")).rlike(TRANSACTION)


def is_malformed(entity_type: Column, value: Column) -> Column:
    """A name that swallowed layout, or is mostly digits."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.array_contains(strings(NAMES), entity_type) & (value.rlike(MALFORMED) | (digits > F.length(value) * 0.4))


def is_field_label(value: Column) -> Column:
    """At most four words, all from captions."""
    normal = shape.normalised(value)
    words = shape.letters_list(normal)
    return (shape.word_count(normal) <= 4) & (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(strings(CAPTION_WORDS), w))


def term_words(terms: Column) -> Column:
    """Words of three letters and more of which terms are made."""
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.filter(F.split(t, r"[/\s]+"), lambda w: F.length(w) > 2))))


def is_vocabulary_phrase(value: Column, terms: Column) -> Column:
    """Nothing is left of a phrase once defined terms (longest first) and fillers are taken away."""
    normal = shape.normalised(value)
    longest = F.array_sort(terms, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    padded = F.concat(F.lit(" "), F.replace(normal, F.lit("/"), F.lit(" ")), F.lit(" "))
    rest = F.aggregate(longest, padded, lambda s, t: F.replace(s, F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" ")))
    words = F.filter(F.regexp_extract_all(rest, F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.array_contains(strings(FILLERS), w))
    return (F.size(terms) > 0) & (shape.word_count(normal) >= 2) & ~normal.rlike(ORGANISATION_WORD) & (F.size(F.array_except(words, term_words(terms))) == 0)


def is_prose(entity_type: Column, value: Column) -> Column:
    """A name-like span that reads as a sentence, by case, or by grammar if all in capitals."""
    words = shape.word_list(value)
    shouted = (F.upper(value) == value) & value.rlike(r"\p{L}")
    small = F.size(F.filter(words, lambda w: w.rlike("^[a-z]")))
    return F.array_contains(strings(NAMES), entity_type) & (F.size(words) >= 3) & F.when(shouted, value.rlike(PROSE_GRAMMAR)).otherwise(small / F.size(words) > PROSE_SHARE)


def is_public_body(value: Column) -> Column:
    """P10: a public body's name, or a phrase that holds one of more than four characters."""
    normal = shape.normalised(value)
    long = _any(tuple(b for b in PUBLIC_BODIES if len(b) > 4))
    return F.array_contains(strings(PUBLIC_BODIES), normal) | normal.rlike(rf"(?<![a-z0-9])(?:{long})(?![a-z0-9])")


def completes_public_body(value: Column, before: Column) -> Column:
    """The tail of a public body's name that the words before it complete."""
    tail = shape.normalised(F.concat(F.coalesce(F.right(before, F.lit(PRECEDING)), F.lit("")), value))
    both = F.struct(shape.normalised(value).alias("own"), tail.alias("tail"))
    return let(both, lambda x: (x["own"] != "") & F.exists(strings(PUBLIC_BODIES), lambda b: F.endswith(x["tail"], b) & F.endswith(b, x["own"]) & (b != x["own"])))


def is_defined_term(value: Column, terms: Column) -> Column:
    """A term of the document in one of its forms, a phrase within one, or a word of one."""
    return let(shape.normalised(value), lambda normal: _is_term(normal, terms))


def _is_term(normal: Column, terms: Column) -> Column:
    stem = F.regexp_replace(normal, "s$", "")
    forms = F.array(
        normal, F.regexp_replace(normal, "[()s]+$", ""), F.concat(normal, F.lit("s")), F.concat(normal, F.lit("(s)")),
        F.replace(normal, F.lit("(s)"), F.lit("")), F.replace(normal, F.lit("(s)"), F.lit("s")), stem, F.concat(stem, F.lit("(s)")),
    )
    single = (F.length(normal) < 4) | ~F.contains(normal, F.lit(" "))
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    within = F.exists(terms, lambda t: (F.length(t) > F.length(normal)) & F.contains(pad(t), pad(normal)))
    return F.arrays_overlap(F.filter(forms, lambda x: x != ""), terms) | F.when(single, F.array_contains(term_words(terms), normal)).otherwise(within)


def is_reference_vocabulary(value: Column, references: Column) -> Column:
    """An acronym's expansion or, word by word, a part of one."""
    bare = F.btrim(shape.key(value), F.lit(" .,;:\"'“”‘’()"))
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return let(bare, lambda plain: (F.length(plain) >= 3) & F.exists(references, lambda d: F.contains(pad(d), pad(plain))))


def is_structural_heading(value: Column, headings: Column) -> Column:
    """A heading, or three words and more of one."""
    return let(F.upper(F.trim(value)), lambda upper: (upper != "") & (F.array_contains(headings, upper) | ((shape.word_count(upper) >= 3) & F.exists(headings, lambda h: F.contains(h, upper)))))


def is_shell(value: Column) -> Column:
    """Only filler words of company names."""
    words = F.filter(shape.letters_list(value), lambda w: F.length(w) >= 3)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(strings(SHELL_WORDS), w))


def is_bare_place(entity_type: Column, value: Column) -> Column:
    """A place of at most three words without a number."""
    return entity_type.isin("LOCATION", "ADDRESS") & ~value.rlike("[0-9]") & (shape.word_count(F.trim(value)) <= 3)


def phrase_key(value: Column) -> Column:
    """P20: the form in which a span is looked up among uncapitalised phrases; NULL over six words."""
    words = shape.word_list(value)
    return F.when(F.size(words).between(1, 6), F.lower(F.array_join(words, " ")))


def _list(column: Column | None) -> Column:
    empty = F.array().cast("array<string>")
    return empty if column is None else F.coalesce(column, empty)


def decision(entity_type: Column, value: Column, before: Column | None = None, terms: Column | None = None, references: Column | None = None, headings: Column | None = None, uncapitalised: Column | None = None) -> Column:
    """The rule that keeps a span as it is, or NULL if the span is to be redacted."""
    before = F.lit("") if before is None else before
    terms, references, headings = _list(terms), _list(references), _list(headings)
    uncapitalised = F.lit(False) if uncapitalised is None else F.coalesce(uncapitalised, F.lit(False))
    x, name = F.trim(value), F.array_contains(strings(NAMES), entity_type)
    small = (F.lower(x) == x) & x.rlike(r"\p{L}")
    return (
        F.when(F.coalesce(x, F.lit("")) == "", "empty")
        .when(~fits_type(entity_type, x), "not shaped like its type")
        .when(entity_type.isin("WEB_ADDRESS", "URL") & is_public_host(x), "public host")
        .when(F.array_contains(strings(ALWAYS), entity_type), F.lit(None))
        .when(F.length(x) < 3, "too short")
        .when(is_transaction_reference(x, before), "transaction reference")
        .when(is_malformed(entity_type, x), "malformed")
        .when(is_field_label(x), "field label")
        .when(is_vocabulary_phrase(x, terms), "document vocabulary")
        .when(is_prose(entity_type, x), "prose")
        .when(is_public_body(x), "public body")
        .when(completes_public_body(x, before), "public body")
        .when(is_defined_term(x, terms), "document-defined term")
        .when(is_reference_vocabulary(x, references), "reference vocabulary")
        .when(F.array_contains(strings(LANGUAGES), shape.normalised(x)), "language name")
        .when(F.array_contains(strings(COMMON_WORDS), shape.normalised(x)), "common word")
        .when(name & is_structural_heading(x, headings), "heading")
        .when(name & is_shell(x), "company-name filler")
        .when(name & small, "lower case")
        .when(name & uncapitalised, "written in lower case elsewhere in the document")
    )


def after_merge(entity_type: Column, value: Column, structured: Column) -> Column:
    """The rule that keeps a merged span as it is, or NULL."""
    return F.when(is_bare_place(entity_type, value), "bare place name").when(~structured & is_prose(F.lit("ORGANIZATION"), value), "prose, after merge")
