"""Text shapes: keys, normal forms, masks, title case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASKED = 48  # characters of a mask
_EDGE = ".,;:'\"()“”‘’"


def key(value: Column) -> Column:
    """Lower case, white space collapsed: what makes two mentions the same string."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def stripped(value: Column, characters: str = _EDGE) -> Column:
    return F.btrim(value, F.lit(characters))


def normalised(value: Column) -> Column:
    """key() without outer punctuation and without one leading article."""
    bare = stripped(key(value))
    return F.trim(F.regexp_replace(bare, r"^(?:the|our|its|their|a|an)\s+", ""))


def mask(value: Column) -> Column:
    """Character shape of a value: capitals A, small letters a, digits 9, the rest as it is."""
    shape = F.substring(F.trim(value), 1, MASKED)
    for pattern, to in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"\p{Nd}", "9")):
        shape = F.regexp_replace(shape, pattern, to)
    return shape


def titled(value: Column) -> Column:
    """First letter of every ASCII letter run in capitals, the others small; length stays."""
    runs = F.regexp_extract_all(value, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def word_list(value: Column) -> Column:
    """Words with their inner punctuation, in order."""
    return F.regexp_extract_all(value, F.lit(r"[A-Za-z][A-Za-z'&.\-]*"), F.lit(0))


def letters_list(value: Column) -> Column:
    """Runs of a-z in the lower-cased value."""
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z]+"), F.lit(0))


def word_count(value: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(value, r"\s+"), lambda x: x != ""))
