import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: Rows that every operator must take: nulls, empty and long texts, ties, repeats, other columns.
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, "a", 6),
    (4, "word", "fr", None, 4),
    (5, "one two three four", "en", "b", 18),
    (6, "the same words stand here in two of the documents of this small table " * 2, "en", "b", 1),
    (7, "the same words stand here in two of the documents of this small table " * 2, "en", "b", 1),
    (8, "Éa ß 😀 好 naïve   text with marks!!! and 12 numbers 3.5", "de", "b", 1),
    (8, "Éa ß 😀 好 naïve   text with marks!!! and 12 numbers 3.5", "de", "b", 1),
    (9, "lorem ipsum dolor sit amet " * 3000, "en", "b", 1),
    (10, "x" * 5000, "en", "b", 1),
    (11, "".join(chr(0x4E00 + i * i % 97) for i in range(400)), "en", "b", 400),
    (None, "a row without an id has words too", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Clashing names: columns that operators make themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("n", "shard", "score", "keep", "component_id", "bucket", "block", "key", "ids", "_text"):
        df = df.selectExpr("*", f"'other' AS {name}")
    return df


@pytest.fixture
def nothing(odd):
    return odd.where("false")
