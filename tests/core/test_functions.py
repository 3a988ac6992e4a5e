import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import spans, text, validators
from veilspan.operators import recognizers
from veilspan.plans import redaction

VECTORS = [
    ("IN_AADHAAR", "3141 5926 5351", True), ("IN_AADHAAR", "3141 5926 5352", False), ("IN_AADHAAR", "0141 5926 5351", False), ("IN_AADHAAR", "314159265351", True),
    ("IN_AADHAAR", "31415926535", False), ("IN_AADHAAR", "3141592653510", False), ("IN_PAN", "ABCPD1234E", True), ("IN_PAN", "abcpd 1234e", True),
    ("IN_PAN", "ABCZD1234E", False), ("IN_PAN", "ABCDE1234", False), ("IN_PAN", "ABCD12345F", False), ("CREDIT_CARD", "4539578763621486", True),
    ("CREDIT_CARD", "4539 5787 6362 1486", True), ("CREDIT_CARD", "4539578763621487", False), ("CREDIT_CARD", "42", False), ("IN_GSTIN", "27AAPFU0939F1ZV", True),
    ("IN_GSTIN", "27AAPFU0939F1ZX", False), ("IN_GSTIN", "39AAPFU0939F1ZV", False), ("IN_IFSC", "HDFC0001234", True), ("IN_IFSC", "HDFC1001234", False),
    ("IN_MOBILE", "+91 9876543210", True), ("IN_MOBILE", "09876543210", True), ("IN_MOBILE", "1234567890", False), ("IN_PASSPORT", "A1234567", True),
    ("IN_PASSPORT", "Q1234567", False), ("IN_PASSPORT", "A123456", False), ("IN_VOTER_ID", "ABC1234567", True), ("IN_VOTER_ID", "AB1234567", False),
    ("IP_ADDRESS", "203.0.113.9", True), ("IP_ADDRESS", "203.0.113.256", False), ("IBAN_CODE", "GB82 WEST 1234 5698 7654 32", True), ("IBAN_CODE", "GB82 WEST 1234 5698 7654 33", False),
]


def test_validators(spark):
    df = spark.createDataFrame(VECTORS, "kind string, value string, expected boolean")
    check = None
    for kind, f in validators.VALIDATORS.items():
        check = F.when(F.col("kind") == kind, f(F.col("value"))) if check is None else check.when(F.col("kind") == kind, f(F.col("value")))
    assert [tuple(r) for r in df.where(check != F.col("expected")).collect()] == []
    assert df.where(check.isNull()).count() == 0


def test_checksum_rejects_nine_of_ten_and_the_digit_repairs_it(spark):
    rng = random.Random(42)
    df = spark.createDataFrame([(str(rng.randrange(2 * 10**11, 10**12)),) for _ in range(5000)], "n string")
    valid = df.where(validators.is_aadhaar(F.col("n"))).count()
    assert 400 < valid < 600
    repaired = F.concat(F.substring("n", 1, 11), validators.verhoeff_digit(F.substring("n", 1, 11)))
    assert df.where(~validators.is_aadhaar(repaired)).count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab12 .@é😀\n", max_size=40), min_size=1, max_size=20))
def test_offsets_slice_back(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", spans.scan(F.col("t"), spans.bounded("[ab]+[0-9]*")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"(?<![A-Za-z0-9_])(?:[ab]+[0-9]*)(?![A-Za-z0-9_])", t)]
        assert got[i] == want


def test_null_text_has_no_spans(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert recognizers.detect(df).count() == 0


@pytest.mark.parametrize(
    ("value", "kind", "found"),
    [
        ("write to a.b@mail.example. com now", "EMAIL_ADDRESS", ["a.b@mail.example. com"]),
        ("see www .issuer.example.com/x, or https://a.example.org", "WEB_ADDRESS", ["www .issuer.example.com/x", "https://a.example.org"]),
        ("éABCPD1234E and ABCPD1234E", "IN_PAN", ["ABCPD1234E", "ABCPD1234E"]),
        ("adobo 1/2/1990", "DATE_OF_BIRTH", []),
        ("DOB: 1/2/1990 and March 3, 1990", "DATE_OF_BIRTH", ["1/2/1990", "March 3, 1990"]),
        ("जन्म तिथि 1990-02-03", "DATE_OF_BIRTH", ["1990-02-03"]),
        ("meeting of " + "x" * 80 + " 1/2/1990", "DATE_OF_BIRTH", []),
        ("call +1 (168) 555-5254", "PHONE_NUMBER", ["+1 (168) 555-5254"]),
        ("at 300.1.1.1 and 10.1.1.1", "IP_ADDRESS", ["10.1.1.1"]),
    ],
)
def test_recognizers(spark, value, kind, found):
    df = spark.createDataFrame([(1, value)], "doc_id long, text string")
    rows = recognizers.detect(df, wanted=(kind,)).orderBy("start").collect()
    assert [r.text for r in rows] == found
    assert all(value[r.start : r.end] == r.text for r in rows)


def test_email_filter_reaches_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = recognizers.detect(docs, wanted=("EMAIL_ADDRESS",))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,@)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Python" not in plan


def test_context_and_floor(spark):
    weak = recognizers.Recognizer("X", r"[A-Z]\d{3}", 0.2, ("badge",))
    df = spark.createDataFrame([(1, "badge A123"), (2, "seat A123")], "doc_id long, text string")
    got = recognizers.detect(df, recognizers=[weak]).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(1, 0.55)]


@pytest.mark.parametrize(("value", "shape"), [("Rakhi É 12", "Aaaaa A 99"), ("  x\tY-ß9 ", "a\tA-a9"), ("a" * 60, "a" * 48)])
def test_mask(col, value, shape):
    assert col(text.mask(F.col("v")), v=value) == shape


def test_text_shapes(col):
    assert col(text.key(F.col("v")), v="  A \n b ") == "a b"
    assert col(text.normalised(F.col("v")), v="“The  Equity Shares.”") == "equity shares"
    assert col(text.titled(F.col("v")), v="TABLE OF O'NEIL-X & é") == "Table Of O'Neil-X & é"


@pytest.mark.parametrize(
    ("value", "kind", "found"),
    [
        ("mobile 09876543210, 98765 43210 or 91-9876543210", "IN_MOBILE", ["09876543210", "98765 43210", "91-9876543210"]),
        ("folio 12345 67890, 1234567890, x9876543210, 98765432101", "IN_MOBILE", []),
        ("Tel: 022 2345 6789 or (0265) 234 5678, fax 04142-234567", "PHONE_NUMBER", ["022 2345 6789", "(0265) 234 5678", "04142-234567"]),
        ("folio 022 2345 6789 of the register", "PHONE_NUMBER", []),
        ("Tel: 02223456789 and +91 22 2345 6789", "PHONE_NUMBER", ["02223456789", "+91 22 2345 6789"]),
    ],
)
def test_national_numbers(spark, value, kind, found):
    test_recognizers(spark, value, kind, found)


def test_national_numbers_are_redacted(spark):
    text = "Tel: 022 2345 6789 or mobile 09876543210."
    got = redaction.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.replacements == 2 and "2345 6789" not in got.text and "9876543210" not in got.text
