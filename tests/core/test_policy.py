import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import spans as scans
from veilspan.operators import policy, vocabulary

CASES = [
    ("IN_AADHAAR", "3141 5926 5351", "", None),
    ("PHONE_NUMBER", "Telephone", "", "not shaped like its type"),
    ("BANK_ACCOUNT", "481920", "Order No. ", "transaction reference"),
    ("BANK_ACCOUNT", "481920", "paid to ", None),
    ("ORGANIZATION", "Registered Office", "", "field label"),
    ("ORGANIZATION", "Zenith\nTelephone: 1", "", "malformed"),
    ("ORGANIZATION", "National Stock Exchange of India", "", "public body"),
    ("ORGANIZATION", "India Limited", "listed on the National Stock Exchange of ", "public body"),
    ("ORGANIZATION", "India Limited", "shares of ", "company-name filler"),
    ("ORGANIZATION", "Hindi", "", "language name"),
    ("ORGANIZATION", "the Board", "", "common word"),
    ("PERSON", "quiet river", "", "lower case"),
    ("PERSON", "Quiet River", "", None),
    ("ORGANIZATION", "The face value of the shares", "", "prose"),
    ("ORGANIZATION", "THE SIZE OF THE OFFER PRICE X", "", "prose"),
    ("WEB_ADDRESS", "www.bseindia.com", "", "public host"),
    ("WEB_ADDRESS", "https://sebi.gov.in/x", "", "public host"),
    ("WEB_ADDRESS", "www.issuer.example. com", "", None),
    ("WEB_ADDRESS", "see this page for more about it", "", "not shaped like its type"),
    ("ORGANIZATION", "SCSBs", "", "document-defined term"),
    ("ORGANIZATION", "Red Herring", "", "document vocabulary"),
    ("ORGANIZATION", "Herring", "", "document-defined term"),
    ("ORGANIZATION", "Allotted Working Days", "", "document vocabulary"),
    ("ORGANIZATION", "Allotted Working Days Bank", "", None),
    ("ORGANIZATION", "Urja Suraksha", "", "reference vocabulary"),
    ("ORGANIZATION", "ja Suraksha", "", None),
    ("ORGANIZATION", "Market Data And Currency", "", "heading"),
    ("PERSON", "Delay In Placing", "", "written in lower case elsewhere in the document"),
    ("PERSON", "  ", "", "empty"),
    ("PERSON", "Al", "", "too short"),
]


def test_decisions(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, kind string, value string, before string, expected string")
    words = lambda *x: F.array(*[F.lit(v) for v in x])
    terms = words("scsb(s)", "red herring prospectus", "working day", "working days", "allotted")
    got = policy.decision(F.col("kind"), F.col("value"), F.col("before"), terms, words("kisan urja suraksha evam"), words("USE OF MARKET DATA AND CURRENCY OF PRESENTATION"), F.col("value") == "Delay In Placing")
    wrong = df.withColumn("got", got).where(~F.col("got").eqNullSafe(F.col("expected"))).collect()
    assert [tuple(r) for r in wrong] == []


@pytest.mark.parametrize(("kind", "value", "bare"), [("LOCATION", "Pune", True), ("LOCATION", "Pune 411001", False), ("LOCATION", "A b c d", False), ("PERSON", "Pune", False)])
def test_bare_places(col, kind, value, bare):
    assert col(policy.is_bare_place(F.col("k"), F.col("v")), k=kind, v=value) is bare


def test_glossary(spark):
    rows = [
        (1, 0, ["Zenith", "before the glossary, so of no account here at all"]),
        (1, 1, ["Term", "Description"]),
        (1, 2, ["Rs. / Rupees / INR", "the lawful currency in which all amounts are stated"]),
        (1, 3, ["BookRunningLeadManagers", "those who run the book and are named in the cover pages"]),
        (1, 4, ["IST", "Indian Standard Time"]),
        (1, 5, ["Zenith", "Zenith Harbour Holdings Limited"]),
        (1, 6, ["Corporate Promoter", "Quarry Lane Park Private Limited"]),
        (1, 7, ["NSB", "Northern State Bank"]),
        (1, 8, ["Particulars", "Amount"]),
        (1, 9, ["Revenue", "one two three four five six seven eight"]),
        (2, 0, ["Revenue"]),
    ]
    got = {(r.kind, r.phrase, r.full) for r in vocabulary.learn_tables(spark.createDataFrame(rows, "doc_id long, row_no int, cells array<string>")).collect()}
    assert {("term", x, None) for x in ("rupees", "inr", "rs", "bookrunningleadmanagers", "book running lead managers", "ist", "indian standard time")} <= got
    assert ("reference", "indian standard time", None) in got and ("alias", "Zenith", "Zenith Harbour Holdings Limited") in got
    assert not any(p in ("revenue", "zenith", "corporate promoter", "nsb", "northern state bank") for _, p, _ in got if _ != "alias")
    assert ("alias", "NSB", "Northern State Bank") in got


def test_prose_glossary(spark):
    lines = ["Foo means nothing yet", "DEFINITIONS AND ABBREVIATIONS", "Offer Price means the price of it", "Bidder: who bids", "plain line", "RISK FACTORS", "Later means nothing"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, block_no int, text string")
    assert {r.phrase for r in vocabulary.learn_prose(df).collect()} == {"offer price", "bidder"}


def test_uncapitalised_phrases(spark):
    texts = spark.createDataFrame([(1, "Delay in it. We fear any delay in\nplacing The Orders, post-offer"), (2, "Delay in it")], "doc_id long, text string")
    asked = spark.createDataFrame([(d, p) for d in (1, 2) for p in ("delay in", "in placing", "placing the orders", "the orders", "post-offer", "delay in it")], "doc_id long, phrase string")
    got = {(r.doc_id, r.phrase) for r in vocabulary.uncapitalised(asked, texts).collect()}
    assert got == {(1, "delay in"), (1, "placing the orders"), (1, "post-offer")}
    every = {r.p for r in texts.where("doc_id = 1").select(F.explode(F.split("text", "\n")).alias("l")).select(F.explode(vocabulary.phrases(F.col("l"))).alias("p")).collect()}
    assert {"delay in", "placing the orders", "post-offer", "we fear"} & every == {"delay in", "placing the orders", "post-offer"}


def test_headings_and_truecase(spark, col):
    doc = "TABLE OF CONTENTS\nRISK FACTORS12\nASHA BIRCH CEDAR signs\nx\nTABLE OF CONTENTS"
    df = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    found = vocabulary.heading_lines(df).orderBy("start").collect()
    assert [(r.heading, doc[r.start : r.end]) for r in found] == [(x, x) for x in ("TABLE OF CONTENTS", "RISK FACTORS12", "TABLE OF CONTENTS")]
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(17).alias("end")))
    recased = col(vocabulary.truecased(F.col("t"), spans), t=doc)
    assert len(recased) == len(doc) and "Asha Birch Cedar signs" in recased and recased.startswith("TABLE OF CONTENTS")


def test_chunks_cover_the_text(col):
    text = ("Some words here. " * 30 + "\n") * 20 + "no break " * 400
    got = col(vocabulary.chunks(F.col("t")), t=text)
    assert all(text[c.start : c.start + len(c.text)] == c.text and len(c.text) <= 1200 for c in got)
    assert all(a.start < b.start <= a.start + len(a.text) for a, b in zip(got, got[1:])) and got[-1].start + len(got[-1].text) == len(text)
    assert col(vocabulary.chunks(F.col("t")), t="") == []


def chunks_one_by_one(text, size=60, overlap=10):
    at, out = 0, []
    while text:
        piece = text[at : at + size]
        last = at + size >= len(text)
        ends = [i for i in range(size // 2, len(piece)) if piece[i] == "\n" or piece[i : i + 2] == ". "]
        n = len(piece) if last or not ends else ends[-1] + 1
        out.append((at, piece[:n]))
        if last:
            break
        at += n - overlap
    return out


def test_chunks_are_those_of_a_walk(spark):
    texts = []
    for seed in range(60):
        draw = random.Random(seed)
        texts.append("".join(draw.choice(["a", "b", "é😀", " ", ". ", ".", "\n", "word " * 3, "x" * 70]) for _ in range(draw.choice([0, 5, 80, 300]))))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", vocabulary.chunks(F.col("t"), 60, 10).alias("c")).collect()
    assert {r.i: [(c.start, c.text) for c in r.c] for r in rows} == {i: chunks_one_by_one(x) for i, x in enumerate(texts)}


def test_scans_of_many_matches(spark):
    rows = spark.createDataFrame([(n, "é1" * n + "z") for n in (0, 1, 2, 700)], "n int, t string").select("n", scans.scan(F.col("t"), r"\d").alias("s")).collect()
    assert all([(s.start, s.end, s.text) for s in r.s] == [(2 * i + 1, 2 * i + 2, "1") for i in range(r.n)] for r in rows)
