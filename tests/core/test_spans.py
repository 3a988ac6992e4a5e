import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.functions import validators
from veilspan.operators import evaluate, overlap, recognizers, rewrite, surrogates, verify
from veilspan.plans import queries

SCHEMA = "doc_id long, entity_type string, start int, end int, score double, text string"


def greedy(found):
    rank = lambda d: (d[0] not in recognizers.STRUCTURED, d[1] - d[2], -d[3], d[1], d[0])
    kept = []
    for d in sorted(found, key=rank):
        if all(d[1] >= k[2] or d[2] <= k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_overlaps_equal_the_greedy_choice(spark):
    rng, docs = random.Random(7), {}
    for doc in range(150):
        docs[doc] = list({(rng.choice(["PERSON", "EMAIL_ADDRESS", "LOCATION"]), s := rng.randrange(60), s + rng.randrange(1, 15), rng.choice([0.5, 0.9, 1.0])) for _ in range(rng.randrange(1, 14))})
    df = spark.createDataFrame([(d, *x, "x") for d, xs in docs.items() for x in xs], SCHEMA)
    got = {}
    for r in overlap.resolve_overlaps(df).collect():
        got.setdefault(r.doc_id, []).append((r.entity_type, r.start, r.end, r.score))
    assert {d: sorted(x) for d, x in got.items()} == {d: greedy(x) for d, x in docs.items()}


ADDRESSES = [
    ("Registered Office: Lane Five, Old Town, Pune", [("ORGANIZATION", "Lane Five"), ("PERSON", "Old Town"), ("LOCATION", "Pune")], [("LOCATION", "Lane Five, Old Town, Pune")]),
    ("Lane Five, Pune - 411 001 and Rosa", [("ORGANIZATION", "Lane Five"), ("LOCATION", "Pune - 411 001"), ("PERSON", "Rosa")], [("LOCATION", "Lane Five, Pune - 411 001 and Rosa")]),
    ("address: Lane Five; Pune", [("PERSON", "Lane Five"), ("LOCATION", "Pune")], [("PERSON", "Lane Five"), ("LOCATION", "Pune")]),
    ("address: Lane Five telephone Pune", [("PERSON", "Lane Five"), ("LOCATION", "Pune")], [("PERSON", "Lane Five"), ("LOCATION", "Pune")]),
    ("met Lane Five, Pune", [("PERSON", "Lane Five"), ("LOCATION", "Pune")], [("PERSON", "Lane Five"), ("LOCATION", "Pune")]),
    ("address: Lane\nPune", [("PERSON", "Lane"), ("LOCATION", "Pune")], [("PERSON", "Lane"), ("LOCATION", "Pune")]),
    ("address: Lane a@b.example Pune", [("PERSON", "Lane"), ("EMAIL_ADDRESS", "a@b.example"), ("LOCATION", "Pune")], [("PERSON", "Lane"), ("EMAIL_ADDRESS", "a@b.example"), ("LOCATION", "Pune")]),
]


def test_addresses(spark):
    rows = [(i, k, t.index(x), t.index(x) + len(x), 0.5, x) for i, (t, parts, _) in enumerate(ADDRESSES) for k, x in parts]
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ADDRESSES)], "doc_id long, text string")
    got = {}
    for r in overlap.merge_addresses(spark.createDataFrame(rows, SCHEMA), texts).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append((r.entity_type, r.text))
    for i, (_, _, want) in enumerate(ADDRESSES):
        assert got[i] == want, ADDRESSES[i][0]


def test_canonical_names_are_word_aligned(spark):
    names = ["Zenith", "Zenith Harbour", "ZENITH  Harbour Limited", "A Birch", "A B Birch", "Zen"]
    df = spark.createDataFrame([(1, "ORGANIZATION", x) for x in names] + [(1, "PERSON", "Harbour"), (2, "ORGANIZATION", "Zenith")], "doc_id long, entity_type string, text string")
    got = {(r.doc_id, r.variant): r.canonical for r in overlap.canonical_names(df).collect()}
    assert got == {(1, "zenith"): "zenith harbour limited", (1, "zenith harbour"): "zenith harbour limited"}


def test_hosts(spark, col):
    assert col(overlap.registrable_host(F.col("u")), u="https://www.Issuer.example. com/x?y") == "issuer.example.com"
    df = spark.createDataFrame([(1, "WEB_ADDRESS", "https://a.example.com/x"), (1, "PERSON", "b.example.com")], "doc_id long, entity_type string, text string")
    assert {(r.variant, r.canonical) for r in overlap.host_aliases(df).collect()} == {("a.example.com", "https://a.example.com/x"), ("www.a.example.com", "https://a.example.com/x")}


def test_five_hundred_people_have_five_hundred_surrogates(spark):
    df = spark.range(500).selectExpr("1L AS doc_id", "'PERSON' AS entity_type", "concat('Person Number', id) AS text", "cast(id AS int) AS start")
    once, again = (surrogates.mapping(df, types=("PERSON",)).orderBy("key").collect() for _ in range(2))
    assert once == again and len({r.surrogate for r in once}) == 500
    assert not any(c.isdigit() or c == "(" for r in once for c in r.surrogate)
    many = spark.range(6000).selectExpr("1L AS doc_id", "'IP_ADDRESS' AS entity_type", "concat('10.0.', id) AS text", "cast(id AS int) AS start")
    mapped = surrogates.mapping(many, types=("IP_ADDRESS",))
    assert mapped.select("surrogate").distinct().count() == 6000 and surrogates.collisions(mapped).count() == 0
    assert mapped.where(validators.is_ipv4(F.col("surrogate"))).count() == 6000


def test_addresses_beyond_their_first_pool_are_addresses(spark, monkeypatch):
    monkeypatch.setitem(surrogates.GENERATORS, "IP_ADDRESS", lambda d, o: F.concat(F.lit("198.18.0."), d.between(0, 1, 9)))
    many = spark.range(300).selectExpr("1L AS doc_id", "'IP_ADDRESS' AS entity_type", "concat('10.0.', id) AS text", "cast(id AS int) AS start")
    got = {r.surrogate for r in surrogates.mapping(many, types=("IP_ADDRESS",)).where(validators.is_ipv4(F.col("surrogate"))).collect()}
    assert len(got) == 300 and sum(x.startswith("198.18.0.") for x in got) == 9


def test_an_empty_pool_ends_in_numbers(spark, monkeypatch):
    monkeypatch.setitem(surrogates.GENERATORS, "PERSON", lambda d, o: F.concat(F.lit("P"), d.between(0, 1, 20)))
    df = spark.range(30).selectExpr("1L AS doc_id", "'PERSON' AS entity_type", "concat('Person ', id) AS text", "cast(id AS int) AS start")
    got = [r.surrogate for r in surrogates.mapping(df, types=("PERSON",)).collect()]
    assert len(set(got)) == 30 and sum(" " not in x for x in got) >= 18


def test_first_type_names_a_key_and_aliases_follow(spark):
    df = spark.createDataFrame([(1, "PERSON", "Zenith", 5), (1, "ORGANIZATION", "ZENITH", 2), (1, "ORGANIZATION", "Zenith Harbour", 9)], "doc_id long, entity_type string, text string, start int")
    mapped = surrogates.mapping(df)
    assert {r.key: r.entity_type for r in mapped.collect()} == {"zenith": "ORGANIZATION", "zenith harbour": "ORGANIZATION"}
    aliases = spark.createDataFrame([(1, "Zenith", "Zenith Harbour"), (1, "ZH", "zenith  harbour"), (1, "Other", "Not There")], "doc_id long, variant string, canonical string")
    got = {r.key: r for r in surrogates.with_aliases(mapped, aliases).collect()}
    assert set(got) == {"zenith", "zenith harbour", "zh"} and len({r.surrogate for r in got.values()}) == 1
    assert verify.shared_surrogates(surrogates.with_aliases(mapped, aliases)).count() == 1


def test_the_last_alias_wins_and_chains_are_followed(spark):
    names = ["A", "B", "C", "D", "X", "Y"]
    df = spark.createDataFrame([(1, "PERSON", n, i) for i, n in enumerate(names)], "doc_id long, entity_type string, text string, start int")
    mapped = surrogates.mapping(df)
    rows = [("A", "B", 0), ("B", "C", 1), ("N", "A", 0), ("D", "X", 0), ("D", "C", 2), ("X", "Y", 0), ("Y", "X", 0)]
    aliases = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, variant string, canonical string, turn int")
    got = {r.key: r.surrogate for r in surrogates.with_aliases(mapped, aliases).collect()}
    own = {r.key: r.surrogate for r in mapped.collect()}
    assert {got[k] for k in "abcdn"} == {own["c"]} and got["x"] == got["y"] and len(got) == 7


REWRITES = [
    ("Ann Lee met ANN   LEE and ann\nlee.", "Bo Ray met Bo Ray and Bo Ray.", 3),
    ("Annlee, Ann Leeds, xAnn Lee, Ann Lee's", "Annlee, Ann Leeds, xAnn Lee, Bo Ray's", 1),
    ("mail zen@x.example or zen, not @zen", "mail Q@y.example or Z1, not @zen", 2),
    ("Ann Lee Harbour", "C1", 1),
    ("ब्रिज और é++ end", "पुल और P end", 2),
    ("a.b and axb", "DOT and axb", 1),
    ("", "", 0),
    (None, None, 0),
]
MAPPING = {"ann lee": "Bo Ray", "ann lee harbour": "C1", "zen": "Z1", "zen@x.example": "Q@y.example", "ब्रिज": "पुल", "é++": "P", "a.b": "DOT"}


@pytest.mark.parametrize("corpus", [False, True])
def test_rewriting(spark, corpus):
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(REWRITES)], "doc_id long, text string")
    rows = [(i, k, v) for i in range(1 if corpus else len(REWRITES)) for k, v in MAPPING.items()]
    mapped = spark.createDataFrame(rows, "doc_id long, key string, surrogate string")
    out = rewrite.rewrite(texts, mapped.drop("doc_id") if corpus else mapped, () if corpus else ("doc_id",))
    got = {r.doc_id: (r.text, r.replacements) for r in out.collect()}
    assert got == {i: (w, n) for i, (_, w, n) in enumerate(REWRITES)}


def test_splicing(spark):
    texts = spark.createDataFrame([(1, "😀ab cd"), (2, "none")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 4, 6, "Y"), (1, 1, 3, "X")], "doc_id long, start int, end int, surrogate string")
    assert {r.doc_id: (r.text, r.replacements) for r in rewrite.spliced(texts, spans).collect()} == {1: ("😀X Y", 2), 2: ("none", 0)}


def scored(spark, detections, annotations, criterion, region=None):
    make = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "doc_id long, entity_type string, start int, end int")
    counts = evaluate.per_type(evaluate.matched(make(detections), make(annotations), criterion, region))
    return {r.entity_type: (r.tp, r.fp, r.fn) for r in counts.collect()}


def test_scoring(spark):
    address = [("LOCATION", 0, 60)]
    parts = [("LOCATION", 0, 20), ("LOCATION", 22, 40), ("PERSON", 42, 60)]
    assert scored(spark, address, parts, "strict") == {"LOCATION": (0, 1, 2), "PERSON": (0, 0, 1)}
    assert scored(spark, address, parts, "relaxed") == {"LOCATION": (2, 0, 0), "PERSON": (0, 0, 1)}
    assert scored(spark, address, parts, "coverage") == {"LOCATION": (2, 0, 0), "PERSON": (1, 0, 0)}
    assert scored(spark, [("PERSON", 5, 10), ("PERSON", 6, 11)], [("PERSON", 5, 10), ("PERSON", 90, 99)], "strict", (0, 50)) == {"PERSON": (1, 1, 0)}
    assert scored(spark, [("PERSON", 0, 4)], [("PERSON", 2, 7)], "strict") == {"PERSON": (0, 1, 1)}


def test_rates(spark):
    counts = spark.createDataFrame([("A", 3, 1, 1), ("B", 0, 0, 0)], "entity_type string, tp long, fp long, fn long")
    a, b = evaluate.rates(counts).orderBy("entity_type").collect()
    assert (a.precision, a.recall, a.f1, a.accuracy) == (0.75, 0.75, 0.75, 0.6) and (b.precision, b.f1, b.accuracy) == (0, 0, 0)
    assert evaluate.micro(counts).first().f1 == 0.75 and evaluate.macro(counts).first().macro_f1 == 0.375


def test_located_values(spark):
    texts = spark.createDataFrame([(1, "Ann Lee, then ann  lee; Anna")], "doc_id long, text string")
    values = spark.createDataFrame([(1, "PERSON", "Ann Lee"), (1, "PERSON", "ann lee")], "doc_id long, entity_type string, value string")
    assert sorted((r.start, r.end) for r in evaluate.located(values, texts).collect()) == [(0, 7), (14, 22)]


def test_located_values_as_written(spark):
    schema = "doc_id long, entity_type string, value string"
    values = spark.createDataFrame([(1, "PHRASE", "Of  the"), (1, "PHRASE", "of the"), (None, "PHRASE", "of the")], schema)
    texts = spark.createDataFrame([(1, "OF The, of\nthe, of  the, _of the, of the_; éof theé"), (None, "of the"), (1, None)], "doc_id long, text string")
    got = evaluate.located(values, texts, exact=True).collect()
    assert sorted((r.doc_id or 0, r.start, r.end) for r in got) == [(0, 0, 6), (1, 0, 6), (1, 16, 23), (1, 44, 50)]


ODD = "Of the_ of\nThe of\t the, _de la DE LA the  that éof theé of the of the that 😀de la"


def test_located_values_agree_with_their_sql_on_odd_texts(spark, tmp_path):
    rows = [(1, ODD), (None, ODD), (2, None), (2, ""), (3, "of the"), (3, "x of the")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(queries.ORACLE["located_values"])
    got = queries.QUERIES["located_values"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str) != []


def test_verification(spark):
    texts = spark.createDataFrame([(1, "Zenith stays, zenith; see www.a.example.com and https://b.example.org")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "Zenith"), (1, "Gone"), (1, "")], "doc_id long, value string")
    assert [(r.value, r.hits) for r in verify.leaks(texts, known).collect()] == [("Zenith", 2)]
    assert [r.phrase for r in verify.missing(texts, ("stays", "absent")).collect()] == ["absent"]
    assert [r.host for r in verify.foreign_hosts(texts, ("example.com",)).collect()] == ["b.example.org"]
    assert verify.probes(known).count() == 0
