import hashlib

import corpus_pipeline as cp
from brute import near_components, repeats_removed

from veilspan.llm import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark):
    stages = dict(cp.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.staged(stages["quality classifier"](spark, docs, SF), "t")
    gold = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in rows(good)}
    assert sum(d not in kept for d, q in gold.items() if q == 1) <= 0.03 * len(gold)
    assert sum(d in kept for d, q in gold.items() if q == 0) <= 2
    known = cp.staged(stages["language ID"](spark, good, SF), "t")
    assert known.count() >= 0.99 * good.count()
    apart = cp.staged(stages["MinHash near-dedup"](spark, known, SF), "t")
    assert {d for d, _ in rows(apart)} == {d for d, (_, c) in near_components(rows(known), cp.SIMILARITY_PERCENT).items() if d == c}
    clean = cp.staged(stages["substring dedup"](spark, apart, SF), "t")


    want = repeats_removed(rows(apart))
    assert {d: hashlib.sha256(x.encode()).hexdigest() for d, x in rows(clean)} == {d: w[2] for d, w in want.items()}
    for df in (good, known, apart, clean):
        assert df.columns == list(cp.COLUMNS)
    packed = stages["packing"](spark, clean, SF)
    assert packed.count() == clean.count()


def test_odd_rows_go_through(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in cp.STAGES:
            docs = cp.staged(stage(spark, docs, SF), "t")
        assert docs.columns[:2] == ["doc_id", "n_tokens"]


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c, short = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("a", 40), ("b", 40), ("c", 40), ("s", 8)))
    near = a + " tail"
    docs = [(1, a), (1, a), (2, near), (3, b), (3, a), (None, a), (None, c), (None, c), (4, short), (4, short), (5, ""), (6, None), (7, b)]
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_copies(spark, df.repartition(3), SF)
    assert got.columns == list(cp.COLUMNS)
    assert sorted(rows(got), key=str) == sorted([(1, a), (3, b), (None, c), (4, short), (5, ""), (6, None)], key=str)
    assert cp.drop_near_copies(spark, df.where("false"), SF).count() == 0
