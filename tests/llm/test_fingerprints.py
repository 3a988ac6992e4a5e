import hashlib

import numpy as np
from brute import shingles
from pyspark.sql import functions as F

from veilspan.llm import fingerprints as fp
from veilspan.llm.tables import table

SF = "/root/testdata/sf0.001"


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs, got, tolerance):
    docs = sorted(docs, key=lambda d: d[0])
    by = {r.doc_id: r for r in got}
    assert len(by) == len(docs)
    errors = []
    for i, (d, text) in enumerate(docs):
        text, near = text or "", docs[i - 1][1] or ""
        edited = text[: len(text) - len(text) // 2] + near[: len(text) // 2]
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r.near_edited - resemblance(text, edited)), abs(r.near_next - resemblance(text, near))]
    assert max(errors) < tolerance and sum(errors) / len(errors) < tolerance / 8


def test_edited_texts_and_likeness_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = fp.op2_fingerprints(spark, SF).collect()
    check(docs, got, 0.2)
    prints = {}
    for r in got:
        prints.setdefault(dict(docs)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_few_and_odd_rows(spark, odd, nothing):
    for docs in ([(5, "alone é here is one text only")], [(1, None), (2, "")], [(3, "a b c d e f"), (9, "好" * 7), (4, None)]):
        check(docs, fp.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect(), 0.01)
    assert fp.edited_fingerprints(odd).count() == odd.count()
    assert fp.edited_fingerprints(nothing).count() == fp.sketches(nothing).count() == 0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, 1, " ".join(words[:2000])), (0, 2, " ".join(words[1996:3000])), (1, 3, " ".join(words)), (1, 4, " ".join(words[:1000]))]
    df = spark.createDataFrame(rows, "g int, doc_id long, text string")
    sketch = fp.sketches(df, k=64).join(df.select("doc_id", "g"), "doc_id")
    both = fp.merge_groups(sketch.where("g = 0"), "g", k=64).select(F.col("sketch").alias("a")).crossJoin(sketch.where("doc_id = 3").select(F.col("sketch").alias("b")))
    row = both.select(F.col("a") == F.col("b"), fp.resemblance(F.col("a"), F.col("b"), 64), fp.distinct_count(F.col("a"), 64)).first()
    assert row[0] and row[1] == 1.0 and abs(row[2] - 2996) < 1200
    parts = {r.doc_id: F.array(*[F.lit(int(x)) for x in r.sketch]) for r in sketch.collect()}
    near, held = spark.range(1).select(fp.resemblance(parts[3], parts[4], 64), fp.containment(parts[4], parts[3], 64)).first()
    assert abs(near - 1 / 3) < 0.2 and held > 0.7


def test_likeness_of_arrays():
    a, b = np.arange(0, 100, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)
    assert fp.likeness(a, a) == 1.0 and fp.likeness(a, b, 1000) == 1 / 3
    assert fp.likeness(a[:0], b) == 0.0 and fp.likeness(a[:0], b[:0]) == 1.0
