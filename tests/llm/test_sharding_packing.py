import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import packing, sharding
from veilspan.llm.tables import table

SF = "/root/testdata/sf0.001"


def check_shards(rows, sources, n_shards):
    counts = Counter(r.shard for r in rows)
    each = [counts.get(s, 0) for s in range(n_shards)]
    assert max(each) - min(each) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixture = Counter((r.shard, r.source) for r in rows)
    for source, n in Counter(sources).items():
        assert all(abs(mixture.get((s, source), 0) - n / n_shards) <= 2 for s in range(n_shards))


def test_shards_of_the_table_match_the_mixture(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    rows = sharding.op6_sharding(spark, SF).collect()
    check_shards(rows, [d.source for d in docs.values()], 24)
    for r in rows:
        data = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_main_path_is_native(spark):
    plan = sharding.op6_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_hot_source_and_odd_rows(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "MIN_SLICES", 16)
    monkeypatch.setattr(sharding, "SLICE_ROWS", 20)
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 20 THEN NULL ELSE concat('s', id % 7) END AS source")
    check_shards(sharding.stratified_shards(docs, 7).collect(), [r.source for r in docs.collect()], 7)
    rows = sharding.stratified_shards(odd).collect()
    assert len(rows) == odd.count() and {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(8, 0)}
    assert sharding.stratified_shards(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    tops = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    rows = rng.integers(1, 30, 9)
    tokens = rows * (tops - rng.integers(0, 1 + tops.min() // 2))

    def padding(bounds):
        return sum(bounds[np.searchsorted(bounds, t)] * r - k for t, r, k in zip(tops, rows, tokens))

    for buckets in (1, 2, 3, 4, 9, 20):
        got = packing.optimal_boundaries(tops, rows, tokens, buckets)
        best = min(padding(list(c) + [tops[-1]]) for n in range(min(buckets, 9)) for c in itertools.combinations(tops[:-1], n))
        assert padding(got) == best and len(got) <= buckets and got[-1] == tops[-1]
    assert packing.optimal_boundaries(tops[:0], rows[:0], tokens[:0], 3) == []


def check_batches(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_length <= budget
        assert all(r.n_tokens <= r.bucket_length for r in b)
    for bucket in {r.bucket for r in rows}:
        sizes = sorted((len(b) for b in batches.values() if b[0].bucket == bucket), reverse=True)
        assert len(set(sizes[:-1])) <= 1  # all but the last are full


def test_batches_of_the_table_and_odd_rows(spark, odd, nothing):
    rows = packing.op7_packing(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    check_batches(rows, packing.BUDGET)
    words = {r.doc_id: r.n_tokens for r in packing.packed(odd, packing.word_count(odd.text), budget=100).collect()}
    assert (words[1], words[2], words[3], words[4], words[9]) == (0, 0, 0, 1, 15000)
    check_batches(packing.packed(odd, packing.word_count(odd.text), budget=100).collect(), 100)
    assert packing.packed(nothing, packing.word_count(nothing.text)).count() == 0


def slow_boundaries(tops, rows, tokens, buckets):
    """Least padding with at most so many buckets, trying every cut."""
    n = len(tops)
    cost = lambda i, j: sum(int(tops[j - 1]) * int(rows[k]) - int(tokens[k]) for k in range(i, j))
    table_ = [[cost(i, j) if i < j else 0 for j in range(n + 1)] for i in range(n + 1)]
    best = [0] + [table_[0][j] for j in range(1, n + 1)]
    for _ in range(1, min(buckets, n)):
        best = [0] + [min(best[i] + table_[i][j] for i in range(j)) for j in range(1, n + 1)]
    return best[n]


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_over_long_lengths_are_exact(seed):
    rng = np.random.default_rng(seed)
    tops = np.unique(rng.integers(1, 5_000_000, 60))
    rows = rng.integers(1, 10**9, len(tops))
    tokens = rows * tops
    for buckets in (1, 2, 5, 8):
        bounds = packing.optimal_boundaries(tops, rows, tokens, buckets)
        padding = sum(int(bounds[np.searchsorted(bounds, t)]) * int(r) - int(k) for t, r, k in zip(tops, rows, tokens))
        assert padding == slow_boundaries(tops, rows, tokens, buckets) and set(bounds) <= set(tops.tolist())


def test_boundaries_of_many_lengths_take_seconds():
    tops = np.arange(1, 200_001)
    rows = np.random.default_rng(1).integers(1, 100, len(tops))
    assert len(packing.optimal_boundaries(tops, rows, rows * tops, 8)) == 8


def test_buckets_of_a_table_with_long_texts_pad_least(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "CAST(1 + id * id * 7 % 9001 AS INT) AS size")
    rows = packing.packed(docs, F.col("size"), buckets=4).collect()
    lengths = Counter(r.n_tokens for r in rows)
    tops = np.array(sorted(lengths))
    n = np.array([lengths[x] for x in tops])
    assert sum(r.bucket_length - r.n_tokens for r in rows) == slow_boundaries(tops, n, n * tops, 4)
    assert {r.bucket_length for r in rows} <= set(lengths)
    check_batches(rows, packing.BUDGET)


def _order(*values):
    """Spark's order: nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


def test_shards_equal_a_slow_version(spark, odd):
    docs = odd.select("doc_id", "text", "source").unionByName(spark.range(20, 300).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 40 THEN NULL ELSE concat('s', id % 7) END AS source"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("unit", sharding._unit(F.xxhash64(F.lit(sharding.SEED), "doc_id", "text_crc32", "size"))).collect()
    mixed = []
    for source in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == source), key=lambda r: _order(r.unit, r.doc_id, r.text_crc32, r.size))
        mixed += [((2 * k - 1) / (2 * len(own)), r) for k, r in enumerate(own, 1)]
    mixed.sort(key=lambda x: (x[0], x[1].source is not None, x[1].source or "", _order(x[1].unit, x[1].doc_id, x[1].text_crc32, x[1].size)))
    n, want, filled = len(mixed), [], Counter()
    for k, (_, r) in enumerate(mixed, 1):
        shard = (24 * k - 1) // n
        want.append((str(r.doc_id), r.size, r.text_crc32, shard, filled[shard]))
        filled[shard] += 1
    got = [(str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.stratified_shards(docs).collect()]
    assert sorted(got) == sorted(want)


def test_batches_equal_a_slow_version(spark):
    docs = spark.range(500).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id % 200 END AS doc_id", "CAST(id * id * 13 % 700 AS INT) AS size")
    rows = docs.select("doc_id", F.col("size").cast("long").alias("n"), sharding._unit(F.xxhash64(F.lit(packing.SEED), "doc_id", F.col("size").cast("long"))).alias("unit")).collect()
    lengths = Counter(max(1, r.n) for r in rows)
    tops, tokens = np.array(sorted(lengths)), Counter()
    for r in rows:
        tokens[max(1, r.n)] += r.n
    bounds = packing.optimal_boundaries(tops, np.array([lengths[x] for x in tops]), np.array([tokens[x] for x in tops]), 5)
    want, start = [], 0
    for b, bound in enumerate(bounds):
        own = sorted((r for r in rows if (bounds[b - 1] if b else 0) < max(1, r.n) <= bound), key=lambda r: _order(r.unit, r.doc_id, r.n))
        each = max(1, 2000 // bound)
        want += [(str(r.doc_id), r.n, b, bound, start + k // each, k % each) for k, r in enumerate(own)]
        start += -(-len(own) // each)
    got = [(str(r.doc_id), r.n_tokens, r.bucket, r.bucket_length, r.batch, r.slot) for r in packing.packed(docs, F.col("size"), buckets=5, budget=2000).collect()]
    assert sorted(got) == sorted(want)
