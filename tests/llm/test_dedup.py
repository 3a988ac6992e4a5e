import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import WORD, near_components, repeats_removed

from veilspan.llm import near_dedup, substring_dedup, tables
from veilspan.llm.tables import table

SF = "/root/testdata/sf0.001"


def families(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Copies of a few bases with more and more words changed, so links stand near the threshold."""
    rng, out = random.Random(seed), []
    for base in range(5):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(n // 5):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            out.append((rng.randrange(10**6), " ".join(own)))
    return list(dict(out).items())


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_components_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    docs = families(percent)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(docs, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = near_dedup.op8_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(docs)


def test_odd_rows_near(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert [by[i].component_id for i in (1, 2, 3, 4, 6, 7, 8)] == [1, 2, 3, 4, 6, 6, 8]
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_needed_matches_lose_next_to_nothing():
    assert near_dedup.needed(16, 0.85) == 4
    assert (near_dedup.sketch_needed(0.85)[1:] <= range(1, 257)).all()


@pytest.mark.parametrize("block", [200, 1 << 22])
def test_repeats_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rng = random.Random(block)
    passages = [" ".join(f"p{rng.randrange(50)}" for _ in range(rng.choice([19, 20, 21, 45]))) for _ in range(6)]
    docs = [(i * 3 % 101, " ".join(rng.choice([rng.choice(passages), f"u{rng.randrange(10**6)}", "a a a a a"]) for _ in range(rng.randrange(12)))) for i in range(80)]
    docs += [(500, "z " * 60), (501, "z\t" * 25), (502, None), (503, "")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats_removed(docs)
    for r in got:
        assert sum(b - a for a, b in r.removed_spans) == r.n_removed


def test_repeats_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = substring_dedup.op5_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats_removed(docs)


def test_odd_rows_repeats(odd, nothing):
    got = substring_dedup.remove_repeats(odd, keep_columns=("lang", "source")).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].text == by[2].text == by[3].text == "" and by[1].n_words == 0
    assert by[6].n_removed == 0 and by[7].n_removed == by[7].n_words == 28
    assert by[None].n_removed == 0 and by[None].lang == "en"
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_cuts_are_short_prefixes_and_keep_order():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    hashes = words[np.minimum(rng.zipf(1.4, 30_000), 40) - 1]
    at = np.arange(len(hashes) - 20)
    letters, path = substring_dedup.letters_of(hashes, at), substring_dedup.rolled(hashes, 20)[at]
    cuts = substring_dedup.Cuts(letters[::3], path[::3], 50)
    order = np.lexsort((path, letters))
    group = cuts.group(letters, path)
    assert (np.diff(group[order]) >= 0).all() and 40 < len(np.unique(group)) <= 50
    assert np.bincount(group).max() < 3 * len(at) / 50
    depth = {next((k for k in (1, 2, 3) if not int(x) & (1 << 64 - 16 * k) - 1), 4) for x in cuts.letters}
    assert len(depth) > 1  # prefixes of several lengths
    assert len(substring_dedup.Cuts(letters[:0], path[:0], 5).group(letters, path)) == len(at)
    same = substring_dedup.Cuts(np.repeat(letters[:1], 1000), np.repeat(path[:1], 1000), 9)  # one suffix everywhere
    assert set(same.group(letters[:1], path[:1]).tolist()) == {0}


@pytest.mark.parametrize("seed", range(3))
def test_internal_nodes_of_a_sorted_subtree(seed):
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, 400)] * np.uint64(2)
    window = 6
    at = np.arange(400 - window + 1)
    letters, path = substring_dedup.letters_of(hashes, at, window), substring_dedup.rolled(hashes, window)[at]
    order = np.lexsort((path, letters))
    common = substring_dedup.lcp(letters[order], path[order], window)
    for depth in (1, 2, 3, window):
        want = Counter(tuple(hashes[i : i + depth].tolist()) for i in at)
        first, last = substring_dedup.nodes(common, depth)
        got = {tuple(hashes[at[order[a]] : at[order[a]] + depth].tolist()): b - a for a, b in zip(first.tolist(), last.tolist(), strict=True)}
        assert got == {k: n for k, n in want.items() if n > 1}


def maximal_repeats(docs, n):
    """doc_id to (start, end, source, source start): rows of windows whose earliest places move on together."""
    first, out = {}, {}
    for d, text in sorted(docs):
        words, runs = WORD.findall(text or ""), []
        for i in range(len(words) - n + 1):
            place = first.setdefault(tuple(words[i : i + n]), (d, i))
            if place != (d, i):
                if runs and runs[-1][1] == i + n - 1 and (runs[-1][2], runs[-1][3] + i - runs[-1][0]) == place:
                    runs[-1][1] = i + n
                else:
                    runs.append([i, i + n, *place])
        out[d] = [tuple(r) for r in runs]
    return out


@pytest.mark.parametrize("block", [200, 6 << 20])
def test_maximal_repeats_with_their_earliest_places(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rng = np.random.default_rng(11)
    pool = [" ".join(f"w{k}" for k in rng.integers(0, 40, 30)) for _ in range(6)]
    docs = [(i, " ".join(str(x) for x in rng.choice(pool, rng.integers(1, 5))) + " " + " ".join(f"u{k}" for k in rng.integers(0, 9, 6))) for i in range(30)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), sources=True).collect()
    want = maximal_repeats(docs, 20)
    assert {r.doc_id: [tuple(x) for x in r.repeats] for r in got} == want and sum(map(len, want.values())) > 20
    for r in got:
        assert {i for x in r.repeats for i in range(x.start, x.end)} == {i for a, b in r.removed_spans for i in range(a, b)}


def test_words_that_fool_polynomial_hashes_are_kept_apart(spark):
    lead = " ".join(f"w{i}" for i in range(19))
    one, other = ("".join(x[i.bit_count() & 1] for i in range(1024)) for x in ("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{lead} {one}"), (2, f"{lead} {other}"), (3, f"{lead} {one}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 20}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 100).collect()}
    assert got == {1: (16, 1), 2: (16, 2), 3: (16, 1)}


def test_text_moves_once(spark):
    """The passes over blocks read the bucketed table without an exchange of texts."""
    plan = substring_dedup.op5_substring_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Bucketed: true" in plan


def test_few_files_are_staged_and_in_small_row_groups(spark, monkeypatch, tmp_path):
    """Each file that an executor writes costs starts of processes on a local disk; a task holds a row group, writing or reading."""
    monkeypatch.setattr(substring_dedup, "ROW_GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(tables, "fresh_path", lambda spark, tag: f"file://{tmp_path}/{tag}")
    monkeypatch.setattr(substring_dedup, "fresh_path", tables.fresh_path)
    docs = spark.createDataFrame([(i, " ".join(f"{i}w{k}" for k in range(300))) for i in range(2000)], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).where("n_words = 300 and n_removed = 0").count() == 2000
    files = {x.name: list(x.glob("*.parquet")) for x in tmp_path.iterdir()}
    assert sorted(files) == ["anchors", "blocks", "marks"] and len(files["marks"]) < 4 and len(files["blocks"]) <= 4
    for file in files["blocks"]:
        groups = pq.ParquetFile(file).metadata
        assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 1 << 19


def test_scans_before_the_passes_are_short_for_that_time_only(spark, monkeypatch):
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    bucketed = substring_dedup._bucketed
    monkeypatch.setattr(substring_dedup, "_bucketed", lambda df, n: seen.append(spark.conf.get(key)) or bucketed(df, n))
    before = spark.conf.get(key)
    substring_dedup.remove_repeats(table(spark, SF, "documents"))
    assert seen == ["256"] and spark.conf.get(key) == before
