import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import chroma


def tune(seed, notes=120):
    return chroma.melody(np.random.default_rng(seed).integers(0, 24, notes))


def error(a, b, offset):
    n = min(len(a) - max(offset, 0), len(b) + min(offset, 0))
    x, y = a[max(offset, 0) :][:n], b[max(-offset, 0) :][:n]
    return np.bitwise_count(x ^ y).sum() / (32 * n)


def test_fingerprints_survive_noise_and_cuts():
    a = chroma.fingerprint(tune(1))
    noisy = tune(1) + np.random.default_rng(9).normal(0, 0.05, len(tune(1)))
    assert error(a, chroma.fingerprint(noisy), 0) < 0.1
    assert error(a, chroma.fingerprint(noisy[20 * chroma.HOP :]), 20) < 0.1
    assert error(a, chroma.fingerprint(tune(2)), 0) > 0.4


def test_every_filter_bit_is_used():
    bits = chroma.fingerprint(tune(5, 1000))[:, None] >> np.arange(32, dtype=np.uint32) & 1
    assert ((bits.mean(0) > 0.15) & (bits.mean(0) < 0.85)).all()


def test_wav_round_trip_and_broken_media():
    x = tune(3)
    assert np.abs(chroma.samples_of(chroma.wav(x)) - x).max() < 1e-3
    assert abs(len(chroma.samples_of(chroma.wav(x, 16000))) - len(x) / 2) <= 1
    for bad in (None, b"", b"RIFF", chroma.wav(x)[:30]):
        assert len(chroma.samples_of(bad)) == 0
    assert len(chroma.fingerprint(np.zeros(10))) == 0


@pytest.fixture
def media(spark):
    whole, cut = tune(1), tune(1)[30 * chroma.HOP :]
    rows = [(0, chroma.wav(whole)), (1, chroma.wav(cut)), (2, chroma.wav(cut)), (3, chroma.wav(tune(2))), (4, None), (5, b"x"), (100, chroma.wav(tune(2)))]
    return spark.createDataFrame(rows, "id long, media binary")


def test_alignment_finds_the_offset(media):
    prints = chroma.fingerprints(media, "id", "media")
    got = chroma.matches(prints, F.col("id") % 100 == 0, "id").collect()
    by = {r.id: r for r in got}
    assert len(got) == 7
    assert (by[0].match_class, by[0].offset) == (1, 30) and by[0].bit_error < 0.05
    assert by[1].class_id == by[2].class_id == 1 and by[1].match_class is None
    assert by[100].class_id == 3 and by[4].class_id == by[5].class_id == 4 and by[4].match_class is None
    assert chroma.matches(chroma.fingerprints(media.where("false"), "id", "media"), F.lit(True), "id").count() == 0


def test_votes_equal_brute_force(media):
    prints = {r.id: r.print for r in chroma.fingerprints(media, "id", "media").collect()}
    runs = lambda p: [(v, i) for i, v in enumerate(p) if i == 0 or p[i - 1] != v]
    votes = {}
    for v, i in runs(prints[0]):
        for w, j in runs(prints[1]):
            if v == w:
                votes[i - j] = votes.get(i - j, 0) + 1
    a, b = (np.array(prints[i], np.uint32) for i in (0, 1))
    overlap = lambda o: min(len(a) - max(o, 0), len(b) + min(o, 0))
    judged = {o: error(a, b, o) for o, n in votes.items() if n >= chroma.MIN_VOTES and overlap(o) >= chroma.MIN_OVERLAP}
    best = min(judged, key=lambda o: (judged[o], -votes[o], o))
    got = next(r for r in chroma.matches(chroma.fingerprints(media, "id", "media"), F.col("id") == 0, "id").collect() if r.id == 0)
    assert (got.offset, got.votes) == (best, votes[best])
    assert got.bit_error == error(a, b, best)


def test_odd_rows(spark):
    """Null ids, repeated rows and columns named like those that are made."""
    whole, cut = chroma.wav(tune(1)), chroma.wav(tune(1)[30 * chroma.HOP :])
    rows = [(0, whole), (0, whole), (None, whole), (1, cut), (None, chroma.wav(tune(9))), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "id long, media binary").selectExpr("*", "1 AS value", "2 AS q", "3 AS print", "'x' AS class_id", "4 AS votes")
    got = chroma.matches(chroma.fingerprints(df, "id", "media"), F.coalesce(F.col("id") == 0, F.lit(True)), "id").collect()
    assert len(got) == len(rows)
    shown = sorted((str(r.id), str(r.class_id), str(r.match_class)) for r in got)
    assert shown == sorted([("0", "0", "1"), ("0", "0", "1"), ("None", "0", "1"), ("1", "1", "None"), ("None", "None", "None"), ("None", "2", "None"), ("2", "2", "None")])


def test_steady_tones_of_different_length_meet(spark):
    tone = chroma.melody(np.zeros(200))
    rows = [(0, chroma.wav(tone)), (1, chroma.wav(tone[: 150 * chroma.NOTE])), (2, chroma.wav(tune(4)))]
    got = {r.id: r for r in chroma.matches(chroma.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id", "media"), F.col("id") == 0, "id").collect()}
    assert got[0].match_class == 1 and got[0].bit_error < 0.05


def test_the_table(spark):
    got = chroma.op9_chroma_match(spark, "/root/testdata/sf0.001")
    assert got.select("vec_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
