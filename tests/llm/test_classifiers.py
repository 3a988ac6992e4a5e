import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import language_id, quality
from veilspan.llm.tables import table
from veilspan.llm.words import Words, raw

SF = "/root/testdata/sf0.01"


def test_quality_agrees_with_the_gold_labels(spark):
    gold = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = quality.op1_quality_classifier(spark, SF).collect()
    assert len(got) == table(spark, SF, "documents").count()
    good = [r.keep for r in got if gold.get(r.doc_id) == 1]
    bad = [r.keep for r in got if gold.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = np.where(rng.random(20_000) < 0.85, 1, -1)
    right, cover = np.linspace(0.9, 0.99, len(quality.LABELLERS)), np.linspace(0.5, 1, len(quality.LABELLERS))
    cast = rng.random((20_000, len(right))) < cover
    said = np.where(rng.random((20_000, len(right))) < right, truth[:, None], -truth[:, None]) * cast
    pattern, rows = np.unique(said, axis=0, return_counts=True)
    model = quality.expectation_maximisation(pattern, rows)
    assert abs(model.prior - 0.85) < 0.05
    assert np.abs(np.array(list(model.accuracies().values())) - right).max() < 0.06
    assert ((model.posterior(said) > 0.5) == (truth > 0)).mean() > 0.99


def test_votes_of_odd_texts():
    texts = ["", None, "word", "### " * 40, "AB!! " * 40, "a | b | c | d | e", "same same same same same", "Some plain words stand here, in order. They end well."]
    votes = quality.votes(Words(*raw(pa.array(texts, pa.string()))))
    assert (votes[:2] == 0).all() and (votes[2] == 0).sum() > 5
    assert (votes[3:7] < 0).any(1).all() and (votes[7] >= 0).all()


def test_odd_rows_quality(odd, nothing):
    got = {r.doc_id: r for r in quality.scored(odd, quality.fit(odd)).collect()}
    assert got[1].quality_score == got[2].quality_score == got[3].quality_score == 0.0 and not got[1].keep
    assert quality.fit(nothing) is None and quality.scored(nothing, None).count() == 0
    assert [r.quality_score for r in quality.scored(odd.where("doc_id = 4"), None).collect()] == [0.0]


def test_language_of_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = language_id.op10_language_id(spark, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 0.2 < len(held) / len(got) < 0.3
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 8, 40):
        code = language_id.codewords(n)
        assert set(np.unique(code)) == {-1.0, 1.0}
        assert all((code[i] != code[j]).sum() >= code.shape[1] // 4 for i in range(n) for j in range(i)) and (np.abs(code.sum(0)) < n).all()


def test_a_wrong_bit_is_corrected():
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.zeros((7, language_id.DIMS)), np.ones(7))
    for i in range(4):
        for bit in range(7):
            margin = 3 * code[i].copy()
            margin[bit] *= -1
            best, _, near = model.decode(margin[None])
            assert best[0] == i and not near[0]
    assert model.decode(np.zeros((1, 7)))[2][0]


def test_trigrams_stay_within_texts():
    texts = ["abc", "de", "", "fgh ij", "É1é"]
    flat, edge = language_id.trigrams(*raw(pa.array(texts)))
    for i, x in enumerate(texts):
        one, _ = language_id.trigrams(*raw(pa.array([x])))
        assert flat[edge[i] : edge[i + 1]].tolist() == one.tolist()


def test_odd_rows_language(spark, odd, nothing):
    model = language_id.fit(odd)
    assert model.langs == ["de", "en"] or model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    for i in (1, 2, 3):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert language_id.fit(nothing).langs == [] and language_id.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(nothing)).collect()} == {"und"}
    letters = spark.createDataFrame([(1, "123 !?"), (2, "好"), (3, "٣"), (4, "ª")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.identify(letters, model).orderBy("doc_id").collect()] == [True, False, True, False]


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    docs = spark.range(20).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id % 4) AS lang")
    with pytest.raises(ValueError, match="more than 3"):
        language_id.fit(docs)
    assert language_id.fit(docs.where("doc_id % 4 < 3")).langs == ["l0", "l1", "l2"]


def test_a_sample_of_copies_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "_fit_linear", lambda rows, columns, values, target: seen.append(len(target)) or np.zeros(quality.DIMS + 1))
    docs = spark.range(2000).selectExpr("7L AS doc_id", "'the same words stand in all of these rows.' AS text")
    quality.fit(docs, sample=200)
    quality.fit(docs, sample_bytes=200 * 42)
    assert all(100 < n < 320 for n in seen) and len(seen) == 2


SOME_TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ zé ÉÜ好09.?!#|-\n\t", max_size=60), st.lists(st.sampled_from(["word", "WORD", "same", "##", "end.", "no!", "a", "7", "é", "x-y"]), max_size=80).map(" ".join)), max_size=6)
LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}
DIGITS = set(range(48, 58))


def slow_votes(text):
    """All labellers on one text, word by word."""
    data = (text or "").encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n = len(ws)
    if not n:
        return [0] * len(quality.LABELLERS)
    share = lambda f: sum(map(f, range(n))) / n
    bars, letters = set(b"#$*%&|~^_=<>\\{}"), sum(b in LETTERS for b in data)
    lone = lambda i: len(ws[i]) == 1 and ws[i][0] not in LETTERS | DIGITS
    others = lambda i: sum(b not in LETTERS for b in ws[i])
    plain = lambda i: not lone(i) and (others(i) == 0 or others(i) == 1 and ws[i][-1] not in LETTERS | bars)
    again = lambda i: i > 0 and ws[i] == ws[i - 1]
    symbols, bangs, ends = (share(lambda i, s=s: ws[i][-1] in s) for s in (bars, b"!", b".?"))
    marks = sum(32 < b < 127 and b not in LETTERS | DIGITS for b in data) / len(data)
    cap = sum(65 <= b <= 90 for b in data) / max(1, letters)
    some, many = n >= 3, n >= 30
    rules = [
        (symbols > 0.08 and some, symbols < 0.02 and some),
        (marks > 0.15 and some, marks < 0.08 and some),
        (share(plain) < 0.6 and some, share(plain) > 0.85 and some),
        (cap > 0.5 and n >= 8, cap < 0.2 and some),
        (bangs > 0.1 and some, bangs < 0.02 and some),
        (share(lone) > 0.1 and some, share(lone) < 0.02 and some),
        (share(again) > 0.2 and some, share(again) < 0.05 and some),
        (share(lambda i: again(i) and again(i - 1)) > 0.1 and some, share(lambda i: again(i) and again(i - 1)) < 0.02 and some),
        (len(set(ws)) / n < 0.3 and many and n < 400, len(set(ws)) / n > 0.5 and many),
        (ends < 0.005 and many, 0.02 < ends < 0.5 and many),
    ]
    return [-1 if bad else int(good) for bad, good in rules]


@settings(max_examples=200, deadline=None)
@given(SOME_TEXTS)
def test_votes_equal_a_slow_version(texts):
    assert quality.votes(Words(*raw(pa.array(texts, pa.string())))).tolist() == [slow_votes(x) for x in texts]


def test_votes_of_the_table_equal_a_slow_version(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert quality.votes(Words(*raw(pa.array(texts, pa.string())))).tolist() == [slow_votes(x) for x in texts]


def slow_features(text):
    """Counts of hashed shapes of one text's words, and of each with the one before it."""
    kind = lambda b: 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    data = (text or "").encode()
    shape = bytes(k for k, _ in itertools.groupby(map(kind, data)))
    hashed = lambda x: int(Words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hashes()[0])
    words, found, half, before, last = re.findall(rb"[^\x20\x09-\x0D]+", data), Counter(), quality.DIMS // 2, 0, None
    for word, own in zip(words, re.findall(rb"[^\x20\x09-\x0D]+", shape), strict=True):
        h = hashed(own)
        two = quality.mix(np.array([(h + 3 * before + (0x9E3779B97F4A7C15 if word == last else 0)) % (1 << 64)], np.uint64))[0]
        found.update([h % half, half + int(two) % half])
        before, last = h, word
    return found


@settings(max_examples=100, deadline=None)
@given(SOME_TEXTS)
def test_features_and_scores_equal_a_slow_version(texts):
    data, bounds = raw(pa.array(texts, pa.string()))
    idx, edge = quality.features(Words(data, bounds))
    want = [slow_features(x) for x in texts]
    assert [Counter(idx[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:])] == want
    weights = np.random.default_rng(0).normal(0, 3, quality.DIMS + 1)
    scores = [1 / (1 + np.exp(-(sum(weights[k] * n for k, n in w.items()) / w.total() + weights[-1]))) if w else 0.0 for w in want]
    assert np.allclose(quality.scores(weights, data, bounds), scores)


def slow_trigrams(text):
    out, data = [], []
    raw_bytes = (text or "").encode()
    for i, b in enumerate(raw_bytes):
        if b < 128:
            b = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32
        elif i and raw_bytes[i - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            b += 32
        data.append(b)
    for a, b, c in zip(data, data[1:], data[2:]):
        if not a == b == 32:
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            out.append(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
    return out


@settings(max_examples=150, deadline=None)
@given(SOME_TEXTS)
def test_predictions_equal_a_slow_version(texts):
    rng = np.random.default_rng(1)
    code = language_id.codewords(3)
    model = language_id.Model(["x", "y", "z"], code, rng.normal(0, 1, (code.shape[1], language_id.DIMS)).astype(np.float32), rng.random(code.shape[1]))
    data, bounds = raw(pa.array(texts, pa.string()))
    grams, edge = language_id.trigrams(data, bounds)
    assert [grams[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [slow_trigrams(x) for x in texts]
    lang, score, near = language_id.predictions(model, data, bounds)
    for i, text in enumerate(texts):
        own = slow_trigrams(text)
        margin = [language_id.SHARPNESS * np.mean([float(w[g]) for g in own]) if own else 0.0 for w in model.weights]
        loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margin, word)) for word in code]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        known = any(c.isalpha() for c in text or "")
        assert lang[i] == (model.langs[int(share.argmax())] if known else "und") or np.ptp(np.sort(share)[-2:]) < 1e-5
        assert abs(score[i] - (share.max() if known else 0.0)) < 1e-4
        two = np.sort(share)[-2:]
        assert near[i] == (known and two[1] - two[0] < language_id.AMBIGUOUS) or abs(two[1] - two[0] - language_id.AMBIGUOUS) < 1e-4


def test_bit_classifiers_equal_a_slow_version(spark):
    """Weights are log odds of the trigrams' mean shares on either side of a bit."""
    rows = [(1, "aaa bbb aaa", "x"), (2, "bbb ccc", "y"), (3, "ccc ccc ddd", "z"), (4, None, "x"), (5, "lost", None), (1, "aaa bbb aaa", "x")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    shares = []
    for lang in "xyz":
        counts = np.full(language_id.DIMS, 0.5)
        for _, text, own in rows:
            if own == lang:
                for g in slow_trigrams(text):
                    counts[g] += 1
        shares.append(counts / counts.sum())
    for k in range(model.code.shape[1]):
        up, down = (np.mean([s for s, c in zip(shares, model.code[:, k]) if c == side], axis=0) for side in (1, -1))
        assert np.allclose(model.weights[k], np.log(up / down), atol=1e-5)
