import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspan.llm import bpe

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = st.sampled_from(["a", "th", "ing", "É", "ß", "Σ", " ", "  ", "\n", " ", "'s", "'LL", "!!", "12", "<|endoftext|>", "<|startoftext|>", "́", "ﬁ", "好", "😀", "\x1c", "|", ".", "zz"])


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return bpe.codec(path, 8), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=60).map("".join), max_size=5))
def test_ids_and_texts_are_the_library_s(both, texts):
    coder, library = both
    ids, at = coder.encode(pa.array(texts, pa.string()))
    decoded = coder.decode(ids, at)
    for i, x in enumerate(texts):
        want = library.encode(x, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert decoded[i] == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abthingr", min_size=1, max_size=300))
def test_tree_concatenation_of_one_long_piece(both, text):
    coder, library = both
    piece = coder.pieces(text)[0]
    assert coder.tree.encode(piece, 4).tolist() == library.encode(text, add_special_tokens=False).ids


#: Letters and marks of scripts whose symbols take two bytes and more, and what joins or ends them.
SCRIPTS = st.sampled_from([
    "".join(map(chr, range(0x4E00, 0x4E40))),
    "".join(map(chr, range(0x3041, 0x3080))),
    "".join(map(chr, range(0x3B1, 0x3CA))),
    "".join(map(chr, range(0x905, 0x94D))),
    "éèüößñçãåâîíĀžşőABCabc",
    "aeiou\u0327\u0301\u0308",
    "😀👩\u200d🏽🇮🇳",
    "</w>|endoftx",
])


@settings(max_examples=120, deadline=None)
@given(SCRIPTS.flatmap(lambda letters: st.tuples(st.just(letters), st.integers(33, 5000), st.randoms(use_true_random=False))), st.sampled_from([4, 32]))
def test_long_runs_of_other_scripts(both, run, leaf):
    letters, size, draw = run
    coder, library = both
    text = "".join(draw.choice(letters) for _ in range(size))
    want = library.encode(text, add_special_tokens=False).ids
    ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(coder.tree.encode(x, leaf), np.uint32) for x in coder.pieces(text))])
    assert ids.tolist() == want or any(x in text for x in coder.special)
    ids, at = coder.encode(pa.array([text, None, text + " end"]))
    assert ids[: at[1]].tolist() == want and at[1] == at[2]
    assert coder.decode(ids, at)[0] == library.decode(want, skip_special_tokens=False)


def test_a_million_symbols_without_a_split(both):
    coder, library = both
    draw = np.random.default_rng(3)
    text = "".join(map(chr, draw.integers(0x4E00, 0x4F00, 400_000)))
    assert coder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_worker_that_forgets_gives_the_same_ids(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    monkeypatch.setattr(bpe, "KNOWN_UNITS", 3)
    coder, library = bpe.Codec(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for text in ("one two three four five", "five six one", "seven", "", "one two seven"):
        assert coder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_library_gets_a_bounded_number_of_units_a_call():
    """What it returns for a unit is held until the call's ids are taken, many times their size."""
    path = public_tokenizers.path(FILES[0])
    coder, library = bpe.Codec(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    calls = []

    class Counted:
        def encode_batch(self, texts, **more):
            calls.append(len(texts))
            return library.encode_batch(texts, **more)

    coder.tokenizer = Counted()
    texts = [" ".join(f"w{i}" for i in range(40_000)), "", "w7 w7", " ".join(f"w{i}" for i in range(39_990, 40_010))]
    ids, at = coder.encode(pa.array(texts))
    assert sum(calls) >= 40_000 and max(calls) <= 1 << 14
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_odd_rows(odd, nothing):
    path = public_tokenizers.path(FILES[1])
    library = Tokenizer.from_file(path)
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(odd, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip(nothing, path).count() == bpe.encode(nothing, path).count() == 0
    texts = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd, path), path).collect()}
    assert (1, "") in texts and (2, "") in texts
