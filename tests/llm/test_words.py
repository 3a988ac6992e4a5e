import numpy as np
import pyarrow as pa
from brute import WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm.words import Words, raw, rolled, slices

TEXT = st.text(alphabet="ab C\t\n\x0b\x0c\rÉß  好😀.\x00\x1c", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_grams_are_those_of_the_pattern(texts):
    words = Words(*raw(pa.array(texts, pa.string())))
    want = [WORD.findall(x or "") for x in texts]
    got = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)]
    assert got == [w for ws in want for w in ws]
    assert words.count.tolist() == [len(w) for w in want]
    h = words.hashes()
    assert len(set(h.tolist())) == len(set(got))
    grams, at = words.grams(3)
    wanted = [tuple(ws[i : i + 3]) for ws in want for i in range(len(ws) - 2)]
    assert [tuple(got[i : i + 3]) for i in at] == wanted
    assert len(set(grams.tolist())) == len(set(wanted))


def test_lower_case_is_ascii_only():
    a = Words(*raw(pa.array(["ABC É"])), lower=True).hashes()
    b = Words(*raw(pa.array(["abc É"]))).hashes()
    c = Words(*raw(pa.array(["abc é"]))).hashes()
    assert (a == b).all() and a[1] != c[1]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * i for i in range(50)])], ["id", "text"])
    parts = list(slices(batch, "text", 100))
    assert [i for rows, _, _ in parts for i in rows.column(0).to_pylist()] == list(range(50))
    assert all(bounds[-1] == len(data) for _, data, bounds in parts)
    assert np.concatenate([data for _, data, _ in parts]).size == sum(range(50))


def test_words_that_fool_polynomial_hashes():
    """Two words of a and b by the parity of ones in each place's number, and its opposite, have equal polynomial hashes modulo 2 ** 64."""
    for size in (32, 64, 65, 512, 1024, 4096):
        one = "".join("ab"[i.bit_count() & 1] for i in range(size))
        other = "".join("ba"[i.bit_count() & 1] for i in range(size))
        lead = " ".join(f"w{i}" for i in range(19))
        words = Words(*raw(pa.array([f"{lead} {one}", f"{lead} {other}", f"{lead} {one}"])))
        for k in range(2):
            h = words.hashes(k).reshape(3, 20)
            assert h[0, 19] != h[1, 19] and (h[0] == h[2]).all() and len(set(h[0].tolist())) == 20
            grams = words.grams(20, k)[0]
            assert grams[0] != grams[1] and grams[0] == grams[2]
        assert not set(words.hashes(0).tolist()) & set(words.hashes(1).tolist())


def test_prefixes_zeros_and_lengths_are_told_apart():
    texts = ["a" * i for i in range(1, 140)] + ["a" * i + "\x00" for i in range(1, 140)]
    h = Words(*raw(pa.array(texts))).hashes()
    assert len(set(h.tolist())) == len(texts)


def test_grams_of_every_width_follow_order():
    h = Words(*raw(pa.array(["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2]))).hashes()
    for n in range(1, 27):
        got = rolled(h, n)[: 53 - n]
        want = [tuple(h[i : i + n].tolist()) for i in range(53 - n)]
        assert len(set(got.tolist())) == len(set(want)) and len(got) == len(want)
