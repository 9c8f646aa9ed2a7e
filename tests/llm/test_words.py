import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from prefweave.llm import words as w

WORD = re.compile(r"[^\W_]+")


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé1_ .\n漢字ß٣-", max_size=40)), max_size=8))
def test_words_are_runs_of_letters_and_digits(texts):
    got = w.words(texts)
    joined = "\n".join(t or "" for t in texts)
    assert [joined[a:b] for a, b in zip(got.start, got.end, strict=True)] == WORD.findall(joined)
    want = [(i, x.lower()) for i, t in enumerate(texts) for x in WORD.findall(t or "")]
    assert got.text.tolist() == [i for i, _ in want]
    names = {}
    for h, (_, x) in zip(got.hash.tolist(), want, strict=True):
        assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(400)) + " " + "x" * 500
    whole = w.words([text, None, "", "w1"])
    monkeypatch.setattr(w, "BLOCK_CHARS", 16)
    cut = w.words([text, None, "", "w1"])
    for a, b in zip(whole, cut, strict=True):
        assert np.array_equal(a, b)
    assert w.words([]).hash.size == 0 and w.words([None, ""]).hash.size == 0


def test_runs_stay_in_one_text():
    got = w.words(["a b c d", "a b c", "x"])
    h, first = w.runs(got, 3)
    assert first.tolist() == [0, 1, 4] and h[0] == h[2] != h[1]
    assert w.runs(w.words(["a"]), 3)[0].size == 0


def test_tables_are_those_of_python():
    alnum, value = w._tables()
    every = [chr(i) for i in range(0x110000)]
    assert alnum.tolist() == [c.isalnum() for c in every]
    low = np.array([ord(c.lower()[0]) if c.isalnum() else i for i, c in enumerate(every)], np.uint64)
    assert (value == (w.mix(low + np.uint64(0x51ED27)) | np.uint64(1))).all()
