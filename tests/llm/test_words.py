"""Word hashing and splitting against plain Python."""

import re

import numpy as np
import pyarrow as pa

from permuta.llm import shared, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = ["", "  ", "one", " two  words\n", "a\tb\x0bc\x0cd\re", "é ü\u00a0x", "same same", "same", "x" * 5000, None, "end "]


def words_of(texts, lower=False, most=shared.MIX_BYTES):
    out = []
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for row, end, data, offsets in shared.binary_parts(column, most):
        w = shared.Words(data, offsets, lower)
        for i in range(end - row):
            a, b = w.first[i], w.first[i + 1]
            out.append([(bytes(w.data[s:e]), h) for s, e, h in zip(w.start[a:b], w.end[a:b], w.hash[a:b])])
    return out


def test_words_are_those_of_the_pattern():
    for most in (1, 40, 1 << 20):
        found = words_of(TEXTS, most=most)
        assert [[w for w, _ in x] for x in found] == [WORD.findall((t or "").encode()) for t in TEXTS]


def test_equal_words_have_equal_hashes_and_others_not():
    seen = {}
    for word, h in (p for x in words_of(TEXTS + ["b a", "ab ba same"]) for p in x):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lower_case_is_ascii_only():
    assert [w for w, _ in words_of(["ABC É"], lower=True)[0]] == [b"abc", "É".encode()]


def test_runs_depend_on_their_words_alone():
    w = shared.Words(*next(shared.binary_parts(pa.array([b"x y z a b c", b"q a b c"])))[2:])
    one, two = w.runs(np.array([3]), np.array([6])), w.runs(np.array([7]), np.array([10]))
    assert one == two and w.runs(np.array([0]), np.array([3])) != one


def test_sliding_min():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 99, 200)
    for width in (1, 2, 5, 32, 45, 200):
        assert (substring.sliding_min(x, width) == np.lib.stride_tricks.sliding_window_view(x, width).min(axis=1)).all()
