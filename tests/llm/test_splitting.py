import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import splitting as S


def check(text, target, limit, overlap):
    pieces = S.split(text, target, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
    out = text[: pieces[0][1]]
    for (_, b), (c, d) in zip(pieces, pieces[1:]):
        out += text[b:d]
    assert out == text
    return pieces


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=list("ab .,\n。，字é́⟦1⟧👍🏽‍🇩🇪#"), max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit // 2, limit, overlap)


def test_cuts_at_the_strongest_boundary():
    text = "aaaa bbbb. Cccc dddd.\n\nEeee ffff gggg hhhh iiii"
    (a, b), *_ = check(text, 10, 30, 0)
    assert text[a:b].endswith("\n\n")


def test_ties_go_right():
    assert S.RangeMax(__import__("numpy").array([1, 3, 3, 2]), 4)(0, 3) == 2


def test_range_max_against_brute_force():
    import numpy as np

    rnd = random.Random(1)
    v = np.array([rnd.randrange(5) for _ in range(200)])
    t = S.RangeMax(v, 64)
    for _ in range(500):
        a = rnd.randrange(200)
        b = min(199, a + rnd.randrange(60))
        assert t(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


def test_tokens_and_clusters_stay_whole():
    text = "word⟦12⟧" * 40 + "é" * 60
    for a, b in check(text, 20, 30, 5):
        assert text[a:b].count("⟦") == text[a:b].count("⟧")
        assert not text[a:b].startswith("́")


def test_text_without_boundary_and_very_long():
    check("x" * 5000, 100, 200, 20)
    check(("Ein Satz. " * 30 + "\n\n") * 3000, 1400, 2600, 200)


@pytest.mark.parametrize("limit", [1, 2])
def test_tiny_limits(limit):
    check("abc def", limit, limit, 5)


def test_found_is_exact(spark):
    rows = [("a", "std", "x" * 10), ("b", "std", "x" * 11), ("b", "std", "x" * 11), ("c", None, "x" * 99), ("d", "std", None), ("e", "std", ""), (None, "std", "y" * 50)]
    chunks = spark.createDataFrame(rows, "id string, profile string, text string")
    prof = spark.createDataFrame([("std", 6, 10, 2)], "profile string, target_chars int, max_chars int, overlap_chars int")
    got = S.split_chunks(chunks, prof).collect()
    assert {r.id for r in got if r.n_pieces > 1} == {"b"}
    assert {(r.id, r.chars) for r in got if r.id in "acde"} == {("a", 10), ("c", 99), ("d", 0), ("e", 0)}
    assert all(r.text is None or len(r.text) == r.chars for r in got)
    assert S.split_chunks(chunks.limit(0), prof).count() == 0
