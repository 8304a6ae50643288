"""Matching of repeated items and counting of discordant pairs against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from permuta.operators import distance

places = st.lists(st.integers(0, 30), max_size=9, unique=True)


def greedy(a, b):
    """Brute force: the closest pair of all that is left, again and again."""
    a, b, out = list(a), list(b), []
    while a and b:
        _, x, y = min((abs(x - y), x, y) for x in a for y in b)
        out.append((x, y))
        a.remove(x)
        b.remove(y)
    return out


@settings(max_examples=400, deadline=None)
@given(places, places)
def test_closest_first_uses_each_position_once(a, b):
    assert distance.closest_first(a, b) == greedy(a, b)


def test_with_repeats_consumes_pairs(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (1, "y", 2), (2, "x", 0)], "id long, item string, pos int")
    b = spark.createDataFrame([(1, "x", 0), (1, "x", 9), (1, "y", 1), (1, "y", 4), (3, "x", 1)], "id long, item string, pos int")
    found = {(r["id"], r["item"], r["pos"]): r["motion"] for r in distance.with_repeats(a, b, "id").collect()}
    assert found == {(1, "x", 0): 0, (1, "x", 1): 8, (1, "y", 2): -1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), min_size=1, max_size=12), max_size=6))
def test_inversions_equal_all_pairs(rows):
    values = np.array([x for r in rows for x in r], np.int64)
    found = distance.inversions(values, np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
    assert found.tolist() == [sum(r[i] > r[j] for i in range(len(r)) for j in range(i + 1, len(r))) for r in rows]


def test_kendall_of_long_rankings_with_ties(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(700), rng.randrange(700)) for k in range(3) for i in range(1000)]
    table = spark.createDataFrame(rows, "id long, item int, a int, b int")
    found = distance.kendall(table.select("id", "item", table.a.alias("pos")), table.select("id", "item", table.b.alias("pos")), "id")
    x = {k: np.array([r[2:] for r in rows if r[0] == k]) for k in range(3)}
    wanted = {k: int((np.sign(np.subtract.outer(v[:, 0], v[:, 0])) * np.sign(np.subtract.outer(v[:, 1], v[:, 1])) < 0).sum() // 2) for k, v in x.items()}
    assert {r["id"]: r["discordant"] for r in found.collect()} == wanted
