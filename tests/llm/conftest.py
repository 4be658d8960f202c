"""Rows that every operator must take: nulls, blanks, copies, long texts, clashing columns."""

import random

import pytest

EDGES = [
    (1, None), (2, ""), (3, "   \n"), (4, "..."), (5, "a"), (6, "same text of a few words here"), (6, "same text of a few words here"), (None, "same text of a few words here"), (None, None),
    (7, "é" * 900), (8, "x" * 30_000), (9, "word " * 6000), (10, "Straße İ K <|endoftext|> \U0001f600 's don't"),
]


def prose(rng, n, words="the of and in to a is that for it as was with be by on not he this are or his from at which but have an had they".split()):
    out = []
    for _ in range(n):
        w = rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ",", ".\n"])
    return " ".join(out)


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with further columns whose names operators use themselves."""
    rows = [(i, t, 0.5, "x", 7, "d", 1, [1], "q") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, hash string, k int, doc string, f int, spans array<int>, root string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def rng():
    return random.Random(8)
