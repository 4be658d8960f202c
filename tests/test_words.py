"""Words, grams, and minimal rare grams against their definitions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raregram.functions import minimal, words
from raregram.options import GramOptions, closure


def brute_minimal(word, low, high, closed):
    """Rare grams that hold no other rare gram, straight from the definition."""
    spans = [(p, p + q) for p in range(len(word)) for q in range(low, high + 1) if p + q <= len(word) and word[p : p + q] not in closed]
    best = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    return [word[a:b] for a, b in sorted(best, key=lambda s: s[1])]


@settings(max_examples=300, deadline=None)
@given(st.text("ab$c", min_size=1, max_size=9), st.integers(1, 3), st.integers(0, 3), st.sets(st.text("ab$c", min_size=1, max_size=4), max_size=12))
def test_minimal_grams_are_the_definition(word, low, more, some):
    closed = frozenset(closure(some, low))
    assert minimal.minimal_grams(word, low, low + more, closed) == brute_minimal(word, low, low + more, closed)


@settings(max_examples=300, deadline=None)
@given(st.text("ab$c", min_size=1, max_size=9), st.integers(1, 3), st.integers(0, 3), st.sets(st.text("ab$c", min_size=1, max_size=4), max_size=12))
def test_given_set_agrees_where_it_is_closed(word, low, more, some):
    closed = closure(some, low)
    assert minimal.given_grams(word, low, low + more, minimal.FrequentPrefixes(closed)) == minimal.minimal_grams(word, low, low + more, frozenset(closed))


def test_word_edges():
    assert minimal.given_grams("$a$", 2, 2, minimal.FrequentPrefixes([])) == ["$a", "a$"]
    assert minimal.padded_words("Wor\u0130ng \u212a a_b \u0130x 9") == ["$wor$", "$ng$", "$a$", "$b$", "$x$", "$9$"]
    assert minimal.given_grams("$a$", 4, 4, minimal.FrequentPrefixes([])) == []


def test_words_and_grams_columns(spark):
    texts = ["Ab, c1! éX", "", None, "\u212a \u0130i", "a" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", words.words(F.col("t")).alias("w"), words.text_grams(F.col("t"), 2, 3).alias("g")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        if t is None:
            assert r["w"] is None and r["g"] is None
            continue
        want = minimal.padded_words(t)
        assert r["w"] == want
        assert sorted(r["g"]) == sorted(w[p : p + q] for w in want for q in (2, 3) for p in range(len(w) - q + 1))


def test_compare_and_metadata(spark):
    df = spark.createDataFrame([("a", "b"), ("é", "z"), ("x", "x"), (None, "a"), ("ab", "a")], "a string, b string")
    got = [r[0] for r in df.select(words.compare(F.col("a"), F.col("b"))).collect()]
    assert got == [-1, 1, 0, None, 1]
    marked = df.select(words.gram_text(F.col("a"), "a"))
    assert marked.schema["a"].metadata == {"gram_text": True}
    assert [r[0] for r in marked.select(words.receive(words.send(F.col("a")))).collect()] == ["a", "é", "x", None, "ab"]


@pytest.mark.parametrize(("low", "high", "said"), [(-1, 2, 'value -1 out of bounds for option "minq"'), (2, 11, 'value 11 out of bounds for option "maxq"'), (4, 2, '"minq" must not be greater than "maxq"')])
def test_option_errors(low, high, said):
    with pytest.raises(ValueError, match=said.replace("(", r"\(")):
        GramOptions(low, high)


def test_options():
    assert (GramOptions().min_q, GramOptions().max_q, GramOptions().frequent) == (2, 5, ())
    assert GramOptions(2, 4, ("b", "a", "b")).frequent == ("a", "b")
    with pytest.raises(TypeError):
        GramOptions(2, 4, ("a", None))
    assert closure(["abc"], 2) == ("ab", "abc", "bc")


def test_query_keys_are_row_keys_for_closed_sets():
    rng = random.Random(4)
    frequent = ["".join(rng.choice("abc$") for _ in range(rng.choice([3, 4]))) for _ in range(25)]
    closed = frozenset(closure(frequent, 2))
    for _ in range(800):
        word = "$" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) + "$"
        a = rng.randrange(len(word))
        b = rng.randint(a, len(word))
        assert set(minimal.minimal_grams(word[a:b], 2, 4, closed)) <= set(minimal.minimal_grams(word, 2, 4, closed))
