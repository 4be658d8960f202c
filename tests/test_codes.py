"""Grams as numbers, against their definitions; steps that must not grow faster than their input."""

import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raregram.functions import codes
from raregram.functions.minimal import minimal_grams, padded_words
from raregram.functions.patterns import backtracks, held, regex
from raregram.operators import GramIndex, analyze, gram_frequencies, like, like_join, not_like, qgram_stat
from raregram.operators.extract import postings
from raregram.operators.like_join import _rarest
from raregram.options import GramOptions

TEXTS = ["Index, the index", None, "", "zz--9", "worKing İn été", "the", "...", "a", "x" * 300]


def cut(texts, of, max_q):
    """Per text the grams that ``of`` gives for a chunk, as a sorted list."""
    out = [[] for _ in texts]
    for first, chunk in codes.chunks(pa.array(texts, pa.string()), max_q):
        for rows, numbers in of(chunk):
            for r, g in zip(rows.tolist(), codes.decode(numbers, max_q).to_pylist(), strict=True):
                out[first + r].append(g)
    return [sorted(x) for x in out]


def grams_of(text, low, high):
    return [w[p : p + q] for w in padded_words(text or "") for q in range(low, high + 1) for p in range(len(w) - q + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text("aAb0 -éK", max_size=20), max_size=6), st.integers(1, 4), st.integers(0, 6), st.data())
def test_codes_are_the_grams(texts, low, more, data):
    high = low + more
    every = sorted({g for t in texts for g in grams_of(t, low, high)})
    options = GramOptions(low, high, tuple(data.draw(st.sets(st.sampled_from(every), max_size=8)) if every else ()))
    frequent, closed = codes.Frequent(options.closed), frozenset(options.closed)
    assert cut(texts, lambda c: c.all_grams(low, high), high) == [sorted(set(grams_of(t, low, high))) for t in texts]
    rare = cut(texts, lambda c: [codes.row_grams(c, *c.rare_grams(low, high, frequent), high)], high)
    assert rare == [sorted({g for w in padded_words(t or "") for g in minimal_grams(w, low, high, closed)}) for t in texts]
    assert sum(c.occurrences(low, high) for _, c in codes.chunks(pa.array(texts, pa.string()), high)) == sum(len(grams_of(t, low, high)) for t in texts)


def test_frequencies_are_counted_where_rows_lie(spark, monkeypatch):
    """No row is made for each gram of each text; parts that are given out early add up."""
    df = spark.createDataFrame([(k, t) for k in ("a", None, "b") for t in TEXTS * 3], "k string, s string")
    want = {}
    for k in ("a", None, "b"):
        for t in TEXTS * 3:
            for g in set(grams_of(t, 2, 4)):
                want[k, g] = want.get((k, g), 0) + 1
    monkeypatch.setattr(codes.Counter, "MOST", 5)
    got = gram_frequencies(df, "s", 2, 4, by=["k"])
    assert {(r["k"], r["gram"]): r["df"] for r in got.collect()} == want
    for frame in (got, qgram_stat(df, "s", 2, 4, 0.1)):
        assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
    summary = analyze(df, "s").summary.first()
    assert summary["occurrences"] == 9 * sum(len(grams_of(t, 1, 3)) for t in TEXTS)


def test_postings_are_not_shuffled(spark):
    """Rows with ids of their own are posted where they lie; of repeated and null ids each pair still stands once."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, s string")
    options = GramOptions(2, 3, ("th", "he"))
    assert "Exchange" not in postings(df, "i", "s", options)._jdf.queryExecution().executedPlan().toString()
    closed = frozenset(options.closed)
    want = sorted((g, i) for i, t in enumerate(TEXTS) for g in {g for w in padded_words(t or "") for g in minimal_grams(w, 2, 3, closed)})
    assert sorted(map(tuple, postings(df, "i", "s", options).collect())) == want
    twice = df.unionByName(df).withColumn("i", F.when(F.col("i") > 0, F.col("i")))
    assert sorted(map(tuple, postings(twice, "i", "s", options).collect()), key=str) == sorted(((g, i or None) for g, i in want), key=str)


def test_candidate_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, s string")
    index = GramIndex.build(df, "i", "s", GramOptions(2, 3))
    frame = index.candidate_counts(["%index%", "%the%", "%qq%", "%", "%K%"])
    assert {r["pattern"]: r["n"] for r in frame.collect()} == {"%index%": 1, "%the%": 2, "%qq%": 0}


def test_like_takes_time_by_the_length_of_the_text(spark):
    """Three runs over a text of one letter: plain LIKE would try 10**10 places."""
    df = spark.createDataFrame([("t" * 300_000,), ("Tab 5%, x",), (None,)], "s string")
    start = time.perf_counter()
    for pattern, fold in (("%t%!%%", True), ("%t%!%%", False), ("%t%!%%x", True)):
        assert [r[0] for r in df.select(like(F.col("s"), pattern, "!", fold)).collect()] == [False, fold, None]
    assert not_like(df, "s", "%t%!%%", "!", True).count() == 1
    assert time.perf_counter() - start < 60


def test_expressions_are_the_patterns(spark):
    """Of every kind of pattern: the linear expression gives what LIKE gives."""
    texts = ["", "a", "ab", "aab", "abab", "a\nb", "xaybz", "a.b", "a%b", "a_b", "\U0001f600b", "ba"]
    patterns = ["", "%", "a", "a%", "%a", "%a%", "%a%b", "a%b%", "%a%b%", "a_b", "%a_%b", "_%b", "%.%b", "%\\%%b", "%%a%%b%%", "a%a%b", "%\\_%b%", "%_b"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for p in patterns:
        got = df.select("s", F.col("s").like(p).alias("a"), F.col("s").rlike(regex(p)).alias("b"), (F.contains("s", F.lit(held(p))) if held(p) else F.col("s").like(p)).alias("c")).collect()
        assert all(r["a"] == r["b"] == r["c"] for r in got), p
    assert [p for p in patterns if not backtracks(p)] == ["", "%", "a", "a%", "%a", "%a%", "a%b%", "a_b", "_%b", "%_b"]


def test_join_meets_the_rarest_key_alone(spark):
    """A pattern of many common keys takes the rows of one; patterns and rows that come again are matched again, by ids that are null too."""
    rows = [(i, "the indexing of the thing") for i in range(30)] + [(None, "the zebra indexing"), (7, "a Zebra indexing K")]
    df = spark.createDataFrame(rows, "i long, s string")
    patterns = spark.createDataFrame([(1, "%zebra indexing%"), (1, "%zebra indexing%"), (2, "%the%thing"), (3, "%a%")], "p int, s string")
    index = GramIndex.build(df, "i", "s", GramOptions(3, 3))
    keyed = spark.createDataFrame([(1, 1, ["the", "ing", "zeb", "ndx"]), (2, 2, ["the", "ing"])], "_a int, _b int, keys array<string>")
    assert {tuple(r) for r in _rarest(index.postings, keyed, lambda x: x).collect()} == {(1, 1, "ndx"), (2, 2, "ing")}
    for fold in (False, True):
        zebra = [None, 7] if fold else [None]
        want = [(1, i) for i in zebra * 2] + [(2, i) for i in range(30)] + [(3, None), (3, 7)]
        assert sorted(map(tuple, like_join(df, "i", "s", patterns, "p", "s", index, fold).collect()), key=str) == sorted(want, key=str)
