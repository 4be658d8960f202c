"""The functions under names for SQL text."""

from __future__ import annotations

from typing import List  # noqa: UP035  the form that Spark reads from a hint

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from raregram.functions.minimal import FrequentPrefixes, given_grams, padded_words
from raregram.functions.patterns import keys as pattern_keys
from raregram.options import GramOptions, check_lengths
from raregram.shipping import ship

NAMES = ("rare_grams", "qgram_stat", "gram_cmp", "gram_like", "gram_ilike", "gram_keys", "gram_stat")


def register(spark: SparkSession, **names: str) -> None:
    """Register all functions; ``names`` gives other SQL names, such as ``rare_grams="my_grams"``.

    ``qgram_stat`` here is an ordinary grouped aggregate, which gathers a group's texts in one task: for
    groups of any size use :func:`raregram.operators.statistics.qgram_stat`.
    """
    ship(spark)
    called = {n: names.get(n, n) for n in NAMES}

    def grams_of(text, min_q, max_q, frequent):
        if text is None or frequent is None or min_q is None or max_q is None:
            return None
        check_lengths(int(min_q), int(max_q), ("min_q", "max_q"))
        f = FrequentPrefixes(frequent)
        return [g for w in padded_words(text) for g in given_grams(w, int(min_q), int(max_q), f)]

    @F.pandas_udf("array<string>")
    def rare(text: pd.Series, min_q: pd.Series, max_q: pd.Series, frequent: pd.Series) -> pd.Series:
        return pd.Series([grams_of(*x) for x in zip(text, min_q, max_q, frequent, strict=True)])

    @F.pandas_udf("array<string>")
    def stat(text: pd.Series, min_q: pd.Series, max_q: pd.Series, threshold: pd.Series) -> List[str]:
        if not len(text):
            return None
        low, high, share = int(min_q.iloc[0]), int(max_q.iloc[0]), float(threshold.iloc[0])  # those of the first row hold
        check_lengths(low, high, ("min_q", "max_q"))
        count: dict[str, int] = {}
        for t in text:
            ws = padded_words(t) if t is not None else []
            for g in {w[p : p + q] for w in ws for q in range(low, high + 1) for p in range(len(w) - q + 1)}:
                count[g] = count.get(g, 0) + 1
        limit = int((len(text) - 1) * share)
        return sorted((g for g, n in count.items() if n >= limit), key=str.encode)

    @F.pandas_udf("array<string>")
    def keys(pattern: pd.Series, min_q: pd.Series, max_q: pd.Series, frequent: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else pattern_keys(p, GramOptions(int(a), int(b), tuple(f))) for p, a, b, f in zip(pattern, min_q, max_q, frequent, strict=True)])

    spark.udf.register(called["rare_grams"], rare)
    spark.udf.register(called["qgram_stat"], stat)
    spark.udf.register(called["gram_keys"], keys)
    # any character may be escaped here; LIKE itself takes an escape before wildcards and backslashes only
    plain = r"regexp_replace(pattern, r'\\([^%_\\])|(\\[%_\\])', '$1$2')"
    for name, operator in (("gram_like", "LIKE"), ("gram_ilike", "ILIKE")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {called[name]}(text STRING, pattern STRING) RETURNS BOOLEAN RETURN text {operator} {plain}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {called['gram_cmp']}(a STRING, b STRING) RETURNS INT RETURN CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END")

    @F.udtf(returnType="gram string, df bigint")
    class GramStat:
        """Grams of the texts given, with the number of texts that hold each."""

        def __init__(self):
            self.count: dict[str, int] = {}

        def eval(self, text: str, min_q: int, max_q: int):
            for g in {w[p : p + q] for w in (padded_words(text) if text is not None else []) for q in range(min_q, max_q + 1) for p in range(len(w) - q + 1)}:
                self.count[g] = self.count.get(g, 0) + 1

        def terminate(self):
            yield from self.count.items()

    spark.udtf.register(called["gram_stat"], GramStat)
