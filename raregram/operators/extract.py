"""Rare grams of texts, as relations over the distinct words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from raregram.functions.codes import Frequent, chunks, decode, row_grams
from raregram.functions.minimal import FrequentPrefixes, given_grams, padded_words
from raregram.functions.words import words
from raregram.options import GramOptions, check_lengths
from raregram.shipping import ship


def gram_table(spark: SparkSession, grams: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(g,) for g in grams], "gram string")


def _starts(dictionary: DataFrame, options: GramOptions) -> DataFrame:
    """(word, p, e): the end of the shortest rare gram from each start.

    With a closed frequent set a gram is rare where it is no member, so this is an anti join; the set is
    bounded by the grams of an average row over its threshold, and is sent or shuffled by its size.
    """
    grams = dictionary.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - (options.min_q - 1))).alias("p")).where("p >= 1 and p <= length(word)")
    grams = grams.select("word", "p", F.explode(F.sequence(F.lit(options.min_q), F.least(F.lit(options.max_q), F.length("word") - F.col("p") + 1))).alias("q")).where(F.col("p") + F.col("q") - 1 <= F.length("word"))
    grams = grams.select("word", "p", (F.col("p") + F.col("q") - 1).alias("e"), F.substring("word", F.col("p"), F.col("q")).alias("gram"))
    closed = options.closed
    if closed:
        grams = grams.join(gram_table(dictionary.sparkSession, closed), "gram", "left_anti")
    return grams.groupBy("word", "p").agg(F.min("e").alias("e"))


def first_rare_grams(dictionary: DataFrame, options: GramOptions) -> DataFrame:
    """(word, p, gram): the shortest rare gram from each start, redundant ones too."""
    return _starts(dictionary, options).select("word", "p", F.substring("word", F.col("p"), F.col("e") - F.col("p") + 1).alias("gram"))


def word_grams(dictionary: DataFrame, options: GramOptions) -> DataFrame:
    """(word, e, gram): the minimal rare grams of each distinct word."""
    last = _starts(dictionary, options).groupBy("word", "e").agg(F.max("p").alias("p"))
    return last.select("word", "e", F.substring("word", F.col("p"), F.col("e") - F.col("p") + 1).alias("gram"))


def word_occurrences(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, n, word) with the place of each word."""
    return df.select(F.col(row_id).alias("row_id"), F.posexplode(words(F.col(text))).alias("n", "word"))


def rare_grams(df: DataFrame, row_id: str, text: str, options: GramOptions) -> DataFrame:
    """(row_id, grams): the grams of every row in order, repeats kept; null for null texts.

    Grams depend on words alone, so they are made once for each distinct word. The set is taken closed under
    substrings; :func:`rare_grams_udf` takes it as it is.
    """
    occ = word_occurrences(df, row_id, text)
    by_word = word_grams(occ.select("word").distinct(), options).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "gram"))).alias("g"))
    rows = occ.join(by_word, "word").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("all"))
    grams = F.transform(F.flatten(F.transform("all", lambda x: x["g"])), lambda x: x["gram"])
    base = df.select(F.col(row_id).alias("row_id"), F.col(text).isNull().alias("none"))
    return base.join(rows.select("row_id", grams.alias("grams")), "row_id", "left").select("row_id", F.when(~F.col("none"), F.coalesce("grams", F.array().cast("array<string>"))).alias("grams"))


def rare_grams_udf(text: Column, min_q: int, max_q: int, frequent: Sequence[str]) -> Column:
    """The grams for a frequent set taken as it is given, in Arrow batches; words are looked up once a batch."""
    check_lengths(min_q, max_q, ("min_q", "max_q"))
    ship()
    members = tuple(frequent)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        f = FrequentPrefixes(members)
        seen: dict[str, list[str]] = {}

        def of(t):
            if t is None:
                return None
            out = []
            for w in padded_words(t):
                if w not in seen:
                    seen[w] = given_grams(w, min_q, max_q, f)
                out += seen[w]
            return out

        return s.map(of)

    return run(text)


def row_gram_sets(df: DataFrame, row_id: str, text: str, options: GramOptions, mark: Column | None = None) -> DataFrame:
    """(row_id, grams) of every row: its distinct minimal rare grams, cut where the row lies; null texts have none.

    Rows where ``mark`` holds have the empty gram too.
    """
    spark = df.sparkSession
    ship(spark)
    low, high = options.min_q, options.max_q
    shared = spark.sparkContext.broadcast(Frequent(options.closed))

    def run(batches):
        frequent = shared.value
        for batch in batches:
            for first, chunk in chunks(batch.column(2), high):
                rows, codes = row_grams(chunk, *chunk.rare_grams(low, high, frequent), high)
                ends = np.zeros(chunk.rows + 1, np.int32)
                np.cumsum(np.bincount(rows, minlength=chunk.rows), out=ends[1:])
                sets = pa.ListArray.from_arrays(pa.array(ends), decode(codes, high))
                yield pa.record_batch([*[batch.column(j).slice(first, chunk.rows) for j in (0, 1)], sets], names=["row_id", "mark", "grams"])

    given = df.select(F.col(row_id).alias("row_id"), (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("mark"), F.col(text).cast("string").alias("text"))
    sets = given.mapInArrow(run, StructType([*given.schema.fields[:2], StructField("grams", ArrayType(StringType()))]))
    if mark is None:
        return sets.select("row_id", "grams")
    return sets.select("row_id", F.when(F.col("mark"), F.concat("grams", F.array(F.lit("")))).otherwise(F.col("grams")).alias("grams"))


def postings(df: DataFrame, row_id: str, text: str, options: GramOptions, mark: Column | None = None) -> DataFrame:
    """(gram, row_id), each pair once; rows where ``mark`` holds stand under the empty gram too.

    Each row's grams are distinct, so the pairs are shuffled only where the ids are not: that is looked up first.
    """
    pairs = row_gram_sets(df, row_id, text, options, mark).select(F.explode("grams").alias("gram"), "row_id")
    repeated = df.groupBy(F.col(row_id)).count().where("count > 1").limit(1).count()
    return pairs.distinct() if repeated else pairs
