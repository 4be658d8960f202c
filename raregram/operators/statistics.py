"""Gram statistics of a text column: document frequencies, frequent grams, column statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from raregram.functions.codes import Counter, chunks
from raregram.functions.words import row_grams
from raregram.options import MOST_Q, check_lengths
from raregram.shipping import ship

#: Fixed values of column statistics: gram lengths, grams kept for each unit of target, and the terms of the cutoff.
STAT_MIN_Q, STAT_MAX_Q = 1, 3
KEPT_PER_TARGET = 10
DEFAULT_TARGET = 100
SAMPLE_PER_TARGET = 300


def _counted(df: DataFrame, text: str, min_q: int, max_q: int, by: Sequence[str] = (), total: bool = False) -> DataFrame:
    """(by..., gram, _count): partial counts of the rows that hold each gram, each batch of texts counted at once where it lies.

    With ``total`` the empty gram has the number of all occurrences.
    """
    ship(df.sparkSession)

    def run(batches):
        counter, occurrences = Counter(max_q), 0
        kinds = [pa.string()] * len(by)

        def taken():
            values, groups, grams, counts = counter.take()
            keys = [pa.array([v[j] for v in values], kinds[j]).take(pa.array(groups)) for j in range(len(by))]
            return pa.record_batch([*keys, grams, pa.array(counts, pa.int64())], names=[*by, "gram", "_count"])

        for batch in batches:
            kinds = [batch.column(j).type for j in range(len(by))]
            keys = list(zip(*[batch.column(j).to_pylist() for j in range(len(by))], strict=True))
            for first, chunk in chunks(batch.column(len(by)), max_q):
                groups = None
                if by:
                    of = keys[first : first + chunk.rows]
                    if counter.full(len(of)):
                        yield taken()
                    groups = np.array([counter.group(v) for v in of], np.int64)
                for rows, codes in chunk.all_grams(min_q, max_q):
                    counter.add(groups[rows] if by else 0, codes)
                if total:
                    occurrences += chunk.occurrences(min_q, max_q)
                if counter.full():
                    yield taken()
        if counter.size:
            yield taken()
        if total and occurrences:
            yield pa.record_batch([pa.array([""]), pa.array([occurrences], pa.int64())], names=["gram", "_count"])

    given = df.select(*by, F.col(text).cast("string").alias("_text"))
    schema = StructType([*given.schema.fields[: len(by)], StructField("gram", StringType()), StructField("_count", LongType())])
    return given.mapInArrow(run, schema)


def gram_frequencies(df: DataFrame, text: str, min_q: int, max_q: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., gram, df): in how many rows each gram occurs. Rows are counted before the shuffle."""
    if not 1 <= min_q <= max_q <= MOST_Q:
        once = df.select(*by, F.explode(row_grams(F.col(text), min_q, max_q)).alias("gram"))
        return once.groupBy(*by, "gram").agg(F.count("*").alias("df"))
    return _counted(df, text, min_q, max_q, by).groupBy(*by, "gram").agg(F.coalesce(F.sum("_count"), F.lit(0)).alias("df"))


def _limit(rows: Column, threshold: float) -> Column:
    """The least frequency kept. The first row of a group does not count in the share."""
    return F.floor((rows - 1) * F.lit(float(threshold))).cast("long")


def frequent_grams(df: DataFrame, text: str, min_q: int, max_q: int, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., gram, df) of the frequent grams."""
    check_lengths(min_q, max_q, ("min_q", "max_q"))
    rows = df.groupBy(*by).agg(F.count("*").alias("rows"))
    counts = gram_frequencies(df, text, min_q, max_q, by)
    if by:
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
        joined = counts.alias("c").join(rows.alias("r"), same)
        return joined.where(F.col("df") >= _limit(F.col("rows"), threshold)).select(*[F.col(f"c.{k}") for k in by], "gram", "df")
    # one row of totals is always small enough to send
    return counts.join(F.broadcast(rows), how="cross").where(F.col("df") >= _limit(F.col("rows"), threshold)).select("gram", "df")


def qgram_stat(df: DataFrame, text: str, min_q: int, max_q: int, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., grams): the sorted frequent grams of each group.

    Null texts count as rows. A group whose texts are all null has an empty array; without
    groups an empty table has a null. How many grams are frequent is bounded by the grams of an
    average row over the threshold, not by the number of rows.
    """
    found = frequent_grams(df, text, min_q, max_q, threshold, by)
    grams = F.array_sort(F.collect_list("gram"))
    if not by:
        rows = df.agg(F.count("*").alias("rows"))
        return rows.join(found.agg(grams.alias("grams")), how="cross").select(F.when(F.col("rows") > 0, F.col("grams")).alias("grams"))
    groups = df.select(*by).distinct()
    got = found.groupBy(*by).agg(grams.alias("grams"))
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in by]
    return groups.alias("g").join(got.alias("f"), same, "left").select(*[F.col(f"g.{k}") for k in by], F.coalesce("f.grams", F.array().cast("array<string>")).alias("grams"))


@dataclass(frozen=True)
class ColumnStats:
    """``grams`` (gram, freq) and a one-row ``summary``."""

    grams: DataFrame
    summary: DataFrame


def cutoff(occurrences: int, target: int = DEFAULT_TARGET) -> int:
    """Counts up to this are dropped: the error bound of counting in buckets of a fixed width."""
    width = (KEPT_PER_TARGET * target + 10) * 1000 // 7
    return 9 * occurrences // width


def analyze(df: DataFrame, text: str, target: int = DEFAULT_TARGET, sample: bool = False, seed: int = 1) -> ColumnStats:
    """Statistics of a column: its most common grams of one to three characters, and its shape.

    Counts are exact over the whole table, or over a random sample of about 300 rows for each
    unit of ``target``. Ties of counts at the end of the list go by gram. The grams are counted once, here: what is
    kept of them is bounded by ``target``, and the frames hold it.
    """
    if sample:
        n = df.count()
        df = df.sample(min(1.0, SAMPLE_PER_TARGET * target / n), seed) if n else df
    spark = df.sparkSession
    kept = KEPT_PER_TARGET * target
    shape = df.agg(F.count("*").alias("n_rows"), F.count(text).alias("n_text"), F.coalesce(F.avg(F.octet_length(F.col(text).cast("string"))), F.lit(0.0)).alias("avg_width")).first()
    counts = _counted(df, text, STAT_MIN_Q, STAT_MAX_Q, total=True).groupBy("gram").agg(F.sum("_count").alias("df"))
    # the number of all occurrences is under the empty gram, before all others: no gram has more rows
    top = [(r["gram"], r["df"]) for r in counts.orderBy(F.desc("df"), "gram").limit(kept + 1).collect()]
    occurrences = top[0][1] if top else 0
    rows, n_text = shape["n_rows"], shape["n_text"]
    grams = [(g, float(np.float32(n / n_text))) for g, n in top[1:] if n > cutoff(occurrences, target)]
    null_frac = 1 - n_text / rows if rows else 0.0
    ends = (min(f for _, f in grams), max(f for _, f in grams)) if grams else (None, None)
    summary = (rows, null_frac, shape["avg_width"], null_frac - 1 if n_text else 0.0, *ends, len(grams), occurrences)
    return ColumnStats(
        spark.createDataFrame(grams, "gram string, freq float"),
        spark.createDataFrame([summary], "n_rows long, null_frac double, avg_width double, n_distinct double, min_freq float, max_freq float, n_grams long, occurrences long"),
    )


def write_stats(stats: ColumnStats, path: str) -> None:
    stats.grams.coalesce(1).write.mode("overwrite").parquet(f"{path}/grams")
    stats.summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")


def read_stats(spark, path: str) -> ColumnStats:
    return ColumnStats(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/summary"))
