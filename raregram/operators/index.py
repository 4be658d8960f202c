"""The gram index: postings in Parquet, ordered by gram, and searches that recheck their candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregram.functions.patterns import backtracks, normalise, regex
from raregram.functions.patterns import keys as pattern_keys
from raregram.operators.extract import postings
from raregram.options import GramOptions

#: Non-ASCII characters with an ASCII letter in their lower case. ILIKE finds them as that letter,
#: the words of the index don't; rows that hold one are candidates of every ILIKE.
ODD_CASE = "\u0130\u212a"
#: The key under which those rows are posted.
ODD_KEY = ""
#: Candidates up to this many are sent into the scan as ranges and a list; more are joined.
MOST_PUSHED, RANGES = 4096, 64
#: Size of the row groups of a table laid out for searches.
GROUP_BYTES = 1 << 20


@dataclass(frozen=True)
class GramIndex:
    """Postings (gram, row_id) of one text column under some options."""

    postings: DataFrame
    options: GramOptions
    #: Whether looking up a few keys is a short job of its own.
    stored: bool = False

    @classmethod
    def build(cls, df: DataFrame, row_id: str, text: str, options: GramOptions) -> GramIndex:
        """An index that lives in the plan; :meth:`write` stores it."""
        return cls(postings(df, row_id, text, options, odd_case(F.col(text))), options)

    def write(self, path: str, partitions: int | None = None, mode: str = "overwrite") -> GramIndex:
        """Store the postings ordered by gram, so that a key reads few row groups.

        The range is over gram and row, so a gram of very many rows is spread over several files.
        """
        spark = self.postings.sparkSession
        cols = ("gram", "row_id")
        p = self.postings.repartitionByRange(partitions, *cols) if partitions else self.postings.repartitionByRange(*cols)
        p.sortWithinPartitions(*cols).write.mode(mode).parquet(f"{path}/postings")
        o = self.options
        rows = [(o.min_q, o.max_q, list(o.frequent))]
        spark.createDataFrame(rows, "min_q int, max_q int, frequent array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return GramIndex.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GramIndex:
        m = spark.read.parquet(f"{path}/manifest").first()
        return cls(spark.read.parquet(f"{path}/postings").select("gram", "row_id"), GramOptions(m["min_q"], m["max_q"], tuple(m["frequent"])), stored=True)

    @staticmethod
    def drop(spark: SparkSession, path: str) -> bool:
        """Delete a stored index; whether there was one."""
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return files.delete(target, True)

    def keys(self, pattern: str, escape: str = "\\", fold: bool = False) -> list[str]:
        return pattern_keys(pattern, self.options, escape, fold=fold)

    def rarest(self, keys: list[str], most: int) -> list[str]:
        """The ``most`` keys with the fewest postings; absent keys come first."""
        counts = {r["gram"]: r["count"] for r in self.postings.where(F.col("gram").isin(keys)).groupBy("gram").count().collect()}
        return sorted(sorted(keys, key=lambda k: (counts.get(k, 0), k))[:most])

    def candidates(self, keys: list[str], fold: bool = False) -> DataFrame:
        """(row_id) of the rows that have all keys; with ``fold`` also of those posted as odd."""
        if len(keys) == 1 and not fold:  # each posting is a candidate
            return self.postings.where(F.col("gram") == keys[0]).select("row_id")
        hits = self.postings.where(F.col("gram").isin(keys + [ODD_KEY] * fold))
        by_row = hits.groupBy("row_id").agg(F.count(F.when(F.col("gram") != ODD_KEY, 1)).alias("n"), F.bool_or(F.col("gram") == ODD_KEY).alias("odd"))
        return by_row.where((F.col("n") == len(keys)) | F.col("odd")).select("row_id")

    def candidate_counts(self, patterns: list[str], escape: str = "\\") -> DataFrame:
        """(pattern, n): how many rows are candidates of each pattern that has keys; all patterns are met in one pass over the postings."""
        spark = self.postings.sparkSession
        wanted = {p: self.keys(p, escape) for p in patterns}
        keyed = spark.createDataFrame([(p, k, len(ks)) for p, ks in wanted.items() for k in ks], "pattern string, gram string, wanted int")
        by_row = self.postings.join(F.broadcast(keyed), "gram").groupBy("pattern", "row_id").agg(F.count("*").alias("n"), F.max("wanted").alias("wanted"))
        counts = by_row.where("n = wanted").groupBy("pattern").agg(F.count("*").alias("n"))
        return keyed.select("pattern").distinct().join(F.broadcast(counts), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))

    def search(self, df: DataFrame, row_id: str, text: str, pattern: str | None, escape: str = "\\", fold: bool = False, probe: int | None = None) -> DataFrame:
        """The rows of ``df`` whose text is LIKE (with ``fold`` ILIKE) the pattern, by way of the index.

        A pattern without keys is answered by a scan; a null pattern matches nothing. ``probe`` limits the keys
        looked up to the rarest; the recheck makes the answer the same.
        """
        if pattern is None:
            return df.where(F.lit(False))
        match = like(F.col(text), pattern, escape, fold)
        keys = self.keys(pattern, escape, fold)
        if not keys:
            return df.where(match)
        if probe and len(keys) > probe:
            keys = self.rarest(keys, probe)
        candidates = self.candidates(keys, fold)
        if self.stored:
            few = [r["row_id"] for r in candidates.limit(MOST_PUSHED + 1).collect()]
            if len(few) <= MOST_PUSHED:
                return df.where(_one_of(F.col(row_id), few)).where(match)
        found = candidates.withColumnRenamed("row_id", "_candidate")
        return df.join(found, F.col(row_id) == F.col("_candidate"), "left_semi").where(match)

    def like(self, df: DataFrame, row_id: str, text: str, pattern: str | None, escape: str = "\\", **options) -> DataFrame:
        return self.search(df, row_id, text, pattern, escape, fold=False, **options)

    def ilike(self, df: DataFrame, row_id: str, text: str, pattern: str | None, escape: str = "\\", **options) -> DataFrame:
        return self.search(df, row_id, text, pattern, escape, fold=True, **options)


def odd_case(text: Column) -> Column:
    """Whether a text holds one of the letters of ``ODD_CASE``."""
    found = [F.contains(text, F.lit(c)) for c in ODD_CASE]
    return found[0] | found[1]


def store_rows(df: DataFrame, row_id: str, path: str, group_bytes: int = GROUP_BYTES, partitions: int | None = None) -> DataFrame:
    """The table laid out by row, in small row groups, so that a search through a stored index reads the groups of its candidates alone."""
    p = df.repartitionByRange(partitions, row_id) if partitions else df.repartitionByRange(row_id)
    p.sortWithinPartitions(row_id).write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 10).parquet(path)
    return df.sparkSession.read.parquet(path)


def _one_of(row: Column, ids: list) -> Column:
    """Whether the row is one of a bounded list, with ranges around them that a scan can skip row groups by."""
    if not ids:
        return F.lit(False)
    ids = sorted(ids)
    gaps = range(1, len(ids))
    if not isinstance(ids[0], str):  # the widest gaps part the ranges
        gaps = sorted(gaps, key=lambda i: ids[i - 1] - ids[i])
    cuts = sorted([*list(gaps)[: RANGES - 1], 0, len(ids)])
    near = [row.between(ids[a], ids[b - 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    while len(near) > 1:  # a balanced tree, whatever the number
        near = [near[i] | near[i + 1] if i + 1 < len(near) else near[i] for i in range(0, len(near), 2)]
    return near[0] & row.isin(ids)


def not_like(df: DataFrame, text: str, pattern: str | None, escape: str = "\\", fold: bool = False) -> DataFrame:
    """NOT LIKE is a filter: no index can rule rows in. A null pattern keeps nothing."""
    if pattern is None:
        return df.where(F.lit(False))
    return df.where(~like(F.col(text), pattern, escape, fold))


def like(text: Column, pattern: str | None, escape: str = "\\", fold: bool = False) -> Column:
    """LIKE with the pattern rules of the index: any character may be escaped. It takes time that goes by the text's length."""
    if pattern is None:
        return F.lit(None).cast("boolean")
    plain = normalise(pattern, escape)
    if backtracks(plain) and (plain.isascii() or not fold):  # others are lower-cased by Spark
        return F.lower(text).rlike(regex(plain.lower())) if fold else text.rlike(regex(plain))
    return text.ilike(plain) if fold else text.like(plain)
