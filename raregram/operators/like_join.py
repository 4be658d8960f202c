"""Join of texts and a table of LIKE patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregram.functions.patterns import held, regex
from raregram.functions.patterns import keys as pattern_keys
from raregram.operators.index import GramIndex, odd_case
from raregram.shipping import ship

#: Patterns without keys are tested in blocks of about this many.
BLOCK = 4096
#: 128 bits that stand for a pattern where it meets the postings.
NAMES = ["_a", "_b"]
#: Whether a text matches: that it holds a piece is told without an expression.
_MATCH = "CASE WHEN {p}held IS NOT NULL THEN contains(text, {p}held) ELSE text RLIKE {p}regex END"


def like_join(df: DataFrame, row_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str, index: GramIndex, fold: bool = False) -> DataFrame:
    """(pattern_id, row_id) of all matches.

    The key of a pattern with the fewest postings meets the postings, and each row found is rechecked: the work goes by the rows
    of a pattern's rarest key, not by those of all its keys. Patterns without keys are tested in blocks, each an array: a
    single block is sent to every task, more blocks meet the rows part by part; with ``fold`` so are those with keys, against
    the rows posted as odd. Patterns are cut on executors, in Arrow batches. Null patterns match nothing.
    """
    spark = df.sparkSession
    kind = patterns.schema[pattern_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast((index.options, frozenset(index.options.closed)))

    def run(batches):
        options, closed = shared.value
        for batch in batches:
            cut = [pattern_keys(p, options, closed=closed, fold=fold) for p in batch.column("pattern").to_pylist()]
            plain = batch.column("plain").to_pylist()
            columns = [pa.array(cut, pa.list_(pa.string())), pa.array([held(p) for p in plain], pa.string()), pa.array([regex(p) for p in plain], pa.string())]
            yield pa.record_batch([batch.column("pattern_id"), batch.column("plain"), *columns], names=["pattern_id", "pattern", "keys", "held", "regex"])

    ship(spark)
    given = patterns.select(F.col(pattern_id).alias("pattern_id"), F.col(pattern).cast("string").alias("pattern"), _folded(F.col(pattern), fold).alias("plain")).where("pattern is not null")
    table = given.mapInArrow(run, f"pattern_id {kind}, pattern string, keys array<string>, held string, regex string").select("*", F.xxhash64("pattern").alias("_a"), F.xxhash64(F.lit(1), "pattern").alias("_b"))
    keyed, bare = table.where(F.size("keys") > 0), table.where(F.size("keys") == 0)
    numbers = table.agg(F.count(F.when(F.size("keys") > 0, 1)).alias("keyed"), F.count(F.when(F.size("keys") == 0, 1)).alias("bare")).first()
    odd = F.coalesce(odd_case(F.col(text)), F.lit(False)) if fold else F.lit(False)
    base = df.select(F.col(row_id).alias("row_id"), _folded(F.col(text), fold).alias("text"), odd.alias("odd"))
    out = []
    if numbers["keyed"]:
        few = numbers["keyed"] <= BLOCK
        sent = F.broadcast if few else (lambda frame: frame)
        hits = index.postings.join(sent(_rarest(index.postings, keyed, sent)), "gram").select(*NAMES, "row_id")
        known, rows, same = keyed.select("pattern_id", "held", "regex", *NAMES), base.where("not odd").alias("b"), F.col("h.row_id").eqNullSafe(F.col("b.row_id"))
        if few:
            met = hits.alias("h").join(rows, same).select(*NAMES, "b.row_id", "text").join(sent(known), NAMES)
        else:
            met = hits.join(known, NAMES).alias("h").join(rows, same).select("pattern_id", "held", "regex", "b.row_id", "text")
        out.append(met.where(_MATCH.format(p="")).select("pattern_id", "row_id"))
        if fold:
            out.append(_tested(base.where("odd"), keyed, numbers["keyed"]))
    if numbers["bare"]:
        out.append(_tested(base, bare, numbers["bare"]))
    return reduce(DataFrame.unionByName, out) if out else base.select(F.lit(None).cast(kind).alias("pattern_id"), "row_id").where("false")


def _folded(text: Column, fold: bool) -> Column:
    """ILIKE is LIKE of the lower cases of both sides."""
    return F.lower(text) if fold else text.cast("string")


def _rarest(postings: DataFrame, keyed: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(names..., gram): of each distinct pattern the key with the fewest postings; absent keys come first."""
    keys = keyed.select(*NAMES, F.explode("keys").alias("gram")).distinct()
    counts = postings.join(sent(keys.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("rows"))
    return keys.join(counts, "gram", "left").groupBy(*NAMES).agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "gram")).alias("key")).select(*NAMES, "key.gram")


def _tested(rows: DataFrame, patterns: DataFrame, number: int) -> DataFrame:
    """(pattern_id, row_id) of all matches of rows and patterns, each row tested against each pattern."""
    blocks = -(-number // BLOCK)
    block = F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(blocks))
    all_of = patterns.groupBy(block.alias("_block")).agg(F.collect_list(F.struct("pattern_id", "held", "regex")).alias("_p")).select("_p")
    tested = rows.crossJoin(F.broadcast(all_of) if blocks == 1 else all_of)
    return tested.select("row_id", F.explode(F.expr(f"filter(_p, x -> {_MATCH.format(p='x.')})")).alias("m")).select("m.pattern_id", "row_id")
