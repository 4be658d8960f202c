"""Connected components of a link table, by alternating star contraction.

No node or link is brought to the driver. Each round is a few hash aggregations and joins; stars
of links to a common least node, as the operators here make them, settle in one or two rounds.

Behaviour: repeated links and links of a node to itself count once and not at all; a link with a null end
joins nothing; least nodes and nodes without links have no row; an empty table gives no rows; columns other than u and v are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregram.llm.common import drop_scratch, materialize

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def contract(edges: DataFrame, rounds: int) -> DataFrame:
    """(u, v) after a fixed number of rounds: v is a node of u's component, not always its least one."""
    edges = edges.select("u", "v").where("u != v").distinct()
    for _ in range(rounds):
        edges = materialize(_small(_large(edges)), "links")
    return edges.groupBy("u").agg(F.min("v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every node but the least ones."""
    edges = materialize(edges.select("u", "v").where("u != v").distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            return edges
        new = materialize(_small(_large(edges)), "links")
        drop_scratch(edges)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            return edges
    raise RuntimeError("components did not settle")
