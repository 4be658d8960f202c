"""Nearest neighbours by multi-index hashing.

Codes: vectors are centred and rotated by a learned rotation (iterative quantisation on a bounded
sample) and cut to signs. A code of ``bits`` bits is split into substrings; each block of rows has
an index of its own for every substring (rows ordered by value, with offsets). A query probes, in
every index, all values within ``radius // parts`` bits (one less in the parts beyond ``radius % parts``):
by the pigeonhole principle this reaches every code within the Hamming radius. Codes beyond the radius
are dropped, the rest are reranked by their float inner products in double precision.

The radius starts from the distances seen in the sample and grows for a query until the block
gave at least ``least`` codes, so a query always has as many results as there are rows.

Copies of one vector are one row of the index that keeps its ids in order; no more than ``k + 1`` of them can
be results of a query, so a crowd of copies costs what one vector costs.

The queries are a stated set. Rows are shuffled once, into blocks of a fixed size with an index each; every block
answers the stream of queries with its best ``k``, of which the best ``k`` of all blocks are kept. There is no all-pairs table.

Vectors have inner products with those of their own length alone. The rotation learned on the sample serves the
commonest length; blocks of other lengths learn one each from at most ``SAMPLE_ROWS`` of their own rows.

Behaviour: vectors that are null, empty, zero, or hold a null or non-finite number take no part; a query finds
rows of its own length only; ties go to the smaller id; rows alike in id and vector count once, as queries
and as neighbours; other repeated ids are rows of their own, but never neighbours of themselves; fewer than ``k`` candidates give all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm.common import arrow_map, materialize

K = 20
BITS, PARTS = 64, 8
SAMPLE_ROWS = 4000
ROW_BLOCK = 16384
#: Share of the sample's true neighbours that lie within the first radius.
COVER = 0.97
ITERATIONS = 20

SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


class Coder:
    """Centre, rotation, and first radius."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, k: int = K, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        bits = -(-bits // 8) * 8
        if bits <= dim:
            _, _, axes = np.linalg.svd(x, full_matrices=False) if n >= bits else (0, 0, np.linalg.qr(rng.normal(size=(dim, dim)))[0])
            base = axes[:bits].T
        else:  # more bits than dimensions: several rotations side by side
            base = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)[:, :bits]
        y = x @ base
        rot = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ITERATIONS):  # turn the data towards the corners of the cube, the corners towards the data
            u, _, vt = np.linalg.svd(np.where(y @ rot >= 0, 1.0, -1.0).T @ y)
            rot = (u @ vt).T
        self.turn = base @ rot
        self.radius = bits // 2
        if n > 2 * k:
            codes = self.encode(sample)
            some = rng.permutation(n)[:200]
            dots = sample[some] @ sample.T
            dots[np.arange(len(some)), some] = -np.inf
            near = np.argpartition(-dots, k, axis=1)[:, :k]
            far = np.bitwise_count(codes[some][:, None] ^ codes[near]).sum(axis=2)
            self.radius = int(np.quantile(far, COVER, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes (rows, bits / 8)."""
        return np.packbits((x - self.mean) @ self.turn >= 0, axis=1)


def _ball(value: int, radius: int) -> list[int]:
    """All bytes within ``radius`` bits of a byte."""
    out = [value]
    for r in range(1, radius + 1):
        for flips in combinations(range(8), r):
            out.append(value ^ sum(1 << f for f in flips))
    return out


class Index:
    """Substring indexes of one block of distinct vectors."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = codes.view(np.uint64)[:, 0] if codes.shape[1] == 8 else None
        self.parts = codes.shape[1]
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(self.parts)]
        self.at = [np.searchsorted(codes[o, p], np.arange(257)) for p, o in enumerate(self.order)]
        self.balls = [[_ball(v, r) for v in range(256)] for r in range(9)]
        self.stamp = np.zeros(len(codes), bool)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        each, extra = divmod(radius, self.parts)
        for p in range(self.parts):
            r = min(8, each if p <= extra else each - 1)
            if r < 0:
                continue
            order, at = self.order[p], self.at[p]
            for v in self.balls[r][code[p]]:
                self.stamp[order[at[v] : at[v + 1]]] = True
        rows = np.flatnonzero(self.stamp)
        self.stamp[rows] = False
        if self.words is not None:
            far = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)[0])
        else:
            far = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
        return rows[far <= radius]


class Block:
    """A block of distinct vectors with their ids and index."""

    def __init__(self, ids: list[np.ndarray], x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.index = ids, x, Index(codes)
        self.copies = np.array([len(i) for i in ids])

    def search(self, q_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, radius: int, k: int = K) -> list[tuple[int, int, float]]:
        """The best ``k`` for each query: (query row, vec_id, score)."""
        out = []
        for j in range(len(q)):
            r = radius
            while True:
                rows = self.index.within(q_codes[j], r)
                if self.copies[rows].sum() > k or r >= 8 * self.index.parts:  # one of them may be the query itself
                    break
                r += 4
            score = exact_dots(self.x[rows], q[j])
            if len(rows) > 4 * k:
                least = np.partition(score, len(score) - (k + 1))[len(score) - (k + 1)]
                rows, score = rows[score >= least], score[score >= least]
            got = [(-s, i) for row, s in zip(rows, score, strict=True) for i in self.ids[row] if i != q_ids[j]]
            out += [(j, i, -s) for s, i in sorted(got)[:k]]
        return out


def exact_dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one order whatever the number of rows, so equal pairs have equal scores."""
    return np.einsum("ij,j->i", x, q, optimize=False)


def own_coder(x: np.ndarray, bits: int = BITS, k: int = K) -> Coder:
    """A coder learned from at most ``SAMPLE_ROWS`` of the rows given; their order does not matter."""
    x = x[np.lexsort(x.T)]
    return Coder(x[np.random.default_rng(2).permutation(len(x))[:SAMPLE_ROWS]], bits, k)


def search(vectors: DataFrame, is_query, k: int = K, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row of which the condition ``is_query`` holds."""
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = good.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    good = materialize(good.withColumn("n", F.size("v")), "vectors")
    sizes = good.groupBy("n").count()
    most, total = sizes.agg(F.max(F.struct("count", (-F.col("n")).alias("n"))), F.sum("count")).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    dim, rows = -most["n"], most["count"]
    common = good.where(F.col("n") == dim)
    # the sample: by hash of id and vector, bounded
    h = F.xxhash64(F.lit(9), "vec_id", "v")
    spread = (h.cast("double") / 2.0**63 + 1) / 2
    picked = common.where(spread <= min(1.0, sample_rows / rows)).select("vec_id", "v").orderBy(h).limit(2 * sample_rows).toArrow()
    if picked.num_rows == 0:
        picked = common.select("vec_id", "v").orderBy(h).limit(1).toArrow()
    coder = Coder(np.array(picked["v"].to_pylist(), float).reshape(-1, dim), bits, k)
    shared = spark.sparkContext.broadcast(coder)
    # rows alike in id and vector count once; copies together, with their least ids: no more than k + 1 of one vector can be results
    copies = good.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    part = copies.groupBy("v", "salt").agg(few(F.collect_set("vec_id")).alias("ids"))
    distinct = part.groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    # Each row goes to one block, which has one index; each query goes to every block of its length. In a block rows come
    # first, then the queries in batches that are answered as they come. The commonest length has the first tasks, a block each;
    # blocks of other lengths are dealt over further tasks.
    blocks = -(-rows // ROW_BLOCK)
    others = -(-(total - rows) // ROW_BLOCK)
    mine = F.size("v") == dim
    split = F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(blocks)).cast("int")
    base = distinct.where(mine).select(split.alias("rb"), F.lit(dim).alias("n"), F.lit(0).alias("sub"), F.lit(0).alias("turn"), "ids", "v")
    asked = good.where("q").select("vec_id", "v").distinct()
    queries = asked.where(mine).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), F.lit(dim).alias("n"), F.lit(0).alias("sub"), F.lit(1).alias("turn"), F.array("vec_id").alias("ids"), "v")
    work = base.unionByName(queries)
    if others:
        parts = sizes.where(F.col("n") != dim).select("n", F.ceil(F.col("count") / ROW_BLOCK).cast("int").alias("subs"))
        task = (F.lit(blocks) + F.pmod(F.xxhash64(F.lit(5), "n", "sub"), F.lit(others))).cast("int").alias("rb")
        rest = distinct.where(~mine).withColumn("n", F.size("v")).join(parts, "n").withColumn("sub", F.pmod(F.xxhash64(F.lit(3), "v"), F.col("subs")).cast("int"))
        rest_asked = asked.where(~mine).withColumn("n", F.size("v")).join(parts, "n").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        work = work.unionByName(rest.select(task, "n", "sub", F.lit(0).alias("turn"), "ids", "v")).unionByName(rest_asked.select(task, "n", "sub", F.lit(1).alias("turn"), F.array("vec_id").alias("ids"), "v"))

    def matrix(col) -> np.ndarray:
        return np.asarray(col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten(), float).reshape(len(col), -1)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index, c = None, [], None, None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in ("rb", "n", "sub", "turn")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(key[a, :3]) != block:
                    block, held, index = tuple(key[a, :3]), [], None
                if not key[a, 3]:
                    held.append((matrix(part.column("v")), part.column("ids").to_pylist()))
                    continue
                if index is None and held:
                    x = np.concatenate([m for m, _ in held])
                    ids = [np.array(i) for _, some in held for i in some]
                    c = shared.value if x.shape[1] == dim else own_coder(x, bits, k)
                    index = Block(ids, x, c.encode(x))
                    held = []
                if index is None:
                    continue
                q = matrix(part.column("v"))
                q_ids = part.column("ids").flatten().to_numpy()
                got = index.search(q_ids, q, c.encode(q), c.radius, k)
                j, i, s = (np.array(z) for z in zip(*got, strict=True)) if got else ([], [], [])
                yield pa.record_batch([pa.array(q_ids[np.array(j, int)]), pa.array(np.array(i, np.int64)), pa.array(np.array(s, float))], names=["query_id", "vec_id", "score"])

    found = work.repartitionById(blocks + others, F.col("rb")).sortWithinPartitions("rb", "n", "sub", "turn").transform(arrow_map, answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
