"""Near-duplicate documents by BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its shingles of ``shingle`` words. Weights are discretised to whole
counts; each shingle owns, by its hash alone, Poisson processes over the weight axis in blocks
[0,1), [1,2), [2,4), [4,8)...: points come in order of time, with a cell of the block and a signature
component. A document sees the points in cells below its counts; a component's value is its
earliest point. Two documents agree in a component with the probability of their weighted Jaccard
similarity. Blocks above a count are never opened, and points after the time by which all
components are filled are never made: the horizon is doubled only for documents with a gap.

Documents with equal multisets are one content. Contents that share a band of the signature are
candidates; in each bucket every content is compared with its head, the one that meets most others, and
contents outside the head's component are compared with those of the open buckets that an exact prefix filter
leaves. So no group is expanded into all its pairs, and no link between the candidates of a bucket is
lost. Components of links are classes.

Behaviour: a text of fewer than ``shingle`` words is one shingle; texts without words are copies
only of byte-equal texts, and a null text is alone; repeated rows are in one class; the class id
is the least id of the class, null ids last; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregram.llm.common import arrow_map, drop_scratch, free_name, join_counted, materialize, mix64, row_key, text_slices, utf8_rows, words_of
from raregram.llm.components import components, contract

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Ratio of one step of sizes in the key of the token join.
SIZE_STEP = 1.03
#: Expected gaps after the first horizon are exp(-SLACK).
SLACK = 2.5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash."""
    _, _, h, wo = words_of(data, offs)
    n = np.diff(wo)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(wo[:-1], count)
    stop = np.repeat(wo[1:], count)
    x = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = at + j < stop
            word = h[np.minimum(at + j, len(h) - 1)] if len(h) else x
            x = np.where(inside, mix64(x * np.uint64(5) + word + np.uint64(j)), x)
    by = np.lexsort((x, row))
    row, x = row[by], x[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    return row[first], x[first], np.diff(np.append(first, len(row)))


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, m: int = BANDS * ROWS, slack: float = SLACK) -> np.ndarray:
    """BagMinHash signatures (rows, m) of multisets; rows without items get a constant."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(rows * m, none)
    total = np.bincount(row, weight, rows)
    live = total > 0
    horizon = m * (np.log(m) + slack) / np.maximum(total, 1)
    top = int(weight.max()).bit_length() if len(weight) else 0
    while live.any():
        use = live[row]
        r0, x0, w0 = row[use], item[use], weight[use]
        for block in range(top + 1):
            low = 0 if block == 0 else 1 << (block - 1)
            size = max(1, low)
            opened = w0 > low
            r, w = r0[opened], w0[opened]
            state = mix64(x0[opened] ^ mix64(np.full(1, block + 1, np.uint64)))
            t = np.zeros(len(r))
            step = np.uint64(0)
            while len(r):
                with np.errstate(over="ignore"):
                    step += np.uint64(1)
                    s = mix64(state + step * _STEP)
                t = t - np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
                keep = t <= horizon[r]
                r, w, state, t, s = r[keep], w[keep], state[keep], t[keep], s[keep]
                p = mix64(s ^ _STEP)
                seen = np.ones(len(r), bool) if size == 1 else low + ((p >> np.uint64(40)) & np.uint64(size - 1)).astype(np.int64) < w
                part = ((p & np.uint64(0xFFFFF)) * np.uint64(m) >> np.uint64(20)).astype(np.int64)
                value = t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | p >> np.uint64(32)
                np.minimum.at(sig, (r * m + part)[seen], value[seen])
        gaps = (sig.reshape(rows, m) == none).any(axis=1)
        live &= gaps
        horizon[live] *= 2
    return sig.reshape(rows, m)


def fingerprints(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each multiset, whatever its order."""
    out = []
    for salt in (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)):
        with np.errstate(over="ignore"):
            v = mix64(mix64(item ^ salt) + weight.astype(np.uint64) * _STEP)
            total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        edge = np.searchsorted(row, np.arange(rows + 1))
        with np.errstate(over="ignore"):
            out.append(mix64(total[edge[1:]] - total[edge[:-1]] + salt))
    return out[0], out[1]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, counts)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - least
    return least / total if total else 1.0


_SIG = "doc_id long, k1 long, k2 long, f struct<a:long,b:long>, weight long, bands array<long>"


def _sign(docs: DataFrame, k: int, bands: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offs = utf8_rows(part.column("text"))
                rows = part.num_rows
                row, item, weight = shingles(data, offs, k)
                f1, f2 = fingerprints(row, item, weight, rows)
                total = np.bincount(row, weight, rows).astype(np.int64)
                # copies within the slice share one signature
                _, first, back = np.unique(f1 ^ mix64(f2), return_index=True, return_inverse=True)
                chosen = np.zeros(rows, bool)
                chosen[first] = True
                place = np.cumsum(chosen) - 1
                use = chosen[row]
                sig = signatures(place[row[use]], item[use], weight[use], int(chosen.sum()), bands * depth)
                key = np.zeros((len(sig), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(depth):
                        key = mix64(key * np.uint64(5) + sig[:, j::depth] + np.uint64(j))
                    key = mix64(key + np.arange(bands, dtype=np.uint64))
                key = key.view(np.int64)[place[first][back]]
                # texts without words are known by their bytes, and have no bands
                some = total > 0
                if not some.all():
                    blank = part.column("blank").to_numpy(zero_copy_only=False)
                    f1, f2 = np.where(some, f1, blank.view(np.uint64)), np.where(some, f2, np.uint64(0))
                f = pa.StructArray.from_arrays([pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], names=["a", "b"])
                f = pa.array([x if t else None for x, t in zip(f.to_pylist(), part.column("text").is_valid().to_pylist(), strict=True)], f.type) if part.column("text").null_count else f
                counts = np.where(some, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(key[some].ravel()))
                yield pa.record_batch([part.column("doc_id"), part.column("k1"), part.column("k2"), f, pa.array(total), lists], names=["doc_id", "k1", "k2", "f", "weight", "bands"])

    return arrow_map(docs.withColumn("blank", F.xxhash64(F.lit(1), "text")), run, _SIG)


def _verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(u, v, similarity) of content pairs. Each pair meets its texts by two joins on one content each."""
    left = pairs.join(texts.select(F.col("f").alias("u"), F.col("text").alias("tu")), "u")
    both = left.join(texts.select(F.col("f").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None

        def bag(text: str):
            _, item, weight = shingles(*utf8_rows(pa.array([text])), k)
            return item, weight

        for batch in batches:
            tu, tv = batch.column("tu"), batch.column("tv")
            out = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                v = tv[i].as_py()
                if v != last:  # the join leaves pairs of one v together
                    last, kept = v, bag(v)
                out[i] = overlap(bag(tu[i].as_py()), kept)
            yield pa.record_batch([batch.column("u"), batch.column("v"), pa.array(out)], names=["u", "v", "sim"])

    node = "struct<a:long,b:long>"
    return both.transform(arrow_map, run, f"u {node}, v {node}, sim double")


def _rest(contents: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (u, v) of a lone content and another one that may still be similar, by exact prefix filtering.

    A content is the set of its (shingle, occurrence) tokens. Two contents of similarity ``threshold``
    share more tokens than either leaves out of its prefix, the rarest ``n - ceil(threshold * n) + 1`` of its
    n tokens, so their prefixes share one, and the first one shared stands early enough in both. Tokens of a
    single content only shorten its prefix: an edited copy with enough words of its own has no partner.
    """
    node = "struct<a:long,b:long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                row, item, weight = shingles(*utf8_rows(part.column("text")), k)
                each = np.repeat(np.arange(len(row)), weight)
                turn = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    token = mix64(item[each] + turn.astype(np.uint64) * _STEP).view(np.int64)
                yield pa.record_batch([part.column("f").take(pa.array(row[each])), pa.array(token)], names=["f", "token"])

    tokens = materialize(texts.join(contents.select("f"), "f", "left_semi").transform(arrow_map, run, f"f {node}, token long"), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    size = tokens.groupBy("f").agg(F.count("*").alias("n"))
    kept = tokens.join(common, "token").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    # single tokens are the rarest: they fill the prefix first, and the places before the others
    left = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) - (F.col("n") - F.size("t"))
    prefix = kept.join(size, "f").join(contents, "f").withColumn("left", left).where("left > 0")
    prefix = prefix.select("f", "lone", "comp", "n", F.size("t").alias("rest"), F.posexplode(F.expr("slice(t, 1, int(left))")).alias("i", "x"))
    # ``rest``: tokens from this one on
    prefix = materialize(prefix.select("f", "lone", "comp", "n", (F.col("rest") - F.col("i")).alias("rest"), "x.token"), "prefix")
    # The first token that two contents share leaves at most the shorter rest in common, so a content with n tokens and
    # a rest of r meets no other of more than (1 + t) / t * r - n tokens, nor of sizes below t * n or above n / t.
    # Sizes go into the key in steps, so contents whose rests are too short for each other don't meet at all.
    def step(n):
        return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")

    slack = 1e-6
    least = F.greatest(F.lit(1.0), threshold * F.col("n") - slack)
    most = F.least(F.col("n") / threshold, (1 + threshold) / threshold * F.col("rest") - F.col("n")) + slack
    one = prefix.where("lone").where(most >= least).select("token", F.explode(F.sequence(step(least), step(most))).alias("size"), F.col("f").alias("v"), F.col("comp").alias("cv"), F.col("n").alias("nv"), F.col("rest").alias("rv"))
    two = prefix.where(most >= least).select("token", step(F.col("n")).alias("size"), F.col("f").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"), F.col("rest").alias("ru"))
    enough = F.least("ru", "rv") * (1 + threshold) >= threshold * (F.col("nu") + F.col("nv")) - slack
    pairs = one.join(two, ["token", "size"]).where((F.col("cu") != F.col("cv")) & enough)
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "more")
    for used in (tokens, prefix):
        drop_scratch(used)
    return pairs


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, f, root): each document's content and the least content of its class."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("*", *row_key("doc_id", "text"))
    sig = materialize(_sign(docs, shingle, bands, rows), "signatures")
    reps = sig.where("weight > 0").groupBy("f").agg(F.min(F.struct("k1", "k2")).alias("place"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    bucket = reps.select("f", "weight", F.explode("bands").alias("band"))
    sizes = bucket.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(bucket.join(sizes, "band"), "shared")
    # The head of a bucket is the content that meets most others over all its bands: of edited copies, the least edited.
    met = shared.groupBy("f").agg(F.sum("n").alias("met"))
    ranked = shared.join(met, "f").select("band", "f", "weight", "met")
    heads = materialize(ranked.groupBy("band").agg(F.max(F.struct("met", "f")).alias("top")).select("band", F.col("top.f").alias("head")), "heads")
    bucket = materialize(ranked.join(heads, "band").select("band", "f", "weight", "head"), "buckets")
    pairs = bucket.where("f != head").select(F.col("f").alias("u"), F.col("head").alias("v")).distinct()
    pairs = materialize(pairs, "pairs")
    # texts of the contents that take part, one row each
    part = bucket.select("f").distinct().join(reps.select("f", "place"), "f").select("f", "place.*")
    texts = docs.join(part, ["k1", "k2"]).select("f", "text").dropDuplicates(["f"])
    texts = materialize(texts, "texts")
    sims = materialize(_verify(pairs, texts, shingle), "similarities")
    first = sims.where(F.col("sim") >= threshold).select("u", "v")
    comp = contract(first, 2)
    near = comp.select(F.col("u").alias("f"), F.col("v").alias("cf"))
    # a head's component is looked up once for each bucket, not for each of its rows
    top = heads.join(comp.select(F.col("u").alias("head"), F.col("v").alias("ch")), "head", "left").select("band", F.coalesce("ch", "head").alias("ch"))
    placed = bucket.join(near, "f", "left").join(top, "band").withColumn("lone", F.coalesce("cf", "f") != F.col("ch"))
    placed = materialize(placed.select("band", "f", F.coalesce("cf", "f").alias("comp"), "lone"), "placed")
    # contents of buckets that are not one component yet
    open_ = placed.join(placed.where("lone").select("band").distinct(), "band", "left_semi").groupBy("f").agg(F.bool_or("lone").alias("lone"), F.min("comp").alias("comp"))
    more = _rest(open_, texts, shingle, threshold)
    again = _verify(more, texts, shingle).where(F.col("sim") >= threshold).select("u", "v")
    links = components(comp.unionByName(first).unionByName(again))
    out = sig.select("doc_id", "k1", "k2", "f").join(links.select(F.col("u").alias("f"), F.col("v").alias("root")), "f", "left").select("doc_id", "k1", "k2", "f", F.coalesce("root", "f").alias("root"))
    out = materialize(out, "classes")
    for used in (sig, shared, heads, bucket, pairs, texts, sims, placed, more, comp, links):
        drop_scratch(used)
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id) of every document."""
    rows = classes(docs, **options)
    known = rows.where("root is not null")
    least = materialize(known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "roots")
    named = join_counted(known, least, ["root"], "rows", known.count()).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return named.unionByName(rows.where("root is null").select("doc_id", F.col("doc_id").alias("class_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns; null texts stay.

    Of rows alike in id and text any one is kept. Columns of any name are kept as they are.
    """
    rows = classes(docs, id_col=id_col, text_col=text_col, **options)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("p")).select("p.k1", "p.k2")
    a, b = free_name(docs.columns, "k1"), free_name(docs.columns, "k2")
    keys = row_key(F.col(id_col).cast("long"), F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).withColumns({a: keys[0], b: keys[1]})
    kept = texts.join(first.select(F.col("k1").alias(a), F.col("k2").alias(b)), [a, b], "left_semi")
    kept = kept.dropDuplicates([a, b]).select(*docs.columns)  # repeated rows
    return kept.unionByName(docs.where(F.col(text_col).isNull()))
