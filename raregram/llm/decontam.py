"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised to words and put into one automaton over word numbers. A document's
words are streamed through it; the state and the longest match length at each word tell which
windows (``window`` successive words of an item, or the whole of a shorter item) end there.
A word outside the benchmark's vocabulary resets the automaton to its root, so only runs of
vocabulary words at least as long as the shortest window need streaming.

The benchmark is read once and its words are counted; beyond ``chunk_words`` it is dealt into several automata,
each sent out and passed over the documents by itself, and their findings are united by 128 bits of the document. The driver
holds the words of one automaton at a time, a task those of its own.

Behaviour: null and empty texts have no words; items without words have no windows; repeated
items count by their ids, and items without an id mark words only; repeated rows and null ids are kept; an empty table of either kind
gives no hits; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm.common import arrow_map, free_name, row_key, text_slices, utf8_rows, words_of

WINDOW = 8
CHUNK_WORDS = 1_000_000
#: Share of hit words from which a whole document is removed.
MAX_COVERAGE = 0.5

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
])


class Automaton:
    """Generalised suffix automaton of items; ``find`` gives hit words and items of a text's words."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        words = [w for _, w in items]
        self.vocab = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]))
        coded = [(i, np.searchsorted(self.vocab, w).tolist()) for i, w in items if len(w)]
        self.least = min((min(len(w), window) for _, w in coded), default=window)
        for _, w in coded:
            last = 0
            for c in w:
                last = self._extend(last, c)
        self.items: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for item, w in coded:
            v = 0
            for at, c in enumerate(w):
                v = self.next[v][c]
                if len(w) >= window and at + 1 >= window:
                    self.items.setdefault(self._up(v, window), set()).add(item)
            if len(w) < window:
                self.short.setdefault(self._up(v, len(w)), set()).add((len(w), item))

    def _up(self, v: int, n: int) -> int:
        """The state of the last n words of state v's match."""
        while self.len[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _new(self, length: int, link: int, nexts: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(nexts)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """Clone q as the state of p's match and c."""
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        cur = self._new(self.len[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Word numbers, -1 outside the vocabulary."""
        if not len(self.vocab):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)

    def stream(self, codes: list[int], base: int, hits: list[tuple[int, int]], found: set) -> None:
        """Run over one stretch of vocabulary words; adds hit (start, end) words and items."""
        v = n = 0
        nexts, link, length, w = self.next, self.link, self.len, self.window
        for at, c in enumerate(codes):
            while v and c not in nexts[v]:
                v = link[v]
                n = length[v]
            to = nexts[v].get(c)
            if to is None:
                v = n = 0
                continue
            v, n = to, n + 1
            if n >= w:
                found |= self.items.get(self._up(v, w), ())
                if self._up(v, w) in self.items:
                    hits.append((base + at + 1 - w, base + at + 1))
            if self.short:
                u = v
                while u > 0:
                    for k, item in self.short.get(u, ()):
                        if k <= n:
                            found.add(item)
                            hits.append((base + at + 1 - k, base + at + 1))
                    u = link[u]

    def find(self, words: np.ndarray, offs: np.ndarray) -> dict[int, tuple[np.ndarray, set]]:
        """Hit mask and items by row, for the rows that have any."""
        codes = self.codes(words)
        known = codes >= 0
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        cut = np.ones(len(words) + 1, bool)
        cut[1:-1] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        run = (ends - starts >= self.least) & (known[starts] if len(starts) else False)
        out: dict[int, tuple[np.ndarray, set]] = {}
        for a, b in zip(starts[run], ends[run], strict=True):
            hits: list[tuple[int, int]] = []
            found: set = set()
            self.stream(codes[a:b].tolist(), int(a), hits, found)
            if found:
                r = int(row[a])
                mask, items = out.setdefault(r, (np.zeros(offs[r + 1] - offs[r], bool), set()))
                for x, y in hits:
                    mask[x - offs[r] : y - offs[r]] = True
                items |= found
        return out


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Benchmark items as word hashes, in chunks of at most about ``chunk_words`` words, one chunk at a time."""
    chunk: list = []
    n = 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        _, _, h, _ = words_of(*utf8_rows(pa.array([r["t"]])))
        if n and n + len(h) > chunk_words:
            yield chunk
            chunk, n = [], 0
        chunk.append((r["i"], h))
        n += len(h)
    yield chunk


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in items if i is not None})).encode()).hexdigest()



def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SPANS_DDL = "array<struct<a:long,b:long>>"


def _sent(spark: SparkSession, benchmark: DataFrame, chunk_words: int) -> list:
    """The items of each automaton, as files that Spark sends; the driver holds one chunk at a time."""
    return [spark.sparkContext.broadcast(chunk) for chunk in load_items(benchmark, chunk_words=chunk_words)]


def _found(rows: DataFrame, shared, window: int, keys: tuple[str, ...], only_hits: bool) -> DataFrame:
    """(keys..., n_words, spans of hit words, items) by one automaton, of all rows of (keys..., text) or of those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(shared.value, window)
        none = (np.zeros(0, bool), set())
        for batch in batches:
            for part in text_slices(batch):
                _, _, h, offs = words_of(*utf8_rows(part.column("text")))
                found = auto.find(h, offs)
                at = sorted(found) if only_hits else range(part.num_rows)
                spans = [[{"a": a, "b": b} for a, b in _runs(found.get(i, none)[0])] for i in at]
                items = [sorted(str(x) for x in found.get(i, none)[1] if x is not None) for i in at]
                take = pa.array(at, pa.int64())
                yield pa.record_batch([*[part.column(k).take(take) for k in keys], pa.array(np.diff(offs).astype(np.int64)).take(take), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=[*keys, "n_words", "spans", "items"])

    return rows.transform(arrow_map, run, f"{', '.join(k + ' long' for k in keys)}, n_words long, spans {_SPANS_DDL}, items array<string>")


def _united(rows: DataFrame, sent: list, window: int) -> DataFrame:
    """(k1, k2, spans, items) of the rows (k1, k2, text) that any automaton hits; rows that are alike count once."""
    out = None
    for shared in sent:
        one = _found(rows, shared, window, ("k1", "k2"), True)
        out = one if out is None else out.unionByName(one)
    each = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return out.groupBy("k1", "k2").agg(each("spans"), each("items"))


def findings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans of hit words, items) of each document."""
    sent = _sent(docs.sparkSession, benchmark, chunk_words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if len(sent) == 1:
        return _found(rows, sent[0], window, ("doc_id",), False)
    rows = rows.select("*", *row_key("doc_id", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                offs = words_of(*utf8_rows(part.column("text")))[3]
                yield pa.record_batch([part.column(k) for k in ("doc_id", "k1", "k2")] + [pa.array(np.diff(offs).astype(np.int64))], names=["doc_id", "k1", "k2", "n_words"])

    words = rows.transform(arrow_map, count, "doc_id long, k1 long, k2 long, n_words long")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return words.join(_united(rows.select("k1", "k2", "text"), sent, window), ["k1", "k2"], "left").select("doc_id", "n_words", none("spans", _SPANS_DDL), none("items", "array<string>"))


def measure(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts of words, hit words and items, and the items' digest, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = digest([])
        for batch in batches:
            hit, n_items, sha = [], [], []
            for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hit.append(len(set().union(*(range(s["a"], s["b"]) for s in spans))) if spans else 0)
                n_items.append(len(items))
                sha.append(digest(items) if items else empty)
            n = np.array(n_items, np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n), pa.array(sha, pa.string()), pa.array(n >= 2)], names=SCHEMA.names)

    return findings(docs, benchmark, **options).transform(arrow_map, run, SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """All columns of ``docs`` without hit spans in the text.

    Documents of which hit words are ``max_coverage`` or more are removed whole. Spans are of the uncut text, and
    coverage of the whole text; with several automata their findings are united first, so the result is the same.
    """
    sent = _sent(docs.sparkSession, benchmark, chunk_words)
    names = docs.columns
    at = names.index(text_col)
    size_at = names.index(n_chars_col) if n_chars_col in names else None

    def cut(part: pa.RecordBatch, found: dict[int, np.ndarray], data, offs, start, end, wo) -> pa.RecordBatch:
        cols = list(part.columns)[: len(names)]
        keep = np.ones(part.num_rows, bool)
        texts = part.column(at).to_pylist() if found else None
        for i, mask in found.items():
            if mask.mean() >= max_coverage:
                keep[i] = False
                continue
            out, done = [], int(offs[i])
            for a, b in _runs(mask):
                out.append(data[done : start[wo[i] + a]].tobytes())
                done = int(end[wo[i] + b - 1])
            texts[i] = b"".join([*out, data[done : offs[i + 1]].tobytes()]).decode()
        if found:
            cols[at] = pa.array(texts, pa.string())
            if size_at is not None:
                sizes = part.column(size_at).to_pylist()
                for i in found:
                    sizes[i] = len(texts[i])
                cols[size_at] = pa.array(sizes, part.column(size_at).type)
        return pa.record_batch(cols, names=names).filter(pa.array(keep))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(sent[0].value, window)
        for batch in batches:
            for part in text_slices(batch, text_col):
                data, offs = utf8_rows(part.column(at))
                start, end, h, wo = words_of(data, offs)
                yield cut(part, {i: mask for i, (mask, _) in auto.find(h, wo).items()}, data, offs, start, end, wo)

    if len(sent) == 1:
        return docs.transform(arrow_map, stream, docs.schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                data, offs = utf8_rows(part.column(at))
                start, end, _, wo = words_of(data, offs)
                found: dict[int, np.ndarray] = {}
                for i, spans in enumerate(part.column(len(names)).to_pylist()):
                    for x in spans or ():
                        found.setdefault(i, np.zeros(wo[i + 1] - wo[i], bool))[x["a"] : x["b"]] = True
                yield cut(part, found, data, offs, start, end, wo)

    k1, k2, extra = free_name(names, "k1"), free_name(names, "k2"), free_name(names, "spans")
    a, b = row_key(F.col(text_col))  # spans depend on the text alone
    keyed = docs.withColumns({k1: a, k2: b})
    hits = _united(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text_col).alias("text")), sent, window)
    hits = hits.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(extra))
    return keyed.join(hits, [k1, k2], "left").select(*names, extra).transform(arrow_map, apply, docs.schema)
