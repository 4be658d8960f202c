"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed: byte bigrams and trigrams, words and word pairs, and n-grams of
a stream that says of each word whether it is new to its document, seen before, or a repeat of the
word before it. Indicators are scaled by the log ratio of their smoothed counts in the two
classes and normalised to length one; a linear model with hinge loss is fit by dual coordinate
descent, and its margins are turned into probabilities by a logistic fit on held-out folds.

The fit reads about ``max_rows`` labelled documents at most, chosen by hash of the id (an id is never a feature); of rows with one
id it reads one, so an id that repeats without end stays one document of the sample. Scoring reads every row and whole
texts in one pass without a shuffle.

Behaviour: null texts are scored as empty ones; repeated rows and null ids are kept; a document
with several labels counts with its lowest, and one with several texts is learned from the text of the least hash; with fewer than two classes the score is the share of
label 1 (0.5 without labels); columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm.common import arrow_map, mix64, text_slices, utf8_rows, words_of

MAX_ROWS = 6000
THRESHOLD = 0.3
BITS = 16
#: Longest n-gram of the novelty stream; its three symbols give base-4 codes.
STREAM_N = 8
SIZE = 3 * (1 << BITS) + 4 ** (STREAM_N + 1) + 64
C, EPOCHS, SMOOTH = 1.0, 20, 1.0
#: The fit ends once no dual variable moves by this much in an epoch.
STOP = 1e-3

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
])


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each row."""
    mask = np.uint64((1 << BITS) - 1)
    b = data.astype(np.uint32)
    two = (b[:-1] << np.uint32(8) | b[1:]).astype(np.int64) if len(b) > 1 else np.empty(0, np.int64)
    three = (((two[:-1].astype(np.uint32) * np.uint32(40503) + b[2:] * np.uint32(2654435)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int64) if len(b) > 2 else np.empty(0, np.int64)
    _, _, words, wo = words_of(data, offs)
    base = 1 << BITS
    with np.errstate(over="ignore"):
        uni = (words & mask).astype(np.int64)
        bi = (mix64(words[:-1] * np.uint64(3) + words[1:]) & mask).astype(np.int64) if len(words) > 1 else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
    # 1 new to the document, 2 seen before, 3 the same as the word before
    order = np.lexsort((np.arange(len(words)), words, row))
    same = np.zeros(len(words), bool)
    same[1:] = (words[order][1:] == words[order][:-1]) & (row[order][1:] == row[order][:-1])
    kind = np.ones(len(words), np.int64)
    kind[order[same]] = 2
    kind[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])] = 3
    streams = [kind]
    for _ in range(STREAM_N - 1):
        prev = streams[-1]
        streams.append(prev[:-1] * 4 + kind[len(streams) :] if len(prev) > 1 else np.empty(0, np.int64))
    mark = np.zeros(SIZE, bool)
    stream_at = 3 * base
    for i in range(len(offs) - 1):
        x, y, u, v = offs[i], offs[i + 1], wo[i], wo[i + 1]
        mark[two[x : max(x, y - 1)] & (base - 1)] = True
        mark[base + three[x : max(x, y - 2)]] = True
        mark[2 * base + uni[u:v]] = True
        mark[2 * base + bi[u : max(u, v - 1)]] = True
        for n, s in enumerate(streams):
            mark[stream_at + s[u : max(u, v - n)]] = True
        mark[SIZE - 64 + int(v - u).bit_length()] = True
        ids = np.flatnonzero(mark)
        mark[ids] = False
        yield ids


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of the hinge model times the ratio of each feature
    ratio2: np.ndarray  # squared ratio, for the length of a row
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weight[ids].sum()) / max(1e-9, float(np.sqrt(self.ratio2[ids].sum()))) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def _fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    count = np.full((2, SIZE), SMOOTH)
    for ids, label in zip(rows, y, strict=True):
        count[int(label)][ids] += 1
    n = np.bincount(y, minlength=2) + 2 * SMOOTH
    ratio = np.log(count[1] / n[1]) - np.log(count[0] / n[0])
    # only a row's length is kept: its scaled indicators take twice the room of its numbers, and are soon made again
    norm = [max(1e-9, np.sqrt((ratio[ids] * ratio[ids]).sum())) for ids in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    cost = C * len(y) / (2 * np.bincount(y, minlength=2)[y])  # both classes weigh the same
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(y)):
            ids = rows[i]
            x = ratio[ids] / norm[i]
            g = sign[i] * (w[ids] @ x + bias) - 1
            a = min(max(alpha[i] - g / 2.0, 0.0), cost[i])  # a row's squared length is 1, and 1 for the bias
            d = (a - alpha[i]) * sign[i]
            if d:
                w[ids] += d * x
                bias += d
                alpha[i] = a
                most = max(most, abs(d))
        if most < STOP:
            break
    return w * ratio, ratio * ratio, bias


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        p = (float(y.mean()) if len(y) else 0.5) * 0.998 + 0.001
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log(p / (1 - p))))
    out = np.zeros(len(y))
    fold = np.arange(len(y)) % 2
    for k in (0, 1):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[train])) < 2:
            out[test] = np.where(y[test] == 1, 1.0, -1.0)
            continue
        m = Model(*_fit([rows[i] for i in train], y[train]), 1.0, 0.0)
        out[test] = [m.margin(rows[i]) for i in test]
    slope, shift = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(60):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * out + shift, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        a = np.array([[(h * out * out).sum() + 1e-3, (h * out).sum()], [(h * out).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(a, [(g * out).sum(), g.sum()])
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(*_fit(rows, y), float(slope), float(shift))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents, taken by hash."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    n = marks.count()
    if n > max_rows:
        spread = (F.xxhash64(F.lit(11), "doc_id").cast("double") / 2.0**63 + 1) / 2
        marks = marks.where(spread <= max_rows / n)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    # one row of each id, found before the shuffle where rows of one id crowd
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                ids = [x.astype(np.int32) for x in features(*utf8_rows(part.column("text")))]
                yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "y", "ids"])

    got = rows.transform(arrow_map, run, "doc_id long, y int, ids array<int>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    y = got["y"].to_numpy()[order].tolist()
    chunks = got["ids"].chunks
    del got
    every: list[np.ndarray] = []
    for chunk in chunks:  # as they came: put together they would be held twice
        o, v = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        every += [v[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
    model = fit([every[i] for i in order], y)
    every.clear()
    chunks = chunk = o = v = None
    pa.default_memory_pool().release_unused()  # or the driver holds the sample's room to the end of the session
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in text_slices(batch):
                s = np.array([m.score(ids) for ids in features(*utf8_rows(part.column("text")))], float)
                yield pa.record_batch([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=SCHEMA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow_map, run, SCHEMA)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in text_slices(batch, text_col):
                s = np.array([m.score(ids) for ids in features(*utf8_rows(part.column(text_col)))], float)
                yield part.filter(pa.array(s >= threshold))

    return docs.transform(arrow_map, run, docs.schema)
