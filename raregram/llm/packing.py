"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention inside its document only).
Each task tokenises its rows, cuts what exceeds a sequence, and packs a window of about
``window_tokens`` at a time: pieces in descending order of cost, each to the cheapest sequence
that still has room for it; a piece that fits nowhere is cut over the cheapest open sequences.
What does not fill a last sequence is carried to the next window, and at the end of a task laid out
in power-of-two sequences, which need no padding. There is no shuffle: sequences are numbered
within their partition, memory is bounded by the window (a longer document is taken whole and
makes its own full sequences), and a lost task is repeated with the same result.

Behaviour: null and empty texts are one end token; repeated rows are packed once each; null ids
are kept; an empty table gives no rows; ties of cost keep input order. Only the id and text columns
are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm import word_bpe
from raregram.llm.common import arrow_map, text_slices

LENGTH = 2048
END_ID = 1
WINDOW_TOKENS = 1 << 20
#: Relative cost of a token in the linear layers and of a token pair in attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def assign(lengths: list[int], bins: int, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Place pieces of at most ``length`` tokens into ``bins`` sequences of ``length``.

    Gives (piece, start in the piece, tokens, bin). The total may not exceed the room.
    Sequences wait in one heap by cost for each amount of room left, so the cheapest with
    enough room is found without a scan over all of them.
    """
    cost = [0.0] * bins
    room = [length] * bins
    by_room: dict[int, list[tuple[float, int]]] = defaultdict(list)
    by_room[length] = [(0.0, i) for i in range(bins)]
    out = []

    def cheapest(least: int) -> int | None:
        best = None
        for r in list(by_room):
            heap = by_room[r]
            if not heap:
                del by_room[r]
            elif r >= least and (best is None or heap[0] < by_room[best][0]):
                best = r
        return best

    def put(piece: int, start: int, n: int, r: int) -> None:
        _, i = heapq.heappop(by_room[r])
        cost[i] += linear * n + quadratic * n * n
        room[i] -= n
        if room[i]:
            heapq.heappush(by_room[room[i]], (cost[i], i))
        out.append((piece, start, n, i))

    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        start, left = 0, lengths[piece]
        while left:
            r = cheapest(left)
            if r is None:  # fits nowhere whole: fill the roomiest, at most halving what is left to place
                r = max(k for k, h in by_room.items() if h)
            n = min(left, r)
            put(piece, start, n, r)
            start, left = start + n, left - n
    return out


def pack_window(docs: list[tuple[object, np.ndarray, int, int]], first: int, final: bool, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pack (doc_id, ids, start of ids in the document, tokens of the document).

    Gives the rows, the next sequence number, and what is carried over.
    """
    rows = []
    seq = first
    rest = []
    for doc_id, ids, base, total in docs:
        whole = len(ids) // length
        for k in range(whole):
            rows.append((doc_id, ids[k * length : (k + 1) * length], base + k * length, total, seq, 0))
            seq += 1
        if len(ids) > whole * length:
            rest.append((doc_id, ids[whole * length :], base + whole * length, total))
    tokens = sum(len(x[1]) for x in rest)
    bins = tokens // length
    carry = []
    if bins:
        over, keep = tokens - bins * length, []
        for x in sorted(rest, key=lambda x: len(x[1])):  # the smallest pieces wait for the next window
            if over >= len(x[1]):
                over -= len(x[1])
                carry.append(x)
            elif over:
                d, ids, base, total = x
                carry.append((d, ids[len(ids) - over :], base + len(ids) - over, total))
                keep.append((d, ids[: len(ids) - over], base, total))
                over = 0
            else:
                keep.append(x)
        offset = [0] * bins
        for k, start, n, b in assign([len(x[1]) for x in keep], bins, length, linear, quadratic):
            d, ids, base, total = keep[k]
            rows.append((d, ids[start : start + n], base + start, total, seq + b, offset[b]))
            offset[b] += n
        seq += bins
    else:
        carry = rest
    if final and carry:
        left = sum(len(x[1]) for x in carry)
        size = length
        queue = sorted(carry, key=lambda x: -len(x[1]))
        carry = []
        while left:
            while size > left:
                size //= 2
            at = 0
            while at < size:
                d, ids, base, total = queue.pop(0)
                n = min(len(ids), size - at)
                rows.append((d, ids[:n], base, total, seq, at))
                at += n
                if n < len(ids):
                    queue.insert(0, (d, ids[n:], base + n, total))
            seq, left = seq + 1, left - size
    return rows, seq, carry


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``with_ids`` adds the token ids."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    schema = T.StructType([*SCHEMA.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else SCHEMA.fields)

    def table(rows) -> pa.RecordBatch:
        cols = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([zlib.crc32(r[1].astype("<u4").tobytes()) for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.int64()),
            pa.array([r[5] for r in rows], pa.int64()),
        ]
        if with_ids:
            cols.append(pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())))
        return pa.record_batch(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_bpe.encoder(tokenizer)
        seq = TaskContext.get().partitionId() << 40
        held, tokens, carry = [], 0, []
        for batch in batches:
            for part in text_slices(batch):
                got = enc.ids(part.column("text").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), got, strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype(np.uint16 if len(enc.ids_of) < 1 << 16 else np.uint32)
                    held.append((doc_id, ids, 0, len(ids)))
                    tokens += len(ids)
                if tokens >= window_tokens:
                    rows, seq, carry = pack_window(carry + held, seq, False, length, linear, quadratic)
                    held, tokens = [], 0
                    yield table(rows)
        rows, seq, _ = pack_window(carry + held, seq, True, length, linear, quadratic)
        if rows:
            yield table(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow_map, run, schema)
