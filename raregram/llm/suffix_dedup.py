"""Exact substring deduplication with two-stage suffix sorting.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed. Strings
are compared without sorting all suffixes of the corpus in one place:

1. Each window of ``length`` bytes is owned by the smallest hash among its ``gram``-byte grams (the first of
   equals), so equal windows have equal owners wherever they stand. Neighbouring windows with one
   owner form a segment, which is known by its owner's hash and the hash of its bytes.
2. Owners that occur once cannot hold a repeat; they are counted by hash aggregation, which combines before the shuffle.
3. Of each content of the other owners two occurrences are fetched, or its only one, and the segments of an owner are
   compared by a suffix array: suffixes smaller than their successors are sorted directly, the others are
   induced by scans over the first bytes' buckets, and windows are repeated where neighbours in suffix order share ``length``
   bytes. What is found in a content holds for all its occurrences; hashes only bring them together.
   Owners with more than ``crowd`` different segments are not brought together in one task; their
   windows are counted by hash aggregation instead, with the same result.

Documents are found again by 128 bits of id and text together. Copies inside one batch of rows are resolved at once, so periodic texts do not inflate the tables. Results are exact up to collisions of 128-bit keys.

Behaviour: null texts are empty; texts shorter than ``length`` bytes and empty texts lose nothing;
repeated rows (also of one id) are repeats of each other; null ids are kept; an empty table gives
no rows; only the id and text columns are read. A text of any length is read whole, in overlapping stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm.common import arrow_map, drop_scratch, join_counted, materialize, mix64, prefix_hash, range_hash, row_key, text_slices, utf8_rows

LENGTH = 200
GRAM = 40
#: Different segments of an owner up to which one task compares them.
CROWD = 4000
#: Bytes of segments in one suffix array: the arrays of one sort take about a hundred times as much.
BLOCK_BYTES = 1 << 20
#: Bytes of rows whose segments are made at a time.
SLICE_BYTES = 1 << 18
#: Window starts handled at a time, and the bits that hold a place within them.
STRETCH = 1 << 20
_PLACE_BITS = 24
_BASE2 = 0xD6E8FEB86659FD93

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
])


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros after the end."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= pad[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def suffix_order(data: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` suffix starts, or all, in the order of their first ``depth`` bytes or more.

    Two stages: suffixes smaller than their successors are sorted directly; each other suffix is
    induced from its successor, by one scan over the buckets of first bytes in ascending order.
    """
    n = len(data)
    if n < 2:
        return np.arange(n) if wanted is None else np.flatnonzero(wanted)
    # smaller than the successor: by the next differing byte; the last suffix is larger than the empty one
    change = np.flatnonzero(data[:-1] != data[1:])
    nxt = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    has = nxt < len(change)
    at = change[nxt[has]]
    small[has] = data[at] < data[at + 1]
    need = np.ones(n, bool)
    if wanted is not None:
        # a larger suffix is induced along its successors up to a smaller one, so those are needed too
        last = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(small, np.arange(n), -1))[:-1]])
        need = last > before
    direct = np.flatnonzero(small & need)
    w8 = _words8(data)
    # direct sort: by eight bytes at a time, refining only groups that are still tied
    order = direct[np.argsort(w8[direct], kind="stable")]
    key = w8[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else np.empty(0, np.int64)
    # later words by their ranks, as many to a round as fit one number with the group
    rank = np.unique(w8, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    bits = int(rank.max()).bit_length()
    done = 8
    live = np.arange(len(order))
    while done < depth and len(live):
        g = group[live]
        size = np.bincount(g)
        live = live[size[g] > 1]
        if not len(live):
            break
        pos = order[live] + done
        g = group[live]
        k = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])]).astype(np.uint64)
        words = max(1, (64 - int(k[-1]).bit_length()) // bits)
        for j in range(words):
            p = pos + 8 * j
            k = k << np.uint64(bits) | np.where(p < n, rank[np.minimum(p, n - 1)], np.uint64(0))
        by = np.argsort(k)
        order[live] = order[live][by]
        k = k[by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        # groups keep their places; parts of a group are told apart by their first place
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        done += 8 * words
    first = data[order]
    start = np.searchsorted(first, np.arange(257))
    # induction: the suffix before a sorted one, if larger than its successor, comes next in its bucket
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    if need[n - 1] and not small[n - 1]:
        buckets[data[n - 1]].append(np.array([n - 1]))
    present = np.flatnonzero(np.bincount(data, minlength=256))

    def induce(c: int, found: np.ndarray) -> np.ndarray:
        """Send the predecessors of sorted suffixes to their buckets; those of this bucket come back."""
        prev = found[found > 0] - 1
        prev = prev[need[prev] & ~small[prev]]
        byte = data[prev]
        far = byte > c
        if far.any():
            p, b = prev[far], byte[far]
            by = np.argsort(b, kind="stable")
            p, b = p[by], b[by]
            cuts = np.flatnonzero(np.diff(b)) + 1
            for part in np.split(p, cuts):
                buckets[data[part[0]]].append(part)
        return prev[byte == c]

    for c in present:
        queue = np.concatenate(buckets[c]) if buckets[c] else np.empty(0, np.int64)
        while len(queue):
            out.append(queue)
            queue = induce(c, queue)
        mine = order[start[c] : start[c + 1]]
        if len(mine):
            out.append(mine)
            induce(c, mine)
    out = np.concatenate(out) if out else np.empty(0, np.int64)
    return out if wanted is None else out[wanted[out]]


def repeated_windows(data: np.ndarray, window_ok: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Marks of the starts whose ``length`` bytes occur at another start; only starts in ``window_ok`` count."""
    order = suffix_order(data, length, window_ok)
    same = np.ones(max(0, len(order) - 1), bool)
    w8 = _words8(data)
    live = np.flatnonzero(same)
    tail = length % 8
    for k in range(0, length - tail, 8):  # common prefixes of neighbours, eight bytes at a time
        bad = w8[order[live] + k] != w8[order[live + 1] + k]
        same[live[bad]] = False
        live = live[~bad]
    if tail:
        shift = np.uint64(64 - 8 * tail)
        k = length - tail
        same[live] = (w8[order[live] + k] >> shift) == (w8[order[live + 1] + k] >> shift)
    out = np.zeros(len(data), bool)
    out[order[:-1][same]] = True
    out[order[1:][same]] = True
    return out


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, stretch: int = STRETCH):
    """(row, start, windows, owner, content) of all segments; starts are positions in ``data``.

    A segment that meets the end of a stretch is cut there; both parts keep their owner.
    """
    parts = [_stretch(data[a : a + stretch + length - 1], np.clip(offs - a, 0, stretch + length - 1), length, gram, a) for a in range(0, max(1, len(data) - length + 1), stretch)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _stretch(data: np.ndarray, offs: np.ndarray, length: int, gram: int, at0: int):
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    s, second = prefix_hash(data), prefix_hash(data, _BASE2)
    at = np.arange(n - gram + 1)
    h = mix64(range_hash(s, at, at + gram))
    width = length - gram + 1
    # the least of each run of ``width`` grams, with its first place: block minima from both sides.
    # Hashes are compared by their upper bits, whatever the size of the data, so equal windows agree.
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h & ~low) | at.astype(np.uint64)
    m = len(key)
    blocks = -(-m // width)
    pad = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:m] = key
    pad = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    w = n - length + 1
    owner_at = (np.minimum(behind[:w], ahead[width - 1 : width - 1 + w]) & low).astype(np.int64)
    # offsets of rows before or after the stretch are clipped to its ends; such rows own no window
    row = np.searchsorted(offs, np.arange(w), side="right") - 1
    ok = np.arange(w) + length <= offs[np.minimum(row + 1, len(offs) - 1)]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (owner_at[1:] != owner_at[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(np.concatenate([ok[:-1] & (first[1:] | ~ok[1:]), ok[-1:]])) + 1
    count = ends - starts
    span = (starts, ends + length - 1)
    # both bases enter both keys: owner and content are told apart by 128 bits together
    owner = mix64(h[owner_at[starts]] ^ mix64(range_hash(second, owner_at[starts], owner_at[starts] + gram, _BASE2)))
    content = mix64(range_hash(s, *span) ^ mix64(count.astype(np.uint64))) ^ mix64(range_hash(second, *span, _BASE2) + np.uint64(1))
    return row[starts], starts + at0, count, owner, content


# A segment's place is start * 256 + windows. Rows without an owner are spans already known to repeat,
# with the end in ``content``.
_SEGMENTS = "k1 long, k2 long, place long, owner long, content long, k int"


def _emit(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all documents; of copies within one batch one row, with their number, and merged spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                data, offs = utf8_rows(part.column("text"))
                row, start, n, owner, content = segments(data, offs, length, gram)
                _, one, back, times = np.unique(owner ^ mix64(content), return_index=True, return_inverse=True, return_counts=True)
                many = np.flatnonzero(times[back] > 1)
                # spans of copies that follow each other without a gap are one span
                a, b = start[many], start[many] + n[many] + length - 1
                new = np.ones(len(many), bool)
                new[1:] = (row[many][1:] != row[many][:-1]) | (a[1:] > b[:-1])
                cut = np.flatnonzero(new)
                last = np.append(cut[1:], len(many))[: len(cut)] - 1
                r1 = row[many][cut]
                rows = np.concatenate([row[one], r1])
                place = np.concatenate([(start[one] - offs[row[one]]) * 256 + n[one], (a[cut] - offs[r1]) * 256])
                own = pa.array(np.concatenate([owner[one].view(np.int64), np.zeros(len(cut), np.int64)]), mask=np.arange(len(rows)) >= len(one))
                body = np.concatenate([content[one].view(np.int64), b[last] - offs[r1]])
                k = np.concatenate([times, np.zeros(len(cut), np.int64)]).astype(np.int32)
                take = pa.array(rows)
                yield pa.record_batch([part.column("k1").take(take), part.column("k2").take(take), pa.array(place), own, pa.array(body), pa.array(k)], names=["k1", "k2", "place", "owner", "content", "k"])

    return docs.select("k1", "k2", "text").transform(arrow_map, run, _SEGMENTS)


_BODY = "k1 long, k2 long, start long, owner long, content long, role int, crowded boolean, body binary"
#: What a body is: the only occurrence of its content, one that stands for all occurrences, a second occurrence
#: of such a one, or one for both where all occurrences have one key and place.
_ONLY, _LEAD, _SECOND, _BOTH = 0, 1, 2, 3


def _fetch(reps: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of chosen segments, each once however many rows are alike."""
    wanted = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "owner", "content", "role", "crowded")).alias("wanted"))
    rows = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offs = utf8_rows(part.column("text"))
                lists = part.column("wanted")
                of = pa.array(np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()))
                w = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
                start, n = np.divmod(w.pop("place").to_numpy(), 256)
                size = n + length - 1
                ends = np.cumsum(size)
                body = data[np.repeat(offs[of.to_numpy()] + start - (ends - size), size) + np.arange(size.sum())]
                body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(body)]).cast(pa.binary())
                yield pa.record_batch([part.column("k1").take(of), part.column("k2").take(of), pa.array(start), *w.values(), body], names=["k1", "k2", "start", *w, "body"])

    return rows.transform(arrow_map, run, _BODY)


# A span has a key and is absolute, or it has an owner and content and holds for all their occurrences.
_SPAN = "k1 long, k2 long, owner long, content long, a long, b long"


def _compare(bodies: DataFrame, length: int, parts: int) -> DataFrame:
    """Spans repeated among the segments of one owner, which share a partition, by suffix arrays."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows, which come by owner, in blocks of about BLOCK_BYTES that end between owners."""
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            owner = batch.column("owner").to_numpy()
            new = np.flatnonzero(owner[1:] != owner[:-1]) + 1
            size = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(), dtype=np.int64)
            at = 0
            while (i := np.searchsorted(size[new - 1], (size[at - 1] if at else 0) + BLOCK_BYTES)) < len(new):
                yield batch.slice(at, new[i] - at)
                at = new[i]
            held = batch.slice(at)
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            role = block.column("role").to_numpy()
            twice = np.repeat(np.arange(len(role)), np.where(role == _BOTH, 2, 1))
            role = np.where(role[twice] == _BOTH, np.where(np.diff(twice, prepend=-1) > 0, _LEAD, _SECOND), role[twice])
            data, offs = utf8_rows(block.column("body").take(pa.array(twice)))
            seg = np.repeat(np.arange(len(twice)), np.diff(offs))
            hit = repeated_windows(data, np.arange(len(data)) + length <= offs[seg + 1], length)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            a, b = edge[::2], edge[1::2]  # no run goes on into the next segment: its last windows would not fit
            a, b = (x[role[seg[a]] != _SECOND] for x in (a, b))
            i = seg[a]
            one = role[i] == _ONLY
            start = block.column("start").to_numpy()[twice[i]] * one - offs[i]
            rows = block.take(pa.array(twice[i]))
            here = lambda name, keep: pa.array(rows.column(name).to_numpy(), mask=~keep)
            yield pa.record_batch([here("k1", one), here("k2", one), here("owner", ~one), here("content", ~one), pa.array(start + a), pa.array(start + b - 1 + length)], names=["k1", "k2", "owner", "content", "a", "b"])

    return bodies.repartition(parts, "owner").sortWithinPartitions("owner").transform(arrow_map, run, _SPAN)


def _count(bodies: DataFrame, length: int) -> DataFrame:
    """The same for crowded owners: windows are counted by 128-bit hash, wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8_rows(batch.column("body"))
            n = np.maximum(np.diff(offs) - length + 1, 0)
            seg = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
            p = offs[seg] + at
            x = mix64(range_hash(prefix_hash(data), p, p + length))
            y = mix64(range_hash(prefix_hash(data, _BASE2), p, p + length, _BASE2))
            take = lambda k: batch.column(k).take(pa.array(seg))
            yield pa.record_batch([take("k1"), take("k2"), pa.array(np.asarray(batch.column("start"))[seg] + at), take("role"), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["k1", "k2", "a", "role", "x", "y"])

    one = bodies.where(F.col("role") != _SECOND)
    windows = one.transform(arrow_map, run, "k1 long, k2 long, a long, role int, x long, y long")
    # one body of each content is counted, so a window that occurs once has one place
    often = windows.groupBy("x", "y").agg(F.count("*").alias("k")).where("k > 1")
    none = F.lit(None).cast("long")
    found = windows.where(F.col("role") == _ONLY).join(often, ["x", "y"], "left_semi").select("k1", "k2", none.alias("owner"), none.alias("content"), "a", (F.col("a") + length).alias("b"))
    whole = one.where(F.col("role") != _ONLY).select(none.alias("k1"), none.alias("k2"), "owner", "content", F.lit(0).cast("long").alias("a"), F.length("body").cast("long").alias("b"))
    return found.unionByName(whole)


def find(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, k1, k2) of the documents, and (k1, k2, spans) of what repeats."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("*", *row_key("doc_id", "text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seg = materialize(_emit(docs, length, gram), "segments")
    own = seg.where("owner is not null")
    total = own.count()
    owners = materialize(own.groupBy("owner").agg(F.sum("k").alias("k"), F.count("*").alias("rows")).where("k > 1").select("owner", "rows"), "owners")
    repeated = materialize(join_counted(own, owners, ["owner"], "rows", total).drop("rows"), "repeated")
    known = materialize(seg.where("owner is null").select("k1", "k2", F.floor(F.col("place") / 256).alias("a"), F.col("content").alias("b")), "known")
    drop_scratch(seg)
    # two places of each content, or one where it is single
    place = F.struct("k1", "k2", "place")
    contents = repeated.groupBy("owner", "content").agg(F.sum("k").alias("k"), F.count("*").alias("rows"), F.min(place).alias("p"), F.max(place).alias("q"))
    contents = materialize(contents, "contents")
    one, same = F.col("k") == 1, F.col("p") == F.col("q")
    role = lambda r: F.lit(r).alias("role")
    roles = F.when(one, F.array(F.struct("p.*", role(_ONLY)))).when(same, F.array(F.struct("p.*", role(_BOTH)))).otherwise(F.array(F.struct("p.*", role(_LEAD)), F.struct("q.*", role(_SECOND))))
    sizes = contents.groupBy("owner").agg((F.count("*") > crowd).alias("crowded"))
    reps = contents.select("owner", "content", F.explode(roles).alias("r")).join(sizes, "owner").select("owner", "content", "crowded", "r.*")
    bodies = materialize(_fetch(reps, docs, length), "bodies")
    found = _compare(bodies.where("not crowded"), length, parts).unionByName(_count(bodies.where("crowded"), length))
    found = materialize(found, "found")
    start = F.floor(F.col("place") / 256)
    # what was found in a content holds wherever it occurs
    each = found.where("owner is not null").groupBy("owner", "content").agg(F.collect_set(F.struct("a", "b")).alias("in")).join(contents.select("owner", "content", "rows"), ["owner", "content"])
    each = materialize(each, "each")
    whole = join_counted(repeated.select("k1", "k2", "place", "owner", "content"), each, ["owner", "content"], "rows", total)
    whole = whole.select("k1", "k2", start.alias("start"), F.explode("in").alias("s")).select("k1", "k2", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
    spans = known.unionByName(whole).unionByName(found.where("owner is null").select("k1", "k2", "a", "b"))
    # rows that are alike have the same spans: each counts once
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    for used in (owners, repeated, known, contents, bodies, found, each):
        drop_scratch(used)
    return docs, spans


def _mask(n: int, spans: list) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    a, b = (np.fromiter((s[k] for s in spans), np.int64, len(spans)) for k in ("a", "b"))
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0


def _join(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")


def measure(docs: DataFrame, **options) -> DataFrame:
    """Sizes, removed bytes and runs, and the digest of what is left, of each document."""
    docs, spans = find(docs, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, s in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
                b = np.frombuffer(t.encode(), np.uint8)
                removed = runs = 0
                if s:
                    gone = _mask(len(b), s)
                    removed, runs = int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                    b = b[~gone]
                rows.append((d, len(b) + removed, removed, runs, hashlib.sha256(b.tobytes()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=SCHEMA.names)

    return _join(docs, spans).transform(arrow_map, run, SCHEMA)


def remove(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): the documents without repeated bytes; bytes that are no longer UTF-8 are dropped."""
    docs, spans = find(docs, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if s:
                    b = np.frombuffer(t.encode(), np.uint8)
                    t = b[~_mask(len(b), s)].tobytes().decode(errors="ignore")
                out.append(t)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _join(docs, spans).transform(arrow_map, run, "doc_id long, text string")
