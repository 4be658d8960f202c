"""Helpers shared by the training-data operators.

Scratch tables go to the folder named in ``spark.checkpoint.dir``, which every executor and
the driver can reach; a scratch table survives the loss of executors and cuts lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregram.shipping import ship

#: Arrow batches are cut into slices of about this many text bytes before numpy work.
SLICE_BYTES = 1 << 20
#: A key is heavy where it has more than this part of all rows; so there are fewer than HEAVY_KEYS heavy keys.
HEAVY_KEYS = 1000

_scratch: list[tuple[SparkSession, str]] = []


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str | Column) -> list[Column]:
    """Columns ``k1`` and ``k2``: 128 bits of a row's content, by which the row is found again.

    Rows alike in the columns have one key, and no rows else: 64 bits alone would meet by chance among
    billions of rows, and ids may be null or repeated.
    """
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(0x5EED), *columns).alias("k2")]


def free_name(columns: list[str], stem: str = "x") -> str:
    """A column name that begins with ``stem`` and that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row for each key and says how many rows of ``left`` have it.

    The fewer than HEAVY_KEYS keys that hold more than a HEAVY_KEYS-th of ``total`` rows are sent to all tasks, so their
    rows are not shuffled; all other keys meet in a shuffle that no key dominates. Keys are never null.
    """
    many = F.col(count) > total / HEAVY_KEYS
    heavy = F.broadcast(right.where(many))
    light = left.join(F.broadcast(right.where(many).select(*on)), on, "left_anti").join(right.where(~many), on)
    return left.join(heavy, on).unionByName(light)


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; one of our own only where the session names none and everything runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="raregram-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/raregram/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append((spark, path))
    spark.sparkContext._jvm.System.gc()  # shuffle files that only this write needed can go
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df_or_path) -> None:
    """Delete scratch tables that no result needs any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else df_or_path.inputFiles()
    roots = {p for s, p in _scratch if any(_bare(f).startswith(_bare(p)) for f in paths)}
    for spark, p in list(_scratch):
        if p in roots:
            _delete(spark, p)
            _scratch.remove((spark, p))


def _bare(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def cleanup() -> None:
    """Delete the scratch tables of sessions that still run."""
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session ended first, with its folder
            pass
    _scratch.clear()


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into slices of about ``limit`` text bytes: at least one row each."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8_rows(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    buf = col.buffers()
    offs = np.frombuffer(buf[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit words (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.full(m, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if m <= 1 << 22:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """S with S[i] = sum of (data[j] + 1) * base**j over j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base), dtype=np.uint64, out=out[1:])
    return out


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each data[start:end] from the prefix sums: equal content, equal hash."""
    inv = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return (s[end] - s[start]) * powers(len(s), inv)[start]


#: Word bytes: digits, lower-case letters and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: (start, end, hash, first word of each row and the total).

    A-Z count as a-z; a word is a run of WORD_BYTE within a row.
    """
    low = LOWER[data]
    inside = WORD_BYTE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True  # a word ends with its row
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = mix64(range_hash(prefix_hash(low), start, end) ^ (end - start).astype(np.uint64))
    return start, end, h, np.searchsorted(start, offs)
