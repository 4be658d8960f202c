"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample texts. Texts are reduced
to lower-case letters, each run of anything else to one blank. A text is cut into chunks, every chunk is compressed with each dictionary, and the language with the smallest total
wins; a winner ahead by less than ``min_margin`` (as a part of the runner-up's size) is rejected.

The sample is bounded: at most ``dict_bytes`` of at most ``sample_rows`` distinct texts a language, those of
the lowest hashes among the rows given for learning; copies count once. Where the column of languages is dirty, the
``languages`` values with the most distinct texts (counted up to ``sample_rows``; then the first names) are learned, so the dictionaries together are bounded too. Everything after that reads all rows and whole texts, in one pass
without a shuffle.

Behaviour: null texts and texts without a letter are ``und`` with score 0; null languages are
not learned; with no learned language every text is ``und``; equal sizes go to the language
first in name order; repeated rows are kept; columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm.common import arrow_map

DICT_BYTES = 64 << 10
#: Distinct texts read for one language's dictionary at most.
SAMPLE_ROWS = 400
#: Languages learned at most.
LANGUAGES = 256
#: One text takes a MAX_PARTS-th of a dictionary at most, unless the others leave room.
MAX_PARTS = 8
CHUNK_BYTES = 4096
LEVEL = 6
MIN_MARGIN = 0.01
#: Steepness of the score in bits a byte.
SHARPNESS = 12.0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("margin", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
])


def normalise(text: str) -> bytes:
    """Lower-case letters (any byte of a non-ASCII character counts as one), runs of others as a blank."""
    b = np.frombuffer(text.lower().encode(), np.uint8)
    letter = _LETTER[b]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, b, np.uint8(32))[keep].tobytes()


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """One dictionary for each of at most ``languages`` languages of ``rows``, from a bounded sample in hash order."""
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text != ''")
    h = F.xxhash64("text")
    rows = rows.withColumn("h", h)
    # the lowest hashes of distinct texts, so copies neither lower the share of a language nor use up its sample
    low = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample_rows)
    most = low.groupBy("lang").agg(F.max("h").alias("end"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    ends = {r["lang"]: r["end"] for r in most.collect()}
    if not ends:
        return {}
    end = F.create_map(*[F.lit(x) for pair in sorted(ends.items()) for x in pair])
    # of a text longer than a dictionary, a piece at a place chosen by its hash
    at = F.pmod("h", F.greatest(F.length("text") - dict_bytes + 1, F.lit(1)).cast("long")).cast("int") + 1
    piece = F.when(F.length("text") <= dict_bytes, F.col("text")).otherwise(F.substring(F.col("text"), at, F.lit(dict_bytes)))
    top = rows.where(F.col("h") <= end[F.col("lang")]).select("lang", "h", piece.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    # in hash order until the budget is met, to which a text counts with its part at most
    part = max(1, dict_bytes // MAX_PARTS)
    before = F.sum(F.least(F.octet_length("text"), F.lit(part))).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    kept = top.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < dict_bytes).orderBy("lang", "h").collect()
    out: dict[str, list[tuple[int, bytes]]] = {}
    for r in kept:
        out.setdefault(r["lang"], []).append((r["h"], normalise(r["text"])))
    return {k: _fill(v, dict_bytes, part) for k, v in sorted(out.items()) if any(t for _, t in v)}


def _fill(texts: list[tuple[int, bytes]], dict_bytes: int, part: int) -> bytes:
    """The texts, of each at most ``part`` bytes, or more where few texts leave room; the place of a piece is chosen by hash."""
    room = dict_bytes
    for i, n in enumerate(sizes := sorted(len(t) for _, t in texts)):
        if n * (len(sizes) - i) >= room:
            part = max(part, room // (len(sizes) - i))
            break
        room -= n
    else:
        part = max(part, sizes[-1])
    pieces = [t[(at := h % (len(t) - part + 1)) : at + part] if len(t) > part else t for h, t in texts]
    return b"\n".join(pieces)[-dict_bytes:]


class Classifier:
    """Compressors of all languages; built once in each task."""

    def __init__(self, dictionaries: dict[str, bytes], chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.chunk = chunk_bytes
        self.compress = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def classify(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0, True
        b = normalise(text)
        n = max(1, round(len(b) / self.chunk))
        step = -(-len(b) // n)
        parts = [b[i : i + step] for i in range(0, len(b), step)]
        sizes = [sum(len(f(p)) for p in parts) for f in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        odds = sum(math.exp(-SHARPNESS * 8 * (s - sizes[best]) / len(b)) for s in others)
        margin = (min(others) - sizes[best]) / min(others) if others else 1.0
        return self.langs[best], 1 / (1 + odds), margin, margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every document.

    ``lang_pred`` is the nearest language even where ``rejected`` says that the margin is narrow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            got = [model.classify(t.as_py(), min_margin) for t in batch.column("text")]
            cols = list(zip(*got, strict=True)) or [[], [], [], []]
            yield pa.record_batch([batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(np.array(cols[1], float)), pa.array(np.array(cols[2], float)), pa.array(cols[3], pa.bool_())], names=SCHEMA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow_map, run, SCHEMA)
