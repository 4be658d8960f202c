"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks. Two neighbouring encodings are spliced at a
position where both begin a token and which is provably a boundary whatever the context: no
alternative of the pre-tokenizer pattern holds a letter or digit followed by white space, so a
word end before white space always ends a pre-token, and a special string holds no white space.
Where an overlap has no such position, it is widened, at last to the end of the document.

Behaviour: null and empty texts count 0 bytes and 0 tokens. Rows are kept as they are,
repeated rows and null ids included; columns other than the id and the text are not read.
A string of the vocabulary's special token counts as that one token.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from raregram.llm.common import arrow_map

CHUNK_CHARS = 1 << 13
OVERLAP_CHARS = 1 << 8
#: Fixed value: the special token of byte_bpe_50k.json and its id.
SPECIAL = {"<|endoftext|>": 50256}
#: White space and word ends on which every encoding must break.
_STABLE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n\t])")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
])


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The byte-level vocabulary as ranks: the same ids as its .json form."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes-50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.lru_cache(maxsize=4)
def _lengths(path: str | None) -> np.ndarray:
    enc = encoder(path)
    out = np.zeros(enc.n_vocab, np.int64)
    for i in range(enc.n_vocab):
        out[i] = len(enc.decode_single_token_bytes(i))
    return out


def encode(text: str, path: str | None = None) -> np.ndarray:
    enc = encoder(path)
    if "<|" not in text:
        return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)
    return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set(SPECIAL)), np.uint32)


def _starts(ids: np.ndarray, path: str | None) -> np.ndarray:
    """Byte offsets at which tokens begin, and the end."""
    return np.concatenate([[0], np.cumsum(_lengths(path)[ids])])


def encode_spliced(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, path: str | None = None) -> np.ndarray:
    """Token ids of ``text``, equal to those of one whole encoding."""
    if len(text) <= chunk + overlap:
        return encode(text, path)
    parts: list[np.ndarray] = []
    at = 0  # the text before this character is encoded
    stop = min(len(text), chunk)
    ids = encode(text[:stop], path)
    while stop < len(text):
        width = overlap
        while True:
            back = max(at + 1, stop - width)
            ahead = min(len(text), back + chunk + width)
            nxt = encode(text[back:ahead], path)
            cut = _splice(text, at, back, stop, ids, nxt, path)
            if cut is not None or ahead == len(text) and back == at + 1:
                break
            if back == at + 1:  # no boundary in the whole chunk: encode it anew with more text
                stop = min(len(text), stop + 2 * (stop - at))
                ids = encode(text[at:stop], path)
                if stop == len(text):
                    break
                width = overlap
            else:
                width *= 2
        if stop == len(text):
            break
        if cut is None:
            stop, ids = len(text), encode(text[at:], path)
            break
        keep, skip, pos = cut
        parts.append(ids[:keep])
        ids, at, stop = nxt[skip:], pos, ahead
    return np.concatenate([*parts, ids])


def _splice(text, at, back, stop, left, right, path):
    """Tokens to keep of left and to skip of right, and the character at which they meet."""
    ls, rs = _starts(left, path), _starts(right, path)
    spots = [m.start() for m in _STABLE.finditer(text, back, stop)]
    spots = [p for p in spots if back < p < stop]
    if not spots:
        return None
    lead = len(text[at:back].encode())
    n = np.cumsum([len(text[a:b].encode()) for a, b in zip([back, *spots[:-1]], spots, strict=True)])
    i, j = np.searchsorted(ls, lead + n), np.searchsorted(rs, n)
    ok = (ls[np.minimum(i, len(ls) - 1)] == lead + n) & (rs[np.minimum(j, len(rs) - 1)] == n)
    if not ok.any():
        return None
    k = int(np.flatnonzero(ok)[len(np.flatnonzero(ok)) // 2])
    return int(i[k]), int(j[k]), spots[k]


def token_counts(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every document, in one pass without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            size = pc.binary_length(col).fill_null(0).cast(pa.int64())
            n = np.fromiter((len(encode_spliced(t, chunk, overlap, path)) if t else 0 for t in map(pa.StringScalar.as_py, col)), np.int64, len(col))
            yield pa.record_batch([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=SCHEMA.names)

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow_map, count, SCHEMA)
