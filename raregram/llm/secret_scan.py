"""Secret scanning with structural confirmation.

Base kinds come from patterns. The method adds spans of candidates whose decoded structure is
that of a secret: signed tokens (three parts, a JSON header that names an algorithm), private
keys in DER (nested lengths that fill their parents exactly), OpenSSH private keys (nested
length-prefixed fields), and their PEM armour; base64 and hex candidates are decoded, once more
where the decoded text is itself armoured. Nothing that only looks random is reported.

Spans are in code points, the end exclusive. Behaviour: null and empty texts have no spans;
repeated rows and null ids are kept; only the id and text columns are read; texts of any length
are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregram.llm.common import arrow_map

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

# Fixed patterns of the base kinds. Runs of a class are maximal, so a least length in the
# pattern finds the same matches as dropping the short ones.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_EDGE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
# Lines of base64 that follow each other are one candidate; a line break may be written as its escape.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}+(?:(?:\\r|\r)?(?:\\n|\n)[\x20\t]*[A-Za-z0-9+/_-]{4,}+)*+={0,2}")
_LINE_END = re.compile(r"(?:\\r|\r)?(?:\\n|\n)[\x20\t]*|\s+")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}+")
_SSH_MAGIC = b"openssh-key-v1\0"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _b64(s: str) -> bytes | None:
    s = _LINE_END.sub("", s).rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly, else None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None  # not the shortest form
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """Whether the bytes are one private key: RSA, DSA, EC, or wrapped with its algorithm."""
    top = der_children(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_children(data, top[0][1], top[0][2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    number = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags[0] == 0x02 else None
    if tags[:3] == [0x02, 0x30, 0x04] and number in (0, 1):  # wrapped with its algorithm
        alg = der_children(data, parts[1][1], parts[1][2])
        return bool(alg) and alg[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and number == 1:  # elliptic curve
        return all(t in (0xA0, 0xA1) for t in tags[2:]) and parts[1][2] - parts[1][1] >= 16
    if set(tags) == {0x02} and number in (0, 1) and len(tags) in (6, 9, 10):  # DSA and RSA
        return all(e > s for _, s, e in parts) and parts[1][2] - parts[1][1] >= 32
    return tags == [0x30, 0x04] and bool(a := der_children(data, parts[0][1], parts[0][2])) and a[0][0] in (0x06, 0x30)  # encrypted


def is_private_ssh(data: bytes) -> bool:
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)):  # cipher, derivation, its options
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        if not field():
            return False
    return at == len(data)


def is_signed_token(s: str) -> bool:
    parts = s.split(".")
    if len(parts) != 3:
        return False
    try:
        head, body = (json.loads(x) if (x := _b64(p)) else None for p in parts[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _kind(data: bytes | None, depth: int = 0) -> str | None:
    """What secret structure the decoded bytes are, if any."""
    if not data:
        return None
    if data[0] == 0x30 and is_private_der(data):
        return "der"
    if is_private_ssh(data):
        return "ssh"
    if depth == 0 and data.isascii():
        s = data.decode("ascii")
        if is_signed_token(s.strip()):
            return "jwt"
        if any(_is_key_body(s[a:b]) for _, _, a, b in _armoured(s)):
            return "pem"
    return None


def _armoured(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start and end of the body) from each first mark of a kind to the next end of that kind, in one pass."""
    opened: dict[str, re.Match] = {}
    for m in _EDGE.finditer(text):
        if m[1] == "BEGIN":
            opened.setdefault(m[2], m)
        elif m[2] in opened:
            first = opened[m[2]]
            yield first.start(), m.end(), first.end(), m.start()
            opened.clear()  # what was opened inside is inside


def _is_key_body(body: str) -> bool:
    """Armoured base64 of a key; with header lines it may be encrypted, so only its encoding is checked."""
    if ":" not in body:
        return bool(_kind(_b64(body), 1))
    return bool(_b64(_LINE_END.sub("\n", body).rstrip("\n").rpartition("\n\n")[2] or body.rpartition("\n\n")[2]))


def confirmed_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "." in text:
        out += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    inside = []
    if "-----BEGIN" in text:
        for start, end, a, b in _armoured(text):
            if _is_key_body(text[a:b]):
                out.append(("pem", start, end))
                inside.append((start, end))
    for m in _BASE64.finditer(text):
        at = bisect(inside, (m.start(), len(text) + 1))
        if at and m.start() < inside[at - 1][1]:
            continue
        if k := _kind(_b64(m[0])):
            out.append((k, *m.span()))
        elif _LINE_END.search(m[0]):  # each line by itself
            start = m.start()
            for cut in (*_LINE_END.finditer(m[0]), None):
                end = m.start() + cut.start() if cut else m.end()
                if end - start >= 32 and (k := _kind(_b64(text[start:end]))):
                    out.append((k, start, end))
                start = m.start() + cut.end() if cut else end
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (k := _kind(bytes.fromhex(m[0]))):
            out.append((k, *m.span()))
    return out


def join_spans(spans: list[Span], by_kind: bool = False, kinds: tuple[str, ...] = KINDS) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    key = (lambda s: (order[s[0]], s[1], s[2])) if by_kind else (lambda s: (s[1], order[s[0]], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=key))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                t = t.as_py() or ""
                base = base_spans(t)
                n = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + confirmed_spans(t))))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=SCHEMA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow_map, run, SCHEMA)
