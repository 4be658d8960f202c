"""A fast, exact encoder for the word-end BPE vocabulary.

The pre-tokenizer never joins characters across white space, and each pre-token ends with a
symbol that carries the word-end mark. Texts of the common alphabet are rewritten in numpy so
that one character stands for one (byte, is-last) symbol; a rank-based BPE engine then encodes a
whole batch in one call. All other texts go through the vocabulary's own library.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import public_tokenizers
import tiktoken

#: Characters for which lower-casing, composition and classes are plain: ASCII and Latin letters.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ž]*")
_SPACE, _DOC = 0x20, 0x0A


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet: printable bytes are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encoder for one vocabulary file; ``ids`` gives each text's ids as uint32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.special = [t["content"] for t in j["added_tokens"]]
        vocab, end = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        char_of = _byte_chars()
        # one code point for each symbol; the commonest take one byte
        self.mid, self.last = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
        for b in range(256):
            self.mid[b] = b if 0x61 <= b <= 0x7A else 0x100 + b
            self.last[b] = b - 32 if 0x61 <= b <= 0x7A else b if 0x30 <= b <= 0x39 else 0x300 + b
        marks = {ord("\x01"): 0}

        def symbols(token: str) -> str:
            tail = token.endswith(end)
            bs = [char_of[c] for c in (token[: -len(end)] if tail else token)]
            return "".join(chr(self.mid[b]) for b in bs[:-1]) + chr((self.last if tail else self.mid)[bs[-1]])

        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        target = np.full(256, -1, np.int64)
        ids = [target]
        n = 256
        base = [s for s in vocab if len(s.removesuffix(end)) == 1 and s not in self.special]
        made = [(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"])]
        more = []
        for token in [*sorted(base, key=vocab.get), *made]:
            key = symbols(token).encode()
            if len(key) == 1:
                target[key[0]] = vocab[token]
            elif key not in ranks:
                ranks[key] = n
                more.append(vocab[token])
                n += 1
        self.ids_of = np.concatenate([*ids, np.array(more, np.int64)])
        del marks
        low, high = "".join(map(chr, self.last[0x61:0x7B])), "0-9̀-Ͽ"
        ends = f"{low}{high}"
        self.engine = tiktoken.Encoding("word-ends", pat_str=f"[^{ends}\\x20\\n]*[{ends}]|[\\x20\\n]", mergeable_ranks=ranks, special_tokens={})
        kind = np.full(256, 3, np.uint8)  # punctuation
        kind[[9, 10, 13, 32]] = 0
        kind[0x61:0x7B] = kind[0x80:] = 1
        kind[0x30:0x3A] = 2
        self.kind = kind

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            if t:
                low = t.lower()
                if _PLAIN.fullmatch(low) and not any(s in t for s in self.special):
                    plain.append((i, low.replace("\n", " ")))
                else:
                    other.append(i)
        if plain:
            for (i, _), x in zip(plain, self._plain("\n".join(x for _, x in plain)), strict=True):
                out[i] = x
        for i in other:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _plain(self, text: str) -> list[np.ndarray]:
        b = np.frombuffer(text.encode(), np.uint8)
        kind = self.kind[b]
        after = np.concatenate([kind[1:], [0]])
        last = (kind == 2) | (kind != after)
        self._contractions(b, kind, last)
        points = np.where(last, self.last[b], self.mid[b])
        points[kind == 0] = _SPACE
        points[b == _DOC] = _DOC
        marked = points.astype("<u4").tobytes().decode("utf-32-le")
        ranks = np.frombuffer(self.engine._core_bpe.encode_to_tiktoken_buffer(marked, set()), np.uint32)
        cut = np.flatnonzero(ranks == _DOC)
        keep = (ranks != _SPACE) & (ranks != _DOC)
        ends = np.concatenate([[0], np.cumsum(keep)])
        ids = self.ids_of[ranks[keep]].astype(np.uint32)
        bounds = np.concatenate([[0], ends[cut], [len(ids)]])
        return [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def _contractions(self, b: np.ndarray, kind: np.ndarray, last: np.ndarray) -> None:
        """An apostrophe that opens a pre-token takes one of these endings with it: s t m d re ve ll."""
        a = np.flatnonzero(b == 0x27)
        if not len(a):
            return
        pad = np.concatenate([b, [32, 32]])
        a = a[(a == 0) | (kind[np.maximum(a - 1, 0)] != 3)]
        one = a[np.isin(pad[a + 1], np.frombuffer(b"stmd", np.uint8))]
        two = a[np.isin(pad[a + 1].astype(np.uint16) << 8 | pad[a + 2], [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")])]
        last[one], last[one + 1] = False, True
        last[two], last[two + 1], last[two + 2] = False, False, True


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> WordBpe:
    return WordBpe(path or public_tokenizers.path("word_bpe_49k.json"))
