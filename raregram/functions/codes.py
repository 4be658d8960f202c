"""Grams of many texts at once, as numbers: six bits a character, so that all grams of at most ten characters are 64-bit integers.

Texts are taken as bytes: all that is no ASCII letter or digit ends a word, and so do the bytes of other characters.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from raregram.options import MOST_Q, PAD

BITS = 6
_ONE = (1 << BITS) - 1
_CHARS = PAD.encode() + b"0123456789abcdefghijklmnopqrstuvwxyz"
#: The number of each character, from one on; bytes outside of words are the pad.
_NUMBER = {c: i for i, c in enumerate(_CHARS.decode(), 1)}
_OF_BYTE = np.array([_NUMBER.get(chr(b).lower() if b < 128 else PAD, 1) for b in range(256)], np.uint8)
_BYTE_OF = np.frombuffer(b"\0" + _CHARS, np.uint8)
#: About how many bytes of text are taken at once; a longer text is taken by itself.
CHUNK_BYTES = 1 << 17
MOST_ROWS = 4096


def decode(codes: np.ndarray, max_q: int) -> pa.Array:
    """The grams of codes, as an Arrow array of strings."""
    parts = np.empty((len(codes), max_q), np.uint8)
    for j in range(max_q):
        parts[:, max_q - 1 - j] = (codes >> (BITS * j)) & _ONE
    there = parts != 0
    ends = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(there.sum(1), out=ends[1:])
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(_BYTE_OF[parts[there]])])


class Frequent:
    """A set of grams closed under substrings as a tree: a step from a gram by one more character, to 1 where it leaves the set."""

    ROOT, LEFT = 0, 1

    def __init__(self, closed: Iterable[str]):
        self.width = len(_CHARS) + 1
        none = array("i", [self.LEFT] * self.width)
        steps = none + none
        for gram in closed:
            at = self.ROOT
            if all(c in _NUMBER for c in gram):  # no word has others
                for c in gram:
                    step = at * self.width + _NUMBER[c]
                    if steps[step] == self.LEFT:
                        steps[step] = len(steps) // self.width
                        steps.extend(none)
                    at = steps[step]
        self.steps = np.array(steps, np.int32)

    def step(self, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self.steps[at * self.width + number]


class Chunk:
    """Some texts laid out as one array of character numbers, each between two pads."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, max_q: int):
        self.rows = rows = len(ends) - 1
        lead = ends[:-1] - ends[0] + 2 * np.arange(rows)
        n = int(ends[-1] - ends[0]) + 2 * rows
        apart = np.zeros(n + 1, bool)
        apart[lead] = True
        self.row_starts = lead
        apart[ends[1:] - ends[0] + 2 * np.arange(rows) + 1] = True
        self.n = n
        self.number = np.full(n + max_q, 1, np.uint8)
        self.number[:n][~apart[:n]] = _OF_BYTE[data[ends[0] : ends[-1]]]
        self.letter = self.number != 1

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(np.append(self.row_starts, self.n)))[at]

    def windows(self, max_q: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(q, the character that the window of each start ends with, codes, whether the window is a gram of a padded word)."""
        n, letter = self.n, self.letter
        code = np.zeros(n, np.int64)
        whole = letter[:n] | letter[1 : n + 1]
        for q in range(1, max_q + 1):
            last = self.number[q - 1 : q - 1 + n]
            code = code << BITS | last
            if q == 1:
                single = whole.copy()
                single[1:] |= letter[: n - 1]
                yield q, last, code, single
                continue
            if q > 2:
                whole = whole & letter[q - 2 : q - 2 + n]
            yield q, last, code, whole

    def all_grams(self, min_q: int, max_q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, codes) of the distinct grams of each row, one pair of arrays for each length.

        The longest grams of all starts are sorted; the shorter ones are their beginnings, and so in order too.
        """
        whole = max_q * BITS
        longest = np.zeros(self.n, np.int64)
        for q, last, _, good in self.windows(max_q):
            longest |= np.where(good, last, 0).astype(np.int64) << (whole - q * BITS)
        at = np.flatnonzero(longest >> (whole - min_q * BITS) & _ONE)
        keys = _distinct(self.rows_of(at) << whole | longest[at])
        for q in range(min_q, max_q + 1):
            some = keys >> (whole - q * BITS)
            some = some[(some & _ONE) != 0]
            some = some[np.append(True, some[1:] != some[:-1])] if len(some) else some
            yield some >> (q * BITS), some & ((1 << q * BITS) - 1)

    def occurrences(self, min_q: int, max_q: int) -> int:
        """How many grams all words have, repeats included."""
        n, letter = self.n, self.letter
        starts = int(np.count_nonzero(letter[1:n] & ~letter[: n - 1]))
        count = 0
        for q, _, _, good in self.windows(max_q):
            if q >= min_q:
                count += int(np.count_nonzero(letter[:n])) + 2 * starts if q == 1 else int(np.count_nonzero(good))
        return count

    def rare_grams(self, min_q: int, max_q: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
        """(starts, codes) of the minimal rare grams.

        From each start the shortest rare gram is taken. With a closed set their ends never move back, so of those with one
        end the last stays.
        """
        n = self.n
        at = np.zeros(n, np.int32)
        length, found = np.zeros(n, np.int8), np.zeros(n, np.int64)
        for q, last, code, good in self.windows(max_q):
            at = frequent.step(at, last)
            if q >= min_q:
                hit = np.flatnonzero(good & (at == Frequent.LEFT) & (length == 0))
                length[hit], found[hit] = q, code[hit]
        start = np.flatnonzero(length)
        end = start + length[start]
        start = start[np.append(end[1:] != end[:-1], True)] if len(start) else start
        return start, found[start]


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def chunks(texts: pa.Array, max_q: int) -> Iterator[tuple[int, Chunk]]:
    """(first row, its texts) of a string column, part by part; null texts are empty."""
    most = min(MOST_ROWS, 1 << (63 - BITS * max_q))
    texts = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1), a + most, len(texts))
        yield a, Chunk(data, ends[a : b + 1], max_q)
        a = b


def row_grams(chunk: Chunk, starts: np.ndarray, codes: np.ndarray, max_q: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, codes), each pair once, by row."""
    shift = BITS * max_q
    keys = _distinct(chunk.rows_of(starts) << shift | codes)
    return keys >> shift, keys & ((1 << shift) - 1)


class Counter:
    """How many rows of each group hold each gram: partial counts, given out when many are gathered."""

    #: Pairs of row and gram that are gathered.
    MOST = 1 << 22

    def __init__(self, max_q: int):
        self.max_q, self.parts, self.size, self.groups = max_q, [], 0, {}
        self.most_groups = 1 << (63 - BITS * max_q)

    def group(self, values: tuple) -> int:
        """The number of a group; values are told apart by how they are written."""
        return self.groups.setdefault(repr(values), (len(self.groups), values))[0]

    def add(self, groups: np.ndarray | int, codes: np.ndarray) -> None:
        self.parts.append(groups << (BITS * self.max_q) | codes)
        self.size += len(codes)

    def full(self, more: int = 0) -> bool:
        return self.size >= self.MOST or len(self.groups) + more > self.most_groups

    def take(self) -> tuple[list[tuple], np.ndarray, pa.Array, np.ndarray]:
        """(values of all groups, group of each count, gram, count) so far; begins anew."""
        keys = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        shift = BITS * self.max_q
        values, keys = [v for _, v in self.groups.values()], keys[first]
        self.parts, self.size, self.groups = [], 0, {}
        return values, keys >> shift, decode(keys & ((1 << shift) - 1), self.max_q), counts


assert BITS * MOST_Q < 63
