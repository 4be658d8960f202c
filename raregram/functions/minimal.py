"""Rare grams of single words, for patterns on the driver and for frequent sets given by callers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

from raregram.options import PAD

_WORD = re.compile("[A-Za-z0-9]+")


def padded_words(text: str) -> list[str]:
    return [f"{PAD}{w.lower()}{PAD}" for w in _WORD.findall(text)]


def minimal_grams(word: str, min_q: int, max_q: int, closed: frozenset[str] | set[str]) -> list[str]:
    """Grams that are rare and hold no other rare gram, by their ends; ``closed`` has all substrings of its members.

    From each start the shortest rare gram is taken; of those with one end the shortest stays.
    """
    start_of: dict[int, int] = {}
    for p in range(len(word)):
        for q in range(min_q, min(max_q, len(word) - p) + 1):
            if word[p : p + q] not in closed:
                start_of[p + q] = p
                break
    return [word[start_of[e] : e] for e in sorted(start_of)]


class FrequentPrefixes:
    """A frequent set as given: a gram is rare where no member starts with it."""

    def __init__(self, frequent: Iterable[str]):
        self.members = sorted({g.encode() for g in frequent})

    def rare(self, gram: str) -> bool:
        g = gram.encode()
        at = bisect_left(self.members, g)
        return at == len(self.members) or not self.members[at].startswith(g)


def given_grams(word: str, min_q: int, max_q: int, frequent: FrequentPrefixes) -> list[str]:
    """Minimal rare grams for a set that need not be closed.

    Ends never move back from one start to the next: a start looks for its rare gram from the end that
    the start before it reached. A gram is given when the next start's gram ends later.
    """
    out: list[str] = []
    end = 0
    held: tuple[int, int] | None = None
    for p in range(len(word)):
        end = max(end, p + 1)
        while end - p < min_q or not frequent.rare(word[p:end]):
            if end == len(word) or end - p >= max_q:
                break  # no rare gram from this start
            end += 1
        else:
            if held and held[1] < end:
                out.append(word[held[0] : held[1]])
            held = (p, end)
    if held:
        out.append(word[held[0] : held[1]])
    return out
