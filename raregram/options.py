"""Index options: gram lengths and the set of frequent grams."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

#: Bounds and defaults of gram lengths, and the mark at both ends of a word.
LEAST_Q, MOST_Q = 1, 10
DEFAULT_MIN_Q, DEFAULT_MAX_Q = 2, 5
PAD = "$"


def check_lengths(min_q: int, max_q: int, names: tuple[str, str] = ("minq", "maxq")) -> None:
    for name, value in zip(names, (min_q, max_q), strict=True):
        if not LEAST_Q <= value <= MOST_Q:
            raise ValueError(f'value {value} out of bounds for option "{name}": valid values are between "{LEAST_Q}" and "{MOST_Q}"')
    if min_q > max_q:
        raise ValueError(f'"{names[0]}" must not be greater than "{names[1]}"')


def closure(frequent: Iterable[str], min_q: int) -> tuple[str, ...]:
    """All substrings of at least ``min_q`` characters: with them, being rare is not being a member."""
    out = {g[a:b] for g in frequent for a in range(len(g)) for b in range(a + min_q, len(g) + 1)}
    return tuple(sorted(out, key=str.encode))


@dataclass(frozen=True)
class GramOptions:
    """Gram lengths and the frequent grams, which the index closes under substrings."""

    min_q: int = DEFAULT_MIN_Q
    max_q: int = DEFAULT_MAX_Q
    frequent: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        check_lengths(self.min_q, self.max_q)
        if isinstance(self.frequent, str) or any(not isinstance(g, str) for g in self.frequent):
            raise TypeError("frequent grams must be strings")
        object.__setattr__(self, "frequent", tuple(sorted(set(self.frequent), key=str.encode)))

    @property
    def closed(self) -> tuple[str, ...]:
        return closure(self.frequent, self.min_q)
