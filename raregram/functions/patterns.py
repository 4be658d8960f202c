"""LIKE patterns: tokens, a form that Spark's LIKE takes, and the grams that every match holds."""

from __future__ import annotations

from dataclasses import dataclass

from raregram.functions.minimal import minimal_grams
from raregram.options import PAD, GramOptions

LITERAL, ANY_ONE, ANY_RUN = "literal", "any one", "any run"


@dataclass(frozen=True)
class Token:
    kind: str
    char: str = ""


def tokens(pattern: str, escape: str = "\\") -> list[Token]:
    """The pattern's parts; ``escape`` makes the next character literal, an empty one is never met."""
    if len(escape) > 1:
        raise ValueError("invalid escape string")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            if i + 1 == len(pattern):
                raise ValueError("LIKE pattern must not end with escape character")
            i += 1
            out.append(Token(LITERAL, pattern[i]))
        elif c == "%":
            out.append(Token(ANY_RUN))
        elif c == "_":
            out.append(Token(ANY_ONE))
        else:
            out.append(Token(LITERAL, c))
        i += 1
    return out


def normalise(pattern: str, escape: str = "\\") -> str:
    """The same pattern with backslashes before wildcards and backslashes alone."""
    text = {ANY_ONE: "_", ANY_RUN: "%"}
    return "".join("\\" * (t.char in "%_\\") + t.char if t.kind == LITERAL else text[t.kind] for t in tokens(pattern, escape))


def _quoted(parts: list[Token]) -> str:
    return "".join("." if t.kind == ANY_ONE else "\\" * (t.char.isascii() and not t.char.isalnum()) + t.char for t in parts)


def _pieces(pattern: str, escape: str) -> list[list[Token]]:
    """What stands before, between and after the runs of any length."""
    out: list[list[Token]] = [[]]
    for t in tokens(pattern, escape):
        if t.kind == ANY_RUN:
            out.append([])
        else:
            out[-1].append(t)
    return out


def held(pattern: str, escape: str = "\\") -> str | None:
    """The text that a match holds anywhere, of a pattern that asks for nothing else."""
    parts = _pieces(pattern, escape)
    inner = [p for p in parts[1:-1] if p]
    if len(parts) < 3 or parts[0] or parts[-1] or len(inner) != 1 or any(t.kind != LITERAL for t in inner[0]):
        return None
    return "".join(t.char for t in inner[0])


def regex(pattern: str, escape: str = "\\") -> str:
    """The pattern as a regular expression to be found in a text, in time that goes by the text's length.

    Each piece between two runs is taken where it comes first and never looked for again, as no later place leaves more for the rest.
    """
    first, *rest = _pieces(pattern, escape)
    if not rest:
        return rf"(?s)\A{_quoted(first)}\z"
    end = rf".*{_quoted(rest[-1])}\z" if rest[-1] else ""
    return rf"(?s)\A{_quoted(first)}" + "".join(f"(?>.*?{_quoted(p)})" for p in rest[:-1] if p) + end


def backtracks(pattern: str, escape: str = "\\") -> bool:
    """Whether plain LIKE may try a later piece anew from each place of an earlier one."""
    return sum(bool(p) for p in _pieces(pattern, escape)[1:]) > 1


def _in_word(t: Token) -> bool:
    return t.kind == LITERAL and t.char.isascii() and t.char.isalnum()


def _folds_into_word(t: Token) -> bool:
    """Whether the literal is no word character itself but its lower case holds one, as of U+0130 and U+212A."""
    return t.kind == LITERAL and not t.char.isascii() and any(c.isascii() and c.isalnum() for c in t.char.lower())


def fragments(pattern: str, escape: str = "\\", fold: bool = False) -> list[str]:
    """Lower-case stretches of word characters that every match holds, with ``fold`` every match in any case.

    A side is padded where the word surely ends there: at the pattern's end or at a literal that is no word
    character. A wildcard may stand for more of the word, and with ``fold`` so may a literal that folds into a word.
    """
    parts = tokens(pattern, escape)
    if fold:
        parts = [Token(ANY_RUN) if _folds_into_word(t) else t for t in parts]
    out, i = [], 0
    while i < len(parts):
        if not _in_word(parts[i]):
            i += 1
            continue
        j = i
        while j < len(parts) and _in_word(parts[j]):
            j += 1
        left = PAD if i == 0 or parts[i - 1].kind == LITERAL else ""
        right = PAD if j == len(parts) or parts[j].kind == LITERAL else ""
        out.append(left + "".join(t.char.lower() for t in parts[i:j]) + right)
        i = j
    return out


def keys(pattern: str, options: GramOptions, escape: str = "\\", closed: frozenset[str] | None = None, fold: bool = False) -> list[str]:
    """The index keys that every match of the pattern has, sorted by bytes; none means that all rows are candidates."""
    closed = frozenset(options.closed) if closed is None else closed
    found = {g for f in fragments(pattern, escape, fold) for g in minimal_grams(f, options.min_q, options.max_q, closed)}
    return sorted(found, key=str.encode)
