"""Column expressions on words and grams; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raregram.options import PAD

#: A word is a run of ASCII letters and digits; it is cut out before it is lower-cased, as some
#: other letters have ASCII lower cases.
WORD = "[A-Za-z0-9]+"


def words(text: Column) -> Column:
    """Padded lower-case words in order; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit(PAD), F.lower(w), F.lit(PAD)))


def grams(word: Column, min_q: int, max_q: int) -> Column:
    """All grams of ``min_q`` to ``max_q`` characters of a padded word; lengths below one count as one."""

    def of(q: int) -> Column:
        q = max(q, 1)
        starts = F.when(F.length(word) >= q, F.sequence(F.lit(1), F.length(word) - (q - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(q)))

    return F.concat(*[of(q) for q in range(min_q, max_q + 1)])


def text_grams(text: Column, min_q: int, max_q: int) -> Column:
    """All grams of all words of a text, repeats included."""
    return F.flatten(F.transform(words(text), lambda w: grams(w, min_q, max_q)))


def row_grams(text: Column, min_q: int, max_q: int) -> Column:
    """The distinct grams of a text; a word that comes again is cut once."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words(text)), lambda w: grams(w, min_q, max_q))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes; null where either is null."""
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).when(a == b, F.lit(0))


def sorted_keys(keys: Column) -> Column:
    """Keys of one row as the index has them: sorted by bytes, each once."""
    return F.array_sort(F.array_distinct(keys))


def all_present(have: Column, wanted: list[str]) -> Column:
    """Whether a row's keys hold all of the wanted ones: false rules the row out, true asks for the recheck."""
    return F.forall(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda k: F.array_contains(have, k))


def gram_text(text: Column, name: str = "text") -> Column:
    """The column marked as searched by grams: metadata only, values stay as they are."""
    return text.cast("string").alias(name, metadata={"gram_text": True})


def send(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def receive(data: Column) -> Column:
    return F.decode(data, "UTF-8")
