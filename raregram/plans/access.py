"""Choice between the index and a scan for a LIKE search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from raregram.operators.index import GramIndex
from raregram.operators.selectivity import Frequencies, like_share

#: Share of rows from which a scan is cheaper than reading postings and joining.
SCAN_SHARE = 0.2


@dataclass(frozen=True)
class Access:
    path: str  # "index" or "scan"
    keys: tuple[str, ...]
    share: float
    reason: str

    def __str__(self) -> str:
        return f"{self.path} (keys: {', '.join(self.keys) or 'none'}; estimated share of rows {self.share:.4g}; {self.reason})"


def choose(index: GramIndex, pattern: str | None, stats: Frequencies | None = None, escape: str = "\\") -> Access:
    share = like_share(pattern, stats, escape)
    if pattern is None:
        return Access("scan", (), share, "a null pattern matches nothing")
    keys = tuple(index.keys(pattern, escape))
    if not keys:
        return Access("scan", keys, share, "the pattern has no key")
    if stats is not None and share > SCAN_SHARE:
        return Access("scan", keys, share, "most rows are expected to match")
    return Access("index", keys, share, "keys narrow the rows")


def search(index: GramIndex, df: DataFrame, row_id: str, text: str, pattern: str | None, stats: Frequencies | None = None, escape: str = "\\", fold: bool = False) -> DataFrame:
    """The matching rows by the chosen path; the answer is the same by either."""
    from raregram.operators.index import like

    if choose(index, pattern, stats, escape).path == "index":
        return index.search(df, row_id, text, pattern, escape, fold)
    return df.where(like(df[text], pattern, escape, fold))
