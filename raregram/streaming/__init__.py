"""Streams into an index and into statistics."""

from raregram.streaming.ingest import GramIngest, stream_frequencies

__all__ = ["GramIngest", "stream_frequencies"]
